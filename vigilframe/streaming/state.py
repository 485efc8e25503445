"""Keyed state of foreachBatch streams: a table in parts, of which a batch rewrites those it touches, and windows in slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.commits import Commits

C = F.col
#: Parts that a state is kept in, by hash of the key.
PARTS = 64


class KeyedState:
    """One row for each key. The commit of a batch names, for each part, the batch that wrote it last, so a restart finds the state as it was."""

    def __init__(self, spark: SparkSession, base: str, key: str, schema: str):
        self.spark, self.base, self.key, self.schema, self.commits = spark, base, key, schema, Commits(spark, base)

    def _parts(self, before: int) -> dict[str, int]:
        done = [n for n in self.commits.numbers() if n < before]
        return self.commits.read(done[-1])["parts"] if done else {}

    def done(self, number: int) -> bool:
        return number in self.commits.numbers()

    def rows(self, number: int, parts: list[int] | None = None) -> DataFrame:
        """The state before batch `number`, in some parts or in all."""
        known = self._parts(number)
        paths = [f"{self.base}/state/batch={n}/part={p}" for p, n in known.items() if parts is None or int(p) in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, batch: DataFrame) -> list[int]:
        return [r.part for r in batch.select(self._part().alias("part")).distinct().collect()]  # PARTS at most

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(C(self.key)), F.lit(PARTS)).cast("int")

    def put(self, number: int, new: DataFrame, parts: list[int], keep: Column | None = None) -> None:
        """Commits the batch: rows of new take the place of those with their keys; of the parts rewritten, old rows that don't satisfy `keep` go."""
        stay = self.rows(number, parts).join(new.select(self.key), self.key, "left_anti")
        every = stay.unionByName(new) if keep is None else stay.where(keep).unionByName(new)
        every.withColumn("part", self._part()).write.mode("overwrite").partitionBy("part").parquet(f"{self.base}/state/batch={number}")
        wrote = {str(r.part) for r in self.spark.read.parquet(f"{self.base}/state/batch={number}").select("part").distinct().collect()} if not every.isEmpty() else set()
        kept = {p: n for p, n in self._parts(number).items() if int(p) not in parts}
        self.commits.write(number, {"parts": kept | dict.fromkeys(wrote, number)})


def sliced(order: str, rows: int) -> Column:
    """Slices of so many numbers of a column that orders rows."""
    return F.floor(C(order) / rows)


def failure_streaks(polls: DataFrame, slice_rows: int = 4096, start: DataFrame | None = None) -> DataFrame:
    """polls(event_id, provider, failed) with streak, failures in a row up to the row, and before, those up to the row before it.

    Streaks are counted in slices of event ids; a slice says how many failures end it and whether all of it failed, and
    such sums pass from slice to slice, so no task holds a provider's log. start(provider, streak): what came before.
    """
    p = polls.withColumn("slice", sliced("event_id", slice_rows))
    inside = W.partitionBy("provider", "slice").orderBy("event_id")
    p = p.withColumn("isle", F.sum(F.when(C("failed"), 0).otherwise(1)).over(inside))
    run = F.sum(C("failed").cast("int")).over(W.partitionBy("provider", "slice", "isle").orderBy("event_id"))
    p = p.withColumn("local", F.when(C("failed"), run).otherwise(0))
    ends = p.groupBy("provider", "slice").agg(F.max_by("local", "event_id").alias("trailing"), (F.max("isle") > 0).alias("broken"))
    if start is not None:  # as a slice before all others, which a streak begins in
        ends = ends.unionByName(start.select("provider", F.lit(-(1 << 62)).alias("slice"), C("streak").alias("trailing"), F.lit(True).alias("broken")))
    along = W.partitionBy("provider").orderBy("slice")
    isles = ends.withColumn("g", F.sum(C("broken").cast("int")).over(along))
    summed = isles.withColumn("upto", F.sum("trailing").over(W.partitionBy("provider", "g").orderBy("slice")))
    carried = summed.withColumn("carry", F.coalesce(F.lag("upto").over(along), F.lit(0))).select("provider", "slice", "carry")
    whole = p.join(carried, ["provider", "slice"])
    whole = whole.withColumn("streak", C("local") + F.when(C("failed") & (C("isle") == 0), C("carry")).otherwise(0))
    before = F.coalesce(F.lag("streak").over(inside), C("carry"))
    return whole.select("event_id", "provider", "failed", C("streak").cast("int").alias("streak"), before.cast("int").alias("before"))


def changed_rows(rows: DataFrame, key: str, digest: str, order: str, slice_rows: int = 4096, start: DataFrame | None = None) -> DataFrame:
    """Rows whose digest differs from the one before under their key; start(key, digest): the last ones known. In slices, as failure_streaks()."""
    r = rows.withColumn("slice", sliced(order, slice_rows))
    inside = W.partitionBy(key, "slice").orderBy(order)
    box = F.struct(C(digest).alias("d"))  # a null digest is one, too
    last = r.groupBy(key, "slice").agg(F.max_by(box, order).alias("last"))
    if start is not None:
        last = last.unionByName(start.select(key, F.lit(-(1 << 62)).alias("slice"), box.alias("last")))
    carried = last.withColumn("carry", F.lag("last").over(W.partitionBy(key).orderBy("slice"))).select(C(key).alias("of"), C("slice").alias("in"), "carry")
    met = r.join(carried, C(key).eqNullSafe(C("of")) & (C("slice") == C("in")), "left")
    was = F.coalesce(F.lag(box).over(inside), C("carry"))
    return met.withColumn("was", was).where("was IS NULL OR NOT (was.d <=> " + digest + ")").select(*rows.columns)
