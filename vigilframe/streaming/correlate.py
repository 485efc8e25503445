"""Correlation of a stream: incidents and their revisions, kept up batch by batch in a folder that outlives the process.

What batches have written lies under their numbers and counts once their commit is there, so a new process goes on where
the last one stopped, and a batch that was cut short is done again. An observation keeps the incident that it got when
it arrived first, so a batch only looks at new observations, and at the evidence in the cells that these can match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text
from ..model import MEDIA_KINDS, RULES
from ..operators.commits import Commits
from ..operators.joins import checkpoint_dir
from ..operators.lifecycle import founder_names, greedy_founders
from ..operators.scoring import incident_scores, incident_status

C = F.col
#: Parts that state is kept in, by hash; a batch reads those it touches.
PARTS = 64
#: What evidence is matched by, and what a version is scored by.
EVIDENCE = ["event_id", "observation_id", "event_at", "lon", "lat", "kind", "headline", "storm_name", "relation_candidate"]
VERSION = ["event_id", "observation_id", "content_hash", "provider_id", "kind", "severity", "urgency", "status", "event_at", "source_updated_at", "ingested_at", "expires_at"]
_ORDER = ["ingested_at", "event_id"]


def cells(around: int) -> Column:
    """Cells of an observation by its kind's rule; with around = 1 those beside it in time too. Observations that can match share a cell of one's own and one around the other."""

    def timed(hours: float, *key: Column) -> Column:
        slot = F.floor(F.unix_micros("event_at") / int(hours * 3.6e9))
        return F.transform(F.array(*map(F.lit, range(-around, around + 1))), lambda d: F.concat_ws("|", "kind", *key, (slot + d).cast("string")))

    tokens = F.array_sort(F.array_distinct(text.title_tokens(C("headline"))), lambda a, b: F.when(F.xxhash64(a) < F.xxhash64(b), -1).when(F.xxhash64(a) > F.xxhash64(b), 1).otherwise(0))
    # Two sets that are alike share one of so many of their tokens, in any one order.
    first = F.slice(tokens, F.lit(1), F.size(tokens) - F.ceil(F.size(tokens) * RULES["media"][1]).cast("int") + 1)
    named = C("kind").isin("wildfire", "volcano", "natural_event", "disaster")
    return F.filter(
        F.when(C("kind") == "earthquake", timed(RULES["earthquake"][0]))
        .when(C("kind") == "tropical_cyclone", timed(RULES["tropical_cyclone"][0], text.normalized_title(C("storm_name"))))
        .when((C("kind") == "tsunami") & (C("relation_candidate") != ""), F.array(F.concat_ws("|", "kind", "relation_candidate")))
        .when(named, timed(RULES["named_hazard"][0], text.normalized_title(C("headline"))))
        .when(C("kind").isin(*MEDIA_KINDS), F.flatten(F.transform(first, lambda t: timed(RULES["media"][0], t))))
        .otherwise(F.array().cast("array<string>")),
        lambda c: c.isNotNull(),
    )


def part_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")


class StreamCorrelator:
    """foreachBatch(correlator.step) over observations.

    links_of(rows) gives the links (a, b) among their event ids, or links and groups (event_id, group) as
    greedy_founders() takes them; rows have EVIDENCE, `at`, `own` and `fresh`.
    """

    def __init__(self, spark: SparkSession, base: str, links_of: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]]):
        checkpoint_dir(spark)
        self.spark, self.base, self.links_of, self.commits = spark, base, links_of, Commits(spark, base)
        self.before: int | None = None

    def _put(self, rows: DataFrame, kind: str, number: int, key: str) -> DataFrame:
        path = f"{self.base}/{kind}/batch={number}"
        rows = rows.withColumn("part", part_of(key))
        rows.write.mode("overwrite").partitionBy("part").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _kept(self, kind: str, like: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """What committed batches, those before the one in hand, wrote of a kind: all, or the rows of these keys. like has the columns but `part`."""
        numbers = [n for n in self.commits.numbers() if self.before is None or n < self.before]
        if not numbers:
            return like.limit(0)
        schema = StructType([*like.schema.fields, StructField("part", IntegerType())]) if "part" not in like.columns else like.schema
        rows = self.spark.read.schema(schema).option("basePath", f"{self.base}/{kind}").parquet(*(f"{self.base}/{kind}/batch={n}" for n in numbers))
        if keys is not None:
            parts = [r.part for r in keys.select(part_of(keys.columns[0])).distinct().collect()]  # PARTS at most
            rows = rows.where(C("part").isin(parts)).join(keys, keys.columns, "left_semi")
        return rows.drop("part", "batch")

    def step(self, batch: DataFrame, number: int) -> None:
        """Takes a batch in. A number that is committed already changes nothing."""
        self.before = number
        if number in self.commits.numbers():
            return
        batch = batch.checkpoint()
        assigned = self._assign(batch, number)
        self._revise(batch.join(assigned.select("observation_id", C("incident").alias("incident_id")), "observation_id"), number)
        self.commits.write(number)
        self.before = None

    def _assign(self, batch: DataFrame, number: int) -> DataFrame:
        """(observation_id, event_id, incident) of the batch's observations. Those not known yet join what they match, in order of arrival."""
        ids = batch.select("observation_id").distinct()
        columns = self.spark.createDataFrame([], "observation_id string, event_id long, incident string")
        known = self._kept("known", columns, ids).checkpoint()
        first = W.partitionBy("observation_id").orderBy(*_ORDER)
        fresh = batch.join(known, "observation_id", "left_anti").withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn").checkpoint()
        evidence = fresh.select(*EVIDENCE)
        like = evidence.select("*", F.lit("").alias("incident"), F.lit("").alias("cell"))
        asked = fresh.select(F.explode(cells(1)).alias("cell")).distinct()
        old = self._kept("evidence", like, asked).drop("cell").distinct().checkpoint()
        key = lambda t: F.struct(t.alias("ingested_at"), "observation_id", "event_id").alias("at")
        long_ago = F.lit("0001-01-01").cast("timestamp")
        arrived = fresh.select(*EVIDENCE, key(C("ingested_at")), founder_names().alias("own"), F.lit(True).alias("fresh"))
        arrived = arrived.unionByName(old.select(*EVIDENCE, key(long_ago), C("incident").alias("own"), F.lit(False).alias("fresh"))).checkpoint()
        links = self.links_of(arrived)
        found = greedy_founders(arrived.select("event_id", "at", "own", "fresh"), *(links if isinstance(links, tuple) else (links,)))
        new = self._put(fresh.join(found, "event_id").select("observation_id", "event_id", "incident"), "known", number, "observation_id").drop("part")
        placed = evidence.withColumn("cell", F.explode(cells(0))).join(new.select("event_id", "incident"), "event_id").select(*like.columns)
        self._put(placed, "evidence", number, "cell")
        return known.unionByName(new)

    def _revise(self, rows: DataFrame, number: int) -> None:
        """One revision for each incident that the batch changed: versions equal to the one before don't count."""
        rows = rows.select("incident_id", *VERSION)
        touched = rows.select("incident_id").distinct()
        old = self._kept("versions", rows, touched).checkpoint()
        was = F.lag("content_hash").over(W.partitionBy("observation_id").orderBy("new", *_ORDER))
        every = old.withColumn("new", F.lit(0)).unionByName(rows.withColumn("new", F.lit(1)))
        changed = every.withColumn("was", was).where("new = 1 AND NOT (content_hash <=> was)").select(*rows.columns)
        new = self._put(changed, "versions", number, "incident_id").drop("part")
        moment = new.groupBy("incident_id").agg(F.max("ingested_at").alias("moment"))
        last = W.partitionBy("observation_id").orderBy(F.desc("new"), F.desc("ingested_at"), F.desc("event_id"))
        members = old.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1))).withColumn("rn", F.row_number().over(last)).where("rn = 1").join(moment, "incident_id")
        score = incident_scores(members, C("moment"), by=["incident_id", "moment"], more=(incident_status().alias("status"), F.count("*").alias("n_members")))
        told = score.select("incident_id", "moment", "priority_score", "status", "n_members")
        like = told.select("*", F.lit("").alias("change_type"), F.lit(1).alias("revision"))
        before = self._kept("revisions", like, touched).groupBy("incident_id").agg(F.max_by(F.struct("revision", "priority_score"), "revision").alias("b"))
        points, now = C("b.priority_score"), C("priority_score")
        kind = F.when(C("b").isNull(), "new").when(C("status") == "cancelled", "cancelled").when(C("status") == "ended", "resolved").when(now >= points + 10, "escalated").when(now <= points - 10, "downgraded").otherwise("updated")
        revised = told.join(before, "incident_id", "left").select(*told.columns, kind.alias("change_type"), (F.coalesce("b.revision", F.lit(0)) + 1).alias("revision"))
        self._put(revised, "revisions", number, "incident_id")

    def incidents(self) -> DataFrame:
        """(observation_id, event_id, incident) of every observation, with the event that it arrived by."""
        return self._kept("known", self.spark.createDataFrame([], "observation_id string, event_id long, incident string"))

    def revisions(self) -> DataFrame:
        """(incident_id, revision, moment, priority_score, status, n_members, change_type) of all batches."""
        return self._kept("revisions", self.spark.createDataFrame([], "incident_id string, moment timestamp, priority_score int, status string, n_members long, change_type string, revision int"))
