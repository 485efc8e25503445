"""Range, likeness and nearest-neighbour joins by blocking keys that make them equi-joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import band_degrees, haversine_km
from ..functions.times import seconds_between


def with_side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))


#: Parts that the right side of a join with many pairs for a key is dealt into.
DEALT = 16


def dealt_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left.join(right, on) for keys that make many pairs.

    The right side's rows of a key are dealt into DEALT parts and the left side's meet each of them, so a key is many
    tasks', and what a task holds of it is a part. Partitions are as many as the session asks for: by their size alone
    small inputs would be taken together, however many pairs they make.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    on = [*on, "dealt"]
    a = left.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    b = right.withColumn("dealt", F.pmod(F.xxhash64(*right.columns), F.lit(DEALT)).cast("int"))
    return a.repartition(n, *on).join(b.repartition(n, *on), on).drop("dealt")


def blocked(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """rows, written once, with a `block` each: n ranges of them in the order of these columns."""
    checkpoint_dir(rows.sparkSession)
    # Both sides of a blocked_join() lie by block, which is not all of its keys; by default Spark would deal them anew by all.
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    placed = rows.repartitionByRange(n, *order).withColumn("block", F.spark_partition_id()).checkpoint()
    return placed.withColumn("block", F.col("block").alias("block", metadata={"blocks": n}))


def blocked_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left.join(right, on) with all pairs of a left row's `block` in one task, so that what is counted by left rows needs no shuffle of pairs.

    The right side's rows go to each block that has their keys. The column's metadata tell how many blocks there are;
    blocked() makes it, and sees to it that such joins are planned by block alone.
    """
    n = left.schema["block"].metadata["blocks"]
    asked = left.select(*on, "block").distinct()
    return left.repartition(n, "block").join(right.join(asked, on).repartition(n, "block"), [*on, "block"])


def time_range_join(left: DataFrame, right: DataFrame, at_left: str, at_right: str, hours: float, keys: list[tuple[str, str]] | None = None, km: float | None = None, place: tuple = ("a_lon", "a_lat", "b_lon", "b_lat")) -> DataFrame:
    """Pairs whose moments lie within hours, of equal keys, and within km where given.

    Moments fall in slots of that length; the right side goes to its own and both neighbouring slots, so the pairs
    meet in an equi-join on slot and keys, and with km also on bands of latitude as high as the distance. Rows of
    equal keys make pairs with a good part of each other, so these are dealt. A left side with a `block` keeps its blocks whole.
    """
    slot = max(int(hours * 3.6e9), 1)
    number = lambda c: F.floor(F.unix_micros(c) / slot).cast("long")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = left.withColumn("slot", number(F.col(at_left)))
    b = right.withColumn("slot", F.explode(F.transform(near, lambda d: number(F.col(at_right)) + d)))
    on = ["slot"]
    if km is not None:
        high = band_degrees(km)
        a = a.withColumn("band", F.floor(F.col(place[1]) / high).cast("long"))
        b = b.withColumn("band", F.explode(F.transform(near, lambda d: F.floor(F.col(place[3]) / high).cast("long") + d)))
        on.append("band")
    for k, (x, y) in enumerate(keys or []):
        a, b = a.withColumn(f"key{k}", F.col(x)), b.withColumn(f"key{k}", F.col(y))
        on.append(f"key{k}")
    met = blocked_join(a, b, on) if "block" in a.columns else dealt_join(a, b, on) if keys else a.join(b, on)
    pairs = met.where(F.abs(seconds_between(F.col(at_left), F.col(at_right))) <= hours * 3600)
    if km is not None:
        pairs = pairs.where(haversine_km(*map(F.col, place)) <= km)
    return pairs.drop(*on)


def likeness_join(left: DataFrame, right: DataFrame, a_id: str, a_tokens: str, b_id: str, b_tokens: str, least: float) -> DataFrame:
    """(a_id, b_id, likeness) of pairs whose token sets are at least that alike, by prefix filtering; nothing is lost.

    Tokens are ordered from the rarest. Two sets as alike as asked share a token among their first n - ceil(least n) + 1
    ones, so only those are joined on, and pairs are verified on the whole sets.
    """
    a = left.select(F.col(a_id), F.array_distinct(F.col(a_tokens)).alias("a_set"))
    b = right.select(F.col(b_id), F.array_distinct(F.col(b_tokens)).alias("b_set"))
    counts = a.select(F.explode("a_set").alias("token")).union(b.select(F.explode("b_set"))).groupBy("token").agg(F.count("*").alias("n"))

    def prefixes(df: DataFrame, key: str, tokens: str) -> DataFrame:
        rare = df.select(key, F.explode(tokens).alias("token")).join(counts, "token").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
        keep = F.size("t") - F.ceil(F.size("t") * least).cast("int") + 1
        return rare.select(key, F.explode(F.slice("t", F.lit(1), keep)).alias("t")).select(key, F.col("t.token").alias("token"))

    met = prefixes(a, a_id, "a_set").join(prefixes(b, b_id, "b_set"), "token").select(a_id, b_id).distinct()
    both = met.join(a, a_id).join(b, b_id)
    same = F.size(F.array_intersect("a_set", "b_set"))
    return both.withColumn("likeness", same / (F.size("a_set") + F.size("b_set") - same)).where(F.col("likeness") >= least).select(a_id, b_id, "likeness")


def nearest(points: DataFrame, stations: DataFrame, point_id: str, station_id: str, most_km: float = math.inf) -> DataFrame:
    """(point_id, station_id, km) of each point's nearest station, ties by id. points and stations hold lon and lat; rows without them are left out.

    A cell that holds points gathers the stations of its own and the cells around it, and a point looks through those of
    its cell; what lies farther than a cell's size isn't sure, so points left over go on with cells three times as large.
    First cells are as large as one or two stations need on average, so they gather about ten stations however many there
    are. Points are never repeated, and are dealt to as many tasks as the session asks for.
    """
    spark = points.sparkSession
    s = stations.select(station_id, F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat")).where("s_lon is not null and s_lat is not null")
    s = s.groupBy("s_lon", "s_lat").agg(F.min(station_id).alias(station_id))  # of those at one place only the first can be asked for
    checkpoint_dir(spark)
    s = s.checkpoint()
    # Cells of 360 / around degrees, a whole number of them around the globe.
    around = int(max(12, min(3600, math.sqrt(2 * s.count()))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = points.select(point_id, "lon", "lat").where("lon is not null and lat is not null").repartition(tasks, point_id)
    found = None
    while True:
        size = 360.0 / around
        row, column = (lambda c: F.floor((c + 90) / size).cast("int")), (lambda c: F.pmod(F.floor((c + 180) / size), F.lit(around)).cast("int"))
        here = left.withColumn("y", row(F.col("lat"))).withColumn("x", column(F.col("lon")))
        # Within a cell's size lie one row each way, and of longitude more cells towards the poles.
        edge = F.greatest(F.abs(F.col("y") * size - 90), F.abs((F.col("y") + 1) * size - 90)) + size
        wide = F.least(F.when(edge >= 85, F.lit(around)).otherwise(F.ceil(1 / F.cos(F.radians(edge)))).cast("int"), F.lit(around // 2 + 1))
        beside = F.explode(F.array_distinct(F.transform(F.sequence(-wide, wide), lambda d: F.pmod(F.col("x") + d, F.lit(around)))))
        seen = here.select("y", "x").distinct().withColumn("s_y", F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1))).withColumn("s_x", beside)
        cells = s.withColumn("s_y", row(F.col("s_lat"))).withColumn("s_x", column(F.col("s_lon")))
        near = seen.join(cells, ["s_y", "s_x"]).groupBy("y", "x").agg(F.collect_list(F.struct("s_lon", "s_lat", station_id)).alias("near"))
        one = F.array_min(F.transform("near", lambda t: F.struct(F.round(haversine_km(F.col("lon"), F.col("lat"), t["s_lon"], t["s_lat"]), 6).alias("km"), t[station_id].alias(station_id))))
        whole = around == 1
        told = here.join(near, ["y", "x"], "left").select(point_id, "lon", "lat", one.alias("best")).checkpoint()
        sure = F.col("best").isNotNull() if whole else F.coalesce(F.col("best.km") <= 111.19 * size, F.lit(False))
        got = told.where(sure).select(point_id, "best")
        found = got if found is None else found.union(got)
        left = told.where(~sure).select(point_id, "lon", "lat")
        if whole or left.isEmpty():
            break
        around = max(1, around // 3)
    found = found.groupBy(point_id).agg(F.min("best").alias("best"))  # a repeated id is one point of all its places
    return found.select(point_id, F.col(f"best.{station_id}"), F.col("best.km").alias("km")).where(F.col("km") <= most_km)


def checkpoint_dir(spark: SparkSession) -> None:
    """Rounds are checkpointed to spark.checkpoint.dir. Where it is unset, to a folder of our own, in local mode only."""
    if spark.sparkContext.getCheckpointDir() is None:
        import re
        import tempfile

        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vigilframe-"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable over links. Labels fall to the least neighbour's and jump along; each round is checkpointed."""
    checkpoint_dir(links.sparkSession)
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(b, a)).distinct().checkpoint()
    label = both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("label")).checkpoint()
    while True:
        near = both.join(label.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = label.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = step.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), (F.least("low", F.coalesce("far", "low")) != F.col("label")).alias("moved")).checkpoint()
        label = new.select("node", "label")
        if new.where("moved").isEmpty():
            return label.withColumnRenamed("label", "component")
