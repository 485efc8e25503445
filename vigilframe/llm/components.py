"""Connected components of large link tables, and dealing out hot groups as pairs of bounded blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


class UnionFind:
    """Of one task's links; roots are the smallest members."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def forest(self) -> list[tuple]:
        """(member, root) of each member that isn't its own root: as many links as members, not as pairs."""
        return [(x, self.root(x)) for x in list(self.up) if self.root(x) != x]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of links(a, b); component is the smallest node reachable.

    Each round merges every node into the first of its neighbourhood: by number in the first round, which folds stars
    around their smallest member, then by a hash that changes with the round, which at least halves long chains on
    average. Rounds are written to the shared folder, so a lost executor costs one round at most.
    """
    edges = materialize(links.where("a <> b").select("a", "b").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        rank = (lambda c: c) if not steps else (lambda c, k=len(steps): F.xxhash64(c, F.lit(k)))
        best = both.groupBy("node").agg(F.min_by("other", rank(F.col("other"))).alias("other"))
        into = F.when(rank(F.col("other")) < rank(F.col("node")), F.col("other")).otherwise(F.col("node"))
        step = materialize(best.select("node", into.alias("into")))
        steps.append(step)
        moved = edges
        for end in ("a", "b"):
            moved = moved.join(step.select(F.col("node").alias(end), F.col("into").alias(f"new_{end}")), end)
        before, edges = edges, materialize(moved.where("new_a <> new_b").select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct())
        release(before)
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    where = steps[0]
    for step in steps[1:]:
        where = where.join(step.select(F.col("node").alias("into"), F.col("into").alias("next")), "into", "left").select("node", F.coalesce("next", "into").alias("into"))
    where = materialize(where)
    first = where.groupBy("into").agg(F.min("node").alias("component"))
    return where.join(first, "into").select("node", "component")


def block_pairs(rows: DataFrame, keys: list[str], spread: Column, block_rows: int) -> DataFrame:
    """Deals rows out to cells (keys, i, j), i <= j, that together hold every pair of rows of equal keys.

    A group of up to block_rows is one cell; a larger one is split into blocks by a hash, and each pair of blocks is a
    cell of at most about twice block_rows. Columns i, j and block come first; a cell i < j needs the pairs across its
    two blocks only. Rows whose group holds nothing else are left out.
    """
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), F.count("*").alias("group_rows"))
    known = rows.join(sizes.where("group_rows > 1").drop("group_rows"), keys)
    dealt = known.withColumn("block", F.pmod(spread, F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = dealt.select("*", other)
    return pairs.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *rows.columns)


def cell_buckets(cells: DataFrame, keys: list[str], n_rows: int, bucket_rows: int = 16_384) -> DataFrame:
    """Adds column bucket: many small cells share a bucket of about bucket_rows of the cells' n_rows, a bucket never parts a cell."""
    least = 4 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-n_rows // bucket_rows))
    return cells.withColumn("bucket", F.pmod(F.xxhash64(*keys, "i", "j"), F.lit(n)).cast("int"))
