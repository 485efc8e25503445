"""Embedding near-duplicates by collision counting on one-dimensional projections."""

from __future__ import annotations

from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, materialize, table
from .components import UnionFind, block_pairs, cell_buckets, connected_components

COSINE = 0.93
#: Projections, half a window's width in standard deviations of a projected difference at the limit, and the share of
#: pairs just at the limit that the count must pass.
PROJECTIONS, HALF_WINDOW, RECALL = 32, 1.5, 0.9999
#: Vectors of one block, and queries that are counted at once.
BLOCK, TILE = 1024, 128


def least_count(projections: int, half_window: float, recall: float) -> int:
    """The largest count that a pair just at the limit reaches with the recall asked for."""
    p = erf(half_window / sqrt(2))
    tail = 0.0
    for k in range(projections, -1, -1):
        tail += comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail >= recall:
            return k
    return 0


@lru_cache(maxsize=8)
def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((dim, PROJECTIONS)).astype("f4")


def collisions(a: np.ndarray, b: np.ndarray, cosine: float):
    """(rows of a, rows of b) that collide often enough, tile after tile.

    b is sorted by each projection. A query's window is a run of each sorted projection, found by binary search; only
    the members of these runs are counted, so a pair costs nothing in projections where it is far apart.
    """
    pa, pb = a @ directions(a.shape[1]), b @ directions(b.shape[1])
    order = np.argsort(pb, axis=0, kind="stable").T
    runs = np.ascontiguousarray(np.take_along_axis(pb.T, order, axis=1))
    need, half = least_count(PROJECTIONS, HALF_WINDOW, RECALL), np.float32(HALF_WINDOW * sqrt(2 - 2 * cosine))
    for at in range(0, len(a), TILE):
        tile, met = pa[at : at + TILE], []
        row = np.arange(len(tile)) * len(b)
        for k in range(PROJECTIONS):
            low = np.searchsorted(runs[k], tile[:, k] - half)
            size = np.searchsorted(runs[k], tile[:, k] + half, "right") - low
            start = low - (np.cumsum(size) - size)
            met.append(order[k][np.arange(size.sum()) + np.repeat(start, size)] + np.repeat(row, size))
        count = np.bincount(np.concatenate(met), minlength=len(tile) * len(b))
        found = np.flatnonzero(count >= need)
        yield at + found // len(b), found % len(b)


def link_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id) of each row of vectors(vec_id, embedding, label).

    Links join rows of equal label, and equal length, at a cosine of at least the limit, verified in double precision.
    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing: 0
    links, a component of their own. Equal vectors of a label are one node with a multiplicity, so copies never make
    pairs: each has the others as links. Nodes have numbers of their own, so one vec_id on several vectors joins nothing,
    and vectors of other lengths meet others of their length only. Repeated rows count as rows; an empty table gives an empty one.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fit = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(squares, F.lit(float("nan"))).between(F.lit(5e-324), F.lit(1.7e308))
    rows = materialize(rows.withColumn("fit", F.coalesce(fit & ~F.isnan(squares), F.lit(False))))
    each = rows.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    nodes = materialize(each.select("*", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("id")))
    n = F.count("*")
    sizes = nodes.groupBy("label", "dim").agg((n * F.ceil(n / BLOCK)).alias("dealt")).agg(F.sum("dealt").alias("dealt")).first()
    cells = cell_buckets(block_pairs(nodes.drop("vec_id"), ["label", "dim"], F.xxhash64("id"), BLOCK), ["label", "dim"], sizes.dealt or 0, 8 * BLOCK)

    def link(part: pd.DataFrame) -> pd.DataFrame:
        found, links = UnionFind(), []
        for (_, _, i, j), cell in part.groupby(["label", "dim", "i", "j"], sort=False):
            sides = [cell[cell.block == i], cell[cell.block == j]] if i != j else [cell, cell]
            v = [np.array(s.embedding.tolist(), "f8") for s in sides]
            ids, copies = [s.id.to_numpy() for s in sides], [s.copies.to_numpy() for s in sides]
            if not len(v[0]) or not len(v[1]):
                continue
            norm = [np.sqrt((x * x).sum(1)) for x in v]
            unit = [(x / n[:, None]).astype("f4") for x, n in zip(v, norm, strict=True)]
            total = [np.zeros(len(x), "i8") for x in v]
            for x, y in collisions(*unit, cosine):
                if i == j:
                    x, y = x[x < y], y[x < y]
                near = (v[0][x] * v[1][y]).sum(1) / (norm[0][x] * norm[1][y]) >= cosine
                x, y = x[near], y[near]
                np.add.at(total[0], x, copies[1][y])
                np.add.at(total[0 if i == j else 1], y, copies[0][x])
                for p, q in zip(ids[0][x].tolist(), ids[1][y].tolist(), strict=True):
                    found.join(p, q)
            for of, n in list(zip(ids, total, strict=True))[: 1 if i == j else 2]:
                some = n > 0
                links += zip(of[some].tolist(), n[some].tolist(), [False] * int(some.sum()), strict=True)
        return pd.DataFrame(links + [(a, b, True) for a, b in found.forest()], columns=["a", "b", "link"])

    told = materialize(cells.groupBy("bucket").applyInPandas(link, "a bigint, b bigint, link boolean"))
    parts = connected_components(told.where("link").select("a", "b"))
    counted = told.where("not link").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    known = materialize(nodes.join(counted, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    least = materialize(known.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("key_rows")))
    told = join_heavy(known, least, ["component"]).select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.col("copies").alias("key_rows"))
    linked = join_heavy(rows.where("fit").drop("fit"), materialize(told), ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op5_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    out = link_vectors(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS s FROM embeddings
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(a.s) * sqrt(b.s)) >= 0.93
), r AS (
  WITH RECURSIVE c(a, b) AS (SELECT a, b FROM p UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a) SELECT a, min(b) AS m FROM c GROUP BY a
), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(r.m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(r.m, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN r ON r.a = v.vec_id
"""
