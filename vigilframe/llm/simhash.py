"""SimHash near-duplicates: fingerprints of shingles, linked through sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, map_columns, materialize, table, text_or_empty
from .components import UnionFind, block_pairs, cell_buckets, connected_components

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 2
#: Fingerprints of one shard tree.
TREE_NODES = 4096
#: 64 bits in five runs. Two fingerprints that differ in two bits agree on three runs at least.
RUNS = (13, 13, 13, 13, 12)


def simhash(text: str) -> int:
    """Unsigned fingerprint of one text; a text without words has 0."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and white space is \\x20 and \\x09-\\x0D
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(words[i : i + SHINGLE_WORDS]), SEED) for i in range(n)], "<u8")
    counts = sum(np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8") for part in np.array_split(hashes, 1 + n // 65536))
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """(key, fp), fp a signed long. Null texts count as empty."""

    def run(keys: list, texts: list[str]) -> dict:
        fps = np.array([simhash(t) for t in texts], "u8").view("i8")
        return {key: keys, "fp": fps.tolist()}

    return map_columns(docs.select(key, text_or_empty()), run, f"{key} {kind}, fp bigint")


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self):
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while (d := (node[0] ^ value).bit_count()) and (child := node[1].get(d)) is not None:
            node = child
        if d:
            node[1][d] = [value, {}]

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Values within the radius: by the triangle inequality only edges within it of the node's own distance lead there."""
        todo = [self.root] if self.root else []
        while todo:
            at, children = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                yield at
            if children:
                todo += [child for edge, child in children.items() if d - radius <= edge <= d + radius]


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """links(a, b) that join the ids of all fingerprints within the radius, from a written table distinct(fp, id).

    A forest for each shard, not all pairs. Shards: fingerprints that agree on three of the five runs, under each of
    the ten choices of three. That is exact for radius 2, and bounds what a tree holds without a broadcast of trees.
    """
    if radius > 2:
        raise ValueError("five runs serve a radius of at most 2")
    ends = np.cumsum(RUNS)
    masks = [sum(((1 << RUNS[k]) - 1) << int(ends[k] - RUNS[k]) for k in c) for c in combinations(range(5), 3)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", "id", F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(signed)])).alias("k"))
    rows = keyed.select("k.mask", "k.bits", "fp", "id")
    cells = cell_buckets(block_pairs(rows, ["mask", "bits"], F.xxhash64("fp"), TREE_NODES), ["mask", "bits"], len(masks) * distinct.count())

    def link(part: pd.DataFrame) -> pd.DataFrame:
        found = UnionFind()
        for (_, _, i, j), cell in part.groupby(["mask", "bits", "i", "j"], sort=False):
            tree, ids = BKTree(), {}
            values = [v & 0xFFFFFFFFFFFFFFFF for v in cell.fp.tolist()]
            across = i != j
            for value, of, block in zip(values, cell.id.tolist(), cell.block.tolist(), strict=True):
                if not across:
                    for other in tree.near(value, radius):
                        found.join(of, ids[other])
                if not across or block == i:
                    tree.add(value)
                    ids[value] = of
            if across:
                for value, of, block in zip(values, cell.id.tolist(), cell.block.tolist(), strict=True):
                    if block == j:
                        for other in tree.near(value, radius):
                            found.join(of, ids[other])
        return pd.DataFrame(found.forest(), columns=["a", "b"], dtype="int64")

    return cells.groupBy("bucket").applyInPandas(link, "a bigint, b bigint")


def fingerprint_components(distinct: DataFrame) -> DataFrame:
    """distinct(fp, *more), a written table, with the component of each fingerprint, named by one of its fingerprints."""
    parts = connected_components(near_links(distinct.select("fp", F.col("fp").alias("id"))))
    return distinct.join(parts, distinct.fp == parts.node, "left").select(*distinct.columns, F.coalesce("component", "fp").alias("component"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of each row.

    Equal fingerprints are one node, so copies never make pairs; texts without words share fingerprint 0 and link like
    any other. Null texts are empty. Rows of one id with different texts are told apart by their fingerprints; a
    component whose ids are all null has a null id. Repeated rows give repeated rows; an empty table gives an empty one.
    """
    prints = materialize(fingerprints(docs))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("key_rows")))
    named = materialize(fingerprint_components(distinct))
    least = materialize(named.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("key_rows")))
    told = join_heavy(named.select("fp", "component", F.col("key_rows").alias("n")), least, ["component"])
    told = materialize(told.select("fp", "component_id", F.col("n").alias("key_rows")))
    return join_heavy(prints, told, ["fp"]).select("doc_id", "fp", "component_id")


def op6_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest (doc_id, hash of the text), null ids last; of rows equal in both the one whose hash over all columns is least.

    Components are of fingerprints, so rows of different ones all stay, whatever their ids. Columns may have any names.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    sha = F.coalesce(F.sha2("text", 256), F.lit(""))
    keyed = docs.select(row, "text", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), sha).alias("row_key"))
    prints = materialize(fingerprints(keyed.select("row_key", "text"), "row_key", "string"))
    doc_id = F.split_part("row_key", F.lit(":"), F.lit(1)).try_cast("bigint")
    firsts = materialize(prints.groupBy("fp").agg(F.min(F.struct(doc_id.isNull().alias("last"), doc_id.alias("doc_id"), "row_key")).alias("first")))
    kept = fingerprint_components(firsts).groupBy("component").agg(F.min("first").alias("first")).select("first.row_key")
    stay = keyed.join(kept, "row_key", "left_semi").select("row", "row_key", F.xxhash64("row").alias("h"))
    return stay.groupBy("row_key").agg(F.min_by("row", "h").alias("row")).select("row.*")
