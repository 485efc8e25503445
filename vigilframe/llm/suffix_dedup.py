"""Removal of long repeated byte strings by sharded suffix sorting.

Two equal strings of one length, LENGTH bytes if no other is asked for, pick the same anchor: the least hash of the k-grams they hold, the rightmost of equal
ones. So every repeated string shows as two occurrences of one anchor k-gram whose contexts agree on so many bytes around
it. Occurrences are grouped by anchor; equal contexts fold into one class with a count; the contexts of different
classes of one anchor are suffix-sorted to the right and to the left of the anchor, comparing by prefix polynomial
hashes and binary search, and neighbours' common extensions, verified byte by byte, say which strings repeat.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, map_columns, materialize, release, squeezed, table, text_or_empty

LENGTH, GRAM = 400, 32
#: In the pipeline: passages of over 50 units are removed. A unit is a word, or a character of a script without spaces; it
#: is written as UNIT_BYTES bytes of its hash, so strings of so many bytes are passages, however long their words are.
#: Two different units share a hash with a chance of 2^-48.
PASSAGE_UNITS, UNIT_BYTES = 51, 6
_UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNIT = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")
#: Units whose hashes a worker keeps.
KNOWN_UNITS = 300_000
#: An anchor lies at most REACH bytes after the start of a string that picks it.
REACH = LENGTH - GRAM
#: Classes of one anchor that one task sorts, in op10 and in the pipeline; a larger group is first parted by what its strings
#: have in common.
SORT_CLASSES, PASSAGE_CLASSES = 2048, 256
#: Places of a string around its anchor that are looked at together when a large group is parted: first many, then fewer
#: where that leaves something open.
CORE_PLACES = (128, 32, 8)
#: Bits of a core's or string's hash that count; tests take fewer, so that hashes collide.
HASH_BITS = 64
#: Bytes hashed at once, and rows sorted at once.
SEGMENT, SORT_ROWS = 1 << 20, 4096
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling polynomial hash of each GRAM bytes."""
    with np.errstate(over="ignore"):
        h, step, at = data.astype("u8") + np.uint64(1), BASE, 1
        while at < GRAM:  # doubling: the hash of 2n bytes from those of n and n
            h = h[:-at] * step + h[at:]
            step, at = step * step, 2 * at
        return _mixed(h)


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all strings of length bytes in data, which holds one at least."""
    h, w = gram_hashes(data), length - GRAM + 1
    bits = np.uint64(int(len(h)).bit_length())
    order = (h >> bits << bits) | (np.uint64((1 << int(bits)) - 1) - np.arange(len(h), dtype="u8"))  # rightmost of equal ones first
    n = -(-len(order) // w) * w
    rows = np.full(n, np.iinfo("u8").max, "u8")
    rows[: len(order)] = order
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: len(order) - w + 1], ahead[w - 1 : len(order)])
    mask = np.uint64((1 << int(bits)) - 1)
    at = np.unique((mask - (least & mask)).astype("i8"))
    return at, h[at]


def document_anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(anchor, c1, c2, doc_id, th, at): each anchor, a 128-bit hash of its context, and where it stands."""
    reach = length - GRAM

    def run(keys: list, hashes: list, texts: list[str]) -> dict:
        import xxhash

        digest, out = xxhash.xxh3_128_intdigest, [[] for _ in range(6)]
        for key, th, text in zip(keys, hashes, texts, strict=True):
            raw, last = text if isinstance(text, bytes) else text.encode(), -1
            for start in range(0, len(raw) - length + 1, SEGMENT):
                at, h = anchors(np.frombuffer(raw, "u1", min(len(raw) - start, SEGMENT + length - 1), start), length)
                fresh = at + start > last  # a string's anchor never lies before that of the string one byte earlier
                at, h = at[fresh], h[fresh]
                places = (at + start).tolist()
                last = max([last, *places[-1:]])
                contexts = [(digest(raw[max(0, p - reach) : p + length]), min(p, reach)) for p in places]
                n = len(places)
                for column, values in zip(out, (h.view("i8").tolist(), [(c & 0xFFFFFFFFFFFFFFFF) - (1 << 63) for c, _ in contexts], [((c >> 64) ^ left) - (1 << 63) for c, left in contexts], [key] * n, [th] * n, places), strict=True):
                    column += values
        return dict(zip(("anchor", "c1", "c2", "doc_id", "th", "at"), out, strict=True))

    long = docs.where(F.octet_length("text") >= length).select("doc_id", "th", "text")
    return map_columns(long, run, "anchor bigint, c1 bigint, c2 bigint, doc_id bigint, th bigint, at int")


class Suffixes:
    """Byte strings of one length limit, compared by prefix hashes."""

    def __init__(self, strings: list[bytes], width: int):
        self.size = np.array([len(s) for s in strings], "i8")
        self.bytes = np.frombuffer(b"".join(s.ljust(width + 1, b"\0") for s in strings), "u1").reshape(len(strings), width + 1)
        self.hash = np.zeros((width + 1, len(strings)), "u8")
        with np.errstate(over="ignore"):
            for k in range(width):
                self.hash[k + 1] = self.hash[k] * BASE + self.bytes[:, k] + np.uint64(1)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix, by binary search over prefix hashes."""
        lo, hi = np.zeros(len(x), "i8"), np.minimum(self.size[x], self.size[y])
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.hash[mid, x] == self.hash[mid, y]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = self.common(x, y)
        ended = (k == self.size[x]) | (k == self.size[y])
        return np.where(ended, self.size[x] < self.size[y], self.bytes[x, k] < self.bytes[y, k])

    def sorted(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order within each row's group (its start and size a row), and the verified common prefix with the one before.

        Mergesort of all groups at once: in each round every string finds its rank in the run beside its own.
        """
        order = np.arange(len(start))
        w = 1
        while w < size.max():
            p = np.arange(len(start)) - start
            pair = p // (2 * w) * (2 * w)
            left = p - pair < w
            beside = pair + np.where(left, w, 0)
            lo, hi = np.zeros(len(p), "i8"), np.clip(size - beside, 0, w)
            while (todo := np.flatnonzero(lo < hi)).size:
                mid = (lo[todo] + hi[todo]) >> 1
                mine, other = order[todo], order[start[todo] + beside[todo] + mid]
                here = left[todo]
                before = np.where(here, self.less(other, mine), ~self.less(mine, other))  # equal ones keep their order
                lo[todo] = np.where(before, mid + 1, lo[todo])
                hi[todo] = np.where(before, hi[todo], mid)
            moved = np.empty_like(order)
            moved[start + pair + (p - pair - np.where(left, 0, w)) + lo] = order
            order, w = moved, 2 * w
        lcp = self._verified(order, start)
        if lcp is None:  # two different prefixes with one hash: sort those bytes themselves
            raw = [self.bytes[i, : self.size[i]].tobytes() for i in range(len(start))]
            order = np.array(sorted(range(len(start)), key=lambda i: (start[i], raw[i])))
            lcp = self._verified(order, start, trust=False)
        return order, lcp

    def _verified(self, order: np.ndarray, start: np.ndarray, trust: bool = True) -> np.ndarray | None:
        x, y = order[:-1], order[1:]
        most = np.minimum(self.size[x], self.size[y])
        differ = self.bytes[x] != self.bytes[y]
        true = np.minimum(np.where(differ.any(1), differ.argmax(1), differ.shape[1]), most)
        inner = start[1:] == start[:-1]
        if trust and (true != self.common(x, y))[inner].any():
            return None
        return np.concatenate([[0], np.where(inner, true, 0)]).astype("i8")


def repeated_reach(lefts: list[bytes], rights: list[bytes], group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each context the furthest repeated string to the left and to the right of its anchor: (bytes before, bytes from it on), -1 for none.

    lefts are reversed. Rows of a group are adjacent. Strings of length bytes around the anchor that start l bytes
    before it repeat if another context agrees on l bytes to the left and length - l from the anchor on.
    """
    n = len(group)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([first, [n]]))
    start, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    left, right = Suffixes(lefts, length - GRAM), Suffixes(rights, length)
    (lo, ll), (ro, rl) = left.sorted(start, size), right.sorted(start, size)
    furthest, least = np.full(n, -1, "i8"), np.full(n, length + 1, "i8")
    two = first[sizes == 2]
    fits = two[ll[two + 1] + rl[two + 1] >= length]
    for side in (0, 1):
        furthest[fits + side], least[fits + side] = ll[fits + 1], length - rl[fits + 1]
    for f, m in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        lcp_l, lcp_r = ll[f : f + m], rl[f : f + m]
        rank_l, rank_r = np.empty(m, "i8"), np.empty(m, "i8")
        rank_l[lo[f : f + m] - f], rank_r[ro[f : f + m] - f] = np.arange(m), np.arange(m)
        known: dict[int, np.ndarray] = {}

        def again(at: int, lcp_l=lcp_l, lcp_r=lcp_r, rank_l=rank_l, rank_r=rank_r, known=known, m=m) -> np.ndarray:
            """Contexts whose string starting so many bytes before the anchor repeats in the group."""
            if at not in known:
                pair = np.cumsum(lcp_l < at)[rank_l] * (m + 1) + np.cumsum(lcp_r < length - at)[rank_r]
                _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
                known[at] = count[back] > 1
            return known[at]

        far, near = np.full(m, -1, "i8"), np.full(m, length + 1, "i8")
        for at in sorted(set(lcp_l[1:].tolist()), reverse=True):
            far[(far < 0) & again(at)] = at
            if (far >= 0).all():
                break
        if (far >= 0).any():
            for at in sorted({length - r for r in lcp_r[1:].tolist() if r >= GRAM}):
                near[(near > length) & again(at)] = at
                if (near[far >= 0] <= length).all():
                    break
        furthest[f : f + m], least[f : f + m] = far, near
    return furthest, np.where(furthest < 0, -1, length - least)


KEYS = ["anchor", "c1", "c2"]
_KEYS_DDL = "anchor bigint, c1 bigint, c2 bigint"


def crowd_strings(batches: Iterator[pa.RecordBatch], length: int, width: int, span: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(id, l, h) from (id, anchor, before, after, cores): hashes, anchor and l in them, of what strings that start l to l + width - 1 bytes before the anchor have in common.

    With more than one string, rows (id, -1 - l, h) too: hashes of all that these strings cover. cores says from which l
    on span places are wanted; null: all.
    """
    import xxhash

    digest, ends = xxhash.xxh3_64_intdigest, length - GRAM + 1
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            sizes, starts, hashes = [], [], []
            for anchor, before, after, cores in zip(*(part.column(c).to_pylist() for c in ("anchor", "before", "after", "cores")), strict=True):
                whole, n, count = before[::-1] + after, len(before), len(starts)
                low = max(0, length - len(after))
                for a, b in [(0, ends)] if cores is None else [(c, c + span) for c in cores]:
                    for l in range(a, min(b, ends), width):
                        last = min(l + width, ends) - 1
                        if l <= n and last >= low:
                            starts.append(l)
                            hashes.append(digest(whole[n - l : n + length - last], (anchor ^ l) & 0xFFFFFFFFFFFFFFFF) >> (64 - bits))
                            if width > 1 and last <= n and l >= low:
                                starts.append(-1 - l)
                                hashes.append(digest(whole[n - last : n + length - l], (anchor ^ (-1 - l)) & 0xFFFFFFFFFFFFFFFF) >> (64 - bits))
                sizes.append(len(starts) - count)
            ids = pa.array(np.repeat(part.column("id").to_numpy(), sizes))
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int32()), pa.array(np.array(hashes, "u8").view("i8"))], names=["id", "l", "h"])


def crowd_reach(hot: DataFrame, length: int) -> DataFrame:
    """(id, before, after) of the contexts hot(id, anchor, before, after), a written table, of anchors with more classes than one task sorts.

    Strings that start up to so many CORE_PLACES apart have a core in common. Where another context has all that they
    cover, they all repeat; where it has the core only, they are looked at in smaller parts, at last one by one, so a
    context with nothing long in common makes a few rows. Of the repeated ones the furthest to each side is held byte by
    byte against another context that has it.
    """

    def repeated(rows: DataFrame) -> DataFrame:
        """The rows whose hash other contexts have too: another such context, and whether this is the first of them."""
        rows = materialize(rows)
        counts = materialize(rows.groupBy("h").agg(F.count("*").alias("key_rows"), F.min("id").alias("first"), F.max("id").alias("last")).where("key_rows > 1"))
        leads = F.col("first") == F.col("id")
        other = F.when(leads, F.col("last")).otherwise(F.col("first"))
        return join_heavy(rows, counts, ["h"]).select("id", "l", other.alias("other"), leads.alias("leads"))

    def hashed(rows: DataFrame, width: int, span: int) -> DataFrame:
        return rows.select("id", "anchor", "before", "after", "cores").mapInArrow(lambda b: crowd_strings(b, length, width, span, HASH_BITS), "id bigint, l int, h bigint")

    asked, span, again = hot.withColumn("cores", F.lit(None).cast("array<int>")), 0, []
    for width in CORE_PLACES:
        shared = materialize(repeated(hashed(asked, width, span)))
        # Contexts with the same cover have the same strings there, so the first of them stands for all.
        covered = F.collect_set(F.when((F.col("l") < 0) & ~F.col("leads"), -1 - F.col("l")))
        wanted = shared.groupBy("id").agg(F.array_except(F.collect_set(F.when(F.col("l") >= 0, F.col("l"))), covered).alias("cores")).where(F.size("cores") > 0)
        edges = F.explode(F.array(-1 - F.col("l"), F.least(-1 - F.col("l") + width, F.lit(length - GRAM + 1)) - 1))
        again.append(shared.where("l < 0").select("id", edges.alias("l"), "other"))
        asked, span = hot.join(wanted, "id"), width
    again = reduce(DataFrame.unionByName, again, repeated(hashed(asked, 1, span)).drop("leads"))
    ends = again.withColumn("o", F.struct("l", "other")).groupBy("id").agg(F.max("o").alias("far"), F.min("o").alias("near"))
    both = ends.select("id", F.explode(F.array_distinct(F.array("far", "near"))).alias("e")).select("id", "e.l", F.col("e.other").alias("o"))
    mine = materialize(hot.join(both, "id").select("id", "anchor", "l", "o", *_sides(length)))
    theirs = mine.groupBy("o").agg(F.count("*").alias("key_rows")).join(hot.select(F.col("id").alias("o"), F.col("anchor").alias("of"), F.col("before").alias("b"), F.col("after").alias("a")), "o")
    held = join_heavy(mine, materialize(theirs), ["o"])
    same = (F.col("anchor") == F.col("of")) & (F.col("left") == F.expr("substring(b, 1, l)")) & (F.col("right") == F.expr(f"substring(a, 1, {length} - l)"))
    told = materialize(held.select("id", "anchor", "l", same.alias("same")))
    reach = told.where("same").groupBy("id", "anchor").agg(F.max("l").alias("before"), (length - F.min("l")).alias("after"))
    failed = told.where(~F.col("same")).select("anchor").distinct()
    if failed.isEmpty():
        return reach.drop("anchor")
    # Two strings with one hash: the anchors concerned are counted by the strings themselves.
    each = hot.join(failed, "anchor").select("id", "anchor", F.explode(F.sequence(F.lit(0), F.least(F.lit(length - GRAM), F.octet_length("before")))).alias("l"), "before", "after")
    each = materialize(each.where(F.octet_length("after") >= length - F.col("l")).select("id", "anchor", "l", *_sides(length)))
    counts = each.groupBy("anchor", "l", "left", "right").agg(F.count("*").alias("key_rows")).where("key_rows > 1")
    exact = join_heavy(each, materialize(counts), ["anchor", "l", "left", "right"]).groupBy("id").agg(F.max("l").alias("before"), (length - F.min("l")).alias("after"))
    return reach.join(failed, "anchor", "left_anti").drop("anchor").unionByName(exact)


def _sides(length: int) -> list:
    """The l bytes before an anchor, the nearest first, and the rest of the string from the anchor on."""
    return [F.expr("substring(before, 1, l)").alias("left"), F.expr(f"substring(after, 1, {length} - l)").alias("right")]


def repeated_spans(docs: DataFrame, length: int = LENGTH, most: int | None = None) -> DataFrame:
    """spans(doc_id, th, start, stop) in bytes, overlapping, that cover just the bytes to remove, from docs(doc_id, th, text); most: classes of an anchor that one task sorts."""
    reach, most = length - GRAM, most or SORT_CLASSES
    found = materialize(document_anchors(docs, length))
    counts = materialize(found.groupBy("anchor").agg(F.count("*").alias("key_rows")).where("key_rows > 1"))
    seen = materialize(join_heavy(found, counts, ["anchor"]))
    release(found)
    classes = materialize(seen.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "at")).alias("one")))
    crowds = materialize(classes.groupBy("anchor").agg(F.count("*").alias("key_rows"), F.count("*").alias("classes")).where("classes > 1"))
    ones = join_heavy(classes, crowds, ["anchor"]).select(*KEYS, (F.col("n") > 1).alias("copied"), "classes", "one.*")
    wanted = ones.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*KEYS, "copied", "classes", "at")).alias("wanted"))
    packed = squeezed(docs.where(F.octet_length("text") >= length))
    texts = packed.join(wanted, packed.doc_id.eqNullSafe(wanted.doc_id) & (packed.th == wanted.th)).select(packed.doc_id, packed.th, "text", "wanted")

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            out, done = [], set()
            for key, th, text, want in zip(batch.doc_id, batch.th, batch.text, batch.wanted, strict=True):
                if (key, th) in done:  # a repeated row
                    continue
                done.add((key, th))
                raw = codec.decompress(text)
                out += [(w["anchor"], w["c1"], w["c2"], w["copied"], w["classes"], raw[max(0, w["at"] - reach) : w["at"]][::-1], raw[w["at"] : w["at"] + length]) for w in want]
            yield pd.DataFrame(out, columns=[*KEYS, "copied", "classes", "before", "after"])

    around = materialize(texts.mapInPandas(contexts, f"{_KEYS_DDL}, copied boolean, classes bigint, before binary, after binary"))

    def sort(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(KEYS).sort_values("anchor", kind="stable")
        ends = np.flatnonzero(np.diff(part.anchor.to_numpy())) + 1
        cuts, done = [0], 0
        for e in [*ends.tolist(), len(part)]:
            if e - cuts[-1] > SORT_ROWS and done > cuts[-1]:
                cuts.append(done)
            done = e
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
            some = part.iloc[a:b]
            before, after = repeated_reach(some.before.tolist(), some.after.tolist(), some.anchor.to_numpy(), length)
            told = some[KEYS].assign(before=before.astype("i4"), after=after.astype("i4"))
            out.append(told[(before >= 0) & ~some.copied.to_numpy(bool)])
        return pd.concat(out)

    small = around.where(F.col("classes") <= most)
    buckets = max(-(-around.count() // SORT_ROWS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    small = small.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    reached = small.groupBy("bucket").applyInPandas(sort, f"{_KEYS_DDL}, before int, after int")
    if not crowds.where(F.col("classes") > most).isEmpty():
        hot = around.where(F.col("classes") > most).dropDuplicates(KEYS).repartition(buckets, "c1")
        hot = materialize(hot.select(F.monotonically_increasing_id().alias("id"), *KEYS, "copied", "before", "after"))
        mine = crowd_reach(hot, length).join(hot.where("not copied").select("id", *KEYS), "id")
        reached = reached.unionByName(mine.select(*KEYS, "before", "after"))
    # A class that stands in several places repeats as a whole; of one that stands in one place, what others share.
    whole = classes.where("n > 1").select(*KEYS, F.lit(reach).alias("before"), F.lit(length).alias("after"), F.col("n").alias("key_rows"))
    reached = materialize(reached.withColumn("key_rows", F.lit(1).cast("long")).unionByName(whole))
    spans = join_heavy(seen, reached, KEYS)
    return spans.select("doc_id", "th", F.greatest(F.col("at") - F.col("before"), F.lit(0)).alias("start"), (F.col("at") + F.col("after")).alias("stop"))


def merged(spans: list[tuple[int, int]], end: int) -> list[tuple[int, int]]:
    """Maximal runs, cut at the text's end."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, end)) for a, b in out]


def with_spans(docs: DataFrame, length: int = LENGTH, most: int | None = None) -> DataFrame:
    """docs with text as zstd frames and column spans: the (start, stop) to remove from each text, null where there are none."""
    keyed = docs.withColumn("repeat_th", F.xxhash64(text_or_empty()))
    spans = repeated_spans(keyed.select("doc_id", F.col("repeat_th").alias("th"), text_or_empty().alias("text")), length, most)
    by_doc = spans.groupBy(F.col("doc_id").alias("repeat_of"), F.col("th").alias("repeat_of_th")).agg(F.collect_set(F.struct("start", "stop")).alias("repeat_spans"))
    long = F.coalesce(F.octet_length("text") >= length, F.lit(False))
    packed = squeezed(keyed.where(long))
    found = packed.join(by_doc, packed.doc_id.eqNullSafe(by_doc.repeat_of) & (packed.repeat_th == by_doc.repeat_of_th), "left")
    short = squeezed(keyed.where(~long)).withColumn("repeat_spans", F.lit(None).cast("array<struct<start:int,stop:int>>"))
    return found.select(*docs.columns, "repeat_spans").unionByName(short.select(*docs.columns, "repeat_spans"))


def removal_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of each row; bytes of a character cut through show as U+FFFD in kept_text only.

    A byte goes if a string of LENGTH bytes that also starts anywhere else, in the same text or another row, covers it.
    Null and short texts lose nothing. Repeated rows are elsewhere to each other. Further columns don't matter; an
    empty table gives an empty one.
    """

    def run(codec, keys: list, texts: list[bytes], spans: list) -> dict:
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
        for key, text, some in zip(keys, texts, spans, strict=True):
            raw, at, rest = codec.decompress(text) if text else b"", 0, []
            runs = merged([(s["start"], s["stop"]) for s in some or ()], len(raw))
            for a, b in runs:
                rest.append(raw[at:a])
                at = b
            kept = b"".join([*rest, raw[at:]])
            for name, v in zip(out, (key, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")), strict=True):
                out[name].append(v)
        return out

    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"
    return map_columns(with_spans(docs.select("doc_id", "text")), run, ddl, decompressor)


def decompressor():
    import zstandard

    return zstandard.ZstdDecompressor()


def unit_codes(docs: DataFrame, units: int) -> DataFrame:
    """(doc_id, th, text): the units of each text as hashes, one behind the other, of texts that have so many."""

    def run(known: dict, keys: list, hashes: list, texts: list[str]) -> dict:
        import xxhash

        digest, out = xxhash.xxh3_64_digest, {"doc_id": [], "th": [], "text": []}
        for key, th, text in zip(keys, hashes, texts, strict=True):
            if len(found := UNIT.findall(text)) >= units:
                for u in set(found).difference(known):
                    known[u] = digest(u.encode())[:UNIT_BYTES]
                for name, v in zip(out, (key, th, b"".join(map(known.__getitem__, found))), strict=True):
                    out[name].append(v)
                if len(known) > KNOWN_UNITS:
                    known.clear()
        return out

    return map_columns(docs.select("doc_id", "th", text_or_empty()), run, "doc_id bigint, th bigint, text binary", dict)


def remove_repeats(docs: DataFrame, units: int = PASSAGE_UNITS) -> DataFrame:
    """docs without passages of so many units or more that also stand elsewhere, in the same text or another row.

    Units are words and single characters of scripts without spaces (UNIT); white space between them doesn't count, and
    what surrounds a passage stays. Passages that overlap go together. All other columns stay as they are, whatever
    their names, but n_chars, counted anew if there. Null texts stay null, every row stays, repeated rows are elsewhere
    to each other; an empty table gives an empty one.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def rest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        codec = decompressor()

        def one(packed: bytes, some) -> str:
            text, at, out = codec.decompress(packed).decode(), 0, []
            places = [m.span() for m in UNIT.finditer(text)]
            for a, b in merged([(s["start"], s["stop"]) for s in some], UNIT_BYTES * len(places)):
                first, last = -(-a // UNIT_BYTES), b // UNIT_BYTES
                if last - first >= units:
                    out.append(text[at : places[first][0]])
                    at = places[last - 1][1]
            return "".join(out) + text[at:]

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("others")
    keyed = docs.select(others, "doc_id", "text", F.xxhash64(text_or_empty()).alias("th"))
    spans = repeated_spans(materialize(unit_codes(keyed, units)), units * UNIT_BYTES, PASSAGE_CLASSES)
    cut = materialize(spans.groupBy(F.col("doc_id").alias("of"), F.col("th").alias("of_th")).agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    match = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th"))
    whole = keyed.join(cut, match, "left_anti").select("others", "text")
    shorter = squeezed(keyed).join(cut, match).select("others", rest("text", "spans").alias("text"))
    out = whole.unionByName(shorter).select("others.*", "text")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in docs.columns))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))
