"""Winnowing fingerprints in DataFrame expressions alone.

A text's units don't depend on where in it they stand: each character of a script without spaces, words of up to UNIT
code points, and longer runs parted after characters of a fixed class. Rolling hashes of GRAM units, a power of two; of
every WINDOW neighbouring hashes the least is chosen, the rightmost of equal ones. Two texts that share
GRAM + WINDOW - 1 units in a row share a chosen hash. Positions are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, text_or_empty

UNIT, GRAM, WINDOW = 16, 4, 4
#: Words cut at every UNIT code points from their start.
STRIDE = rf"\S{{1,{UNIT}}}"
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
_REST, _ENDS = rf"[\S&&[^{_ALONE}]]", r"\p{Punct}aeiouAEIOU048"
_INNER = rf"[\S&&[^{_ALONE}{_ENDS}]]"
#: A character of a script without spaces; a whole short run; of a longer run what ends with one of _ENDS, or its tail.
PARTED = rf"[{_ALONE}]|(?<!{_REST}){_REST}{{1,{UNIT}}}+(?!{_REST})|{_INNER}*+[{_ENDS}]|{_INNER}++"
#: Low bits of a chosen number: the gram's place, turned round so that the rightmost of equal hashes is the least.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
#: Documents, on average, of one bucket of neighbouring ids, and buckets of one shelf.
BUCKET, SHELF = 64, 4096
#: Stretches of the order of documents that each hold about as many, by a sample of so many rows.
STRETCHES, SAMPLE = 256, 8192


def let(value: Column, fn) -> Column:
    """fn of a value that is computed once, however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def chosen(text: Column, unit: str = STRIDE) -> Column:
    """Numbers chosen from a text, in order of place: a hash in the high bits, its place in the low ones. unit is a pattern of units.

    A text of fewer than GRAM units is one gram; one without units, but not empty, is one gram of itself; an empty one
    has none. Places beyond PLACE_BITS wrap round; hashes don't.
    """
    units = F.regexp_extract_all(text, F.lit(unit), F.lit(0))

    def grams(h: Column, n: int = 1) -> Column:
        """Rolling hashes by cyclic polynomials: a hash of 2n units is that of the first n, turned by n bits, and that of the n after them."""
        turned = lambda a, b: F.shiftleft(a, n).bitwiseOR(F.shiftrightunsigned(a, 64 - n)).bitwiseXOR(F.coalesce(b, F.lit(0)))
        if 2 * n < GRAM:
            return let(F.zip_with(h, F.slice(h, F.lit(1 + n), F.size(h)), turned), lambda g: grams(g, 2 * n))
        place = lambda i: F.lit(PLACE) - i.bitwiseAND(F.lit(PLACE))
        heads = F.slice(h, F.lit(1), F.greatest(F.size(h) - GRAM + 1, F.lit(1)))
        return F.transform(heads, lambda a, i: turned(a, F.get(h, i + n)).bitwiseAND(F.lit(~PLACE)) + place(i))

    def least(v: Column, step: int = 1) -> Column:
        """Least of each WINDOW neighbours, by doubling."""
        if step >= WINDOW:
            return v
        both = let(v, lambda v: F.slice(F.zip_with(v, F.slice(v, F.lit(step + 1), F.size(v)), lambda a, b: F.least(a, b)), F.lit(1), F.greatest(F.size(v) - step, F.lit(1))))
        return least(both, step * 2)

    def winnow(g: Column) -> Column:
        return F.when(F.size(g) <= WINDOW, F.array(F.array_min(g))).otherwise(F.array_distinct(least(g)))

    hashed = F.transform(units, lambda u: F.xxhash64(u))
    picked = let(hashed, lambda h: F.when(F.size(h) > 0, let(grams(h), winnow)).otherwise(F.array(F.xxhash64(text).bitwiseOR(F.lit(PLACE)))))
    return F.when(F.length(text) > 0, picked).otherwise(F.array().cast("array<bigint>"))


def hashes(c: Column) -> Column:
    return F.transform(c, lambda x: F.shiftright(x, PLACE_BITS))


def places(c: Column) -> Column:
    """In units from the text's start."""
    return F.transform(c, lambda x: F.lit(PLACE) - x.bitwiseAND(F.lit(PLACE)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of hashes; two empty ones are alike."""
    same = lambda x: F.size(F.array_intersect(x["a"], x["b"]))
    share = lambda x: let(same(x), lambda n: n / (F.size(x["a"]) + F.size(x["b"]) - n))
    return let(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), lambda x: F.when((F.size(x["a"]) == 0) & (F.size(x["b"]) == 0), 1.0).otherwise(share(x)))


def with_next(docs: DataFrame, more) -> DataFrame:
    """(doc_id, text, x, next_text, next_x), x = more(text): each row with the next one in order of doc_id from the highest; after the last comes the first.

    Rows of one doc_id stand in order of text; null ids come last. Rows are put in buckets of neighbours, and each
    bucket is ordered by itself; only its first row goes on to the bucket above it, found through the buckets'
    numbers. No task orders all rows. Bounds from a sample part the order into stretches that hold about as many rows,
    so neither far-off ids nor one id with many rows fills a bucket, unless their texts begin alike; within a stretch
    buckets are of equal id width.
    """
    placed = docs.select("doc_id", "text", *_order())
    n = docs.count()
    some = placed.sample(min(1.0, SAMPLE / max(n, 1)), seed=11).select("known", "id", "head").collect()  # about SAMPLE rows at most
    found = sorted((r.known, r.id, r.head) for r in some)
    bounds = sorted({found[k * len(found) // STRETCHES] for k in range(1, STRETCHES)}) if found else []
    keyed = placed.select("doc_id", "text", _bucket(bounds, max(1, n // STRETCHES)).alias("bucket"))
    order = W.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "text")
    rows = keyed.repartition("bucket").withColumn("x", more(F.col("text")))
    rows = rows.select("*", F.lead(F.struct("text", "x")).over(order).alias("next"))
    # Buckets: within a shelf by a window, from shelf to shelf by one over the shelves, one for BUCKET * SHELF rows.
    numbers = keyed.select("bucket").distinct().withColumn("shelf", F.floor(F.col("bucket") / SHELF))
    inside = numbers.withColumn("below", F.lag("bucket").over(W.partitionBy("shelf").orderBy("bucket")))
    tops = numbers.groupBy("shelf").agg(F.max("bucket").alias("top"))
    tops = tops.withColumns({"below_shelf": F.lag("top").over(W.orderBy("shelf")), "highest": F.max("top").over(W.orderBy("shelf").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    after = inside.join(tops.select("shelf", "below_shelf", "highest"), "shelf").select(F.col("bucket").alias("above"), F.coalesce("below", "below_shelf", "highest").alias("bucket"))
    firsts = keyed.withColumn("k", F.row_number().over(order)).where("k = 1").select("bucket", "text")
    edges = firsts.join(after, "bucket").select(F.col("above").alias("bucket"), F.struct("text", more(F.col("text")).alias("x")).alias("edge"))
    joined = rows.join(edges, "bucket").withColumn("next", F.coalesce("next", "edge"))
    return joined.select("doc_id", "text", "x", F.col("next.text").alias("next_text"), F.col("next.x").alias("next_x"))


def _order() -> list[Column]:
    """What rows are bucketed by, rising where the order of documents falls: known ids, the id, and the less the later the text's first seven bytes."""
    head = F.conv(F.rpad(F.hex(F.substring(F.encode("text", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return [F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), (-head).alias("head")]


def _numbers(values: list) -> Column:
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",").try_cast("array<bigint>")


def _bucket(bounds: list[tuple], stretch_rows: int) -> Column:
    """Number of a row's bucket: its stretch between the bounds and, by the id, its part of the stretch."""
    if not bounds:
        return F.lit(0).cast("long")
    # Lists are split from one string each: the optimizer makes one literal of that, where structs of literals would be
    # planned one by one. Bounds are written so that they compare as strings.
    known = F.split(F.lit(",".join(f"{int(k)}{i + (1 << 63):016X}{h + (1 << 63):016X}" for k, i, h in bounds)), ",")
    shown = lambda c: F.lpad(F.hex(F.col(c).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    mine = F.concat(F.when(F.col("known"), "1").otherwise("0"), shown("id"), shown("head"))
    # Of a stretch from one known id to another: where it begins, and how many ids make a bucket.
    parts = max(1, stretch_rows // BUCKET)
    spans = [(a[1], max(1, (b[1] - a[1]) // parts)) if a[0] and a[1] != b[1] else (None, None) for a, b in zip(bounds, bounds[1:], strict=False)]
    lows, wides = (_numbers([None, *x, None]) for x in (zip(*spans, strict=True) if spans else ([], [])))
    inner = lambda s: F.coalesce((F.col("id") - F.get(lows, s)).cast("decimal(20,0)") / F.get(wides, s), F.lit(0)).cast("long")
    stretch = let(mine, lambda m: F.size(F.filter(known, lambda b: b <= m)))
    return let(stretch, lambda s: s.cast("long") * F.lit(1 << 32) + inner(s))


def fingerprint_documents(docs: DataFrame, unit: str = STRIDE) -> DataFrame:
    """(doc_id, text, edited, chosen, edited_chosen, next_chosen) of each row; hashes() and places() read the chosen numbers.

    edited is the text with its last floor(n/2) code points replaced by as many of the next row's first, or all of
    them. Null texts are empty, an empty text has no hashes; rows of one doc_id are ordered by text; null ids come
    last; a lone row's next is itself; an empty table gives an empty one; further columns don't matter.
    """
    rows = with_next(docs.select("doc_id", text_or_empty()), lambda text: chosen(text, unit))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = rows.select("doc_id", "text", edited.alias("edited"), F.col("x").alias("chosen"), F.col("next_x").alias("next_chosen"))
    once = let(F.col("edited"), lambda e: F.struct(e.alias("edited"), chosen(e, unit).alias("edited_chosen")))
    return both.select("doc_id", "text", "chosen", "next_chosen", F.explode(F.array(once)).alias("e")).select("doc_id", "text", "e.edited", "chosen", "e.edited_chosen", "next_chosen")


def op3_winnowing(spark, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(table(spark, sf_dir, "documents"), PARTED)
    shown = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)
    near = lambda c: likeness(hashes(F.col("chosen")), hashes(F.col(c)))
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), shown("chosen").alias("fingerprint"), shown("edited_chosen").alias("edited_fingerprint"),
        near("edited_chosen").alias("near_edited"), near("next_chosen").alias("near_next"),
    )
