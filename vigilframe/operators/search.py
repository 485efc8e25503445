"""Search by a token index: a table (token, id) sorted by token, so that a term is a range of it.

Every term of a query must begin some word of a row. The index lies in generations: rows that change are written anew
under the next one, with their ids, and the newest generation of an id counts, so nothing else is touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from .commits import Commits

C = F.col
#: Terms of a query that count, and lengths of a query; others are refused.
TERMS, LENGTHS = 8, (2, 100)
#: Different terms of one lookup that are broadcast, and for which ranges are pushed to the scan, at most.
BROADCAST_TERMS, RANGES = 10_000, 24


def head_of(token: Column) -> Column:
    """The part of the index that a token lies in: its first letter or digit, or the block of 256 code points of any other sign."""
    code = F.ascii(token)
    return F.when(code < 128, F.left(token, F.lit(1))).otherwise(F.concat(F.lit("u"), F.hex(F.shiftright(code, 8))))


def asked_terms(asked: DataFrame) -> DataFrame:
    """(query, terms) of queries (query, asked): the first TERMS words. Queries too short or too long, or without a word, have none."""
    size = F.length(F.trim("asked"))
    terms = asked.where(size.between(*LENGTHS)).select("query", F.array_distinct(F.slice(word_tokens(C("asked")), 1, TERMS)).alias("terms"))
    return terms.where(F.size("terms") > 0)


class SearchIndex:
    """An index over rows of one id column (a string or a number) in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.commits = spark, path, Commits(spark, path)

    def put(self, rows: DataFrame, id: str, said: list[str]) -> SearchIndex:
        """Indexes the words of the columns `said`; rows whose id is there already are replaced. Repeated ids count as one row of all their words; null ids are left out."""
        number = max(self.commits.numbers(), default=-1) + 1
        known = rows.where(C(id).isNotNull()).select(C(id).alias("id"), F.array_distinct(word_tokens(F.concat_ws(" ", *said))).alias("tokens"))
        # explode() would have the words made twice more, for a filter on their number.
        tokens = known.select("id", F.explode_outer("tokens").alias("token")).where("token IS NOT NULL").withColumn("head", head_of(C("token")))
        self._lay(tokens, number)
        if number:  # the first generation replaces nothing
            known.select("id").write.mode("overwrite").parquet(f"{self.path}/ids/gen={number}")
        self.commits.write(number, {"type": dict(rows.dtypes)[id]})
        return self

    def _lay(self, tokens: DataFrame, number: int) -> None:
        """Writes tokens under their heads, each file sorted by token. A head's rows are dealt to several tasks by id, so a frequent token or letter fills none."""
        salts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 4)
        dealt = tokens.repartition("head", F.pmod(F.xxhash64("id"), F.lit(salts)))
        dealt.sortWithinPartitions("head", "token", "id").write.mode("overwrite").partitionBy("head").parquet(f"{self.path}/tokens/gen={number}")

    def remove(self, ids: DataFrame) -> None:
        """Takes rows out: their ids are written without words."""
        self.put(ids.select("id").withColumn("nothing", F.lit("")), "id", ["nothing"])

    def compact(self) -> None:
        """Writes what counts as one generation; older ones are not read any more."""
        number, live = max(self.commits.numbers()) + 1, self._live(self._tokens())
        kind = self.commits.read(number - 1)["type"]
        self._lay(live.select("id", "token", "head"), number)
        self.commits.write(number, {"type": kind, "whole": True})

    def _generations(self) -> list[int]:
        numbers = self.commits.numbers()
        whole = max((n for n in numbers if self.commits.read(n).get("whole")), default=-1)
        return [n for n in numbers if n >= whole]

    def _read(self, part: str, generations: list[int], schema: str) -> DataFrame:
        paths = [f"{self.path}/{part}/gen={n}" for n in generations]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}").parquet(*paths)

    def _tokens(self) -> DataFrame:
        kind = self.commits.read(self.commits.numbers()[-1])["type"]
        return self._read("tokens", self._generations(), f"id {kind}, token string, gen int, head string")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Of rows (id, gen, ...) those whose id was not written again later."""
        later = self._generations()[1:]
        if not later:
            return rows
        newest = self._read("ids", later, f"id {dict(rows.dtypes)['id']}, gen int").groupBy("id").agg(F.max("gen").alias("newest"))
        return rows.join(newest, "id", "left").where("newest IS NULL OR gen >= newest").drop("newest")

    def search(self, asked: DataFrame) -> DataFrame:
        """(query, id) of queries (query, asked) and the rows that they find; case and marks don't count.

        Queries are not repeated. Terms meet tokens by their beginnings of the terms' lengths, which are at most
        LENGTHS[1] many, so the join is on equal strings. A row's terms are gathered once for all queries, and meet the
        queries by the term of each that the fewest tokens begin with, so frequent terms make no pairs.
        """
        queries = asked_terms(asked)
        terms = queries.select("query", F.explode("terms").alias("term"))
        known = terms.select("term").distinct().limit(BROADCAST_TERMS + 1).collect()  # so many short strings at most
        few = len(known) <= BROADCAST_TERMS
        light = F.broadcast if few else lambda df: df
        lengths = sorted({len(r.term) for r in known} if few else range(1, LENGTHS[1] + 1))
        tokens = self._tokens()
        if few:
            heads = [r.head for r in self.spark.createDataFrame(known, "term string").select(head_of(C("term")).alias("head")).distinct().collect()]
            tokens = tokens.where(C("head").isin(heads))
        if few and len(known) <= RANGES:
            ranges = ((C("token") >= r.term) & (C("token") < r.term + chr(0x10FFFF)) for r in known)
            tokens = tokens.where(reduce(lambda a, b: a | b, ranges, F.lit(False)))
        # Terms go by short numbers where they are few.
        number = self.spark.createDataFrame([(r.term, k) for k, r in enumerate(known)], "term string, n int") if few else terms.select("term", C("term").alias("n")).distinct()
        beginnings = F.filter(F.array(*(F.when(F.length("token") >= n, F.left("token", F.lit(n))) for n in lengths)), lambda t: t.isNotNull())
        begun = lambda rows: rows.withColumn("term", F.explode(beginnings)).join(light(number), "term")
        often = begun(tokens.groupBy("token").agg(F.count("*").alias("rows"))).groupBy("n").agg(F.sum("rows").alias("rows"))
        asks = terms.join(light(number), "term").join(light(often), "n", "left")
        least = F.min_by("n", F.coalesce("rows", F.lit(0)))
        asks = asks.groupBy("query").agg(least.alias("n"), F.collect_list("n").alias("asked"))
        has = self._live(begun(tokens)).groupBy("id").agg(F.collect_set("n").alias("has"))
        met = has.withColumn("n", F.explode("has")).join(light(asks), "n")
        return met.where(F.size(F.array_except("asked", "has")) == 0).select("query", "id")
