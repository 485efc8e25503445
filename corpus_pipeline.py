"""Corpus pipeline: toxic documents out, one of each near-duplicate group, repeated passages out, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilframe.llm.common import materialize, session, table
from vigilframe.llm.packing import pack_documents
from vigilframe.llm.simhash import keep_one_of_each
from vigilframe.llm.suffix_dedup import remove_repeats
from vigilframe.llm.toxicity import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the chain fitted on labels scores under one half."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component, the one with the smallest doc_id."""
    session(spark)
    return keep_one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without passages of over 50 words that stand elsewhere too."""
    session(spark)
    return remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 tokens."""
    session(spark)
    return pack_documents(docs)


STAGES = [("toxicity", without_toxic), ("simhash_near_dedup", without_near_duplicates), ("suffix_array_dedup", without_repeats), ("best_fit_packing", packed)]

#: No stage but the last can be said in SQL, so tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
