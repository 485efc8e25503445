"""Structured Streaming forms of the batch operators. Late rows are kept: watermarks only bound state."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.joins import checkpoint_dir
from .state import KeyedState, changed_rows, failure_streaks

C = F.col


def shared_folder(spark: SparkSession, name: str | None = None) -> str:
    """A folder under spark.checkpoint.dir: of that name, the same in every session, so that a stream goes on where it stopped, or a new one."""
    checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) if name else None
    return f"{base or spark.sparkContext.getCheckpointDir()}/stream-{name or uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of their file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def source_name(spark: SparkSession, path: str) -> str:
    """A name for what lies under a path: of the path and of its oldest file's size and time. Files that are added leave it as it is; a replaced source has another."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lie = [s for s in files.listStatus(there) if not s.getPath().getName().startswith(("_", "."))]
    oldest = min(((s.getModificationTime(), s.getPath().getName(), s.getLen()) for s in lie), default=())
    return hashlib.sha256(f"{path}|{oldest}".encode()).hexdigest()[:16]


def run_available(stream: DataFrame, mode: str = "append", name: str | None = None) -> DataFrame:
    """Runs a stream over what is there, into Parquet, and reads the result. Under a name it goes on from its own checkpoint the next time."""
    spark = stream.sparkSession
    base = shared_folder(spark, name)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def for_each_batch(stream: DataFrame, fn, mode: str = "append") -> None:
    base = shared_folder(stream.sparkSession)
    stream.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


def dedupe_keys(stream: DataFrame, keys: list[str], at: str, keep: str) -> DataFrame:
    """First row of each key within the time that state is kept."""
    return stream.withWatermark(at, keep).dropDuplicatesWithinWatermark(keys)


def changed_only(stream: DataFrame, base: str, key: str, digest: str, order: str, at: str, keep_ms: int) -> DataFrame:
    """Rows whose digest differs from the last one seen under their key (numbers or null); state is a digest and a moment a key.

    A key's state goes once its moment lies keep_ms behind a later batch's last one that touches its part. The result
    lies in `base` and goes on where the last run stopped.
    """
    spark, types = stream.sparkSession, dict(stream.dtypes)
    state = KeyedState(spark, base, key, f"{key} {types[key]}, {digest} {types[digest]}, {at} timestamp")

    def step(batch: DataFrame, number: int) -> None:
        if state.done(number) or batch.isEmpty():
            return
        parts = state.touched(batch)
        known = state.rows(number, parts).join(batch.select(key).distinct(), key, "left_semi")
        changed_rows(batch.select(key, order, digest), key, digest, order, start=known).write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        last = batch.groupBy(key).agg(F.max_by(F.struct(digest, at), order).alias("l")).select(key, "l.*")
        end = batch.agg(F.max(at).alias("end")).first().end
        state.put(number, last, parts, F.lit(end).isNull() | (C(at) >= F.lit(end) - F.expr(f"INTERVAL {keep_ms} MILLISECONDS")))

    return _committed(stream, base, step, state, stream.select(key, order, digest).schema)


def failure_events(polls: DataFrame, base: str, opens_at: int = 3) -> DataFrame:
    """(provider, event_id, event): lost when a provider fails opens_at times in a row, recovered at the next success; state is the streak a provider."""
    state = KeyedState(polls.sparkSession, base, "provider", f"provider {dict(polls.dtypes)['provider']}, streak int")

    def step(batch: DataFrame, number: int) -> None:
        if state.done(number) or batch.isEmpty():
            return
        parts = state.touched(batch)
        told = failure_streaks(batch, start=state.rows(number, parts)).checkpoint()
        event = F.when(C("failed") & (C("streak") == opens_at), "lost").when(~C("failed") & (C("before") >= opens_at), "recovered")
        told.select("provider", "event_id", event.alias("event")).where("event IS NOT NULL").write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        state.put(number, told.groupBy("provider").agg(F.max_by("streak", "event_id").alias("streak")), parts)

    return _committed(polls, base, step, state, StructType([polls.schema["provider"], polls.schema["event_id"], StructField("event", StringType())]))


def _committed(stream: DataFrame, base: str, step, state: KeyedState, schema: StructType) -> DataFrame:
    """Runs a stream over what is there and reads what its committed batches wrote."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/stream").trigger(availableNow=True).start().awaitTermination()
    paths = [f"{base}/out/batch={n}" for n in state.commits.numbers()]
    return stream.sparkSession.read.schema(schema).parquet(*paths) if paths else stream.sparkSession.createDataFrame([], schema)


def recent(stream: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n of each key after each batch (update mode): state is a list of n numbers."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        new = list(state.get[0]) if state.exists else []
        for batch in batches:  # no more than n and one batch are held
            new = sorted(new + batch[order].tolist())[-n:]
        state.update((new,))
        yield pd.DataFrame({key: [k[0]], "recent": [new]})

    return stream.select(key, order).groupBy(key).applyInPandasWithState(step, f"{key} long, recent array<long>", "recent array<long>", "update", "NoTimeout")
