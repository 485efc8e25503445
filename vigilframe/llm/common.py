"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts may be long, so batches are kept small.
BATCH_ROWS = 512


def session(spark: SparkSession) -> SparkSession:
    """Sets what the Python stages count on: small Arrow batches, one clock zone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it lies. Documents in fewer files than there are cores are dealt out first: a file of one row group is one task."""
    out = session(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return out.repartition(2 * cores) if name == "documents" and len(out.inputFiles()) < cores else out


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own, in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vigilframe-"))
    return context.getCheckpointDir()


def _hadoop_path(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    there, files = _hadoop_path(spark, path)
    files.deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing lazy reads it any more."""
    there, files = _hadoop_path(df.sparkSession, df.written_to)
    files.delete(there, True)


def join_heavy(rows: DataFrame, told: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """rows inner-joined with told(*keys, *more, key_rows), unique by its keys; key_rows says how many of the rows have them.

    Keys that hold over one in `share` of the rows, `share` of them at most, are broadcast, so no task gets one of
    them whole. All others meet by a shuffle. rows and told are read twice: both should be written tables.
    """
    limit = max(1, rows.count() // share)
    heavy = F.broadcast(told.where(F.col("key_rows") > limit))  # at most `share` rows
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(told.where(F.col("key_rows") <= limit), keys)
    return rows.join(heavy, keys).unionByName(rest).drop("key_rows")


def squeezed(df: DataFrame, column: str = "text") -> DataFrame:
    """df with a string or binary column as zstd frames, for texts that go through a shuffle: half of what the shuffle's own codec leaves."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([StructField(f.name, BinaryType(), True) if f.name == column else f for f in df.schema])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [None if t is None else codec.compress(t if isinstance(t, bytes) else t.encode()) for t in batch.column(at).to_pylist()]
            columns = [pa.array(packed, pa.binary()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, fn: Callable[..., dict], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """fn gets the batch's columns as lists, and what setup() made once in the task; returns columns as a dict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [setup()] if setup else []
        for batch in batches:
            if batch.num_rows:
                out = fn(*made, *(c.to_pylist() for c in batch.columns))
                yield from pa.Table.from_pydict(out, schema=arrow).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)
