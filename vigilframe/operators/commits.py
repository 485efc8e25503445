"""Numbered commits in a shared folder: what a writer has finished, for readers and for the writer after a restart."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from .joins import checkpoint_dir


def new_folder(spark: SparkSession, name: str = "") -> str:
    """A new folder under spark.checkpoint.dir that goes when the session's JVM ends."""
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}{uuid.uuid4().hex}"
    there, files = _at(spark, path)
    files.mkdirs(there)
    files.deleteOnExit(there)
    return path


def _at(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Commits:
    """Commit files base/commits/<number>, each a line of JSON. What has no commit file doesn't count, whatever lies in the folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def numbers(self) -> list[int]:
        there, files = _at(self.spark, f"{self.base}/commits")
        if not files.exists(there):
            return []
        return sorted(int(n) for s in files.listStatus(there) if (n := s.getPath().getName()).isdigit())

    def read(self, number: int) -> dict:
        there, files = _at(self.spark, f"{self.base}/commits/{number}")
        stream = files.open(there)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, number: int, told: dict | None = None) -> None:
        """Written beside and renamed, so that a commit is there in whole or not at all; the same number again changes nothing."""
        aside, files = _at(self.spark, f"{self.base}/commits/.{number}-{uuid.uuid4().hex}")
        stream = files.create(aside, True)
        stream.write(bytearray(json.dumps(told or {}).encode()))
        stream.close()
        if not files.rename(aside, _at(self.spark, f"{self.base}/commits/{number}")[0]):
            files.delete(aside, False)
