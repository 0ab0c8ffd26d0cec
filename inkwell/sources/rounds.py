"""Committed rounds of iterative jobs.

A round's table is written whole, then marked, before the next round reads it:
plans stay as long as one round, a lost executor costs a re-read, and a job that was
stopped goes on behind its last marked round. Rounds live under the hash of
their job's settings; a source that differs from the one they were made from is refused.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.sinks import digest, exists


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where that is unset (local tests) a temporary one is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="inkwell-"))
    return context.getCheckpointDir().get().rstrip("/")


class Rounds:
    """Named tables of one job, each marked when it is whole."""

    def __init__(self, spark: SparkSession, folder: str | None = None, settings: dict | None = None, source: DataFrame | None = None) -> None:
        """Without a folder the rounds are this run's own; with one, a run with equal settings over an equal source goes on with them."""
        self.spark = spark
        key = hashlib.sha256(json.dumps(settings or {}, sort_keys=True, default=str).encode()).hexdigest()[:24]
        self.path = f"{folder.rstrip('/')}/{key}" if folder else f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
        if folder and source is not None:
            n, h = digest(source)
            if self.has("source"):
                said = self.read("source").first()
                if (said["n"], said["h"]) != (n, h):
                    raise ValueError("the rounds in this folder were made from another source")
            else:
                self.commit(spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(h).cast("long").alias("h")), "source")

    def _place(self, name: str) -> str:
        return f"{self.path}/{name}"

    def has(self, name: str) -> bool:
        return exists(self.spark, self._place(name) + ".whole")

    def commit(self, df: DataFrame, name: str) -> DataFrame:
        """Write a round (what a stopped run left of it is replaced), mark it and read it back."""
        # what is written needs no shuffle files any more; few bytes of a round are much work, so its files are dealt to several tasks a core
        held = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.files.minPartitionNum": str(4 * self.spark.sparkContext.defaultParallelism)}
        old = {key: self.spark.conf.get(key, None) for key in held}
        for key, value in held.items():
            self.spark.conf.set(key, value)
        try:
            df.write.mode("overwrite").parquet(self._place(name))
        finally:
            for key, value in old.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)
        jvm = self.spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(self._place(name) + ".whole")
        mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(mark, True).close()
        return self.spark.read.schema(df.schema).parquet(self._place(name))

    def drop(self, name: str) -> None:
        """Delete a round that no later one needs."""
        jvm = self.spark._jvm
        for place in (self._place(name) + ".whole", self._place(name)):
            p = jvm.org.apache.hadoop.fs.Path(place)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._place(name))

    def last(self, prefix: str, most: int) -> int:
        """The greatest k up to most with a whole round prefix-k, or -1."""
        return next((k for k in range(most, -1, -1) if self.has(f"{prefix}-{k}")), -1)
