"""Sinks: guarded, verified writes; run folders; event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RefusedWrite(ValueError):
    """The destination is a source, or exists."""


def digest(df: DataFrame) -> tuple[int, int]:
    """Number of rows and an order-free hash of them."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.expr("coalesce(bit_xor(xxhash64(struct(*))), 0)").alias("h")).first()
    return r["n"], r["h"]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_verified(df: DataFrame, path: str, sources: tuple[str, ...] = (), overwrite: bool = False) -> None:
    """Write Parquet where nothing stands (or may be replaced), read it back and compare; a source is never written to."""
    spark = df.sparkSession
    if path.rstrip("/") in {s.rstrip("/") for s in sources}:
        raise RefusedWrite(f"{path} is a source")
    if not overwrite and exists(spark, path):
        raise RefusedWrite(f"{path} exists")
    want = digest(df)
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    if digest(spark.read.parquet(path)) != want:
        raise OSError(f"{path} does not hold what was written")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def save_run(report: DataFrame, folder: str, run_id: str) -> str:
    """A run's report under its own partition; written last, so it marks the run as whole."""
    path = f"{folder}/run_id={run_id}"
    if exists(report.sparkSession, path):
        raise RefusedWrite(f"run {run_id} exists")
    report.write.json(path)
    return path


def list_runs(spark: SparkSession, folder: str) -> list[str]:
    if not exists(spark, folder):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(s.getPath().getName().removeprefix("run_id=") for s in found if s.getPath().getName().startswith("run_id="))


def sibling(path: str) -> str:
    """x.txt -> x.clean.txt"""
    head, dot, tail = path.rpartition(".")
    return f"{head}.clean.{tail}" if dot and "/" not in tail else f"{path}.clean"
