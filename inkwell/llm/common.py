"""Helpers shared by the training-data operators: shared-folder tables, Arrow maps, row keys."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is spark.checkpoint.dir; only where that is unset (local tests) a
    temporary folder is chosen and set as the checkpoint folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        where = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.sparkContext.setCheckpointDir(where)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


def table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it back.

    The files outlive any executor, so a lost executor costs only a re-read.
    """
    spark = df.sparkSession
    path = table_path(spark, label)
    with shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkwell_path = path
    return out


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run in here leave no shuffle files behind: their result is written, none of them is read again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Rows of an Arrow batch from here on: few where rows hold whole texts, many where they hold numbers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_STATE: tuple[str, dict] = ("", {})


def worker_state(owner: str) -> dict:
    """What an operator keeps in a worker process between tasks; another operator's start lets go of it."""
    global _STATE
    if _STATE[0] != owner:
        _STATE[1].clear()
        _STATE = (owner, {})
        give_back()
    return _STATE[1]


#: Bytes that a worker may keep between tasks; an idle worker just started has some 60 MB.
KEPT = 96 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def own_bytes() -> int:
    """Memory of this process that no file backs (0 where the system doesn't tell)."""
    try:
        with open("/proc/self/statm") as f:
            resident, shared = map(int, f.read().split()[1:3])
    except OSError:
        return 0
    return (resident - shared) * os.sysconf("SC_PAGE_SIZE")


def give_back() -> None:
    """Hand what this process has freed back to the system, if it holds more than ``KEPT``; allocators keep it for themselves otherwise."""
    if own_bytes() > KEPT:
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's function, after which the worker gives back what it has freed: executors keep workers as long as they live."""

    @functools.wraps(run)
    def out(*given) -> Iterator:
        try:
            yield from run(*given)
        finally:
            give_back()

    return out


TEXT_ROWS, NUMBER_ROWS = 1000, 20_000


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    path = getattr(df, "_inkwell_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches kept small enough that long texts stay within a worker's memory."""
    return df.mapInArrow(fn, schema)


def whole_groups(rows: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """Rows dealt and sorted so that one task reads all rows of a key in a row.

    Dealt by the keys' hash and not by the keys themselves: behind a join on the same keys Spark leaves that
    repartition out, and a skewed part of the join is split among tasks then, with rows of one key in several of them.
    """
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Re-cut batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        data = batch.column(column)
        sizes = [0 if x is None else x for x in pc.binary_length(data).to_pylist()]
        start = used = 0
        for i, size in enumerate(sizes):
            if i > start and used + size > limit:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += size
        yield batch.slice(start)


def with_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names of our own, so that extra columns cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
