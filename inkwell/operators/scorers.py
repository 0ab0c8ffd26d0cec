"""Scorers: any function of a text as an Arrow function, with a table of scores already known."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.sources.sinks import exists


def cache_key(name: str, version: str):
    """A text's key under a scorer's name and version."""
    return F.sha2(F.concat_ws("|", F.lit(name), F.lit(version), "text"), 256)


def score(docs: DataFrame, load: Callable[[], Callable[[str], float]], name: str, version: str, known: DataFrame | None = None) -> DataFrame:
    """doc_id, key, score, token_count of every row. load() runs once a task and gives the scorer.

    A text is scored once however many rows have it; texts whose key is in
    ``known`` (key, score, token_count) aren't scored again.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", cache_key(name, version))
    made = _scores(keyed, load, known)
    made = made if known is None else known.select("key", "score", "token_count").unionByName(made)
    return keyed.select("doc_id", "key").join(made, "key").select("doc_id", "key", "score", "token_count")


def _scores(keyed: DataFrame, load: Callable[[], Callable[[str], float]], known: DataFrame | None) -> DataFrame:
    """key, score, token_count of the distinct texts that aren't known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = load()
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([float(fn(t)) for t in texts], pa.float64()), pa.array([len(t.split()) for t in texts], pa.int32())], ["key", "score", "token_count"])

    new = keyed if known is None else keyed.join(known.select("key"), "key", "left_anti")
    return new.groupBy("key").agg(F.any_value("text").alias("text")).mapInArrow(run, "key string, score double, token_count int")


def score_into(docs: DataFrame, load: Callable[[], Callable[[str], float]], name: str, version: str, folder: str) -> DataFrame:
    """As ``score``, with the scores kept in a folder: a later run over the same texts scores nothing.

    New scores are appended as files of their own before they are read; two
    runs at once may score a text twice, and either score stands.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", cache_key(name, version))
    schema = "key string, score double, token_count int"
    known = spark.read.schema(schema).parquet(folder) if exists(spark, folder) else None
    new = _scores(keyed, load, known)
    new.write.mode("append").parquet(folder)
    table = spark.read.schema(schema).parquet(folder).groupBy("key").agg(F.min("score").alias("score"), F.min("token_count").alias("token_count"))
    return keyed.select("doc_id", "key").join(table, "key").select("doc_id", "key", "score", "token_count")


def evidence(scores: DataFrame, detector: str, kind: str, threshold: float | None = None, lower_is_riskier: bool = False) -> DataFrame:
    """Scores as evidence: detector, kind, risk and whether it lies below the threshold."""
    if kind not in ("native", "surrogate", "zero_shot", "heuristic"):
        raise ValueError(f"unknown kind of evidence {kind}")
    risk = -F.col("score") if lower_is_riskier else F.col("score")
    below = (risk < threshold) if threshold is not None else F.lit(None).cast("boolean")
    return scores.withColumns({"detector": F.lit(detector), "kind": F.lit(kind), "risk": risk, "below": below})
