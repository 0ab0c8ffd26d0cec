"""Sources: text files, attachments, run folders, voice profiles; wrong input becomes rows, not failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media type by suffix, and the most characters of a document.
MEDIA_TYPES = {"txt": "text/plain", "text": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "mdown": "text/markdown"}
MOST_CHARS = 1_000_000


def media_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = None
    for s, m in MEDIA_TYPES.items():
        out = F.when(suffix == s, m) if out is None else out.when(suffix == s, m)
    return out.otherwise("unsupported")


def read_texts(spark: SparkSession, path: str, most_chars: int = MOST_CHARS) -> DataFrame:
    """path, media_type, text, problem: files as strict UTF-8 text; the problem says why a text is null."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.decode("content", "UTF-8"))
    r = raw.withColumns({"media_type": media_type(F.col("path")), "text": text})
    why = F.when(F.col("media_type") == "unsupported", "unsupported type").when(F.col("text").isNull(), "not UTF-8").when(F.length("text") > most_chars, "too long")
    return r.withColumn("problem", why).select("path", "media_type", F.when(F.col("problem").isNull(), F.col("text")).alias("text"), "problem")


def read_attachments(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> DataFrame:
    """path, content, problem of every file; the content of one beyond a size is null, and the problem says so."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = F.col("length") > most_bytes
    return files.select("path", F.when(~large, F.col("content")).alias("content"), F.when(large, "too large").alias("problem"))


EVENT = "run_id string, sequence bigint, timestamp timestamp, kind string, state string, message string, candidate_id string, data string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def read_voices(spark: SparkSession, path: str) -> DataFrame:
    """name, body, format: profiles as prose or JSON; prose is preferred where a name has both."""
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("p"))
    rows = files.select(F.regexp_extract("p", r"([^/]+)\.(md|json)$", 1).alias("name"), F.regexp_extract("p", r"\.(md|json)$", 1).alias("format"), F.col("value").alias("body"))
    best = rows.filter("name <> ''").groupBy("name").agg(F.max_by(F.struct("body", "format"), F.col("format")).alias("v"))
    return best.select("name", "v.body", "v.format")
