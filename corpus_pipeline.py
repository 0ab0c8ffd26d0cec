"""A training corpus from raw documents: quality, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame that is written and read again as the next one's docs.
Extra columns pass through all but the last stage, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import kneser_ney, near_copies, packing, substrings
from inkwell.llm.common import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose perplexity under the model of trusted text lies within their language's limits.

    Null and blank texts go. Rows without an id or a language are judged like others (by the common limits where a
    language has none); repeated rows are judged each and alike; a text of any length is judged whole.
    """
    judged = kneser_ney.classify(docs, kneser_ney.labels_of(spark, sf_dir), prefix="_kn_")
    return judged.filter("_kn_accepted").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id.

    Rows without an id stay. Rows that share an id are one document, of which one row stays, by the
    hash of its text and then its other columns. Texts without words are copies of each other.
    """
    return near_copies.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document (or an earlier place) has; drop documents that are nothing else.

    Null ids come last; a null text has no words and stays as it is; a text shorter than a window loses
    nothing; rows with one id and different texts are ordered by the hash of the text; n_chars follows the text.
    """
    return substrings.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 4096 tokens.

    A null text is empty and takes the closing token alone; longer documents are cut into pieces; rows that share an
    id are packed each, and so are rows without one.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", packing_stage),
]

#: A trained model and iterated components can't be put in SQL; tests hold all four stages against slow versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written and read again."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k + 1 < len(STAGES):
            out = materialize(out, name.replace(" ", "-"))
    return out
