"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import bpe, class_ngrams, kdtree, kneser_ney, licences, packing, pages, prefix_trie, product_codes, sampling, simhash, substrings, tokens


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir), shingle=3, distance=3)
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = kdtree.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 256)
    return kdtree.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.over_limit(counts, 1024)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 4096)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_documents(spark, sf_dir), window=20).drop("o", "th")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip(docs, path, bpe.build_lexicon(docs, path))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = kneser_ney.classify(_documents(spark, sf_dir), kneser_ney.labels_of(spark, sf_dir))
    return judged.select("doc_id", "lang", "perplexity", "deviation", "accepted")


def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.neighbours(_documents(spark, sf_dir))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_ngrams.score(_documents(spark, sf_dir), class_ngrams.every_tenth_held())


def op12_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.compress(product_codes.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.trie(*prefix_trie.shared_heads(turns))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_token_counts": op3_token_counts,
    "op4_licences": op4_licences,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_quality": op8_quality,
    "op9_weighted_sampling": op9_weighted_sampling,
    "op10_main_text": op10_main_text,
    "op11_class_ngrams": op11_class_ngrams,
    "op12_product_codes": op12_product_codes,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op4_licences": licences.oracle_sql(),
    "op12_product_codes": product_codes.oracle_sql(),
    "op13_prefix_trie": prefix_trie.oracle_sql(),
}
