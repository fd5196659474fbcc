"""The queries of this package, with production parameters, and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    host_links,
    host_quality,
    language_id,
    line_windows,
    packing,
    pii_votes,
    prefix_trie,
    ranked_search,
    setsketch_dedup,
    subspace_join,
    suffix_pieces,
    token_counts,
    toxicity_knn,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_host_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_links.judge_urls(_table(spark, sf_dir, "pages"))


def op3_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace_join.near_vectors(_table(spark, sf_dir, "embeddings"), 0.93)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_knn.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_votes.digests(pii_votes.find_spans(_table(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_pieces.round_trips(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return host_quality.judge(docs).select("doc_id", *host_quality.FIGURES, "base_failed", F.round("host_rate", 6).alias("host_rate"), "kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(_table(spark, sf_dir, "documents"))
    return ranked_search.search(index, _table(spark, sf_dir, "benchmark"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_host_links, op3_setsketch_dedup, op4_line_windows, op5_subspace_join,
    op6_toxicity, op7_pii_votes, op8_packing, op9_suffix_pieces, op10_host_quality, op11_prefix_trie,
    op12_ranked_search, op13_language_id, pipeline,
)}
ORACLES = {
    "op4_line_windows": line_windows.ORACLE, "op10_host_quality": host_quality.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE, "op12_ranked_search": ranked_search.ORACLE,
}
