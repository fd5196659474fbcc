"""From raw documents to packed training sequences: STAGES over the documents table.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the
columns of documents; the last one returns packed pieces. `run` writes each stage's rows to the
folder in spark.checkpoint.dir and reads them for the next. The stages use the operators of
`tidemark.llm` as they are: null texts, repeated rows, empty tables and extra columns have the
results stated there. n_chars follows the text wherever a stage changes it.

ORACLE_SQL is None: SQL cannot express the stages private_data and packing. tests/llm holds the whole
pipeline against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import host_quality, line_windows, packing, pii_votes, setsketch_dedup
from tidemark.session import stage


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with n_chars (if there) as the length of the text."""
    return docs.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose host is rejected, go."""
    return host_quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages go from the texts; every document stays."""
    return _recounted(line_windows.dedup_lines(docs), docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    dropped = setsketch_dedup.near_duplicates(docs, width=5, num=80, den=100).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _recounted(pii_votes.masked(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup),
    ("private_data", private_data), ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; returns the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
