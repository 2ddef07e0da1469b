"""From raw documents to token ids: quality, copies, benchmark leaks, secrets, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; ``run`` writes it to the shared
folder and reads it back for the next. All but the last keep the columns of ``documents``. Missing
ids and texts are allowed: a NULL text is empty, and a row without an id is never a copy or a leak.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import bpe, decontamination, near_dup, quality, secrets
from gazette.llm.common import table
from gazette.llm.queries import ranks_path
from gazette.sources.scratch import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones selects."""
    return quality.resampled(docs, table(spark, sf_dir, "labels")).where("selected").select(
        docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8."""
    return near_dup.without_copies(docs).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark")).select(
        docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark and its length counted again."""
    found = secrets.find_spans(docs, ranks_path(), public_tokenizers.PATTERN)
    clean = found.withColumn("text", secrets.without_spans(F.col("text"), F.col("spans")))
    changed = (F.size("spans") > 0) & F.col("text").isNotNull()
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(
        F.col("n_chars"))).select(docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document in place of its text, and the digest of their bytes."""
    # Written in between: a task holds one Python process with its codec, not two.
    coded = written(bpe.encode(docs, ranks_path(), public_tokenizers.PATTERN).drop("text"),
                    "token-ids")
    back = bpe.decode(coded, ranks_path(), public_tokenizers.PATTERN)
    return back.withColumns({"n_tokens": F.size("ids").cast("bigint"),
                             "decoded_sha256": F.sha2("decoded", 256)}).drop("decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("byte-level BPE", tokens_stage),
]

# The models and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
