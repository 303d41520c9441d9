"""The corpus pipeline: each stage works on all documents that the one before it kept.

Quality rules drop what they reject; of each class of near copies one document
with the least doc_id stays; contaminated documents go; secrets are redacted;
the last stage encodes what is left.  ``run`` writes each stage to the shared
folder and reads it back, so a lost executor never costs an earlier stage.

All stages: each row goes or stays by its own text, so rows that share a doc_id
or have none never stand for each other.  Null texts count as texts without
words.  Columns other than doc_id and text are kept as they are, whatever their
names (but for ``n_chars``, which follows the redacted text), up to the last
stage, which returns results of its own.  An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import byte_bpe, decontam, jaccard_join, quality_rules, scratch, secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the current policy keeps, by the failure bits of a written ledger.

    Null and empty texts have too few words and go.  Repeated rows go or stay together.
    """
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, 0.8).

    The least doc_id stays, null ids after all others; of rows equal in id the one
    with the least text hash, of rows equal in both any one.  Rows without words
    are near copies of nothing and all stay.
    """
    return jaccard_join.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by a benchmark item; null and empty texts stay.

    Equal texts have equal verdicts, which go by a 64-bit hash of the text.
    """
    own = docs.select(F.struct(*docs.columns).alias("own"), F.xxhash64("text").alias("h"))
    verdicts = decontam.op1(docs.select(F.xxhash64("text").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = verdicts.where("contaminated").select(F.col("doc_id").alias("bad")).distinct()
    return own.join(bad, F.col("h") == F.col("bad"), "left_anti").select("own.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every found secret replaced by a mark; null texts stay null."""
    ledger = secrets.update(spark, docs, scratch.new_path(spark, "secret-ledger"))
    changed = secrets.redacted(docs, ledger)
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text with digests, and ``same``: whether decoding them gave the text back; a null text has no ids."""
    return byte_bpe.tokenised(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("byte-level BPE", tokens),
]

#: The near-duplicate classes and the BPE ids have no SQL; tests hold run() against a plain re-implementation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch.run() as tables:
        for name, stage in STAGES[:-1]:
            docs = scratch.durable(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
            tables.sweep(spark, keep=1)  # what led to this stage's rows is no longer read
        out = STAGES[-1][1](spark, docs, sf_dir)
    scratch.adopt(tables)
    return out
