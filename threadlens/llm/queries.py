"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, centroids, decontam, jaccard_join, langid, licenses, oracles, personal, quality_knn, quality_rules, resampling, secrets, substring_dedup, token_store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    path = public_tokenizers.path
    return {
        "op1_decontamination": lambda s, d: decontam.op1(_docs(s, d), _table(s, d, "benchmark")),
        "op2_quality_rules": lambda s, d: quality_rules.op2(_docs(s, d)),
        "op3_quality_classifier": lambda s, d: quality_knn.op3(_docs(s, d), _table(s, d, "labels")),
        "op4_token_store": lambda s, d: token_store.op4(_docs(s, d), path("word_bpe_49k.json")),
        "op5_language_id": lambda s, d: langid.op5(_docs(s, d)),
        "op6_secret_scan": lambda s, d: secrets.op6(_docs(s, d)),
        "op7_byte_bpe": lambda s, d: byte_bpe.op7(_docs(s, d), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        "op8_substring_dedup": lambda s, d: substring_dedup.op8(_docs(s, d)),
        "op9_license_scan": lambda s, d: licenses.op9(_docs(s, d)),
        "op10_jaccard_join": lambda s, d: jaccard_join.op10(_docs(s, d)),
        "op11_personal_data": lambda s, d: personal.op11(_docs(s, d)),
        "op12_exponion": lambda s, d: centroids.op12(_table(s, d, "embeddings")),
        "op13_resampling": lambda s, d: resampling.op13(_docs(s, d), _table(s, d, "benchmark")),
        "op2_rule_ablation": lambda s, d: quality_rules.op2_ablation(_docs(s, d)),
        "op10_jaccard_links": lambda s, d: jaccard_join.linked(_docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    """The rest has no SQL: models, tokenizers and an expression parser; tests hold those to plain re-implementations."""
    return {"op1_decontamination": oracles.OP1, "op2_quality_rules": oracles.OP2, "op2_rule_ablation": oracles.OP2_ABLATION, "op6_secret_scan": oracles.OP6, "op8_substring_dedup": oracles.OP8, "op10_jaccard_join": oracles.OP10, "op12_exponion": oracles.OP12, "op13_resampling": oracles.OP13}
