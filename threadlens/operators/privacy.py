"""Pseudonyms by salted hashes, and the way back."""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHED = ("comment_id", "author_id", "reply_to_comment_id", "video_id")
DROPPED = ("author_name", "text", "cleaned_comment")


def new_salt() -> str:
    """Sixteen random bytes in hex, made once by the driver."""
    return secrets.token_hex(16)


def pseudonym(value: Column, salt: str) -> Column:
    return F.coalesce(F.sha2(F.concat(value.cast("string"), F.lit(salt)), 256), F.lit(""))


def anonymized(df: DataFrame, salt: str, columns: tuple[str, ...] = HASHED, dropped: tuple[str, ...] = DROPPED) -> DataFrame:
    """One salt for all columns, so ids that were equal stay equal."""
    return df.withColumns({c: pseudonym(F.col(c), salt) for c in columns}).drop(*dropped, "Unnamed: 0")


def id_mapping(df: DataFrame, salt: str, columns: tuple[str, ...] = HASHED) -> DataFrame:
    """(column, anon, original) of every different non-null value."""
    parts = [df.select(F.lit(c).alias("column"), pseudonym(F.col(c), salt).alias("anon"), F.col(c).cast("string").alias("original")).where(F.col(c).isNotNull()).distinct() for c in columns]
    return reduce(DataFrame.unionByName, parts)


def deanonymized(df: DataFrame, mapping: DataFrame, columns: tuple[str, ...] = HASHED) -> DataFrame:
    """Originals where the mapping knows the pseudonym, null elsewhere."""
    for c in columns:
        one = mapping.where(F.col("column") == c).select(F.col("anon").alias("_anon"), F.col("original").alias("_original"))
        # the empty pseudonym of many rows stands for null: such rows are dealt by what else they hold and match nothing
        key = F.when(F.col(c) != "", F.col(c)).otherwise(F.concat(F.lit("#"), F.xxhash64(*df.columns).cast("string")))
        df = df.withColumn("_key", key).join(one, F.col("_key") == F.col("_anon"), "left").withColumn(c, F.col("_original")).drop("_anon", "_original", "_key")
    return df
