"""Joins on keys of which some may carry a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 10_000  # hot keys at most, by construction
LEAST = 32  # rows that any key may have in one task


def joined(rows: DataFrame, keyed: DataFrame, key: str, sizes: DataFrame, total: int, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each ``key``.

    ``sizes`` (key, size) counts the rows of each key and ``total`` all rows.  A
    key is hot from max(LEAST, total / MOST) rows on, so there are MOST hot keys
    at most: they alone are broadcast, with a number of salts each, and ``keyed``
    is repeated for those.  ``by`` deals the rows of a hot key over its salts.
    Rows without a key never meet others; ``how`` "left" keeps them.
    """
    bound = max(LEAST, total // MOST)
    hot = F.broadcast(sizes.where(F.col("size") > bound).select(F.col(key).alias("_hot"), F.ceil(F.col("size") / bound).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    known = rows.where(F.col(key).isNotNull())
    left = known.join(hot, known[key] == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_hot", "_salts")
    right = keyed.join(hot, keyed[key] == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hot", "_salts")
    out = left.join(right, [key, "_salt"], how).drop("_salt")
    if how != "left":
        return out
    extra = [c for c in out.columns if c not in rows.columns]
    kinds = {f.name: f.dataType for f in out.schema}
    none = rows.where(F.col(key).isNull()).select(*rows.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in extra])
    return out.unionByName(none)
