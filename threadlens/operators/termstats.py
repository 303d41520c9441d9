"""Term counts and TF-IDF of buckets, in long form (bucket, term, value)."""

from __future__ import annotations

import os
import zipfile
from datetime import timedelta
from functools import cache
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import intervals
from ..functions import text as X
from . import timebuckets


@cache
def spanish_stop_words() -> tuple[str, ...]:
    """The Spanish stop words that Spark ships, read from its library so that no session is needed."""
    package = Path(pyspark.__path__[0])
    homes = [package, *package.parents, *([Path(home)] if (home := os.environ.get("SPARK_HOME")) else [])]
    jar = next(jar for home in homes for jar in home.glob("jars/spark-mllib_*.jar"))
    with zipfile.ZipFile(jar) as z:
        return tuple(dict.fromkeys(z.read("org/apache/spark/ml/feature/stopwords/spanish.txt").decode().split()))


def term_counts(rows: DataFrame, keys: list[str], stop_words: list[str] | None = None, text: str = "cleaned_comment") -> DataFrame:
    return rows.select(*keys, F.explode(X.terms(F.col(text), stop_words)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def counts_by_text(rows: DataFrame, texts: DataFrame, keys: list[str], stop_words: list[str] | None = None, mark: str | None = None) -> DataFrame:
    """``term_counts`` of the non-blank texts that ``rows`` name by text_id; each text (text_id, cleaned_comment) is taken apart once.

    ``mark`` stands among the terms, once for each row.
    """
    held = rows.groupBy(*keys, "text_id").agg(F.count("*").alias("m"))
    lines = texts.select("text_id", X.told(F.col("cleaned_comment"), stop_words).alias("line")).where("line is not null")
    words = X.told_terms(F.col("line"))
    met = held.join(lines, "text_id").select(*keys, "m", F.explode(words if mark is None else F.concat(words, F.array(F.lit(mark)))).alias("term"))
    return met.groupBy(*keys, "term").agg(F.sum("m").alias("n"))


def top_terms(counts: DataFrame, k: int) -> DataFrame:
    """The k terms with most occurrences over all buckets, ties by name."""
    return counts.groupBy("term").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "term").limit(k)


def weighted(counts: DataFrame, size: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """tf * (ln((1 + n) / (1 + df)) + 1), each row of ``keys`` of length one.

    ``counts`` has the vocabulary's terms only; ``size`` has ``n_docs``, the
    non-blank documents of each ``scope`` (of everything if that is empty).
    """
    per_term = counts.withColumn("df", F.count("*").over(Window.partitionBy(*scope, "term")))
    joined = per_term.join(size, scope) if scope else per_term.crossJoin(F.broadcast(size))  # one row
    w = F.col("n") * (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0)
    return joined.withColumn("w", w).withColumn("tfidf", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))).select(*keys, "term", "n", "tfidf")


SAID = ""  # stands among the terms of a bucket for each comment in it


def series(comments: DataFrame, kind: str, top_n: int = 5, stop_words: list[str] | None = None, start: str | None = None, end: str | None = None, strict: bool = False, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts and TF-IDF of the top terms for every bucket, zeros included.

    With ``start`` and ``end`` the vocabulary and the weights are those of the
    range alone and the series covers all of it.  The comments are counted once,
    into a table; with ``texts`` (text_id, cleaned_comment) they name their text by text_id.  ``strict`` raises ValueError where no comment with text or no
    term is found; otherwise the series is then empty.
    """
    if top_n < 1:
        raise ValueError("top_n must be above zero")
    rows = timebuckets.bucketed(timebuckets.between(comments, start, end) if start else comments, kind)
    if texts is None:
        marked = F.concat(X.terms(F.col("cleaned_comment"), stop_words), F.array(F.lit(SAID)))
        each = rows.where(~X.is_blank(F.col("cleaned_comment"))).select("bucket", F.explode(marked).alias("term")).groupBy("bucket", "term").agg(F.count("*").alias("n"))
    else:
        each = counts_by_text(rows, texts, ["bucket"], stop_words, SAID)
    every = shared.durable(each, "bucket-counts")
    said, counts = every.where(F.col("term") == SAID), every.where(F.col("term") != SAID)
    if strict and said.isEmpty():
        raise ValueError("no comment with text")
    if strict and counts.isEmpty():
        raise ValueError("no term besides stop words")
    top = shared.durable(top_terms(counts, top_n), "top-terms")
    kept = counts.join(F.broadcast(top.select("term")), "term")  # top_n rows
    size = said.agg(F.count("*").alias("n_docs"))
    grid = timebuckets.spine(said, kind, start, end).crossJoin(F.broadcast(top.select("term")))
    filled = grid.join(weighted(kept, size, ["bucket"], []), ["bucket", "term"], "left")
    return filled.select("bucket", "term", F.coalesce("n", F.lit(0)).alias("n")), filled.select("bucket", "term", F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"))


def top_terms_by_days(comments: DataFrame, start_date, end_date, top_n: int = 5, stop_words: list[str] | None = None, zone: str = timebuckets.ZONE, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``series`` by day from one date to another, both included; ValueError for dates that are none or out of order, and for nothing to count."""
    first, last = intervals.span(start_date, end_date, zone)
    day = lambda moment, more: str(intervals.local(moment, zone).date() + timedelta(days=more))
    return series(comments, "daily", top_n, stop_words, day(first, 0), day(last, 1), strict=True, texts=texts)


def top_terms_24h(comments: DataFrame, day, top_n: int = 5, stop_words: list[str] | None = None, zone: str = timebuckets.ZONE, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``series`` by hour of one day: 24 buckets."""
    date = intervals.local(day, zone).date()
    return series(comments, "hourly", top_n, stop_words, str(date), str(date + timedelta(days=1)), strict=True, texts=texts)
