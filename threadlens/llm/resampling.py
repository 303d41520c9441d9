"""Importance resampling towards a target distribution, over hashed word n-grams.

Words are found on the bytes of Arrow's UTF-8 buffers: a table classifies every
byte, differences of neighbours give word edges, and a table-driven CRC-32 takes
one byte of every word at once, longest words first, so that the words still
running are always a prefix.  From LONG bytes on, what is left of the few words
that long is fed to zlib, which goes on from the same state.  A run of several
words goes on from the state of its first words, over a blank and the next word.

Corpus and target are counted by bucket (``buckets`` numbers at most leave each
task, and as many reach the driver); a bucket's gain is the scaled, floored
logarithm of its smoothed likelihood ratio, and a document's weight the floored
mean of its features' gains.  ``drawn`` adds Gumbel noise that follows from the
document's id and keeps the highest scores: sampling without replacement with
probabilities in proportion to exp(weight / 1000).

Null and empty texts have no features and weight 0.  Repeated rows count each
and may each be drawn; ties in score and id, and null ids (which share one noise
and come after all others), are ordered by where the rows were read.  An empty
corpus gives an empty table; with an empty target all its counts are 0.  Only
``doc_id`` and ``text`` are read, whatever else the tables hold.  A very long
text is read whole by one task, a very long word by zlib.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .wordscan import ALNUM, LOWER, slices

LONG = 64
POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


TABLE = crc_table()


class Buffer:
    """Words in the UTF-8 buffer of a column; text k has words first[k]:first[k + 1].  Null reads as empty."""

    def __init__(self, column: pa.Array):
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        cut = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8)[cut[0] : cut[-1]] if data else np.zeros(0, np.uint8)
        self.data, cut = LOWER[data], cut - cut[0]
        inside = ALNUM[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = cut[(cut > 0) & (cut < len(data))]  # a word never goes on in the next text
        begins[edge], ends[edge - 1] = inside[edge], inside[edge - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, cut)
        self.counts = np.diff(self.first)


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC states after the bytes start:end of each stretch, one byte of every stretch at a time."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, run = starts[order], state[order]
    left = np.cumsum(np.bincount(np.minimum(sizes, LONG), minlength=LONG + 1)[::-1])[::-1]  # left[j]: stretches of j bytes at least
    for j in range(LONG):
        n = int(left[j + 1])
        if not n:
            break
        run[:n] = TABLE[(run[:n] ^ data[at[:n] + j]) & 255] ^ (run[:n] >> 8)
    for k in range(int(left[LONG])):
        stop = at[k] + sizes[order[k]]
        run[k] = np.uint32(zlib.crc32(data[at[k] + LONG : stop].tobytes(), int(run[k] ^ ONES))) ^ ONES
    out = np.empty_like(run)
    out[order] = run
    return out


def hashed(words: Buffer, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, CRC-32) of every run of 1 to ``most`` consecutive words joined by one blank."""
    n = len(words.starts)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    last = np.repeat(words.first[1:], words.counts)
    state, live = advance(np.full(n, ONES, np.uint32), words.data, words.starts, words.ends), np.arange(n)
    owners, found = [text], [state]
    for k in range(1, most):
        goes_on = live + k < last[live]
        state, live = state[goes_on], live[goes_on]
        state = TABLE[(state ^ np.uint32(0x20)) & 255] ^ (state >> 8)
        state = advance(state, words.data, words.starts[live + k], words.ends[live + k])
        owners.append(text[live])
        found.append(state)
    return np.concatenate(owners), np.concatenate(found) ^ ONES


@dataclass(frozen=True)
class Features:
    order: int = 1  # words in a run at most
    buckets: int = 10_000

    def __post_init__(self) -> None:
        if self.order < 1 or self.buckets < 1:
            raise ValueError("order and buckets must be above zero")

    def of(self, words: Buffer) -> tuple[np.ndarray, np.ndarray]:
        text, crc = hashed(words, self.order)
        return text, (crc % np.uint32(self.buckets)).astype(np.int64)


def counted(docs: DataFrame, features: Features = Features()) -> np.ndarray:
    """How often each bucket occurs in all texts: a sum of at most ``buckets`` numbers of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(features.buckets, np.int64)
        for batch in slices(batches):
            total += np.bincount(features.of(Buffer(batch.column(0)))[1], minlength=features.buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["bucket", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(features.buckets, np.int64)
    for bucket, n in rows.collect():  # one row a bucket
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the ratio of the target's share to the corpus' share), both smoothed by one in each bucket."""
    n = len(corpus)
    whole, aim = float(int(corpus.sum()) + n), float(int(target.sum()) + n)
    return np.array([math.floor(scale * math.log((t + 1) * whole / ((s + 1) * aim))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, features: Features = Features()) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Buffer(batch.column(1))
            text, bucket = features.of(words)
            n = np.bincount(text, minlength=len(words.counts))
            total = np.zeros(len(n), np.int64)
            np.add.at(total, text, gain[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.counts.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int | str) -> F.Column:
    """Gumbel noise in thousandths, from the first 32 bits of SHA-256 of ``seed:doc_id``."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def drawn(weights: DataFrame, percent: int = 10, least_words: int = 20, seed: int | str = 2024) -> DataFrame:
    """``weights`` with score and rank; a rank for the ``percent`` of the rows of ``least_words`` words that score highest.

    Rows are dealt by ranges of (score, doc_id, place read), which no two rows share, so neither equal scores
    nor repeated ids fill a range.  A row's rank is its place in its range and the sizes of the ranges before.
    """
    row = F.monotonically_increasing_id()
    scored = scratch.durable(weights.withColumn("score", F.col("weight") + noise(seed)).withColumn("row", row), "resampling-scores")
    eligible = F.col("n_words") >= least_words
    quota = percent * scored.where(eligible).count() // 100
    # scores are whole numbers of a bounded range (some ten thousands of values), whatever the number of rows
    levels = scored.where(eligible).groupBy("score").agg(F.count("*").alias("n"))
    above = levels.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n"))
    lowest = above.where(F.col("above") < quota).agg(F.min("score")).first()[0]
    in_reach = eligible & (F.col("score") >= F.lit(lowest)) if lowest is not None else F.lit(False)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    ranged = scratch.durable(scored.where(in_reach).repartitionByRange(*order).withColumn("piece", F.spark_partition_id()), "resampling-ranges")
    sizes = ranged.groupBy("piece").agg(F.count("*").alias("n"))  # one row a range
    before = sizes.select("piece", (F.sum("n").over(Window.orderBy("piece")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("piece").orderBy(*order)) + F.col("before")
    ranked = ranged.join(F.broadcast(before), "piece").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")).cast("long"))
    rest = scored.where(~in_reach).withColumn("rank", F.lit(None).cast("long"))
    columns = [*weights.columns, "score", "rank"]
    return ranked.select(columns).unionByName(rest.select(columns))


def resampled(docs: DataFrame, target: DataFrame, features: Features = Features(), percent: int = 10, least_words: int = 20, seed: int | str = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``, drawn towards the texts of ``target``."""
    return drawn(weighed(docs, gains(counted(docs, features), counted(target, features)), features), percent, least_words, seed)


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resampled(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
