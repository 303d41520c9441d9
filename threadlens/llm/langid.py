"""Language by multinomial naive Bayes over hashed character n-grams.

Counts of n-grams of 1 to 3 letters are learned from a bounded sample:
PER_LANGUAGE documents of each language at most, those with the least hashes of
doc_id and text, however many rows share an id, a text or both; the prior of a
language is its share of all documents that may be learned from.  The
log-probability matrix (BUCKETS rows, one column a language) goes to every
executor in blocks of COLUMNS languages, so any number of languages will do; a
batch is scored by gathering rows and adding them up by document, block after
block.  The language with the largest posterior is predicted.  ``score`` is a
tempered posterior: overlapping n-grams are far from independent, so there the
evidence counts by the root of its length.

``lang_pred`` is ``und`` with score 0 where a text is null or has no letter, or
where nothing could be learned.  Ties go to the smaller language name.  Repeated
rows give repeated results; a null ``doc_id`` stays null and counts as held out
by no rule.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .wordscan import mix, slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 4000
COLUMNS = 64  # languages whose part of the matrix is broadcast at once: 17 MB
FIT_PARTS = 8
PLACES = 1 << 30

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order the hashed n-grams of all texts and each text's first one; whether a text has a letter.

    Letters are lower-cased; whatever else stands between words becomes one blank.
    """
    joined = "\n".join((t or "").lower().replace("\n", " ") for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = points == 10
    alpha = letters()[points]
    blank = ~alpha
    keep = alpha | ends
    keep[1:] |= ~blank[:-1]  # the first blank after a letter
    points = np.where(blank & ~ends, np.uint32(32), points)[keep].astype(np.uint64)
    ends = points == 10
    first = np.concatenate(([0], np.flatnonzero(ends)[:-1] + 1))
    has = np.add.reduceat(letters()[points.astype(np.uint32)].astype(np.int64), first) > 0
    out, value = [], np.zeros(len(points), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        value = value[: len(points) - order + 1] << np.uint64(21) | points[order - 1 :]
        if order in ORDERS:
            padded = np.full(len(points), BUCKETS, np.int64)
            padded[: len(value)] = (mix(value, order) >> np.uint64(48)).astype(np.int64)
            for k in range(order):  # none that holds a text's end
                padded[: len(points) - k][ends[k:]] = BUCKETS
            out.append(padded)
    return out, [first] * len(out), has


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS + 1 rows; the last one, of no n-gram, is zero
    prior: np.ndarray  # logarithms

    def parts(self, columns: int) -> list[Model]:
        return [Model(self.languages[k : k + columns], self.table[:, k : k + columns], self.prior[k : k + columns]) for k in range(0, len(self.languages), columns)]

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logarithm of each text's probability in each language, the number of its n-grams and whether it has a letter."""
        found, firsts, has = grams(texts)
        total, number = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for ids, first in zip(found, firsts, strict=True):
            for column in range(len(self.languages)):
                total[:, column] += np.add.reduceat(self.table[:, column][ids], first, dtype=np.float64)
            number += np.add.reduceat((ids < BUCKETS).astype(np.int64), first)
        return total, number, has


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(rows: DataFrame, place: Column, known: dict, per_language: int) -> DataFrame:
    """At most ``per_language`` rows of each language, those of the least places; ``known`` has each language's n and least place."""
    # a margin of four keeps enough rows for the cut, the least place at least one; equal rows fall together and are cut there
    margins = F.create_map(*[F.lit(x) for name, r in known.items() for x in (name, max(int(min(1.0, 4 * per_language / r.n) * PLACES), r.least + 1))])
    near = rows.select("doc_id", "text", "lang", place.alias("place")).where(F.col("place") < F.element_at(margins, F.col("lang")))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    return near.withColumn("at", order).where(F.col("at") <= per_language)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from ``docs`` (text, lang); rows without a language or a text teach nothing."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(PLACES))
    known = {r.lang: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("least")).toLocalIterator()}
    languages = sorted(known)
    sizes = {name: r.n for name, r in known.items()}
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0))
    chosen = sample(rows, place, known, per_language)
    number = {name: k for k, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            names = batch.column(1).to_pylist()
            found, firsts, _ = grams(batch.column(0).to_pylist())
            whose = np.array([number[n] for n in names])
            for ids, first in zip(found, firsts, strict=True):
                owner = np.repeat(whose, np.diff(np.append(first, len(ids))))
                for k in set(whose.tolist()):
                    counts[k] = counts.get(k, 0) + np.bincount(ids[owner == k], minlength=BUCKETS + 1)
        for k, found in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([found[:BUCKETS].astype("<i8").tobytes()], pa.binary())], ["k", "counts"])

    parts = chosen.select("text", "lang").repartition(FIT_PARTS).mapInArrow(count, "k int, counts binary")
    counts = np.zeros((BUCKETS + 1, len(languages)), np.float32)
    for row in parts.toLocalIterator():
        counts[:BUCKETS, row.k] += np.frombuffer(row.counts, "<i8")
    table = np.log((counts + 0.5) / (counts.sum(0, dtype=np.float64) + 0.5 * BUCKETS).astype(np.float32))
    table -= table.mean(1, keepdims=True)  # the same for all languages: it changes no posterior
    table[BUCKETS] = 0
    every = np.array([sizes[name] for name in languages], float)
    return Model(languages, table.astype(np.float32), np.log(every / every.sum()))


STATE = "doc_id bigint, text string, best double, lang_pred string, top double, mass double"
_STATE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("best", pa.float64()), ("lang_pred", pa.string()), ("top", pa.float64()), ("mass", pa.float64())])


def predicted(docs: DataFrame, model: Model, columns: int = COLUMNS) -> DataFrame:
    """doc_id, lang_pred and score of every text."""
    none = F.lit(None)
    rows = docs.select("doc_id", "text", none.cast("double").alias("best"), none.cast("string").alias("lang_pred"), none.cast("double").alias("top"), none.cast("double").alias("mass"))

    def step(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = sent.value
            for batch in slices(batches, limit=1 << 20):
                total, number, has = part.evidence(batch.column(1).to_pylist())
                full = total + part.prior
                tempered = total / np.sqrt(np.maximum(number, 1))[:, None] + part.prior
                k = full.argmax(1)
                best, names = full.max(1), [part.languages[x] for x in k.tolist()]
                # the best language so far, its tempered evidence, and the sum of all tempered evidence relative to it
                top = tempered[np.arange(len(k)), k]
                mass = np.exp(np.minimum(tempered - top[:, None], 700)).sum(1)
                before, said, high, held = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("best", "lang_pred", "top", "mass"))
                old = np.array([x is not None for x in said], bool)
                stay = old & (np.where(old, before, 0) >= best)
                scale = np.exp(np.clip(np.where(old, high, top) - top, -700, 700))
                mass = np.where(stay, np.where(old, held, 0) + mass / scale, mass + np.where(old, held, 0) * scale)
                letters = pa.array(has)
                names = pa.array([x if s else y for s, x, y in zip(stay.tolist(), said, names, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.where(stay, before, best)), pc.if_else(letters, names, "und"), pa.array(np.where(stay, high, top)), pc.if_else(letters, pa.array(mass), np.inf)], schema=_STATE)

        return run

    for part in model.parts(columns):
        rows = rows.mapInArrow(step(docs.sparkSession.sparkContext.broadcast(part)), STATE)
    return rows.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce(1 / F.col("mass"), F.lit(0.0)).alias("score"))


def op5(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out()))
    return predicted(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
