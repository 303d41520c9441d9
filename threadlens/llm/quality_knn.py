"""Quality by a similarity-weighted vote of the nearest labelled documents.

Documents become hashed term counts: words, and pseudo-terms for the binned
shape of the text (symbols, capitals, repetition, line and word lengths).  A
bounded labelled sample (PER_LABEL documents of each label, by a hash of
doc_id) gives idf weights and, through a randomised SVD, a latent-semantic
space.  Its labelled vectors go to every executor; each block of documents is
projected and compared with all of them by one exact matrix product, and the
NEIGHBOURS most similar vote with their cosines.

Scores lie in 0 to 1; null and empty texts are scored by their shape alone, and
0.5 stands where nothing could be learned.  Repeated rows give repeated
results; a null ``doc_id`` stays null and is never learned from; of rows that
share a labelled doc_id the one with the least text hash is learned from.  The
sample is in order of doc_id, and of neighbours with equal cosines those earlier
in it count.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordscan import NONSPACE, Words, slices, texts_of

TERMS = 1 << 13
BINS, SHAPES = 12, 10
PER_LABEL = 2500
DIMENSIONS, NEIGHBOURS = 48, 9
SHAPE_WEIGHT = 8.0

_CLASS = np.zeros(256, np.uint8)  # 1 letter or byte of one, 2 capital, 3 digit, 4 symbol, 5 other mark
_CLASS[0x21:0x7F] = 5
_CLASS[[ord(c) for c in "#*$%&|<>@^~_=+\\/{}[]"]] = 4
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[0x80:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of the texts: document, term and weight (before idf), sorted by document and term."""
    words = Words(texts, NONSPACE, fold=False)
    n, first = np.diff(words.first), words.first
    hashes = words.hashes()
    owner = np.repeat(np.arange(len(texts)), n)
    ids = (hashes >> np.uint64(40)).astype(np.int64) % (TERMS - BINS * SHAPES)
    key, count = np.unique(owner * TERMS + ids, return_counts=True)
    weight = 1 + np.log(count)

    kind = _CLASS[words.data]
    totals = np.concatenate((np.zeros((1, 5), np.int64), np.cumsum(np.stack([kind == k for k in range(1, 6)], 1), 0)))
    by = (totals[words.base[1:]] - totals[words.base[:-1]]).astype(float)
    chars = np.maximum(by.sum(1), 1)
    some = np.maximum(n, 1)
    lines = np.add.reduceat((words.data == 10).astype(np.int64), words.base[:-1])
    same = np.zeros(len(hashes) + 1)
    same[1:-1] = np.cumsum((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])) if len(hashes) > 1 else 0
    if len(hashes):
        same[-1] = same[-2]
    again = same[np.maximum(first[1:], 1) - 1] - same[np.minimum(first[:-1], len(same) - 1)] if len(hashes) else np.zeros(len(texts))
    different = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)], float)
    shape = np.stack([
        by[:, 3] / chars * 4, by[:, 1] / chars, by[:, 2] / chars * 2, by[:, 4] / chars * 2, different / some, again / some,
        (chars / some) / 15, lines / some * 4, np.log1p(n) / 12, by[:, 3] / some,
    ], 1)
    place = np.clip((shape * BINS), 0, BINS - 1.001)
    low = np.floor(place).astype(np.int64)
    part = place - low  # a value between two bins counts for both
    base = TERMS - BINS * SHAPES + np.arange(SHAPES) * BINS
    rows = np.repeat(np.arange(len(texts)), SHAPES) * TERMS
    scale = SHAPE_WEIGHT * np.sqrt(1 + np.log1p(n))[:, None]
    keys = np.concatenate((key, rows + (base + low).ravel(), rows + (base + np.minimum(low + 1, BINS - 1)).ravel()))
    weights = np.concatenate((weight, ((1 - part) * scale).ravel(), (part * scale).ravel()))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    return keys // TERMS, keys % TERMS, weights.astype(np.float32)


def _dense(n: int, rows: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """n x TERMS, each row of length one; the caller bounds n."""
    out = np.bincount(rows * TERMS + ids, weights, n * TERMS).reshape(n, TERMS).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest values of each row, ascending; of equal values the first ones."""
    last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    above, level = cosine > last, cosine == last
    seats = k - above.sum(1, keepdims=True)
    taken = above | level & (np.cumsum(level, axis=1) <= seats)
    return np.nonzero(taken)[1].reshape(-1, k)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # TERMS x DIMENSIONS
    vectors: np.ndarray  # one row of length one for each labelled document
    labels: np.ndarray

    def project(self, texts: list[bytes]) -> np.ndarray:
        rows, ids, weights = terms(texts)
        weights = weights * self.idf[ids]
        out = np.zeros((len(texts), self.basis.shape[1]), np.float32)
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        out[rows[starts]] = np.add.reduceat(self.basis[ids] * weights[:, None], starts, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.labels) or not texts:
            return np.full(len(texts), 0.5)
        own, out = self.project(texts), np.zeros(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(own), 512):  # blocks of documents against all labelled vectors
            cosine = own[at : at + 512] @ self.vectors.T
            near = nearest(cosine, k)
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) ** 4
            out[at : at + 512] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL) -> Model:
    """Learn from labelled documents: ``per_label`` of each of the labels 0 and 1 at most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))
    order = F.xxhash64("doc_id")
    chosen = known.where("label = 0").orderBy(order, "doc_id").limit(per_label).unionByName(known.where("label = 1").orderBy(order, "doc_id").limit(per_label))
    # at most 2 * per_label ids: small enough to be sent to every executor
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch.column(1))
            rows, ids, weights = terms(texts)
            cut = np.searchsorted(rows, np.arange(len(texts) + 1))
            ids, weights = ids.astype("<u2"), weights.astype("<f4")
            parts = [(ids[a:b].tobytes(), weights[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], ["doc_id", "label", "ids", "weights"])

    # one row for each labelled id, however many documents share it
    one = sample.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = sorted(one.select("doc_id", "text", "label").mapInArrow(features, "doc_id bigint, label int, ids binary, weights binary").toLocalIterator())
    if not got:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    ids = [np.frombuffer(r.ids, "<u2").astype(np.int64) for r in got]
    weights = [np.frombuffer(r.weights, "<f4") for r in got]
    frequency = np.zeros(TERMS)
    for x in ids:
        frequency[np.unique(x)] += 1
    idf = np.log((1 + len(got)) / (1 + frequency)).astype(np.float32)
    idf[TERMS - BINS * SHAPES :] = 1.0

    def blocks() -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, len(got), 256):
            part = range(at, min(at + 256, len(got)))
            rows = np.repeat(np.arange(len(part)), [len(ids[i]) for i in part])
            which = np.concatenate([ids[i] for i in part])
            yield slice(at, at + len(part)), _dense(len(part), rows, which, np.concatenate([weights[i] for i in part]) * idf[which])

    basis = np.random.Generator(np.random.PCG64(7)).standard_normal((TERMS, DIMENSIONS + 8)).astype(np.float32)
    for _ in range(4):  # subspace iteration on the term side
        turned = np.zeros_like(basis)
        for _, x in blocks():
            turned += x.T @ (x @ basis)
        basis = np.linalg.qr(turned)[0]
    seen = np.concatenate([x @ basis for _, x in blocks()])
    rotation = np.linalg.svd(seen.T @ seen)[0][:, :DIMENSIONS].astype(np.float32)
    vectors = seen @ rotation
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Model(idf, basis @ rotation, vectors, np.array([r.label for r in got], float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(texts_of(batch.column(1))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.where(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
