"""Summaries by truncated latent semantic analysis.

The term by sentence matrix has, as the published weighting has it, 0.4 + 0.6 f / m
for a term that occurs f times in a sentence whose most frequent term occurs m
times, and 0.4 for every term of the text that a sentence lacks.  So it is a sparse
matrix plus a matrix of rank one, and is never filled: the largest singular values
come from Golub-Kahan-Lanczos bidiagonalisation, whose steps multiply by both.
A sentence's weight is the length of its vector in the dimensions kept, the root of
the sum of (singular value * component)^2 (Steinberger and Jezek, 2004).

Time grows with the words of a text times the steps, memory with (terms +
sentences) times the steps; a text is handled by one task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import BLANKS, EMPTY_TEXT, NO_SUMMARY, _SENTENCE, _WORD

SMOOTH = 0.4
HALF = 0.5  # dimensions below this share of the largest singular value say little, as published
CLOSE = 1e-10  # of the largest singular value
HELD = 100  # texts


class TermMatrix:
    """The weights of a text's terms (rows) in its sentences (columns); a sentence without words has none."""

    def __init__(self, sentences: list[str]):
        numbers: dict[str, int] = {}
        row, column, value = [], [], []
        for j, sentence in enumerate(sentences):
            counts = Counter(_WORD.findall(sentence.lower()))
            most = max(counts.values(), default=1)
            for term, c in counts.items():
                row.append(numbers.setdefault(term, len(numbers)))
                column.append(j)
                value.append((1 - SMOOTH) * c / most)
        self.shape = (len(numbers), len(sentences))
        self.row, self.column, self.value = np.array(row, np.int64), np.array(column, np.int64), np.array(value)
        self.worded = np.zeros(len(sentences))
        self.worded[self.column] = 1.0

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * x[self.column], self.shape[0]) + SMOOTH * float(self.worded @ x)

    def turned(self, y: np.ndarray) -> np.ndarray:
        """The transpose times y."""
        return np.bincount(self.column, self.value * y[self.row], self.shape[1]) + SMOOTH * float(y.sum()) * self.worded

    def dense(self) -> np.ndarray:
        out = SMOOTH * np.ones((self.shape[0], 1)) * self.worded
        np.add.at(out, (self.row, self.column), self.value)
        return out


def _unit(rng: np.random.Generator, basis: np.ndarray) -> np.ndarray | None:
    """A unit vector at right angles to the rows of ``basis``; None where they span everything."""
    if len(basis) >= basis.shape[1]:
        return None
    for _ in range(5):
        x = _freed(rng.standard_normal(basis.shape[1]), basis)
        size = float(np.linalg.norm(x))
        if size > 1e-8:
            return x / size
    return None


def truncated(matrix: TermMatrix, rank: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values, in descending order, and their right vectors as rows.

    ``rank`` of them, or with None all that reach half of the largest.  Values that are zero
    within rounding are left out.  A space that repeats itself (breakdown) goes on from a new
    direction, drawn with a fixed seed, so values that occur several times are found as often.
    """
    m, n = matrix.shape
    if not m or not n:
        return np.zeros(0), np.zeros((0, n))
    rng = np.random.Generator(np.random.PCG64(7))
    most = min(m, n)
    scale = math.sqrt(float(matrix.value @ matrix.value)) + SMOOTH * math.sqrt(m * n)
    tiny = 1e-13 * scale
    room = min(n, 16)
    left, right = np.zeros((room, m)), np.zeros((room, n))  # one direction a row
    alphas: list[float] = []
    betas: list[float] = []
    v = rng.standard_normal(n)
    v /= np.linalg.norm(v)
    check = 6 if rank is None else rank + 4
    while True:
        k = len(alphas)
        if k == room:
            room = min(n, 2 * room)
            left, right = np.pad(left, ((0, room - k), (0, 0))), np.pad(right, ((0, room - k), (0, 0)))
        right[k] = v
        u = _freed(matrix.times(v), left[:k])
        alpha = float(np.linalg.norm(u))
        if alpha > tiny:
            left[k] = u / alpha
        else:
            alpha, fresh = 0.0, _unit(rng, left[:k])
            if fresh is not None:  # else they span everything, and the row stays zero
                left[k] = fresh
        alphas.append(alpha)
        w = _freed(matrix.turned(left[k]), right[: k + 1])
        beta = float(np.linalg.norm(w))
        if k + 1 == n:
            break
        if k + 1 == check or k + 1 >= most:
            check = k + 5
            if beta > tiny and _settled(alphas, betas, beta, rank):
                break
        if beta > tiny:
            v = w / beta
            betas.append(beta)
        else:
            v = _unit(rng, right[: k + 1])
            if v is None:
                break
            betas.append(0.0)
    p, s, q = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
    keep = s > 1e-9 * max(s[0], 1e-300)
    keep &= (np.arange(len(s)) < rank) if rank is not None else (s >= HALF * s[0])
    return s[keep], q[keep] @ right[: len(alphas)]


def _freed(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``x`` without its parts along the rows of ``basis``; taken out twice, which is enough for full orthogonality."""
    for _ in range(2):
        x = x - (basis @ x) @ basis
    return x


def _settled(alphas: list[float], betas: list[float], beta: float, rank: int | None) -> bool:
    """Whether the values asked for have converged and, with no rank, the next one lies below the half within its error."""
    p, s, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
    error = beta * np.abs(p[-1])
    wanted = rank if rank is not None else int((s >= HALF * s[0]).sum())
    if wanted >= len(s) or (error[:wanted] > CLOSE * s[0]).any():
        return False
    return rank is not None or s[wanted] + error[wanted] < HALF * s[0]


def summary(text: str, n: int = 5, rank: int | None = None) -> tuple[str, int]:
    """The ``n`` weightiest sentences in document order, and how many dimensions weighed them.

    Equal weights (at nine places) go to the earlier sentence.  A text of at most ``n`` sentences is its
    own summary, weighed in no dimension; one without any is the fixed message.
    """
    if not text.strip():
        return EMPTY_TEXT, 0
    sentences = [s for x in _SENTENCE.findall(text) if (s := x.strip(BLANKS))]
    if len(sentences) <= n:
        return " ".join(sentences), 0
    values, vectors = truncated(TermMatrix(sentences), rank)
    weight = np.round(np.sqrt(((values[:, None] * vectors) ** 2).sum(0)), 9) if len(values) else np.zeros(len(sentences))
    chosen = np.sort(np.argsort(-weight, kind="stable")[:n])
    return " ".join(sentences[i] for i in chosen), len(values)


def summarised(df: DataFrame, text: str, key: str = "doc_id", n: int = 5, rank: int | None = None) -> DataFrame:
    """(key, summary, n_dims) of every row, null texts as empty; a failure on one text leaves the fixed message there."""
    if n < 1 or rank is not None and rank < 1:
        raise ValueError("a summary needs at least one sentence and one dimension")

    def one(value: str | None) -> tuple[str, int]:
        try:
            return summary(value or "", n, rank)
        except Exception:  # a summariser must not end the job for one text
            return NO_SUMMARY, 0

    kind = dict(df.dtypes)[key]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, batch.num_rows, HELD):  # of a batch only so many texts are strings at a time
                part = batch.slice(at, HELD)
                made = [one(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int32())], names=["key", "summary", "n_dims"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, summary string, n_dims int")
    return rows.withColumnRenamed("key", key)
