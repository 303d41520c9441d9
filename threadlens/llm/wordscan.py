"""Words of many texts at once: byte tables, offsets, numbers and hashes in numpy.

UTF-8 keeps every byte of a character outside ASCII at 0x80 or above, so word
classes that name ASCII characters only can be read off the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20

#: byte classes: True where the byte belongs to a word
ALNUM = np.ones(256, bool)
ALNUM[:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each stretch data[start:end] among the different ones, and those; compared byte by byte.

    Stretches ascend and do not overlap.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), []
    edges = np.empty(2 * n, np.int64)
    edges[0::2], edges[1::2] = starts, ends
    cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * n - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    coded = cells.take(pa.array(np.arange(0, 2 * n - 1, 2))).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bytes_of(coded.dictionary)


def bytes_of(array: pa.LargeBinaryArray) -> list[bytes]:
    """The values of an array without nulls."""
    _, offsets, data = array.buffers()
    if not len(array):
        return []
    cut = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    whole, cut = data[int(cut[0]) : int(cut[-1])].to_pybytes() if data else b"", (cut - cut[0]).tolist()
    return [whole[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of 64-bit hashes; their order counts."""
    return mix(mix(a, 3) + b, 4)


class Words:
    """The words of some texts, in order; text k has words first[k]:first[k + 1]."""

    def __init__(self, texts: list[bytes], table: np.ndarray, fold: bool):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if fold:
            data = LOWER[data]
        inside = table[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.data, self.starts, self.ends = data, edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.starts, self.base)

    def __len__(self) -> int:
        return len(self.starts)

    @cached_property
    def numbered(self) -> tuple[np.ndarray, list[bytes]]:
        """Each word's number among the different words, and those."""
        return distinct(self.data, self.starts, self.ends)

    @cached_property
    def digests(self) -> np.ndarray:
        """Two unrelated 64-bit hashes of each different word: the halves of its 128-bit xxHash."""
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.numbered[1])), "<u8").reshape(-1, 2).astype(np.uint64)

    def hashes(self, half: int = 0) -> np.ndarray:
        return self.digests[:, half][self.numbered[0]]

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive values; shorter input gives none.

    Stretches of 1, 2, 4, ... values are hashed from their halves, and k is put together from those.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, size, power = None, 0, 1, hashes
    while True:
        if k & size:
            out = power[at : at + n] if out is None else joined(out, power[at : at + n])
            at += size
        if at == k:
            return mix(out, seed + 17)
        power = joined(power[:-size], power[size:])
        size *= 2


def window_numbers(words: Words, k: int) -> np.ndarray:
    """Equal numbers for equal windows of k words, compared word by word; for all windows of the run of texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    out, at, size, power = None, 0, 1, words.numbered[0]
    while True:
        if k & size:
            out = power[at : at + n] if out is None else pairs(out, power[at : at + n])
            at += size
        if at == k:
            return out
        power = pairs(power[:-size], power[size:])
        size *= 2


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null reads as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate(([0], np.cumsum(sizes)))
        at = 0
        while at < len(column):
            to = int(np.searchsorted(total, total[at] + limit, "right")) - 1
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to
