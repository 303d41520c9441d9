"""Repeated passages by a relative Lempel-Ziv parse against a distributed index.

Documents are packed into blocks, and every block is a reference block: a hash
index dealt over buckets knows for each stretch of WINDOW words that can repeat
where in all blocks it first stands.  What the index returns to a block is its
part of the reference: the earlier passages, put together from overlapping
stretches, with their documents and places.  Each document is then factored
greedily against those passages: from the left, the longest run of words that
continues at one earlier place becomes a factor (start, length, source, source
start), the least source on ties; words where none of WINDOW words starts are
literals.  At the end of each factor the runs that start inside it and cross its
end are looked up as well, so a passage is found whichever way the parse was
cut, and every repeated stretch is covered.  Runs are compared word by word.
Factors and literals give the text back; the words of factors are the duplicate
spans.

Only stretches that can repeat are indexed.  Every stretch of WINDOW words picks
one of its SEED-word seeds (the one with the least hash, leftmost on ties):
equal stretches pick equal seeds, so a stretch whose seed is unique in the
corpus is unique too.  A block sends each seed and each stretch once, whatever
the number of copies it holds, and gets back one bit for each: a passage that a
third of all documents share costs every index block one row a document block.
A block sends a bucket nothing it has no seed for, so its rows are bounded by
its own seeds, at any number of buckets.

Order: documents by doc_id (null first), then by a hash of the text; places by
start.  Rows with equal doc_id and text are one document and get equal results.
Null and empty texts have no words.  Empty tables give empty results; input
columns other than doc_id and text are dropped.  The index compares stretches by
96 bits, 64 from one half of each word's 128-bit xxHash and 32 from the other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .wordscan import NONSPACE, Words, mix, slices, texts_of, windows

WINDOW, SEED = 20, 12
NULL_ID = -(1 << 63)

PACKED = "block bigint, doc_ids array<bigint>, sizes binary, texts binary"


def packed(docs: DataFrame) -> DataFrame:
    """Blocks of whole documents; a block's number holds for one run of the job, so write them once before use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            ids = [d for b in held for d in b.column(0).to_pylist()]
            texts = [t for b in held for t in texts_of(b.column(1))]
            held.clear()
            sizes = np.array([len(t) for t in texts], "<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([zstandard.compress(sizes, 1)], pa.binary()), pa.array([zstandard.compress(b"".join(texts), 6)], pa.binary())], ["block", "doc_ids", "sizes", "texts"])

        for batch in slices(batches, limit=1 << 20):
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= 2 << 20:
                yield flush()
                size, number = 0, number + 1
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def _ints(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _blob(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


class Block:
    """A block's words, seeds and stretches; everything here follows from its rows alone."""

    def __init__(self, doc_ids: list[int | None], sizes: bytes, texts: bytes):
        whole, ends = zstandard.decompress(texts), np.cumsum(_ints(sizes, "<i8")).tolist()
        self.doc_ids = doc_ids
        self.texts = [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        self.words = Words(self.texts, NONSPACE, fold=False)
        self.hashes = self.words.hashes()
        first = self.words.first
        self.owner = np.repeat(np.arange(len(doc_ids)), np.diff(first))
        self.key = np.array([(NULL_ID if d is None else d, xxhash.xxh3_64_intdigest(t) >> 1) for d, t in zip(doc_ids, self.texts, strict=True)], np.int64).reshape(-1, 2)
        n = len(self.hashes) - WINDOW + 1
        at = np.arange(max(n, 0))
        self.places = at[self.owner[: max(n, 0)] == self.owner[WINDOW - 1 :]] if n > 0 else at  # where a stretch starts
        # documents in order; rows of one document share a rank
        order = np.lexsort((self.key[:, 1], self.key[:, 0]))
        ranked = self.key[order]
        self.ranked = ranked[np.concatenate(([True], (ranked[1:] != ranked[:-1]).any(1)))] if len(ranked) else ranked
        self.rank = np.zeros(len(doc_ids), np.int64)
        self.rank[order] = np.cumsum(np.concatenate(([0], (ranked[1:] != ranked[:-1]).any(1)))) if len(ranked) else 0

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct seeds, the seed of each stretch and whether a seed stands at two places in the block."""
        grams = windows(self.hashes, SEED, 1)
        if not len(self.places):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        wide = WINDOW - SEED + 1
        # leftmost least of each run of ``wide``: place by place, later ones only where less
        best, rank = self.places.copy(), mix(grams, 9)  # by another hash, so that the chosen ones spread over all buckets
        least = rank[best]
        for k in range(1, wide):
            other = rank[self.places + k]
            less = other < least
            least = np.where(less, other, least)
            best = np.where(less, self.places + k, best)
        spots = np.unique(best)
        distinct, counts = np.unique(grams[spots], return_counts=True)
        return distinct, np.searchsorted(distinct, grams[best]), counts > 1

    def stretches(self, live: np.ndarray) -> Stretches:
        places = self.places[live]
        low, high = windows(self.hashes, WINDOW, 2)[places], windows(self.words.hashes(1), WINDOW, 3)[places] >> np.uint64(32)
        doc = self.owner[places]
        start = places - self.words.first[doc]
        order = np.lexsort((start, self.rank[doc], high, low))
        low, high, places, start, rank = low[order], high[order], places[order], start[order], self.rank[doc][order]
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]))) if len(low) else np.zeros(0, bool)
        return Stretches(places, start, rank, np.cumsum(new) - 1, np.flatnonzero(new), low, high)


@dataclass
class Stretches:
    """Stretches sorted by hash, then by order of occurrence; ``head`` has each distinct one's first."""

    place: np.ndarray
    start: np.ndarray
    rank: np.ndarray
    group: np.ndarray
    head: np.ndarray
    low: np.ndarray
    high: np.ndarray


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the hash, so sorted hashes lie in runs of buckets."""
    return (hashes >> np.uint64(32)).astype(np.int64) * buckets >> 32


def _cut(sorted_hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    edges = np.searchsorted(bucket_of(sorted_hashes, buckets), np.arange(buckets + 1))
    return [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def shared_seeds(blocks: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, bits: which of a block's distinct seeds other blocks have too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, doc_ids, sizes, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                distinct = Block(doc_ids, sizes, texts).seeds()[0]
                cuts = _cut(distinct, buckets)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in cuts], pa.int32()), pa.array([block] * len(cuts), pa.int64()), pa.array([distinct[a:b].astype("<u8").tobytes() for _, a, b in cuts], pa.binary())], ["bucket", "block", "seeds"])

    def meet(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u8") for x in table["seeds"].to_pylist()]
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(every), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        bits = [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum([len(p) for p in parts])[:-1])]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    rows = blocks.mapInArrow(send, "bucket int, block bigint, seeds binary")
    return rows.groupBy("bucket").applyInArrow(meet, "block bigint, bucket int, bits binary")


def _gathered(rows: DataFrame, name: str) -> DataFrame:
    """One row a block; its list is bounded by what the block itself has sent."""
    fields = [c for c in rows.columns if c != "block"]
    return rows.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias(name))


def _live(block: Block, answers: list[dict] | None, buckets: int) -> np.ndarray:
    """Which stretches have a seed that stands at two places of the corpus at least."""
    distinct, seed, repeated = block.seeds()
    by = {x["bucket"]: x["bits"] for x in answers or ()}
    for bucket, a, b in _cut(distinct, buckets):
        if (bits := by.get(bucket)) is not None:
            repeated[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return repeated[seed]


def earlier(blocks: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, bits and sources: which distinct stretches of a block start in an earlier document of another block, and where.

    ``blocks`` has the seeds' answers as ``seeds``.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, doc_ids, sizes, texts, seeds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = Block(doc_ids, sizes, texts)
                found = block.stretches(_live(block, seeds, buckets))
                low, high, rank, start = (x[found.head] for x in (found.low, found.high, found.rank, found.start))
                out = []
                for bucket, a, b in _cut(low, buckets):
                    docs, which = np.unique(rank[a:b], return_inverse=True)
                    out.append((bucket, name, low[a:b].astype("<u8").tobytes(), high[a:b].astype("<u4").tobytes(), _blob(block.ranked[docs].astype("<i8")), _blob(which.astype("<i4")), _blob(start[a:b].astype("<i4"))))
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)], ["bucket", "block", "low", "high", "docs", "which", "start"])

    def meet(table: pa.Table) -> pa.Table:
        low = [np.frombuffer(x, "<u8") for x in table["low"].to_pylist()]
        sizes = [len(x) for x in low]
        every, high = np.concatenate(low), np.frombuffer(b"".join(table["high"].to_pylist()), "<u4")
        key = np.concatenate([_ints(d, "<i8").reshape(-1, 2)[_ints(w, "<i4")] for d, w in zip(table["docs"].to_pylist(), table["which"].to_pylist(), strict=True)])
        start = np.concatenate([_ints(x, "<i4") for x in table["start"].to_pylist()])
        order = np.lexsort((start, key[:, 1], key[:, 0], high, every))
        every, high = every[order], high[order]
        new = np.concatenate(([True], (every[1:] != every[:-1]) | (high[1:] != high[:-1])))
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # each entry's first occurrence
        source = np.zeros(len(order), np.int64)
        source[order] = head
        late = (key[source] != key).any(1)
        out = {"block": table["block"].to_pylist(), "bucket": table["bucket"].to_pylist(), "bits": [], "docs": [], "which": [], "start": []}
        at = 0
        for n in sizes:
            mark = late[at : at + n]
            src = source[at : at + n][mark]
            docs, which = np.unique(key[src], axis=0, return_inverse=True)
            for name, value in (("bits", np.packbits(mark)), ("docs", docs.astype("<i8")), ("which", which.ravel().astype("<i4")), ("start", start[src].astype("<i4"))):
                out[name].append(_blob(value))
            at += n
        return pa.table(out, pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in ("bits", "docs", "which", "start")]]))

    rows = blocks.select("block", "doc_ids", "sizes", "texts", "seeds").mapInArrow(send, "bucket int, block bigint, low binary, high binary, docs binary, which binary, start binary")
    return rows.groupBy("bucket").applyInArrow(meet, "block bigint, bucket int, bits binary, docs binary, which binary, start binary")


PAIRS = 2_000_000  # runs that are compared at once


@dataclass
class Passages:
    """A block's part of the reference: passages of earlier documents, one unused word between them."""

    words: np.ndarray  # numbers as in the block's own words
    low: np.ndarray  # hashes of the stretches, ascending
    place: np.ndarray  # where they start
    key: np.ndarray  # for each word of ``words``: the document and ...
    start: np.ndarray  # ... the place there


def passages(block: Block, source: np.ndarray, place: np.ndarray) -> Passages:
    """What overlapping stretches make up; each is a source (doc_id, address, start) and one place in the block with its words."""
    order = np.lexsort((source[:, 2], source[:, 1], source[:, 0]))
    source, place = source[order], place[order]
    step = np.diff(source[:, 2], prepend=0)
    new = np.concatenate(([True], (source[1:, :2] != source[:-1, :2]).any(1) | (step[1:] > WINDOW)))
    step[new] = WINDOW + 1  # the stretch before it, and a gap
    step[0] = 0
    at = np.cumsum(step)
    numbers = block.words.numbered[0]
    size = int(at[-1]) + WINDOW
    words, key, start = np.full(size, -1), np.zeros((size, 2), np.int64), np.zeros(size, np.int64)
    low = np.arange(size, dtype=np.uint64)  # what stands in gaps is matched by nothing: every match is compared
    for k in range(WINDOW):
        words[at + k], key[at + k], start[at + k] = numbers[place + k], source[:, :2], source[:, 2] + k
        low[at + k] = block.hashes[place + k]
    low = windows(low, WINDOW, 2)
    turn = np.argsort(low, kind="stable")
    return Passages(words, low[turn], turn, key, start)


def longest(block: Block, found: Stretches, live: np.ndarray, known: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the stretches ``live`` (numbers in ``found``): place, the most words that go on at one earlier place, and that place in ``known``; by place."""
    live = live[np.argsort(found.place[live])]
    place = found.place[live]
    first, last = (np.searchsorted(known.low, found.low[live], side) for side in ("left", "right"))
    total = np.cumsum(last - first)
    size, where = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    numbers = block.words.numbered[0]
    own, own_start = block.key[block.owner[place]], found.start[live]
    ahead = (-1, np.zeros(0, np.int64), np.zeros(0, np.int64))  # a place, what goes on from there in ``known`` and how far
    # from the right, so that a run's length is known where it goes on in the part before
    for part in np.split(np.arange(len(place)), np.flatnonzero(np.diff(total // PAIRS)) + 1)[::-1]:
        n = last[part] - first[part]
        which = np.repeat(part, n)
        there = known.place[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[part], n)]
        key, at = known.key[there], known.start[there]
        mine = own[which]
        earlier = (key[:, 0] < mine[:, 0]) | (key[:, 0] == mine[:, 0]) & ((key[:, 1] < mine[:, 1]) | (key[:, 1] == mine[:, 1]) & (at < own_start[which]))
        for k in range(WINDOW):
            earlier &= known.words[there + k] == numbers[place[which] + k]
        which, there = which[earlier], there[earlier]
        here = place[which]
        turn = np.lexsort((here, there - here))
        which, there, here = which[turn], there[turn], here[turn]
        ends = np.append((here[1:] != here[:-1] + 1) | (there[1:] != there[:-1] + 1), True)
        stop = np.flatnonzero(ends)
        more = np.zeros(len(stop), np.int64)
        if len(ahead[1]):
            goes = here[stop] + 1 == ahead[0]
            spot = np.minimum(np.searchsorted(ahead[1], there[stop] + 1), len(ahead[1]) - 1)
            more = np.where(goes & (ahead[1][spot] == there[stop] + 1), ahead[2][spot], 0)
        run = np.searchsorted(stop, np.arange(len(here)))
        length = here[stop][run] - here + 1 + more[run]
        best = np.lexsort((known.start[there], known.key[there, 1], known.key[there, 0], -length, which))
        head = best[np.concatenate(([True], which[best][1:] != which[best][:-1]))] if len(best) else best
        size[which[head]], where[which[head]] = length[head] + WINDOW - 1, there[head]
        opening = np.flatnonzero(here == place[part[0]])
        opening = opening[np.argsort(there[opening])]
        ahead = (int(place[part[0]]), there[opening], length[opening])
    return place, size, where


def parse(block: Block, seeds: list[dict] | None, answers: list[dict] | None, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors: first word (in the block), words, and source (doc_id, address, start), by first word."""
    found = block.stretches(_live(block, seeds, buckets))
    heads = found.head
    late, source = np.zeros(len(heads), bool), np.zeros((len(heads), 3), np.int64)
    source[:, :2], source[:, 2] = block.ranked[found.rank[heads]], found.start[heads]
    by = {x["bucket"]: x for x in answers or ()}
    for bucket, a, b in _cut(found.low[heads], buckets):
        if (x := by.get(bucket)) is not None:
            mark = np.unpackbits(_ints(x["bits"], np.uint8), count=b - a).astype(bool)
            late[a:b] = mark
            at = np.flatnonzero(mark) + a
            source[at, :2] = _ints(x["docs"], "<i8").reshape(-1, 2)[_ints(x["which"], "<i4")]
            source[at, 2] = _ints(x["start"], "<i4")
    order_here = found.rank << 32 | found.start
    again = np.flatnonzero(late[found.group] | (order_here > order_here[heads][found.group]))
    none = np.zeros(0, np.int64)
    if not len(again):
        return none, none, np.zeros((0, 3), np.int64)
    needed = np.unique(found.group[again])
    known = passages(block, source[needed], found.place[heads[needed]])
    place, size, where = longest(block, found, again, known)
    end = place + size
    factors: list[int] = []
    edge = -WINDOW
    while True:
        a, b = np.searchsorted(place, (edge - WINDOW + 1, edge + 1)).tolist()
        if b > a and place[b - 1] == edge and size[b - 1]:
            k = b - 1  # the next factor starts where the last one ended
        elif b > a and end[a:b].max() > edge:
            k = a + int(end[a:b].argmax())  # a run that crosses the end of the last factor
        elif b < len(place):
            k = b  # after literals
        else:
            break
        factors.append(k)
        edge = max(int(end[k]), edge + 1)
    taken = np.array(factors, np.int64)
    taken = taken[size[taken] > 0]
    spot = where[taken]
    return place[taken], size[taken], np.concatenate((known.key[spot], known.start[spot][:, None]), 1)


PARSED = "doc_id bigint, n_words bigint, n_removed bigint, kept string, factors array<struct<start: bigint, size: bigint, source: bigint, source_start: bigint>>"
DIGEST = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def deduplicated(docs: DataFrame, digest: bool = False) -> DataFrame:
    """One row a document: what is left of it, words joined by blanks, and its factors.

    ``digest`` gives the SHA-256 of what is left in place of it, and no factors.
    """
    blocks = scratch.durable(packed(docs), "passage-blocks")
    n = blocks.count()
    buckets = max(1, math.ceil(4 * math.sqrt(n)), n // 64)  # index blocks of a few tens of MB at any size
    seeds = scratch.durable(_gathered(shared_seeds(blocks, buckets), "seeds"), "passage-seeds")
    # documents meet their answers by block: one row of a few MB each, no key is frequent
    asked = blocks.join(seeds, "block", "left")
    answers = scratch.durable(_gathered(earlier(asked, buckets), "answers"), "passage-sources")
    rows = asked.join(answers, "block", "left").select("doc_ids", "sizes", "texts", "seeds", "answers")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, sizes, texts, seeds, answers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = Block(doc_ids, sizes, texts)
                first, size, source = parse(block, seeds, answers, buckets)
                words, edge = block.words, np.zeros(len(block.words) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + size, -1)
                gone = np.cumsum(edge[:-1]) > 0
                n = np.diff(words.first)
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
                # bytes of the kept words, each with the one byte after it made a blank
                stay = np.zeros(len(words.data) + 2, np.int32)
                stay[words.starts[~gone]] += 1
                stay[words.ends[~gone] + 1] -= 1
                mask = np.cumsum(stay[: len(words.data)]) > 0
                data = np.where(NONSPACE[words.data], words.data, np.uint8(32))
                cut = np.concatenate(([0], np.cumsum(mask)))[words.base].tolist()
                left = data[mask].tobytes()
                kept = [left[a:b][:-1] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                head = [pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())]
                if digest:
                    yield pa.RecordBatch.from_arrays([*head, pa.array([hashlib.sha256(x).hexdigest() for x in kept])], ["doc_id", "n_words", "n_removed", "kept_sha256"])
                    continue
                factors: list[list[dict]] = [[] for _ in doc_ids]
                for a, m, (d, _, s) in zip(first.tolist(), size.tolist(), source.tolist(), strict=True):
                    doc = int(block.owner[a])
                    factors[doc].append({"start": a - int(words.first[doc]), "size": m, "source": None if d == NULL_ID else d, "source_start": s})
                kind = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*head, pa.array([x.decode("utf-8", "replace") for x in kept]), pa.array(factors, kind)], ["doc_id", "n_words", "n_removed", "kept", "factors"])

    return scratch.durable(rows.mapInArrow(finish, DIGEST if digest else PARSED), "passages-removed")


def op8(docs: DataFrame) -> DataFrame:
    return deduplicated(docs, digest=True)
