"""Byte-level BPE by a rank file, with long texts cut into overlapping chunks.

The split pattern looks ahead but never behind, so what follows a pre-token
boundary depends on the text from there on alone.  Chunks of a long text are
pre-tokenised in parallel; two neighbours agree from the first boundary on that
both have inside their overlap and that the left one reached before the end of
its chunk could have cut a match short.  There they are stitched; each chunk's
pre-tokens are encoded where they were found, so stitching only picks ids.  Where
an overlap holds no such boundary (one endless run of letters, say) the text from
the last sure boundary is pre-tokenised again with more chunks, twice as many at
each failure, so the work stays linear.

Null texts count as empty and give no ids.  Repeated rows give repeated results
and a null ``doc_id`` stays null; of equal long texts one is encoded, whatever
their ids.  Empty tables give empty results; input
columns other than doc_id and text are dropped.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, skew
from .wordscan import slices

CHUNK, OVERLAP = 1 << 15, 1 << 9
CACHED_PIECES = 500_000
CLIPPED = 4  # characters before a chunk's end in which a lookahead may have seen too little

_coders: dict[tuple[str, str], PieceCoder] = {}


class PieceCoder:
    """Ids of pre-tokens: the lowest-ranked adjacent pair merges first, leftmost on ties."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {v: k for k, v in self.ranks.items()}
        self.known: dict[str, bytes] = {}

    def piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if len(raw) > 256:
            return self._long(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        get, none = self.ranks.get, 1 << 60
        pairs = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _long(self, raw: bytes) -> list[int]:
        """The same merges with a heap over linked parts, for runs of any length."""
        import heapq

        n = len(raw)
        after, before, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        get = self.ranks.get

        def pair(i: int) -> tuple[int, int, int] | None:
            j = after[i]
            rank = get(raw[i : end[j]]) if j < n else None
            return None if rank is None else (rank, i, end[j])

        heap = [p for i in range(n) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != to:
                continue
            alive[j], end[i], after[i] = False, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        return [self.ranks[raw[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, pieces: list[str]) -> bytes:
        """Little-endian unsigned 32-bit ids of consecutive pre-tokens."""
        return b"".join(self.each(pieces))

    def each(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token."""
        known = self.known
        out = list(map(known.get, pieces))
        if None in out:
            if len(known) > CACHED_PIECES:
                known.clear()
            for k, got in enumerate(out):
                if got is None:
                    p = pieces[k]
                    got = known.get(p)
                    if got is None:
                        got = np.array(self.piece(p.encode("utf-8", "surrogatepass")), "<u4").tobytes()
                        if len(p) <= 64:
                            known[p] = got
                    out[k] = got
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(path: str, pattern: str) -> PieceCoder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = PieceCoder(path, pattern)
    return _coders[path, pattern]


def boundaries(pattern, text: str) -> list[int]:
    """Ends of the pre-tokens."""
    return [m.end() for m in pattern.finditer(text)]


def stitched(pattern, chunks: list[tuple[int, str, list[int]]], size: int) -> list[tuple[int, int, int]]:
    """Pre-token ends of a text from its overlapping chunks (start, text, ends within it), in order.

    With each end the chunk that found it and its number there, or -1 twice where neither chunk could be trusted.
    """
    out: list[tuple[int, int, int]] = []
    n, k, ahead = len(chunks), 0, 1
    while k < n:
        start, text, found = chunks[k]
        stop = start + len(text) - CLIPPED if k < n - 1 else start + len(text) + 1  # a piece that reaches the chunk's end may go on in the next one
        own = [(start + e, k, i) for i, e in enumerate(found) if start + e < stop]
        if k == 0:
            out, k = own, 1
            continue
        # the first boundary that both chunks have; a chunk's own start counts as one
        here, at = {start, *[e for e, _, _ in own]}, len(out)
        while at and out[at - 1][0] >= start:
            at -= 1
        meet = next((i for i in range(at, len(out)) if out[i][0] in here), None)
        if meet is not None:
            del out[meet + 1 :]
            out += [x for x in own if x[0] > out[meet][0]]
            k, ahead = k + 1, 1
            continue
        # no agreement inside the overlap: go on from the last sure boundary
        sure, to = out[-1][0] if out else 0, min(n - 1, k + ahead - 1)
        first = sure // size
        whole = "".join([t[:size] for _, t, _ in chunks[first:to]] + [chunks[to][1]])[sure - first * size :]
        stop = sure + len(whole) - CLIPPED if to < n - 1 else sure + len(whole) + 1
        out += [(sure + e, -1, -1) for e in boundaries(pattern, whole) if sure + e < stop]
        k, ahead = to + 1, 2 * ahead
    return out


RESULT = "ids binary, raw binary, same boolean"


def _results(code: PieceCoder, texts: list[str], ids: list[bytes]) -> dict[str, pa.Array]:
    raw = [code.decode(x) for x in ids]
    same = [r == t.encode("utf-8", "surrogatepass") for r, t in zip(raw, texts, strict=True)]
    return {"ids": pa.array(ids, pa.binary()), "raw": pa.array(raw, pa.binary()), "same": pa.array(same, pa.bool_())}


def _long(texts: DataFrame, path: str, pattern: str, size: int, overlap: int) -> DataFrame:
    """(address, ids, raw, same) of texts (address, text), each different one once, by chunks that are dealt over all tasks."""
    schema = pa.schema([("address", pa.string()), ("k", pa.int32()), ("chunk", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                for at in range(0, len(text), 64 * size):
                    starts = range(at, min(at + 64 * size, len(text)), size)
                    yield pa.RecordBatch.from_pydict({"address": [address] * len(starts), "k": [a // size for a in starts], "chunk": [text[a : a + size + overlap] for a in starts]}, schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in slices(batches, "chunk"):
            ends, ids, counts = [], [], []
            for text in batch.column(2).to_pylist():
                found = boundaries(code.pattern, text)
                each = code.each([text[a:b] for a, b in zip([0, *found[:-1]], found, strict=True)])
                ends.append(found)
                ids.append(b"".join(each))
                counts.append(list(map(len, each)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32())), pa.array(ids, pa.binary()), pa.array(counts, pa.list_(pa.int32()))], [*batch.schema.names, "ends", "ids", "counts"])

    def meet(table: pa.Table) -> pa.Table:
        code = coder(path, pattern)
        got = table.sort_by("k").to_pydict()
        chunks = [(k * size, t, e) for k, t, e in zip(got["k"], got["chunk"], got["ends"], strict=True)]
        text = "".join([t[:size] for _, t, _ in chunks[:-1]] + [chunks[-1][1]])
        places = [np.concatenate(([0], np.cumsum(c))) for c in got["counts"]]
        out, before, run = [], 0, None  # run: chunk and first and last place of ids that are taken as they are

        def taken() -> None:
            if run:
                out.append(got["ids"][run[0]][run[1] : run[2]])

        for end, k, i in stitched(code.pattern, chunks, size):
            if k < 0:
                taken()
                run = None
                out.append(code.encode([text[before:end]]))
            elif run and run[0] == k and run[2] == places[k][i]:
                run = (k, run[1], int(places[k][i + 1]))
            else:
                taken()
                run = (k, int(places[k][i]), int(places[k][i + 1]))
            before = end
        taken()
        return pa.table({"address": pa.array([got["address"][0]])} | _results(code, [text], [b"".join(out)]))

    chunks = texts.mapInArrow(cut, "address string, k int, chunk string").repartition("address", "k")
    pieces = chunks.mapInArrow(split, "address string, k int, chunk string, ends array<int>, ids binary, counts array<int>")
    return pieces.groupBy("address").applyInArrow(meet, "address string, " + RESULT)


def encoded(docs: DataFrame, path: str, pattern: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ``ids`` (little-endian unsigned 32-bit), ``raw`` (the bytes that the ids stand for) and ``same`` (whether those are the text's) of every text.

    Texts of one chunk are done where they are read.  Of longer ones each
    different text is done once and joins back to its rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | _results(code, texts, [code.encode(code.pattern.findall(t)) for t in texts]))

    short = rows.where(F.length("text") <= size).mapInArrow(direct, "doc_id bigint, " + RESULT)
    long = rows.where(F.length("text") > size).withColumn("address", F.sha2("text", 256))
    texts = long.groupBy("address").agg(F.first("text").alias("text"))
    done = scratch.durable(_long(texts, path, pattern, size, overlap), "long-ids")
    asked = scratch.durable(long.select("doc_id", "address", F.monotonically_increasing_id().alias("row")), "long-rows")
    sizes = asked.groupBy("address").agg(F.count("*").alias("size"))
    back = skew.joined(asked, done, "address", sizes, asked.count(), "row")
    return short.unionByName(back.select("doc_id", "ids", "raw", "same"))


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and ``raw``: the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in batches:
            raw = [code.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["doc_id", "ids", "raw"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, raw binary")


def tokenised(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, the ids with their number and digest, the digest of what they decode to, and whether that is the text."""
    rows = encoded(docs, path, pattern)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"), "same", "ids")


def op7(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return tokenised(docs, path, pattern).drop("ids")
