"""Benchmark decontamination by a distributed positional inverted index.

``build`` turns documents into index blocks.  A block holds the postings of
some documents: for each term the ascending places where it stands, with one
unused place between documents so that no run of consecutive places crosses
from one into the next.  Terms are sorted by a 64-bit hash for look-up and
compared byte by byte, so a result never rests on a hash.  ``phrases`` looks up
query phrases: for each block the rarest term of a phrase gives candidate starts
and the other terms' lists, moved by their offsets, are intersected with them in
order of rarity.  ``near`` returns proximity matches.

Items become query blocks of about QUERY_WORDS words, rows of a table of their
own; index blocks meet them in a join that Spark broadcasts only while the query
blocks are small, so neither side has to fit anywhere as a whole and nothing
passes through the driver.

Null texts have no words; null and empty items have no windows; equal items all
count.  An item without an id marks words as hit but is neither counted nor
listed, as SQL's distinct count has it.  Repeated document rows give repeated
results; a null ``doc_id`` stays null; other columns are ignored.  Empty tables,
documents or items, give empty results or no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .wordscan import ALNUM, Words, slices, texts_of

WINDOW = 13
QUERY_WORDS = 200_000
CANDIDATES = 2_000_000  # starts that are intersected at once

BLOCK = "block bigint, doc_ids array<bigint>, n_words array<bigint>, terms binary, lexicon binary, cuts binary, places binary"


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _loaded(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _numbers() -> Iterator[int]:
    """Numbers that no other task of the job gives."""
    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def build(docs: DataFrame) -> DataFrame:
    """The index blocks of ``docs``; a block's number holds for one run of the job, so write them once (``scratch.durable``) before use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in zip(_numbers(), slices(batches, limit=2 << 20)):
            words = Words(texts_of(batch.column(1)), ALNUM, fold=True)
            n = np.diff(words.first)
            places = np.arange(len(words), dtype=np.int64) + np.repeat(np.arange(len(n)), n)
            owner, lexicon = words.numbered
            hashes = words.digests[:, 0]
            turn = np.argsort(hashes, kind="stable")
            rank = np.empty(len(turn), np.int64)
            rank[turn] = np.arange(len(turn))
            order = np.argsort(rank[owner], kind="stable")
            cuts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(turn))[turn])[:-1])) if len(turn) else np.zeros(0, np.int64)
            listed = places[order].astype("<i8")
            steps = np.diff(listed, prepend=0)  # ascending within a term: small steps pack well
            steps[cuts] = listed[cuts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int64())),
                    *[pa.array([x], pa.binary()) for x in (_squeeze(hashes[turn].astype("<u8")), zstandard.compress(b" ".join([lexicon[k] for k in turn.tolist()]), 1), _squeeze(cuts.astype("<i4")), _squeeze(steps.astype("<i4")))],
                ],
                ["block", "doc_ids", "n_words", "terms", "lexicon", "cuts", "places"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, BLOCK)


class Postings:
    """One loaded index block."""

    def __init__(self, n_words: list[int], terms: bytes, lexicon: bytes, cuts: bytes, places: bytes):
        self.n_words, self.terms = np.array(n_words, np.int64), _loaded(terms, "<u8")
        self.lexicon = zstandard.decompress(lexicon).split(b" ")
        steps = _loaded(places, "<i4").astype(np.int64)
        self.cuts = np.append(_loaded(cuts, "<i4").astype(np.int64), len(steps))
        self.sizes = np.diff(self.cuts)
        total = np.cumsum(steps)
        before = np.where(self.cuts[:-1] > 0, total[self.cuts[:-1] - 1], 0) if len(steps) else np.zeros(0, np.int64)
        self.places = total - np.repeat(before, self.sizes)
        # term and place in one ascending key: one search tests any posting
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64), self.sizes) << 36 | self.places
        self.first = np.concatenate(([0], np.cumsum(self.n_words + 1)))

    def rows(self, hashes: np.ndarray, lexicon: list[bytes]) -> np.ndarray:
        """The term numbers of different words with these hashes, -1 where the block lacks one."""
        out = np.full(len(hashes), -1)
        if not len(self.terms):
            return out
        at = np.searchsorted(self.terms, hashes)
        for k in np.flatnonzero(self.terms[np.minimum(at, len(self.terms) - 1)] == hashes).tolist():
            row = int(at[k])
            while row < len(self.terms) and self.terms[row] == hashes[k]:
                if self.lexicon[row] == lexicon[k]:
                    out[k] = row
                    break
                row += 1
        return out

    def has(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        wanted = rows << 36 | np.maximum(places, 0)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[at] == wanted) & (places >= 0)

    def postings(self, row: int) -> np.ndarray:
        return self.places[self.cuts[row] : self.cuts[row + 1]]

    def phrases(self, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place of its first word) for each occurrence of the phrase of terms rows[start:start + size]."""
        none = np.zeros(0, np.int64)
        if not len(starts) or not len(self.keys):
            return none, none
        often = np.where(rows >= 0, self.sizes[rows], 0)
        width = int(sizes.max())
        offset = np.arange(width)
        real = offset < sizes[:, None]
        at = np.minimum(starts[:, None] + offset, len(rows) - 1)
        rarity = np.where(real, often[at], np.iinfo(np.int64).max)
        live = np.flatnonzero(rarity.min(1) > 0)
        order = np.argsort(rarity[live], axis=1, kind="stable")
        out: list[tuple[np.ndarray, np.ndarray]] = []
        load = np.cumsum(rarity[live].min(1)) // CANDIDATES if len(live) else none
        for part in np.split(np.arange(len(live)), np.flatnonzero(np.diff(load)) + 1) if len(live) else []:
            phrase, turn = live[part], order[part]
            head = rows[at[phrase, turn[:, 0]]]
            n = self.sizes[head]
            which = np.repeat(np.arange(len(part)), n)
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            place = self.places[self.cuts[head][which] + inner] - turn[which, 0]
            keep = place >= 0
            which, place = which[keep], place[keep]
            for j in range(1, width):
                if not len(which):
                    break
                asked = sizes[phrase[which]] > j
                off = turn[which, j]
                row = rows[at[phrase[which], off]]
                keep = ~asked | self.has(row, place + off)
                which, place = which[keep], place[keep]
            out.append((phrase[which], place))
        return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (none, none)


class Query:
    """The windows of a query block's items: slices of one run of words."""

    def __init__(self, items: list[str | None], sizes: bytes, numbers: bytes, lexicon: bytes, window: int):
        self.numbers = _loaded(numbers, "<i4").astype(np.int64)
        self.lexicon = zstandard.decompress(lexicon).split(b" ")
        self.hashes = Words([b" ".join(self.lexicon)], ALNUM, fold=False).hashes() if len(self.numbers) else np.zeros(0, np.uint64)
        size = _loaded(sizes, "<i8")
        many = np.where(size > 0, np.maximum(size - window, 0) + 1, 0)
        owner = np.repeat(np.arange(len(size)), many)
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        self.starts = (np.cumsum(size) - size)[owner] + inner
        self.sizes = np.minimum(size, window)[owner]
        self.items = [items[k] for k in owner.tolist()]

    def found(self, block: Postings) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.numbers):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return block.phrases(block.rows(self.hashes, self.lexicon)[self.numbers], self.starts, self.sizes)


QUERY = "query bigint, items array<string>, sizes binary, numbers binary, words binary"


def query_blocks(items: DataFrame, limit: int = QUERY_WORDS) -> DataFrame:
    """The items (item_id, text) in blocks of about ``limit`` words; write them once before use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers()
        for batch in slices(batches, limit=6 * limit):
            words = Words(texts_of(batch.column(1)), ALNUM, fold=True)
            ids, lexicon = words.numbered
            row = (_squeeze(np.diff(words.first).astype("<i8")), _squeeze(ids.astype("<i4")), zstandard.compress(b" ".join(lexicon), 1))
            yield pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.string())), *[pa.array([x], pa.binary()) for x in row]], ["query", "items", "sizes", "numbers", "words"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    return rows.repartition(max(1, math.ceil(size / (6 * limit)))).mapInArrow(run, QUERY)


FOUND = "block bigint, place int, items array<string>, spans array<struct<start: bigint, size: bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
_FOUND = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("items", pa.list_(pa.string())), ("spans", _SPANS)])


def merged(starts: list[int], sizes: list[int]) -> list[tuple[int, int]]:
    """The union of spans as disjoint spans in order."""
    out: list[list[int]] = []
    for a, n in sorted(zip(starts, sizes, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b - a) for a, b in out]


def searched(index: DataFrame, queries: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document and query block with a hit: the items that occur and the hit words as disjoint spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[int, Query] = {}
        last: tuple[int | None, Postings | None] = (None, None)
        for batch in batches:
            for k in range(batch.num_rows):
                value = lambda name: batch.column(name)[k].as_py()  # noqa: B023, E731
                number, asked = value("block"), value("query")
                if number != last[0]:
                    last = (number, Postings(*map(value, ("n_words", "terms", "lexicon", "cuts", "places"))))
                if asked not in loaded:
                    if len(loaded) >= 4:
                        loaded.clear()
                    loaded[asked] = Query(*map(value, ("items", "sizes", "numbers", "words")), window)
                block, query = last[1], loaded[asked]
                phrase, place = query.found(block)
                doc = np.searchsorted(block.first, place, "right") - 1
                order = np.argsort(doc, kind="stable")
                phrase, place, doc = phrase[order], place[order], doc[order]
                rows = {name: [] for name in _FOUND.names}
                for d, a, b in zip(*_runs(doc), strict=True):
                    rows["block"].append(number)
                    rows["place"].append(d)
                    rows["items"].append(sorted({x for p in phrase[a:b].tolist() if (x := query.items[p]) is not None}))
                    rows["spans"].append([{"start": s, "size": n} for s, n in merged((place[a:b] - block.first[d]).tolist(), query.sizes[phrase[a:b]].tolist())])
                if rows["block"]:
                    yield pa.RecordBatch.from_pydict(rows, _FOUND)

    # a stated set of queries against all blocks: Spark broadcasts the queries below its threshold and deals both sides otherwise
    return index.select("block", "n_words", "terms", "lexicon", "cuts", "places").crossJoin(queries).mapInArrow(run, FOUND)


def _runs(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Value, start and end of each run of equal values."""
    if not len(values):
        return [], [], []
    cut = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(values)]


def near(index: DataFrame, words: list[str], within: int) -> DataFrame:
    """doc_id, start and size of the shortest stretches of at most ``within`` words that hold all ``words``.

    One stretch for each place that ends one; repeated query words count once.
    """
    asked = Words([w.encode() for w in words], ALNUM, fold=True)
    hashes, lexicon = asked.digests[:, 0], asked.numbered[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc_id": [], "start": [], "size": []}
            for k in range(batch.num_rows):
                doc_ids = batch.column(1)[k].as_py()
                block = Postings(*(batch.column(i)[k].as_py() for i in range(2, 7)))
                rows = block.rows(hashes, lexicon)
                if len(rows) and (rows >= 0).all():
                    lists = sorted((block.postings(r) for r in rows), key=len)
                    ends = np.unique(np.concatenate(lists))
                    starts = ends.copy()
                    for places in lists:  # for each end the last place of every word up to it
                        at = np.searchsorted(places, ends, "right") - 1
                        starts = np.minimum(starts, np.where(at >= 0, places[np.maximum(at, 0)], -1))
                    doc = np.searchsorted(block.first, ends, "right") - 1
                    keep = (starts >= block.first[doc]) & (ends - starts < within)
                    for d, s, e in zip(doc[keep].tolist(), starts[keep].tolist(), ends[keep].tolist(), strict=True):
                        out["doc_id"].append(doc_ids[d])
                        out["start"].append(s - int(block.first[d]))
                        out["size"].append(e - s + 1)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("size", pa.int64())]))

    return index.mapInArrow(run, "doc_id bigint, start bigint, size bigint")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = QUERY_WORDS) -> DataFrame:
    """doc_id, n_words, items and spans of every document over all items."""
    index = scratch.durable(build(docs), "postings")
    found = scratch.durable(searched(index, scratch.durable(query_blocks(items, limit), "query-blocks"), window), "postings-found")
    # what one row got from several query blocks meets by its place in the index; a row each block at most
    met = found.groupBy("block", "place").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "size": n} for a, n in merged([x["start"] for x in row], [x["size"] for x in row])] for row in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, _SPANS)], batch.schema.names)

    hits = met.select("block", "place", "items", "spans").mapInArrow(join, FOUND)
    rows = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "d"))
    none = F.array().cast("array<string>"), F.array().cast("array<struct<start: bigint, size: bigint>>")
    return rows.join(hits, ["block", "place"], "left").select(F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"), F.coalesce("items", none[0]).alias("items"), F.coalesce("spans", none[1]).alias("spans"))


def op1(docs: DataFrame, items: DataFrame) -> DataFrame:
    rows = contamination(docs, items)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))
