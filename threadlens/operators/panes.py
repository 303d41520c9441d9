"""Counts by pane as packed arrays of whole numbers: what windows are made of, without a row for each pane and term.

Terms are numbered in their order, so numbers decide ties of names.  Texts lie in
chunks; a chunk's task gets its terms' numbers, its texts once each, and the
places of the comments that say them (``packed``).  For each place it adds up the
texts' terms and sends one packed row, so neither texts nor words are sent for a
comment.  A slice's task gets these rows in order of places, adds them up and
makes all that its ticks need at once: the top terms with their weights
(``tops``) or the digests of all cells (``digests``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as X
from .bursts import DAY, _us

MOST = 1 << 14  # texts of a chunk
BLOCK = 1 << 16  # terms of a row of the vocabulary
EPOCH = datetime(1970, 1, 1)
NONE = 1 << 60  # the place of what lies in a window at an end off the grid
PACKED = "slice bigint, place bigint, bin bigint, msgs bigint, said bigint, size bigint, data binary"
TOP = "slice bigint, k bigint, id bigint, freq bigint, rank int, value double, bins array<bigint>, ns array<bigint>, weights array<double>, n_msgs bigint, n_docs bigint, low bigint, high bigint, n_terms bigint"
_LOW = (1 << 31) - 1


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def named(comments: DataFrame, stop_words: list[str] | None, texts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Comments (local_ts, text_id) and a written table (text_id, chunk, line) of what each text says."""
    line = X.told(F.col("cleaned_comment"), stop_words).alias("line")
    if texts is None:
        comments = shared.durable(comments.select(F.monotonically_increasing_id().alias("text_id"), "local_ts", line), "pane-comments")
        lines = comments.select("text_id", "line")
    else:
        lines = shared.durable(texts.select("text_id", line), "pane-lines")
    return comments.select("local_ts", "text_id"), lines


def _tokens(lines: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The line that each token is in, and the tokens."""
    lists = pc.split_pattern(pc.fill_null(lines, ""), " ")
    lengths, tokens = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
    keep = pc.not_equal(tokens, "")
    return np.repeat(np.arange(len(lines)), lengths)[keep.to_numpy(zero_copy_only=False)], tokens.filter(keep)


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, term) of a batch's lines, each once."""
    for batch in batches:
        at, tokens = _tokens(batch["line"])
        coded = tokens.dictionary_encode()
        chunk, of = np.unique(batch["chunk"].to_numpy(), return_inverse=True)
        pairs = np.unique((of[at].astype(np.int64) << 32) | coded.indices.to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunk[pairs >> 32]), "term": coded.dictionary.take(pa.array(pairs & ((1 << 32) - 1)))})


def vocabulary(words: DataFrame, after: str = "") -> DataFrame:
    """(term, id) of a table's different terms, numbered from 0 in their order, each followed by ``after``; a written table."""
    terms = shared.durable(words.select("term").distinct(), "pane-terms")
    place = F.monotonically_increasing_id()
    ordered = terms.withColumn("name", F.concat("term", F.lit(after))).repartitionByRange(_parts(words), "name").sortWithinPartitions("name").select("term", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    ordered = shared.durable(ordered, "pane-order")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("size"))  # one row a task
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return shared.durable(ordered.join(F.broadcast(before), "part").select("term", (F.col("before") + F.col("at")).alias("id")), "pane-vocabulary")


@dataclass
class _Chunk:
    """The texts of a chunk as lists of numbered terms."""

    def __post_init__(self) -> None:
        self.terms, self.numbers, self.texts = [], [], []

    def words(self, table: pa.RecordBatch) -> None:
        self.terms.append(table["text"])
        self.numbers.append(table["id"].to_numpy())

    def lines(self, table: pa.RecordBatch) -> None:
        known = pa.concat_arrays(self.terms) if self.terms else pa.array([], pa.string())
        self.terms = [known]
        at, tokens = _tokens(table["text"])
        code = pc.index_in(tokens, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, n = np.unique((at.astype(np.int64) << 32) | code, return_counts=True)
        number = np.concatenate(self.numbers)[pairs & ((1 << 32) - 1)] if len(pairs) else np.empty(0, np.int64)
        said = pc.is_valid(table["text"]).to_numpy(zero_copy_only=False)
        self.texts.append((table["id"].to_numpy(), said, np.bincount(pairs >> 32, minlength=table.num_rows), number.astype(np.int32), n.astype(np.int32)))

    def ready(self) -> None:
        ids, self.spoken, sizes, self.number, self.n = (np.concatenate(x) for x in zip(*self.texts))
        self.order = np.argsort(ids)
        self.ids, self.ends = ids[self.order], np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.terms, self.numbers, self.texts = [], [], []

    def counts(self, texts: np.ndarray, times: np.ndarray) -> tuple[int, int, int, bytes]:
        """Comments, those that are not blank, different terms, and the packed counts of texts (by their place here) that are said some times."""
        one, of = np.unique(texts, return_inverse=True)
        m = np.zeros(len(one), np.int64)
        np.add.at(m, of, times)
        sizes = self.ends[one] - self.starts[one]
        at = np.arange(sizes.sum()) + np.repeat(self.starts[one] - (np.cumsum(sizes) - sizes), sizes)
        ids, n = added(self.number[at], self.n[at] * np.repeat(m, sizes))
        return int(m.sum()), int(m[self.spoken[one]].sum()), len(ids), pressed(ids, n)


def added(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers in order, with the sums of their counts."""
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = (ids.astype(np.int64) << 31) | n
    both.sort()
    name = both >> 31
    opens = np.flatnonzero(np.diff(name, prepend=-1))
    return name[opens], np.add.reduceat(both & _LOW, opens)


def pressed(ids: np.ndarray, n: np.ndarray) -> bytes:
    """Steps between numbers and counts, the first bytes of all before the second ones: most are 0."""
    planes = lambda x: x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.compress(planes(np.diff(ids, prepend=0)) + planes(n), codec="zstd", asbytes=True)


def opened(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``pressed`` was given."""
    planes = np.frombuffer(pa.decompress(data, 8 * size, codec="zstd", asbytes=True), np.uint8).reshape(2, 4, size)
    steps, n = (np.ascontiguousarray(x.T).view("<u4").reshape(-1).astype(np.int64) for x in planes)
    return np.cumsum(steps), n


def held(place: int, grid) -> tuple[int, int]:
    """The first and the last tick of the grid that hold a place."""
    return max(place // (2 * grid.step) + 1, 1), min((place + 2 * grid.panes - 1) // (2 * grid.step), grid.last)


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Where stretches of equal values start and end."""
    size = len(columns[0])
    if not size:
        return []
    new = np.zeros(size - 1, bool)
    for c in columns:
        new |= np.diff(c) != 0
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), size]
    return list(zip(edges, edges[1:]))


def _pack(batches: Iterator[pa.RecordBatch], grid) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED from each chunk's terms (kind 0), lines (1) and comments (2), in this order."""
    name, chunk, kinds = None, None, pa.schema([(c, pa.binary() if c == "data" else pa.int64()) for c in ("slice", "place", "bin", "msgs", "said", "size", "data")])

    def dealt(place: int, bin: int, late: bool) -> Iterator[tuple[int, int, int]]:
        first, last = held(place, grid)
        for slice in range(first // grid.slice_ticks, last // grid.slice_ticks + 1) if first <= last else ():
            yield slice, place, bin
        if late:
            yield grid.ending // grid.slice_ticks, NONE, bin

    for batch in batches:
        for a, b in _runs(batch["chunk"].to_numpy(), batch["kind"].to_numpy()):
            part = batch.slice(a, b - a)
            kind = part["kind"][0].as_py()
            if part["chunk"][0].as_py() != name:
                name, chunk = part["chunk"][0].as_py(), _Chunk()
            if kind < 2:
                chunk.lines(part) if kind else chunk.words(part)
                continue
            if chunk.texts:
                chunk.ready()
            elif not hasattr(chunk, "ids"):
                continue  # no text of these comments is there
            ids = part["id"].to_numpy()
            at = np.minimum(np.searchsorted(chunk.ids, ids), len(chunk.ids) - 1)
            there = chunk.ids[at] == ids
            at, times = chunk.order[at[there]], part["n"].to_numpy()[there]
            where = [part[c].to_numpy()[there] for c in ("place", "bin", "late")]
            out, size = [], 0
            for i, j in _runs(*where):
                counts = chunk.counts(at[i:j], times[i:j])
                for one in dealt(*(int(c[i]) for c in where)):
                    out.append(dict(zip(kinds.names, (*one, *counts))))
                    size += len(counts[-1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, kinds)


@dataclass
class Texts:
    """Texts (text_id, line) in chunks with their terms, found once."""

    lines: DataFrame
    after: str = ""  # see ``vocabulary``

    def __post_init__(self) -> None:
        size = self.lines.count() // (2 * _parts(self.lines)) + 1
        self.chunk = F.floor(F.col("text_id") / min(max(1 << (size - 1).bit_length(), 64), MOST)).alias("chunk")
        self.words = shared.durable(self.lines.select(self.chunk, "line").mapInArrow(_said, "chunk bigint, term string").distinct(), "pane-words")
        self.terms = vocabulary(self.words, self.after)

    def packed(self, said: DataFrame, grid) -> DataFrame:
        """Rows of PACKED, several for a place and bin, for each slice of ``grid`` (``changes.Grid``), of texts said n times (text_id, place, late, bin, n)."""
        none = F.lit(None).cast("bigint")
        nowhere = [none.alias(c) for c in ("place", "bin", "late", "n")]
        kinds = [
            self.words.join(self.terms, "term").select("chunk", F.lit(0).alias("kind"), F.col("term").alias("text"), "id", *nowhere),
            self.lines.select(self.chunk, F.lit(1).alias("kind"), F.col("line").alias("text"), F.col("text_id").alias("id"), *nowhere),
            said.select(self.chunk, F.lit(2).alias("kind"), F.lit(None).cast("string").alias("text"), F.col("text_id").alias("id"), *[F.col(c).cast("bigint").alias(c) for c in ("place", "bin", "late", "n")]),
        ]
        every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).repartition(_parts(said), "chunk").sortWithinPartitions("chunk", "kind", "place", "bin", "late")
        return every.mapInArrow(lambda batches: _pack(batches, grid), PACKED)


def packed(comments: DataFrame, grid, stop_words: list[str] | None = None, texts: DataFrame | None = None, bin: Column | None = None, after: str = "") -> tuple[DataFrame, DataFrame]:
    """``Texts.packed`` of all comments and the vocabulary.

    With ``texts`` (text_id, cleaned_comment) comments name their text by text_id; ``bin`` stands for the number of the grain.
    """
    w, (comments, lines) = grid.w, named(comments, stop_words, texts)
    since, known = _us(F.col("local_ts")) - w.start_us, Texts(lines, after)
    place = 2 * F.floor(since / w.pane_us) + F.when(F.pmod(since, F.lit(w.pane_us)) == 0, 0).otherwise(1)
    late = F.lit(False) if grid.whole else since > w.end_us - w.start_us - w.window_us
    bin = F.floor(_us(F.col("local_ts")) / w.grain_us) if bin is None else bin
    said = comments.where((since > -w.window_us) & (since < w.end_us - w.start_us)).select("text_id", place.alias("place"), late.alias("late"), bin.alias("bin"), F.lit(1).alias("n"))
    return known.packed(said, grid), known.terms


@dataclass
class _Cell:
    """What is said at a place in a bin."""

    place: int
    bin: int
    msgs: int
    said: int
    ids: np.ndarray
    n: np.ndarray


def _cells(rows: Iterator[dict]) -> list[_Cell]:
    """A slice's rows, in order, added up by place and bin."""
    out = []
    for (place, bin), same in groupby(rows, lambda r: (r["place"], r["bin"])):
        same = list(same)
        ids, n = added(*(np.concatenate(x) for x in zip(*[opened(r["data"], r["size"]) for r in same])))
        out.append(_Cell(place, bin, sum(r["msgs"] for r in same), sum(r["said"] for r in same), ids.astype(np.int32), n.astype(np.int32)))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            yield from batch.slice(at, 100).to_pylist()


def _dealt(rows: DataFrame, grid, *order: str) -> DataFrame:
    parts = max(_parts(rows), 2 * (grid.w.last // grid.slice_ticks + 1))
    return rows.repartition(parts, "slice").sortWithinPartitions("slice", *order)


def tops(packed: DataFrame, grid, top_n: int) -> DataFrame:
    """Rows of TOP: for each tick with messages one of null id, which tells of the tick, and one for each of its top terms.

    A term has its ``bins`` with counts and weights; ``value`` is the sum of the weights.
    """
    step, panes, ticks, last, ending = grid.step, grid.panes, grid.slice_ticks, grid.last, grid.ending

    def tick(slice: int, k: int, held: list[_Cell]) -> list[pa.RecordBatch]:
        msgs = sum(c.msgs for c in held)
        if not msgs:
            return []
        ids, freq = added(np.concatenate([c.ids for c in held]), np.concatenate([c.n for c in held]))
        said = sorted({c.bin for c in held if c.said})
        told = {"slice": slice, "k": k, "n_msgs": msgs, "n_docs": len(said), "low": said[0] if said else None, "high": said[-1] if said else None, "n_terms": len(ids)}
        out = [pa.RecordBatch.from_pylist([told], kinds)]
        if not len(ids):
            return out
        if len(ids) > top_n:
            reach = freq >= np.partition(freq, len(freq) - top_n)[len(freq) - top_n]
            ids, freq = ids[reach], freq[reach]
        kept = np.sort(np.lexsort((ids, -freq))[:top_n])
        ids, freq = ids[kept], freq[kept]  # in order of ids
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, -freq))] = np.arange(1, len(ids) + 1)
        n = np.zeros((len(ids), len(said)), np.int64)
        for c in held:
            if len(c.ids):
                at = np.minimum(np.searchsorted(c.ids, ids), len(c.ids) - 1)
                n[:, said.index(c.bin)] += np.where(c.ids[at] == ids, c.n[at], 0)
        there = n > 0
        w = n * (np.log((1.0 + len(said)) / (1.0 + there.sum(1))) + 1.0)[:, None]
        norm = np.sqrt((w * w).sum(0))
        weight = w / np.where(norm > 0, norm, 1.0)
        row, col = np.nonzero(there)
        ends = pa.array(np.concatenate([[0], np.cumsum(there.sum(1))]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (np.array(said, np.int64)[col], n[row, col], weight[row, col])]
        some = {"slice": pa.array(np.full(len(ids), slice)), "k": pa.array(np.full(len(ids), k)), "id": pa.array(ids), "freq": pa.array(freq), "rank": pa.array(rank, pa.int32()), "value": pa.array(weight.sum(1)), "bins": lists[0], "ns": lists[1], "weights": lists[2]}
        out.append(pa.RecordBatch.from_arrays([some[f.name] if f.name in some else pa.nulls(len(ids), f.type) for f in kinds], schema=kinds))
        return out

    types = {"rank": pa.int32(), "value": pa.float64(), "bins": pa.list_(pa.int64()), "ns": pa.list_(pa.int64()), "weights": pa.list_(pa.float64())}
    kinds = pa.schema([(c.split()[0], types.get(c.split()[0], pa.int64())) for c in TOP.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slice, rows in groupby(_rows(batches), lambda r: r["slice"]):
            cells = _cells(rows)
            for k in range(max(slice * ticks, 1), min(slice * ticks + ticks - 1, last) + 1):
                yield from tick(slice, k, [c for c in cells if 2 * k * step - 2 * panes < c.place < 2 * k * step])
            if ending and ending // ticks == slice:
                yield from tick(slice, ending, [c for c in cells if c.place == NONE])

    return _dealt(packed, grid, "place", "bin").mapInArrow(run, TOP)


def _pressed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for place, data in zip(batch["place"], batch["data"]):
            raw = data.as_py()
            yield pa.RecordBatch.from_pydict({"place": pa.array([place.as_py()], pa.int64()), "size": pa.array([len(raw)], pa.int64()), "data": pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())})


def _with_vocabulary(packed: DataFrame, terms: DataFrame, grid) -> DataFrame:
    """Packed rows (kind 0), and for each slice the vocabulary (kind 1): a row for each block of BLOCK terms, whose ``place`` is its number."""
    block = terms.groupBy(F.floor(F.col("id") / BLOCK).alias("place")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "term"))), lambda x: x["term"]), "\n").cast("binary").alias("data"))
    block, none = shared.durable(block.mapInArrow(_pressed_blocks, "place bigint, size bigint, data binary"), "pane-blocks"), F.lit(None).cast("bigint")
    slices = terms.sparkSession.range((grid.ending or grid.last) // grid.slice_ticks + 1).select(F.col("id").alias("slice"))
    blocks = slices.crossJoin(block).select("slice", F.lit(1).alias("kind"), "place", none.alias("bin"), none.alias("msgs"), none.alias("said"), "size", "data")
    return packed.withColumn("kind", F.lit(0)).unionByName(blocks)


def _names(row: dict, block: int) -> tuple[int, pa.Array]:
    """The first number of a block, and its terms."""
    return row["place"] * block, pa.array(pa.decompress(row["data"], row["size"], codec="zstd", asbytes=True).decode().split("\n"), pa.string())


def freqs(packed: DataFrame, terms: DataFrame, grid) -> DataFrame:
    """(k, term, n): how often each window holds each of its terms; a block of terms at a time."""
    kinds = pa.schema([("k", pa.int64()), ("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, name = [], None
        for (slice, kind), rows in groupby(_rows(batches), lambda r: (r["slice"], r["kind"])):
            if not kind:
                cells, name = _cells(rows), slice
                ticks = {k: [i for i, c in enumerate(cells) if 2 * k * grid.step - 2 * grid.panes < c.place < 2 * k * grid.step] for k in range(max(slice * grid.slice_ticks, 1), min((slice + 1) * grid.slice_ticks - 1, grid.last) + 1)}
                if grid.ending and grid.ending // grid.slice_ticks == slice:
                    ticks[grid.ending] = [i for i, c in enumerate(cells) if c.place == NONE]
            elif slice == name:
                for row in rows:
                    low, names = _names(row, BLOCK)
                    part = [(c.ids[a:b], c.n[a:b]) for c in cells for a, b in [np.searchsorted(c.ids, [low, low + BLOCK])]]
                    for k, held in ticks.items():
                        if held:
                            ids, n = added(*(np.concatenate([part[i][x] for i in held]) for x in (0, 1)))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k)), names.take(pa.array(ids - low)), pa.array(n)], schema=kinds)

    return _dealt(_with_vocabulary(packed, terms, grid), grid, "kind", "place", "bin").mapInArrow(run, "k bigint, term string, n bigint")


def digests(packed: DataFrame, terms: DataFrame, grid, n: str, digest: str, odd: int | None = None) -> DataFrame:
    """(tick, n, digest) of every window's cells ``term:bin:count`` in order, from ``packed`` with terms in the order of ``term:``.

    A slice's task holds its packed counts and goes through the vocabulary block by block, so that cells pass in order
    into the digests of the ticks that hold them.  With ``odd`` bins are starts of stretches in microseconds, and a
    window's bins have that length from the midnight of its first comment.
    """
    every = _with_vocabulary(packed, terms, grid)
    kinds = pa.schema([("k", pa.int64()), (n, pa.int64()), (digest, pa.string())])

    def placed(slice: int, cells: list[_Cell]) -> list[tuple[_Cell, int, int, int]]:
        """Cells with their first and last tick and the moment of their bin."""
        low, high = slice * grid.slice_ticks, (slice + 1) * grid.slice_ticks - 1
        ends = [(grid.ending,) * 2 if c.place == NONE else (max(x[0], low), min(x[1], high)) for c in cells for x in [held(c.place, grid)]]
        if odd is None:
            return [(c, a, b, c.bin * grid.w.grain_us) for c, (a, b) in zip(cells, ends)]
        day = {}
        for c, (a, b) in zip(cells, ends):
            for k in range(a, b + 1):
                day[k] = min(day.get(k, c.bin), c.bin)
        day = {k: first // DAY * DAY for k, first in day.items()}
        out = []
        for c, (a, b) in zip(cells, ends):  # the days of the ticks' first comments never go back
            for start, ks in groupby(range(a, b + 1), day.get):
                ks = list(ks)
                out.append((c, ks[0], ks[-1], start + (c.bin - start) // odd * odd))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .changes import _Ticks

        cells, name, ticks = [], None, None
        for (slice, kind), rows in groupby(_rows(batches), lambda r: (r["slice"], r["kind"])):
            if not kind:
                cells, name, ticks = placed(slice, _cells(rows)), slice, _Ticks()
                moments, bins = np.unique([x[3] for x in cells], return_inverse=True)
                told = pa.array([f"{EPOCH + timedelta(microseconds=int(m)):%Y%m%d%H%M}" for m in moments], pa.string())
            elif slice == name:
                for row in rows:
                    low, names = _names(row, BLOCK)
                    cuts = [np.searchsorted(c.ids, [low, low + BLOCK]) for c, *_ in cells]
                    sizes = np.array([b - a for a, b in cuts])
                    if not sizes.sum():
                        continue
                    ids, counts = (np.concatenate([x[a:b] for x, (a, b) in zip(of, cuts)]).astype(np.int64) for of in ([c.ids for c, *_ in cells], [c.n for c, *_ in cells]))
                    first, last, bin = (np.repeat(x, sizes) for x in (np.array([c[1] for c in cells]), np.array([c[2] for c in cells]), bins))
                    order = np.lexsort((bin, ids))
                    cell = pc.binary_join_element_wise(names.take(pa.array(ids[order] - low)), told.take(pa.array(bin[order])), ":")
                    ticks.feed(cell, counts[order], first[order], last[order])
                ks = sorted(ticks.n)
                yield pa.RecordBatch.from_pydict({"k": ks, n: [ticks.n[k] for k in ks], digest: [ticks.hashes[k].hexdigest() for k in ks]}, schema=kinds)

    found = _dealt(every, grid, "kind", "place", "bin").mapInArrow(run, f"k bigint, {n} bigint, {digest} string")
    return found.select(grid.moment(F.col("k")).alias("tick"), n, digest)
