"""Exact set-similarity join of word shingles by a partitioned universe.

Two sets of sizes x and y with a Jaccard similarity of 0.8 or more differ in at
most H = (x + y) / 9 elements.  Sizes are cut into bands.  A band hashes the
universe into m > H segments, so two similar sets agree on some segment
altogether: the index holds the *subset* that a set has in each segment.  Small
bands use fewer, larger segments and also index every subset less one element
(the one-deletion neighbourhood), which finds segments that differ in one.

A set is indexed under its own band and, if its partners may lie there, under
the band below.  Allocation follows cost: empty subsets are never indexed (all
sets share them), and of the rest those that turn out frequent are spent only
where a set could not do without them.  A band has more segments than H + 1, so
a set with D empty or frequent segments needs them only if D >= m - H; sets with
that many *empty* segments are also indexed by the elements of their prefix.

Groups of sets that share an index entry are not expanded into pairs.  Each
group first compares its members with its least and its most shared one, the
likely original of its copies; components of the verified links follow.  Only
groups that then still span several components are looked at pair by pair, in
bounded blocks, and a parity bitmap of each set (whose distance never exceeds
the sets') discards nearly all of those pairs.  Every surviving pair is verified
on the shingles themselves.

Equal sets are one node from the start; a node is a 64-bit hash of its set, or of
both its hashes where another set has the same first one.  Hashes only propose: a pair is a link if its
shingles, compared word by word, say so.  A node keeps one compressed text, from
which its index entries and its shingles are made, so the documents are read
once.  Keys that many rows share (copies of one text, members of one group or
component, pairs of one hub) are salted by their measured sizes (``skew``).

Rows: one for each input row.  Null and empty texts and texts without words have
no shingles and link with nothing, so their component is their own doc_id.  A
null ``doc_id`` stays null; a component of such rows only has a null id.  Empty
tables give empty results; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, scratch, skew
from .wordscan import NONSPACE, SLICE_BYTES, Words, mix, slices, texts_of, window_numbers, windows

SHINGLE = 5
WORD = "[^\\x20\\x09-\\x0D]"
FREQUENT = 64  # members from which an index entry counts as frequent
BLOCK = 1024  # members of a group that are compared with as many others in one task
FLUSH = 1_000_000  # index entries that a task holds before it sends them
BUCKET_BYTES = 16 << 20  # of index entries that meet in one task


def distance_bound(x, y):
    """The most elements in which similar sets of sizes x and y differ."""
    return (x + y) // 9


@lru_cache(None)
def bands() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest size, segments and bound of each band; bands below 48 elements use deletions."""
    tops = [7, 15, 23, 31, 47]
    while tops[-1] < 1 << 40:
        tops.append(tops[-1] * 3 // 2)
    tops = np.array(tops, np.int64)
    bound = distance_bound(tops, tops * 5 // 4)
    segments = np.where(np.arange(len(tops)) < SMALL_BANDS, bound // 2 + 1, bound + bound // 8 + 3)
    return tops, segments, bound


SMALL_BANDS = 5


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text, as ascending hashes."""
    words = Words(texts, NONSPACE, fold=True)
    hashes = words.hashes()
    grams = windows(hashes, SHINGLE)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:  # a short text is one shingle of its own length
            out.append(mix(windows(hashes[a:b], b - a), 100 + b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _fold(values: np.ndarray, seed: int) -> int:
    """An order-free hash of a set."""
    return int(mix(mix(values, seed).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(values)), seed + 1)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bitmap(values: np.ndarray) -> bytes:
    """Parities of the elements by hash; four to eight bits an element, in a power of two from 256.

    So few elements share a bit that the distance of two bitmaps comes close to the sets'.
    """
    bits = 4 << max(6, int(len(values) - 1).bit_length())
    return np.packbits((np.bincount((mix(values, 40) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _segments(values: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Role (0 own band, 1 the band below), band, the segment of each element, the segments' sizes and the frequent entries that can be spared."""
    tops, segments, _ = bands()
    x = len(values)
    own = int(np.searchsorted(tops, x))
    for role, band in ((0, own), (1, own - 1)):
        if band < 0 or role and -(-4 * x // 5) > tops[band]:
            continue
        m = int(segments[band])
        segment = (mix(values, 60 + band) >> np.uint64(32)).astype(np.int64) * m >> 32
        size = np.bincount(segment, minlength=m)
        most = distance_bound(x, min(x * 5 // 4, int(tops[min(own + 1, len(tops) - 1)])) if role == 0 else int(tops[band]))
        # where deletions are indexed, counting by segment is moot: all entries are needed
        yield role, band, segment, size, -1 if band < SMALL_BANDS else m - most - 1 - int((size == 0).sum())


def spare(values: np.ndarray) -> tuple[int, int]:
    """How many frequent index entries a set can do without, for each role."""
    out = [0, 0]
    for role, _, _, _, n in _segments(values):
        out[role] = n
    return out[0], out[1]


def entries(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set and the role of each; entries of role 2 (prefix elements) are always needed."""
    x, sparse = len(values), False
    keys, roles = [], []
    mixed = mix(values, 50)
    for role, band, segment, size, free in _segments(values):
        total = np.zeros(len(size), np.uint64)
        np.add.at(total, segment, mixed)
        total += mix(np.arange(len(size), dtype=np.uint64) + np.uint64(band << 40), 70)
        keys.append(mix(total[size > 0], 80))
        if band < SMALL_BANDS:
            rest = segment[size[segment] > 1]
            keys.append(mix(total[rest] - mixed[size[segment] > 1], 80))
            sparse |= bool((size <= 1).any())
        else:
            sparse |= free < 0
        roles.append(np.full(sum(map(len, keys)) - sum(map(len, roles)), role, np.uint8))
    if sparse:
        prefix = np.sort(mix(values, 90))[: x - -(-4 * x // 5) + 1]
        keys.append(mix(prefix, 91))
        roles.append(np.full(len(prefix), 2, np.uint8))
    return np.concatenate(keys), np.concatenate(roles)


def exact_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text as ascending numbers, equal for equal words and only for those."""
    words = Words(texts, NONSPACE, fold=True)
    grams = window_numbers(words, SHINGLE)
    whole: dict[tuple, int] = {}  # texts of fewer words, as one shingle each
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        else:
            out.append(np.array([-1 - whole.setdefault(tuple(words.numbered[0][a:b].tolist()), len(whole))] if b > a else [], np.int64))
    return out


SETS = "row bigint, doc_id bigint, h bigint, n bigint, node bigint, second bigint, bits binary, spare0 int, spare1 int, z binary"


def sets(docs: DataFrame) -> DataFrame:
    """A number and a hash of every row's text, its shingle set's size, node and second hash; for the first of a task's equal sets also bitmap, spare entries and the compressed text.

    Numbers hold for one run of the job: write the table once before use.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number = set(), TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            texts = texts_of(batch.column(1))
            got = shingles(texts)
            nodes = [_signed(_fold(v, 30)) if len(v) else None for v in got]
            second = [_signed(_fold(v, 32)) for v in got]
            new = []
            for both in zip(nodes, second, strict=True):
                new.append(both[0] is not None and both not in seen)
                seen.add(both)
            free = [spare(v) if k else (None, None) for v, k in zip(got, new, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(number, number + len(got)), pa.int64()), batch.column(0), batch.column(2), pa.array([len(v) for v in got], pa.int64()), pa.array(nodes, pa.int64()), pa.array(second, pa.int64()),
                    pa.array([bitmap(v) if k else None for v, k in zip(got, new, strict=True)], pa.binary()), pa.array([f[0] for f in free], pa.int32()), pa.array([f[1] for f in free], pa.int32()),
                    pa.array([zstandard.compress(t, 3) if k else None for t, k in zip(texts, new, strict=True)], pa.binary()),
                ],
                ["row", "doc_id", "h", "n", "node", "second", "bits", "spare0", "spare1", "z"],
            )
            number += len(got)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, SETS)


def _unpacked(packed: list[bytes]) -> Iterator[dict[int, bytes]]:
    """Texts by their place, in parts of about SLICE_BYTES."""
    held: dict[int, bytes] = {}
    size = 0
    for k, z in enumerate(packed):
        held[k] = zstandard.decompress(z)
        size += len(held[k])
        if size >= SLICE_BYTES:
            yield held
            held, size = {}, 0
    if held:
        yield held


GROUPS = "pair boolean, a bigint, b bigint, members binary, roles binary, number int"
_GROUPS = pa.schema([("pair", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("members", pa.binary()), ("roles", pa.binary()), ("number", pa.int32())])


def index_groups(nodes: DataFrame, buckets: int) -> DataFrame:
    """What the index entries of nodes (node, z) bring together: pairs (least member, other), and groups of three or more as packed members."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, roles, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(keys, kind="stable")
            keys, roles, nodes = keys[order], roles[order], nodes[order]
            edge = np.searchsorted((keys >> np.uint64(32)).astype(np.int64) * buckets >> 32, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edge))
            # forty bits tell entries of one bucket apart; what falls together by chance fails verification
            short = keys.view(np.uint8).reshape(-1, 8)[:, :5]
            cut = [slice(int(edge[k]), int(edge[k + 1])) for k in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array([x[c].tobytes() for c in cut], pa.binary()) for x in (short, roles, nodes)]], ["bucket", "keys", "roles", "nodes"])

        for batch in batches:
            for part in _unpacked(batch.column(1).to_pylist()):
                for k, values in zip(part, shingles([text for text in part.values()]), strict=True):
                    keys, roles = entries(values)
                    held.append((keys, roles, np.full(len(keys), batch.column(0)[k].as_py(), np.int64).view(np.uint64)))
                    size += len(keys)
                    if size >= FLUSH:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        short = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint8).reshape(-1, 5)
        keys = np.zeros((len(short), 8), np.uint8)
        keys[:, :5] = short
        keys = keys.view("<u8").ravel()
        roles, nodes = np.frombuffer(b"".join(table["roles"].to_pylist()), np.uint8), np.frombuffer(b"".join(table["nodes"].to_pylist()), "<i8")
        order = np.argsort(keys, kind="stable")
        once = np.ones(len(order), bool)
        ranked = keys[order]
        once[1:] = ranked[1:] != ranked[:-1]
        lonely = once & np.append(once[1:], True)
        order = order[~lonely]
        order = order[np.lexsort((roles[order], nodes[order], keys[order]))]
        keys, roles, nodes = keys[order], roles[order], nodes[order]
        keep = np.ones(len(keys), bool)
        keep[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, roles, nodes = keys[keep], roles[keep], nodes[keep]
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(keys)))
        least = np.repeat(nodes[head], size)
        pairs = np.unique(np.stack([least, nodes], 1)[nodes != least], axis=0)
        big = np.flatnonzero(size > 2)
        groups: dict[tuple[bytes, bytes], int] = {}
        for h, n in zip(head[big].tolist(), size[big].tolist(), strict=True):
            found = (nodes[h : h + n].tobytes(), roles[h : h + n].tobytes())
            groups[found] = groups.get(found, 0) + 1
        none, p, g = None, len(pairs), len(groups)
        return pa.table([
            pa.array([True] * p + [False] * g), pa.array([*pairs[:, 0].tolist(), *[none] * g], pa.int64()), pa.array([*pairs[:, 1].tolist(), *[none] * g], pa.int64()),
            pa.array([none] * p + [k[0] for k in groups], pa.binary()), pa.array([none] * p + [k[1] for k in groups], pa.binary()), pa.array([none] * p + list(groups.values()), pa.int32()),
        ], schema=_GROUPS)

    rows = nodes.select("node", "z").mapInArrow(send, "bucket int, keys binary, roles binary, nodes binary")
    return rows.groupBy("bucket").applyInArrow(meet, GROUPS)


def may_link(x: np.ndarray, y: np.ndarray, a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Whether pairs of sets with sizes x, y and bitmaps a, b can be similar; never false for a pair that is."""
    out = (5 * np.minimum(x, y) >= 4 * np.maximum(x, y))
    for k in np.flatnonzero(out).tolist():
        p, q = sorted((a[k], b[k]), key=len)
        q = np.bitwise_xor.reduce(np.frombuffer(q, "<u8").reshape(-1, len(p) // 8), axis=0)
        out[k] = int(np.bitwise_count(np.frombuffer(p, "<u8") ^ q).sum()) <= distance_bound(int(x[k]), int(y[k]))
    return out


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and bitmaps allow."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    pairs = scratch.durable(pairs, "proposed-pairs")
    total, degrees = pairs.count(), _degrees(pairs)
    sizes = lambda c: degrees.select(F.col("node").alias(c), "size")
    met = skew.joined(skew.joined(pairs, two, "b", sizes("b"), total, "a"), one, "a", sizes("a"), total, "b")
    near = met.where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_numpy() for i in (2, 3))
            yield batch.filter(pa.array(may_link(x, y, batch.column(4).to_pylist(), batch.column(5).to_pylist()))).select(["a", "b"])

    return near.mapInArrow(run, "a bigint, b bigint")


def _degrees(pairs: DataFrame) -> DataFrame:
    """(node, size): the pairs that each node is in."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("size"))


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are similar, with both sizes and the common shingles.

    The node of a pair with more pairs is its hub.  A hub's text is sent once for
    each of its salts, ahead of the texts that are compared with it.
    """
    total = pairs.count()
    degrees = scratch.durable(_degrees(pairs), "pair-degrees")
    one, two = degrees.select(F.col("node").alias("a"), F.col("size").alias("size_a")), degrees.select(F.col("node").alias("b"), F.col("size").alias("size_b"))
    sizes = lambda c: degrees.select(F.col("node").alias(c), "size")
    ranked = skew.joined(skew.joined(pairs.select("a", "b"), one, "a", sizes("a"), total, "b"), two, "b", sizes("b"), total, "a")
    turned = ranked.select(F.when(F.col("size_a") >= F.col("size_b"), F.struct(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("size_a").alias("n"))).otherwise(F.struct(F.col("b").alias("hub"), F.col("a").alias("node"), F.col("size_b").alias("n"))).alias("p")).select("p.*")
    bound = max(skew.LEAST, total // skew.MOST)
    salts = F.ceil(F.col("n") / bound).cast("int")
    members = turned.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
    # only texts that some pair asks for go further
    texts = scratch.durable(nodes.select("node", "z").join(degrees.select("node"), "node", "left_semi"), "candidate-texts")
    hubs = members.select("hub", "salt").distinct().join(texts.select(F.col("node").alias("hub"), "z"), "hub").select("hub", "salt", F.lit(None).cast("bigint").alias("node"), "z")
    others = skew.joined(members.select("hub", "salt", "node"), texts, "node", degrees, total, "hub").select("hub", "salt", "node", "z")
    # nulls first: a hub's own text comes before the others
    dealt = hubs.unionByName(others).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "node")
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "n_a", "n_b", "common")])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple[int | None, bytes] = (None, b"")
        for batch in batches:
            texts: list[bytes] = []
            asked: list[tuple[int, int, int, int]] = []  # hub, node and the places of their texts
            size, place = 0, -1
            for name, node, z in zip(*(batch.column(c).to_pylist() for c in ("hub", "node", "z")), strict=True):
                text = zstandard.decompress(z)
                if node is None:
                    hub, place = (name, text), -1
                    continue
                if place < 0:
                    place = len(texts)
                    texts.append(hub[1])
                    size += len(hub[1])
                asked.append((name, node, place, len(texts)))
                texts.append(text)
                size += len(text)
                if size >= SLICE_BYTES:
                    yield compared(texts, asked)
                    texts, asked, size, place = [], [], 0, -1
            if asked:
                yield compared(texts, asked)

    def compared(texts: list[bytes], asked: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        found = exact_sets(texts)
        out = {c: [] for c in schema.names}
        for hub, node, x, y in asked:
            common = len(np.intersect1d(found[x], found[y], assume_unique=True))
            if 100 * common >= 80 * (len(found[x]) + len(found[y]) - common):
                (a, x), (b, y) = sorted([(hub, x), (node, y)])
                for name, value in zip(out, (a, b, len(found[x]), len(found[y]), common), strict=True):
                    out[name].append(value)
        return pa.RecordBatch.from_pydict(out, schema)

    return dealt.select("hub", "node", "z").mapInArrow(judge, "a bigint, b bigint, n_a bigint, n_b bigint, common bigint")


def _members(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, node): the members of the index groups that may be needed to find a link."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, roles, number in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                node = np.frombuffer(packed, "<i8")
                group = _signed(_fold(np.frombuffer(packed, "<u8"), 34))
                for at in range(0, len(node), 8192):
                    part = node[at : at + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), group), pa.int64()), pa.array(part), pa.array(np.frombuffer(roles, np.uint8)[at : at + 8192].astype(np.int32)), pa.array(np.full(len(part), number, np.int32)), pa.array(np.full(len(part), len(node) > FREQUENT))], ["g", "node", "role", "number", "frequent"])

    every = scratch.durable(groups.select("members", "roles", "number").mapInArrow(spread, "g bigint, node bigint, role int, number int, frequent boolean"), "index-members")
    # a frequent entry is needed only by members that have too few others
    spent = every.where("frequent").groupBy("node").agg(*[F.sum(F.when(F.col("role") == k, F.col("number")).otherwise(0)).alias(f"d{k}") for k in (0, 1)])
    thin = spent.join(nodes, "node").where("d0 > spare0 or d1 > spare1").select("node")
    always = every.where("not frequent or role = 2").select("g", "node")
    return scratch.durable(always.unionByName(every.where("frequent and role < 2").join(thin, "node", "left_semi").select("g", "node")).distinct(), "index-members")


def _spanning(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(g, node, root, size) of the groups whose members lie in several components."""
    rows = scratch.durable(members.join(labels, "node", "left").select("g", "node", F.coalesce("root", "node").alias("root")), "labelled-members")
    groups = scratch.durable(rows.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")), "group-sizes")
    several, sizes = groups.where("low <> high").select("g", "size"), groups.select("g", "size")
    return scratch.durable(skew.joined(rows, several, "g", sizes, rows.count(), "node"), "open-groups")


def _pivots(members: DataFrame) -> DataFrame:
    """Pairs of each group's most shared member, the likely original of its copies, with the others."""
    shared = members.groupBy("node").agg(F.count("*").alias("weight"))
    pivot = scratch.durable(members.join(shared, "node").groupBy("g").agg(F.max_by("node", F.struct("weight", "node")).alias("p"), F.count("*").alias("size")), "pivots")
    met = skew.joined(members, pivot.drop("size"), "g", pivot.select("g", "size"), members.count(), "node")
    return met.where("node <> p").select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()


def _crossing(open_groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of possible links between different components within one index group."""
    rows = open_groups.join(nodes.select("node", "n", "bits"), "node")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    placed = rows.withColumn("of", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).select("g", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "root", "n", "bits")

    def compare(table: pa.Table) -> pa.Table:
        mine, node, root, n = (table[c].to_numpy() for c in ("mine", "node", "root", "n"))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        bits = table["bits"].to_pylist()
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        width = min(map(len, bits))
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(b, "<u8").reshape(-1, width // 8), axis=0) for b in bits])
        out = []
        for a in left.tolist():
            b = right[(right > a) | (i != j)] if i == j else right
            b = b[(root[b] != root[a]) & (5 * np.minimum(n[b], n[a]) >= 4 * np.maximum(n[b], n[a]))]
            b = b[np.bitwise_count(folded[b] ^ folded[a]).sum(1) <= distance_bound(n[b], n[a])]
            out += [(node[a], node[k]) if node[a] < node[k] else (node[k], node[a]) for k in b.tolist()]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return dealt.groupBy("g", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def _set_nodes(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``every`` and their nodes, both written.

    Sets that share a number but not the second hash get numbers made of both.  A few
    such are to be expected among billions of sets, so they are a small table, and rows
    are numbered anew only if there are any, until each number has one set.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "row")
    shown = F.first(F.when(F.col("z").isNotNull(), F.struct("n", "bits", "spare0", "spare1", "z")), ignorenulls=True)
    while True:
        found = every.where("node is not null").groupBy("node").agg(shown.alias("s"), F.min(first).alias("m"), F.count("*").alias("copies"), F.min("second").alias("low"), F.max("second").alias("high"))
        nodes = scratch.durable(found.select("node", "s.n", "copies", "m", "s.bits", "s.spare0", "s.spare1", "s.z", (F.col("low") != F.col("high")).alias("shared")), "set-nodes")
        shared = nodes.where("shared").select("node", F.lit(True).alias("shared"))
        if shared.isEmpty():
            return every, nodes.drop("shared")
        own = F.when(F.col("shared"), F.xxhash64("node", "second")).otherwise(F.col("node"))
        told = scratch.durable(every.join(shared, "node", "left").withColumn("node", own).select(every.columns), "shingle-sets")
        scratch.drop(every)
        scratch.drop(nodes)
        every = told


def joined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(row, doc_id, h, n, node) of every row, its nodes with their component, verified links (a, b, n_a, n_b, common) between nodes, and the nodes' texts.

    Nodes have node, n, copies, root (the least node of the component) and m: (none, doc_id, h, row) of the
    component's first row, by doc_id (null last), h and row.  The links span the
    components and are not all there are: ``linked`` counts those.
    """
    spark = docs.sparkSession
    every, nodes = _set_nodes(scratch.durable(sets(docs), "shingle-sets"))
    rows = scratch.durable(every.select("row", "doc_id", "h", "n", "node"), "set-rows")
    scratch.drop(every)
    # about half an entry of 14 bytes for each shingle
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 7 * (nodes.agg(F.sum("n")).first()[0] or 0) // BUCKET_BYTES)
    found = scratch.durable(index_groups(nodes, buckets), "index-groups")
    members = _members(found.where("not pair"), nodes)
    stars = found.where("pair").select("a", "b").unionByName(_pivots(members)).distinct()
    tested = scratch.durable(_possible(stars, nodes), "pairs")
    links = scratch.durable(verified(tested, nodes), "similar")
    labels = components.labels(links.select("a", "b"))
    rest = scratch.durable(_crossing(_spanning(members, labels), nodes).join(tested, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        more = scratch.durable(verified(rest, nodes), "similar")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components.labels(links.select("a", "b"))
    return rows, _classed(nodes, labels), links, nodes.select("node", "z")


def _classed(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with root and the first row of the whole component as m."""
    own = scratch.durable(labels.join(nodes.select("node", "m"), "node"), "labelled-nodes")
    classes = scratch.durable(own.groupBy("root").agg(F.min("m").alias("first"), F.count("*").alias("size")), "components")
    met = skew.joined(own.select("node", "root"), classes.drop("size"), "root", classes.select("root", "size"), own.count(), "node")
    every = nodes.select("node", "n", "copies", "m").join(met, "node", "left")
    return scratch.durable(every.select("node", "n", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("first", "m").alias("m")), "classed-nodes")


def _with_nodes(rows: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Every row with columns of its node, null where it has none."""
    return skew.joined(rows, nodes.select("node", *columns), "node", nodes.select("node", F.col("copies").alias("size")), rows.count(), "row", "left")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable) of every row."""
    rows, nodes, _, _ = joined(docs)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("m.doc_id"))
    return _with_nodes(rows, nodes, "m").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


LINK_BLOCK = 512  # nodes of a component that are compared with as many others in one task
LINK_SHINGLES = 1_000_000  # of such a block, on average


def _linked_rows(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, n_near): the rows whose sets are similar to a node's own but not equal; ``nodes`` has node, n, root and copies, ``texts`` node and z.

    Similar sets lie in one component, so each pair of a component's nodes is looked at once, on the shingles
    themselves, compared word by word.
    """
    size = nodes.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    asked = skew.joined(nodes.select("root", "node", "copies"), size, "root", size, nodes.count(), "node")
    rows = scratch.durable(asked.join(texts, "node"), "linked-nodes")
    placed = rows.withColumn("of", F.least("size", F.greatest(F.ceil(F.col("size") / LINK_BLOCK), F.ceil(F.col("shingles") / LINK_SHINGLES))).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "copies", "z")

    def count(table: pa.Table) -> pa.Table:
        mine, node, copies = (table[c].to_numpy() for c in ("mine", "node", "copies"))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        sets = exact_sets([zstandard.decompress(z) for z in table["z"].to_pylist()])
        n = np.array([len(v) for v in sets])
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        near = np.zeros(len(node), np.int64)
        if len(left) and len(right):
            universe, place = np.unique(np.concatenate(sets), return_inverse=True)
            first = np.concatenate(([0], np.cumsum(n)))
            there = np.concatenate([place[first[k] : first[k + 1]] for k in right.tolist()])
            starts = np.concatenate(([0], np.cumsum(n[right])[:-1]))
            seen = np.zeros(len(universe), bool)
            for a in left.tolist():
                own = place[first[a] : first[a + 1]]
                seen[own] = True
                common = np.add.reduceat(seen[there], starts, dtype=np.int64)
                seen[own] = False
                similar = right[(100 * common >= 80 * (n[a] + n[right] - common)) & (right != a)]
                near[a] += copies[similar].sum()
                if i != j:
                    near[similar] += copies[a]
        return pa.table({"node": pa.array(node), "n_near": pa.array(near)})

    return dealt.groupBy("root", "i", "j").applyInArrow(count, "node bigint, n_near bigint").groupBy("node").agg(F.sum("n_near").alias("n_near"))


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row: the other rows whose shingle sets are similar to its own, equal ones included."""
    rows, nodes, _, texts = joined(docs)
    near = nodes.select("node", "copies", "m").join(_linked_rows(nodes, texts), "node", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("n_near", F.lit(0)))
    every = _with_nodes(rows, scratch.durable(near, "linked-nodes"), "m", "n_links")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("m.doc_id"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class one row, of those with the least doc_id.

    Rows are told apart by doc_id and a 64-bit hash of the text, so each of the
    rows that share a doc_id stands for itself.  Null ids come after all others; a
    class that has only such rows keeps one.  Rows without shingles all stay.
    Columns are kept whatever their names.
    """
    rows, nodes, _, _ = joined(docs)
    first = nodes.groupBy("root").agg(F.min("m").alias("m")).select("m.doc_id", "m.h", "m.row")
    # rows of one id and one text are one and the same: one of them stays, and the join below must not meet all of them
    again = rows.where("node is not null").groupBy("doc_id", "h").agg(F.count("*").alias("copies")).where("copies > 1")
    kept = scratch.durable(first.join(again, first.doc_id.eqNullSafe(again.doc_id) & (first.h == again.h), "left").select(first.doc_id.alias("id"), first.h.alias("h"), F.coalesce("copies", F.lit(1)).alias("copies")), "representatives")
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), (~F.coalesce("text", F.lit("")).rlike(WORD)).alias("blank"))
    meant = own.id.eqNullSafe(kept["id"]) & (own.h == kept["h"])
    once = own.where("not blank").join(kept.where("copies = 1"), meant, "left_semi")
    twice = own.where("not blank").join(kept.where("copies > 1"), meant, "left_semi").groupBy("id", "h").agg(F.first("own").alias("own"))
    return own.where("blank").select("own.*").unionByName(once.select("own.*")).unionByName(twice.select("own.*"))


def op10(docs: DataFrame) -> DataFrame:
    return classes(docs)
