"""Token ids in fixed-width bit-packed blocks.

Every id takes the fewest bits that the vocabulary needs, least significant bit
first.  A store is a folder of row files; one row is a block: whole documents,
about BLOCK_IDS ids, with the block's place in its shard and the documents'
lengths, so a document's bits are found by arithmetic and unpacked by numpy.
Rows go through Spark's own writers: a retried task leaves no half file, and
any file system of the cluster will do.

Null texts encode as empty; every document ends with ``end_id``.  Documents are
stored in ascending doc_id, nulls first, those with equal ids by a hash of their
token ids; rows that are equal in both are told apart by a number, so neither one
id nor null can fill a shard by itself.  Shards grow in number with the input.
Pre-tokens are told apart by their bytes.  Other columns are dropped.
Empty tables give an empty store.  A document longer than a block makes one
larger block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .wordscan import distinct, slices

BLOCK_IDS = 1 << 16
CACHED_WORDS = 800_000
SHARD_BYTES = 128 << 20
BLOCK = "shard int, first_id bigint, least_doc bigint, greatest_doc bigint, has_null boolean, doc_ids array<bigint>, sizes array<bigint>, width int, payload binary"


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """ids start:start + count of a block, touching only the bytes that hold them."""
    at = (np.int64(start) + np.arange(count, dtype=np.int64)) * width
    low = start * width >> 3
    part = np.frombuffer(payload[low : ((start + count) * width + 7 >> 3)] + bytes(8), np.uint8).astype(np.uint64)
    byte, bit = (at >> 3) - low, (at & 7).astype(np.uint64)
    value = part[byte]
    for k in range(1, (width + 14) // 8):
        value = value | part[byte + k] << np.uint64(8 * k)
    return (value >> bit & np.uint64((1 << width) - 1)).astype(np.uint32)


# The tokenizer file's split pattern, and its classes spelled out for lower-case characters below U+0100.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)
KIND = np.full(256, _OTHER, np.uint8)
KIND[[*range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER
KIND[[*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
KIND[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = _BLANK

_coders: dict[str, WordCoder] = {}


def split(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of PATTERN's matches in lower-case Latin-1 bytes that end with a blank."""
    kind = KIND[data]
    before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
    start = (kind != _BLANK) & ((kind != before) | (kind == _NUMBER))
    mark = np.flatnonzero((data == 0x27) & start)  # an apostrophe that opens a run may open a contraction
    one, two = data[np.minimum(mark + 1, len(data) - 1)], data[np.minimum(mark + 2, len(data) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for which, size in ((short, 2), (long, 3)):
        at = mark[which]
        start[at + 1] = False
        start[at + size] = kind[at + size] != _BLANK
    bounds = np.flatnonzero(start | ((kind == _BLANK) & (before != _BLANK)))
    opens = start[bounds]
    return bounds[opens], bounds[1:][opens[:-1]]


class WordCoder:
    """Ids of texts by a tokenizers file, kept by pre-token; equal ones are encoded once.

    The tokenizer lower-cases, splits, and merges within a split only.  Texts of
    characters below U+0100 are split here, many at once; any other text is cut
    at blanks, which never join two splits, and left to the library.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size()
        self.kind = "<u2" if width_of(self.vocabulary) == 16 else "<u4"
        self.closes = np.zeros(self.vocabulary, bool)
        for token, i in self.library.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.splits = PATTERN in str(self.library.pre_tokenizer)
        self.known: dict[bytes, bytes] = {}  # Latin-1 pre-tokens
        self.pieces: dict[str, bytes] = {}  # blank-separated pieces of other texts

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(got.ids, self.kind).tobytes() for got in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        for at in range(0, len(new), 2048):  # many pre-tokens as one text, cut again where words end
            part = new[at : at + 2048]
            texts = [p.decode("latin-1") for p in part]
            ids = np.array(self.library.encode(" ".join(texts), add_special_tokens=False).ids, self.kind)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                self.known.update(zip(part, self._each(texts), strict=True))
                continue
            raw, size = ids.tobytes(), ids.itemsize
            cut = (ends * size).tolist()
            self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)], strict=True))

    def _many(self, texts: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        starts, ends = split(data)
        which, tokens = distinct(data, starts, ends)
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        known = self.known
        self._learn([t for t in tokens if t not in known])
        coded = list(map(known.__getitem__, tokens))
        pool, unit = np.frombuffer(b"".join(coded), self.kind), np.dtype(self.kind).itemsize
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // unit
        place = np.cumsum(size) - size
        size, place = size[which], place[which]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = pool[np.repeat(place - total[:-1], size) + np.arange(total[-1])].tobytes()
        base = np.cumsum([0, *[len(t) + 1 for t in texts]])
        cut = (total[np.searchsorted(starts, base)] * unit).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Ids of each text with the end id, little-endian, in ``kind``."""
        plain, out = {}, {}
        for k, text in enumerate(texts):
            if self.splits and "<|" not in text:  # which may open a special token
                try:
                    plain[k] = text.lower().encode("latin-1")
                    continue
                except UnicodeEncodeError:
                    pass
            pieces = text.split(" ")
            if len(self.pieces) > CACHED_WORDS // 4:
                self.pieces = {}
            new = [p for p in dict.fromkeys(pieces) if p not in self.pieces]
            self.pieces.update(zip(new, self._each(new), strict=True))
            out[k] = b"".join(map(self.pieces.__getitem__, pieces))
        if plain:
            out |= zip(plain, self._many(list(plain.values())), strict=True)
        end = np.array([end_id], self.kind).tobytes()
        return [out[k] + end for k in range(len(texts))]


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and ``ids``: the text's ids, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = coder(path)
        bits = width_of(library.vocabulary)
        for batch in slices(batches, limit=1 << 20):
            ids = library.encode([t or "" for t in batch.column(1).to_pylist()], end_id)
            size = np.dtype(library.kind).itemsize
            packed = ids if 8 * size == bits else [pack(np.frombuffer(x, library.kind), bits) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // size for x in ids], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, ids binary")


def write(docs: DataFrame, store: str, path: str, end_id: int = 2) -> None:
    """Encode ``docs`` and write them to ``store`` in ascending doc_id."""
    spark = docs.sparkSession
    bits = width_of(coder(path).vocabulary)
    rows = scratch.durable(encoded(docs, path, end_id).withColumns({"content": F.xxhash64("ids"), "row": F.monotonically_increasing_id()}), "token-ids")
    total = rows.agg(F.sum("n")).first()[0] or 0  # one number
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * bits // (8 * SHARD_BYTES)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal at
            sizes = [n for _, n, _ in held]
            if bits % 8 == 0:
                payload = b"".join(x for _, _, x in held)
            else:
                payload = pack(np.concatenate([unpack(x, bits, 0, n) for _, n, x in held]), bits)
            ids = [d for d, _, _ in held]
            known = [d for d in ids if d is not None]
            row = {"shard": [shard], "first_id": [at], "least_doc": [min(known, default=None)], "greatest_doc": [max(known, default=None)], "has_null": [len(known) < len(ids)], "doc_ids": [ids], "sizes": [sizes], "width": [bits], "payload": [payload]}
            at += sum(sizes)
            held.clear()
            return pa.RecordBatch.from_pydict(row, schema)

        schema = pa.schema([("shard", pa.int32()), ("first_id", pa.int64()), ("least_doc", pa.int64()), ("greatest_doc", pa.int64()), ("has_null", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("width", pa.int32()), ("payload", pa.binary())])
        waiting = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                waiting += row[1]
                if waiting >= BLOCK_IDS:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    order = ["doc_id", "content", "row"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    with scratch.small_batches(spark):
        ordered.mapInArrow(blocks, BLOCK).write.mode("overwrite").option("compression", "zstd").parquet(store)


def shard_starts(spark: SparkSession, store: str) -> dict[int, int]:
    """Ids before each shard; as many entries as the store has files."""
    rows = spark.read.parquet(store).select("shard", F.col("first_id") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).groupBy("shard").max().collect()
    out, total = {}, 0
    for shard, _, n in sorted(rows):
        out[shard] = total
        total += n
    return out


def read(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids (little-endian unsigned 32-bit) of every stored document."""
    starts = shard_starts(spark, store)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, first, doc_ids, sizes, bits, payload = (batch.column(i)[k].as_py() for i in (0, 1, 5, 6, 7, 8))
                ends = np.cumsum(sizes)
                ids = unpack(payload, bits, 0, int(ends[-1])).astype("<u4").tobytes()
                cut = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes, strict=True)]
                place = starts[shard] + first + ends - np.array(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(place, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cut, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return spark.read.parquet(store).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def fetch(spark: SparkSession, store: str, doc_id: int | None) -> list[list[int]]:
    """The ids of one document (of each row with that id, null included) by random access."""
    held = F.col("has_null") if doc_id is None else F.lit(doc_id).between(F.col("least_doc"), F.col("greatest_doc"))
    out = []
    for row in spark.read.parquet(store).where(held).toLocalIterator():
        at = 0
        for d, n in zip(row.doc_ids, row.sizes, strict=True):
            if d == doc_id:
                out.append(unpack(bytes(row.payload), row.width, at, n).tolist())
            at += n
    return out


def op4(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    store = scratch.new_path(spark, "token-store")
    write(docs, store, path, end_id)
    return read(spark, store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
