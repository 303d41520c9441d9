"""k-means over integer vectors, with the bounds and balls of the exponion method.

Each vector keeps its cluster, an upper bound of the distance to that centroid
and a lower bound of the distance to all others.  When centroids move, bounds
move with them; a vector whose upper bound stays strictly below its lower bound,
or below half the way to the nearest other centroid, keeps its cluster unseen.
Otherwise the upper bound u is made exact, and if that does not help only the
centroids within 2 u + s of its own are scanned (s: the way to the nearest other
centroid), which the sorted list of distances between centroids yields as a
prefix.  The radius is inclusive and every bound is widened by SLACK, so equal
distances are never skipped: results are those of the full scan, ties going to
the smaller number.  Distances that decide are whole numbers, computed exactly.

Vectors lie in written blocks of at most one Arrow batch, with their state and
their sums by cluster.  A round is one map over blocks and a sum of k vectors;
nothing but these k x dim numbers reaches the driver, and nothing else is sent
to tasks.  The blocks before go once the next ones are written.

Vectors that are null, of another length than ``dim``, or with a null or
non-finite component are not kept; neither are those with a component of 2**19
or more in size, whose squared distances no long could hold.  Repeated rows
count each; rows that share an id are told apart by their components as seeds.
A null ``vec_id`` stays null and seeds last.  With fewer than k vectors there are
as many centroids as vectors; an empty table stays empty.  Only ``vec_id`` and
``embedding`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

SCALE = 256
LARGEST = 1 << 19  # size of a component before scaling
SLACK = 1e-9
SMALL = 1 << 22  # whole numbers below it have exact products in doubles, up to 64 of them added up (and 128 x 2**44 < 2**53)
BLOCK = "ids array<bigint>, vectors binary, cluster binary, upper binary, lower binary, sums array<struct<cluster: int, n: bigint, inertia: bigint, total: array<bigint>>>"


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x from all rows of c."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if top < SMALL and 4 * top * top * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def _own(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    step = x - c[cluster]
    return np.einsum("ij,ij->i", step, step)


def _over(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + SLACK) + SLACK


def _under(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - SLACK) - SLACK


def _two_nearest(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column of the least distance (the first one of equals) and the second least distance."""
    best = d2.argmin(1)
    second = np.partition(d2, 1, axis=1)[:, 1] if d2.shape[1] > 1 else np.full(len(d2), 1 << 62)
    return best, second


class Geometry:
    """Distances between centroids: sorted lists and the way to the nearest other one."""

    def __init__(self, centroids: np.ndarray):
        d2 = _squares(centroids, centroids)
        k = len(centroids)
        self.order = np.argsort(d2, 1, kind="stable")
        self.sorted = _under(np.take_along_axis(d2, self.order, 1))
        away = d2.astype(np.float64) + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.nearest = np.sqrt(away.min(1)) if k else np.zeros(0)

    def ball(self, cluster: int, radius: float) -> int:
        """How many centroids lie in a ball around one of them; its edge counts."""
        return int(np.searchsorted(self.sorted[cluster], radius, "right"))


class Search:
    """Assignments of blocks to some centroids, from scratch or from bounds that held for earlier centroids."""

    def __init__(self, centroids: np.ndarray, earlier: np.ndarray | None = None):
        self.centroids, self.moved = centroids, None
        self.seen = 0  # distances that were computed, for tests
        if earlier is not None:
            self.geometry, self.moved = Geometry(centroids), _over(((centroids - earlier) ** 2).sum(1))
            self.moved[(centroids == earlier).all(1)] = 0
            self.most = int(self.moved.argmax())
            rest = np.delete(self.moved, self.most)
            self.second = float(rest.max()) if len(rest) else 0.0

    def __call__(self, x: np.ndarray, state: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower) of every vector."""
        if state is None:
            d2 = _squares(x, self.centroids)
            self.seen += d2.size
            cluster, second = _two_nearest(d2)
            return cluster.astype(np.int32), _over(d2[np.arange(len(x)), cluster]), _under(second)
        cluster, upper, lower = state[0].copy(), state[1] + self.moved[state[0]], state[2] - np.where(state[0] == self.most, self.second, self.moved[self.most])
        bound = np.maximum(self.geometry.nearest[cluster] * (0.5 * (1 - SLACK)) - SLACK, lower)
        open_ = np.flatnonzero(~(upper < bound))
        upper[open_] = _over(_own(x[open_], self.centroids, cluster[open_]))
        self.seen += len(open_)
        open_ = open_[~(upper[open_] < bound[open_])]
        for c in np.unique(cluster[open_]):
            self._scan(x, open_[cluster[open_] == c], int(c), cluster, upper, lower)
        return cluster, upper, lower

    def _scan(self, x: np.ndarray, rows: np.ndarray, c: int, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        g, k = self.geometry, len(self.centroids)
        radius = (2 * upper[rows] + g.nearest[c]) * (1 + SLACK) + SLACK
        reach = np.searchsorted(g.sorted[c], radius, "right")
        # vectors are taken together by rings of 2, 4, 8, ... centroids; a ring too large only adds candidates
        rings = np.minimum(1 << np.ceil(np.log2(np.maximum(reach, 2))).astype(np.int64), k)
        for size in np.unique(rings):
            some, near = rows[rings == size], np.sort(g.order[c][:size])  # ascending numbers: the first least one wins ties
            d2 = _squares(x[some], self.centroids[near])
            self.seen += d2.size
            best, second = _two_nearest(d2)
            cluster[some], upper[some], lower[some] = near[best], _over(d2[np.arange(len(some)), best]), _under(second)


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their components times SCALE, floored)."""
    column = column.cast(pa.list_(pa.float64()))
    kept = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    values = column.take(pa.array(kept)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls read as NaN
    sound = (np.abs(values) < LARGEST).all(1)  # False for NaN and infinities
    return kept[sound], np.floor(SCALE * values[sound]).astype(np.int64)


def _sums(x: np.ndarray, cluster: np.ndarray, d2: np.ndarray | None = None) -> list[dict]:
    out = []
    for c in np.unique(cluster):
        mine = cluster == c
        out.append({"cluster": int(c), "n": int(mine.sum()), "inertia": 0 if d2 is None else int(d2[mine].sum()), "total": x[mine].sum(0).tolist()})
    return out


def _block(ids: list, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, d2: np.ndarray | None = None) -> pa.RecordBatch:
    """One row; ``upper`` holds the squared distances instead where they are given."""
    kinds = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct({"cluster": pa.int32(), "n": pa.int64(), "inertia": pa.int64(), "total": pa.list_(pa.int64())}))]
    cells = [ids, x.astype("<i4").tobytes(), cluster.astype("<i4").tobytes(), (upper.astype("<f8") if d2 is None else d2.astype("<i8")).tobytes(), lower.astype("<f8").tobytes(), _sums(x, cluster, d2)]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(cells, kinds, strict=True)], ["ids", "vectors", "cluster", "upper", "lower", "sums"])


def _started(vectors: DataFrame, centroids: np.ndarray, dim: int, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            kept, x = integers(batch.column(1), dim)
            if len(kept):
                found = search(x, None)
                yield _block(batch.column(0).take(pa.array(kept)).to_pylist(), x, *found, _own(x, centroids, found[0]) if last else None)

    return vectors.mapInArrow(run, BLOCK)


def _next(blocks: DataFrame, centroids: np.ndarray, earlier: np.ndarray, dim: int, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, earlier)
        for batch in batches:
            for ids, vectors, cluster, upper, lower in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                x = np.frombuffer(vectors, "<i4").reshape(-1, dim).astype(np.int64)
                found = search(x, (np.frombuffer(cluster, "<i4"), np.frombuffer(upper, "<f8"), np.frombuffer(lower, "<f8")))
                yield _block(ids, x, *found, _own(x, centroids, found[0]) if last else None)

    return blocks.select("ids", "vectors", "cluster", "upper", "lower").mapInArrow(run, BLOCK)


def _totals(blocks: DataFrame, dim: int) -> list:
    """(cluster, n, inertia, component sums): one row a cluster."""
    sums = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dim)]
    return blocks.select(F.inline("sums")).groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *sums).collect()


def seeds(vectors: DataFrame, k: int, dim: int, seed: int | str) -> np.ndarray:
    """The k kept vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; k rows reach the driver."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)) & ~F.isnan(x))
    kept = vectors.where((F.size("embedding") == dim) & sound)
    rows = kept.orderBy(F.asc_nulls_last(hashed), "embedding").limit(k).select("embedding").collect()
    return np.floor(SCALE * np.array([r[0] for r in rows], np.float64).reshape(-1, dim)).astype(np.int64)


def clustered(vectors: DataFrame, k: int = 40, dim: int = 64, rounds: int = 5, seed: int | str = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector after ``rounds`` moves."""
    if min(k, dim) < 1 or rounds < 0:
        raise ValueError("k and dim must be above zero, rounds not below")
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    centroids = seeds(vectors, k, dim, seed)
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    blocks = scratch.durable(_started(vectors, centroids, dim, rounds == 0), "centroid-blocks")
    for at in range(rounds):
        earlier, centroids = centroids, centroids.copy()
        for row in _totals(blocks, dim):
            centroids[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dim)]
        done = blocks
        blocks = scratch.durable(_next(done, centroids, earlier, dim, at == rounds - 1), "centroid-blocks")
        scratch.drop(done)
    inertia = {row["cluster"]: row["inertia"] for row in _totals(blocks, dim)}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    whole = sum(inertia.values())
    own = np.array([inertia.get(c, 0) for c in range(len(names))], np.int64)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, cluster, distance in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                c = np.frombuffer(cluster, "<i4")
                cells = [pa.array(ids, pa.int64()), pa.array(c), pa.array(np.frombuffer(distance, "<i8")), pa.array(own[c]), pa.array(np.full(len(c), whole, np.int64)), pa.array(names).take(pa.array(c))]
                yield pa.RecordBatch.from_arrays(cells, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.select("ids", "cluster", "upper").mapInArrow(told, "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")


def op12(embeddings: DataFrame) -> DataFrame:
    return clustered(embeddings)
