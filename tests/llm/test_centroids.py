"""Exponion search against the full scan, and k-means against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from threadlens.llm import centroids as C


def plain(rows, k=40, dim=64, rounds=5, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) < C.LARGEST for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, q, strict=True)), j) for j, q in enumerate(c))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        c = [[sum(col) // len(m) for col in zip(*m, strict=True)] if (m := [v for (_, v), o in zip(kept, own, strict=True) if o == j]) else q for j, q in enumerate(c)]
    found = [(i, *nearest(v)) for i, v in kept]
    whole = sum(d for _, d, _ in found)
    each = {j: sum(d for _, d, o in found if o == j) for j in range(len(c))}
    name = [hashlib.sha256(",".join(map(str, q)).encode()).hexdigest() for q in c]
    return sorted(((i, j, d, each[j], whole, name[j]) for i, d, j in found), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def lattice(n, dim, rng, values=(0, 1, 2, 3)):
    """Few different whole coordinates, so many distances are equal."""
    return [(i, [rng.choice(values) / 256 for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("k, dim, rounds", [(6, 2, 5), (40, 3, 4), (1, 2, 2), (5, 3, 0), (300, 2, 2)])
def test_equal_to_plain_with_many_ties(spark, k, dim, rounds):
    rows = lattice(200, dim, random.Random(k))
    rows += [(500, rows[3][1]), (3, rows[3][1]), (None, rows[9][1]), (600, None), (601, []), (602, [0.1] * (dim + 1)), (603, [float("nan")] * dim), (604, [float("inf")] * dim), (605, [None] * dim), (606, [-3.3] * dim), (607, [600_000.0] * dim)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster string").repartition(3)
    assert rows_of(C.clustered(df, k, dim, rounds)) == plain(rows, k, dim, rounds)


def test_large_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-500_000, 500_000) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert rows_of(C.clustered(df, 7, 4, 3)) == plain(rows, 7, 4, 3)


@pytest.mark.parametrize("spread", [1, 3, 40])
def test_search_equals_full_scan_and_sees_less(spread):
    rng = np.random.default_rng(spread)
    middles = rng.integers(-400, 400, (30, 8))
    x = (middles[rng.integers(0, 30, 3000)] + rng.integers(-spread, spread + 1, (3000, 8))).astype(np.int64)
    c = middles.astype(np.int64)
    state, seen = C.Search(c)(x, None), 0
    for _ in range(6):
        moved = c + rng.integers(-2, 3, c.shape)
        moved[4] = c[4]
        search = C.Search(moved, c)
        state, c = search(x, state), moved
        d2 = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (state[0] == d2.argmin(1)).all()
        true = np.sqrt(d2.astype(float))
        own = true[np.arange(len(x)), state[0]]
        assert (state[1] >= own).all()
        true[np.arange(len(x)), state[0]] = np.inf
        assert (state[2] <= true.min(1)).all()
        seen += search.seen
    assert seen < 6 * d2.size / 3


def test_ball_keeps_its_edge():
    g = C.Geometry(np.array([[0, 0], [3, 4], [6, 8], [0, 1]]))
    assert g.ball(0, 5.0) == 3 and g.ball(0, 4.9) == 2 and g.order[0].tolist() == [0, 3, 1, 2]


def test_repeated_centroids_and_empty_tables(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert rows_of(C.clustered(df, 4, 2, 2)) == plain(rows, 4, 2, 2)
    assert C.op12(df).count() == 0 and C.op12(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.clustered(df, 0)
