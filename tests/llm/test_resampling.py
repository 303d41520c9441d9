"""Importance resampling against zlib, plain Python and SQL's rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from threadlens.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def runs(text, order):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def plain(docs, bench, order=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, x in rows for f in runs(x, order)) for rows in (docs, bench))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, x in docs:
        f = [gain(bucket(g)) for g in runs(x, order)]
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=str)


def odd():
    rng = random.Random(3)
    said = [f"w{k}" for k in range(50)] + ["Ñandú", "日本", "a" * 63, "b" * 64, "c" * 65, "d" * 5000, "İ", "x1"]
    rows = [(k, " ".join(rng.choice(said) for _ in range(rng.randrange(60)))) for k in range(150)]
    return [*rows, (200, None), (201, ""), (202, "..."), (203, "tail"), (204, "z" * 100_000 + "!" + "q"), (7, rows[7][1])]


def test_crc_is_zlibs_for_every_run():
    texts = [x for _, x in odd()]
    for column in (pa.array(texts), pa.array(["junk words", *texts, "more"])[1:-1]):
        for order in (1, 2, 3):
            owner, crc = R.hashed(R.Buffer(column), order)
            got = sorted(zip(owner.tolist(), crc.tolist(), strict=True))
            assert got == sorted((k, zlib.crc32(f.encode())) for k, x in enumerate(texts) for f in runs(x, order))


def test_words_end_with_their_text():
    found = R.Buffer(pa.array(["ab", "cd", None, "", "ef gh"]))
    assert found.counts.tolist() == [1, 1, 0, 0, 2]
    assert len(R.Buffer(pa.array([], pa.string())).counts) == 0


@pytest.mark.parametrize("order, buckets, percent, least", [(1, 10_000, 10, 20), (2, 97, 33, 5), (3, 1000, 100, 0)])
def test_resampled_equals_plain(spark, order, buckets, percent, least):
    docs, bench = odd(), [(1, "w1 w2 w3 w4 Ñandú"), (2, None), (3, "w1 w1")]
    df = spark.createDataFrame([(i, x, "k", 1) for i, x in docs], "doc_id bigint, text string, row string, score int").repartition(3)
    target = spark.createDataFrame(bench, "item_id bigint, text string")
    got = R.resampled(df, target, R.Features(order, buckets), percent, least).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, bench, order, buckets, percent, least)


def test_null_ids_ties_and_copies_are_all_kept(spark):
    rows = [(None, "one two three")] * 40 + [(5, "one two three")] * 60
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    out = R.resampled(df, df, percent=50, least_words=1).collect()
    assert len(out) == 100 and sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 51))
    assert len({r["score"] for r in out}) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c " * 10), (2, None)], "doc_id bigint, text string")
    assert R.op13(none, some).count() == 0
    assert [tuple(r)[:3] for r in R.op13(some, none).orderBy("doc_id").collect()] == [(r[0], r[1], r[2]) for r in plain([(1, "a b c " * 10), (2, None)], [])]


def test_gains_follow_the_target():
    gain = R.gains(np.array([100, 1, 0]), np.array([0, 50, 0]))
    assert gain[1] > 0 > gain[0]
    with pytest.raises(ValueError):
        R.Features(0)
