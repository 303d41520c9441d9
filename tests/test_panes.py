"""Packed counts of panes against counts as rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens import shared
from threadlens.operators import bursts, changes, panes

from .test_arguments import comments

SAID = ["uno dos dos", "tres fuego", " ", "cuatro uno fuego fuego", None, "ñu zeta"]


def made(spark, seed=3):
    rng = random.Random(seed)
    rows = [(rng.choice([rng.randrange(300), rng.randrange(0, 300, 10)]), str(rng.randrange(70) % 7)) for _ in range(200)]
    named = comments(spark, rows).withColumn("text_id", F.col("cleaned_comment").cast("bigint") * 100).drop("cleaned_comment")  # a text that is not there, too
    return named, spark.createDataFrame([(i * 100, t) for i, t in enumerate(SAID)], "text_id bigint, cleaned_comment string")


@pytest.mark.parametrize("end", ["2024-01-01 05:04", "2024-01-01 05:00"])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_packed_rows_are_the_counts(spark, end, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    named, texts = made(spark)
    grid = changes.Grid(bursts.Sliding("2024-01-01 00:00", end, "10min", "30min", zone="UTC"))
    rows, terms = panes.packed(named, grid, ["dos"], texts)
    names = {r.id: r.term for r in terms.collect()}
    got = Counter()
    for r in rows.collect():
        at = (r.slice, None if r.place == panes.NONE else r.place, r.bin)
        got[*at, changes.MESSAGE] += r.msgs
        got[*at, changes.SAID] += r.said
        for i, n in zip(*panes.opened(r.data, r.size)):
            got[*at, names[i]] += int(n)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [names[i] for i in range(len(names))] == sorted(names.values())
    want = changes.counted(named, grid, ["dos"], texts).collect()
    assert +got == {(r.slice, r.place, r["bin"], r.term): r.n for r in want}


def test_packing():
    for ids, n in (([], []), ([7], [1]), ([0, 3, 1 << 30], [1 << 20, 1, 300])):
        back = panes.opened(panes.pressed(np.array(ids, np.int64), np.array(n, np.int64)), len(ids))
        assert [x.tolist() for x in back] == [ids, n]


def test_no_row_for_a_pane_and_term(spark, monkeypatch):
    """Windows are made without a table of a row for each pane and term, and without a text for each comment."""
    monkeypatch.setattr(shared, "bucketed", lambda *a: pytest.fail("counts as rows"))
    named, texts = made(spark)
    found = changes.Changes(named, bursts.Sliding("2024-01-01 00:00", "2024-01-01 05:04", zone="UTC", top_n=3), bursts.Detector(), ["dos"], texts)
    assert found.top().count() and found.snapshots().count() == found.ticks.count()


@pytest.mark.parametrize("end", ["2024-01-01 05:04", "2024-01-01 05:00"])
def test_digests_of_packed_rows(spark, monkeypatch, end):
    """The vocabulary passes in blocks, digits stand before the mark after a term, and nothing is a row for a pane and term."""
    monkeypatch.setattr(panes, "BLOCK", 2)
    rng = random.Random(4)
    rows = [(rng.choice([rng.randrange(300), rng.randrange(0, 300, 10)]), " ".join(rng.choices(["uno", "uno1", "unos", "ñu"], k=3))) for _ in range(90)]
    grid = changes.Grid(bursts.Sliding("2024-01-01 00:00", end, "10min", "30min", zone="UTC"))
    want = changes.counts_digests(changes.counted(comments(spark, rows), grid), grid).collect()
    monkeypatch.setattr(shared, "bucketed", lambda *a: pytest.fail("counts as rows"))
    assert sorted(map(tuple, changes.all_counts_digests(comments(spark, rows), grid).collect())) == sorted(map(tuple, want))
