"""Digests of windows, made from cells that pass by in order, against windows built one by one."""

import datetime as dt
import hashlib
import random
from collections import Counter

import pytest

from threadlens import catalog
from threadlens.operators import bursts, changes

from .test_arguments import comments

START = dt.datetime(2024, 1, 1)


def made():
    """Comments, some of them exactly on a pane's edge."""
    rng = random.Random(5)
    return [(rng.choice([rng.randrange(300), rng.randrange(0, 300, 10)]), " ".join(rng.choices(["uno", "dos", "tres", "sol", "sola"], k=3))) for _ in range(200)]


def expected(rows, w, bin_of):
    ends = [*range(w.step_us, w.end_us - w.start_us, w.step_us), w.end_us - w.start_us]
    out = {}
    for end in ends:
        inside = [(m * 60_000_000, x) for m, x in rows if end - w.window_us < m * 60_000_000 < end]
        cells = Counter((t, bin_of(us, min(u for u, _ in inside))) for us, x in inside for t in x.split())
        if cells:
            told = sorted(f"{t}:{b:%Y%m%d%H%M}:{n}" for (t, b), n in cells.items())
            out[dt.datetime.fromtimestamp((w.start_us + end) / 1e6, dt.timezone.utc).replace(tzinfo=None)] = (len(told), hashlib.sha256(",".join(told).encode()).hexdigest())
    return out


@pytest.mark.parametrize("end", ["2024-01-01 05:04", "2024-01-01 05:00"])
@pytest.mark.parametrize("grain", ["10min", "30min"])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_counts(spark, monkeypatch, end, grain, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows, w = made(), bursts.Sliding("2024-01-01 00:00", end, "10min", "30min", grain, zone="UTC")
    grid = changes.Grid(w)
    got = {r.tick: (r.n_cells, r.counts_sha256) for r in changes.counts_digests(changes.counted(comments(spark, rows), grid), grid).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == expected(rows, w, lambda us, first: START + dt.timedelta(microseconds=us // w.grain_us * w.grain_us))


@pytest.mark.parametrize(("end", "window"), [("2024-01-01 05:04", "1h10min"), ("2024-01-02 03:07", "26h"), ("2024-01-01 04:10", "50min")])
def test_odd_counts(spark, end, window):
    rows = [(m * 6, x) for m, x in made()]
    w = bursts.Sliding("2024-01-01 00:00", end, "25min", window, "50min", zone="UTC")
    got = {r.tick: (r.n_cells, r.counts_sha256) for r in changes.odd_counts_digests(comments(spark, rows), w).collect()}

    def bin_of(us, first):
        day = first // bursts.DAY * bursts.DAY
        return START + dt.timedelta(microseconds=day + (us - day) // w.grain_us * w.grain_us)

    assert got == expected(rows, w, bin_of) and len(got) > 5


@pytest.mark.parametrize("name", ["sliding_counts", "sliding_odd_windows"])
def test_no_tick_is_one_row(spark, sf, name):
    """A tick's cells are not collected into one row, nor, where windows share bins, copied for each tick."""
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and (name != "sliding_counts" or "Generate" not in plan)
