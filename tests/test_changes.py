"""Windows made of changes against a loop over ticks, and against windows that are counted tick by tick."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest

from threadlens.operators import bursts, changes

from .test_arguments import comments
from .test_operators import fold


def made(spark, rows, detector=bursts.Detector(), **lengths):
    w = bursts.Sliding(lengths.pop("start"), lengths.pop("end"), zone="UTC", **lengths)
    return w, changes.Changes(comments(spark, rows), w, detector)


@pytest.mark.parametrize("hot", [5_000, 0])
@pytest.mark.parametrize(
    ("step", "window", "grain", "end", "top_n"),
    [("10min", "2h", "10min", "2024-01-01 08:11", 3), ("10min", "30min", "10min", "2024-01-01 08:03", 2), ("7min", "25min", "5min", "2024-01-01 06:00", 4), ("30min", "10min", "1h", "2024-01-01 09:03", 1), ("1min", "4min", "2min", "2024-01-01 03:03", 800)],
)
def test_top_terms_equal_a_loop(spark, monkeypatch, hot, step, window, grain, end, top_n):
    monkeypatch.setattr(changes, "HOT", hot)
    rng = random.Random(top_n)
    rows = [(rng.choice([rng.randrange(600), rng.randrange(60) * 10, rng.randrange(2400) / 4]), rng.choice(["uno dos", "dos tres", " ", "tres tres cuatro", "cinco"])) for _ in range(150)]
    w, ch = made(spark, rows, start="2024-01-01 01:03", end=end, step=step, window=window, grain=grain, top_n=top_n)
    start, end = dt.datetime(2024, 1, 1, 1, 3), dt.datetime.fromisoformat(end)
    step, window, grain = (dt.timedelta(microseconds=x) for x in (w.step_us, w.window_us, w.grain_us))
    n, top, cells, t = {}, {}, {}, start
    while t < end:
        t = min(t + step, end)
        inside = [(at, text) for m, text in rows if t - window < (at := dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) < t]
        if inside:
            n[t] = len(inside)
            freq = Counter(x for _, text in inside for x in text.split())
            for rank, (term, f) in enumerate(sorted(freq.items(), key=lambda x: (-x[1], x[0]))[:top_n]):
                top[t, term] = (f, rank + 1)
                cells[t, term] = Counter(dt.datetime(2024, 1, 1) + (at - dt.datetime(2024, 1, 1)) // grain * grain for at, text in inside for x in text.split() if x == term)
    assert {r.tick: r.n_msgs for r in ch.timed(ch.ticks.select("k", "n_msgs")).collect()} == n
    found = ch.timed(ch.top()).collect()
    assert len(found) == len(top) and {(r.tick, r.term): (r.freq, r["rank"]) for r in found} == top
    weights = ch.timed(ch.tfidf()).withColumn("bin", ch.grid.bin_moment(changes.F.col("bin"))).collect()
    got = defaultdict(Counter)
    for r in weights:
        got[r.tick, r.term][r.bin] += r.n
    assert got == cells
    said = {t: len({x for at, text in every for x in text.split() if t - window < at < t}) for every in [[(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), text) for m, text in rows]] for t in n}
    assert {r.tick: r.n_terms for r in ch.timed(ch.ticks.select("k", "n_terms")).collect()} == said


def test_stretches_hold_every_windows_counts(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2400) / 4, rng.choice(["uno dos", "dos", "tres dos dos"])) for _ in range(200)]
    w, ch = made(spark, rows, start="2024-01-01 00:00", end="2024-01-01 10:05", step="5min", window="20min")
    held = {}
    for r in changes.stretches(ch.ranges()).collect():
        for k in range(r.first, r.last + 1):
            assert (r.term, k) not in held
            held[r.term, k] = r.freq
    counts = bursts.windowed(comments(spark, rows), w)[0].groupBy("tick", "term").sum("n").collect()
    assert held == {(r.term, (r.tick - dt.datetime(2024, 1, 1)) // dt.timedelta(minutes=5)): r[2] for r in counts}


@pytest.mark.parametrize("agg", ["sum", "mean"])
def test_detector_equals_a_loop(spark, agg):
    rng = random.Random(8)
    rows = [(rng.choice([rng.randrange(300), rng.randrange(380, 500)]), " ".join(rng.choice(["uno", "dos", "tres", "cuatro", "cinco"]) for _ in range(rng.randrange(4)))) for _ in range(300)] + [(450, "fuego fuego")] * 4
    detector = bursts.Detector(baseline=12, k_sigma=1.0, min_history=3, sigma_floor=0.02, top_k=2, agg=agg)
    w, ch = made(spark, rows, detector, start="2024-01-01 00:07", end="2024-01-01 08:20", window="30min", top_n=4)
    vector, freq = defaultdict(dict), {}
    for r in ch.timed(ch.vectors()).collect():
        vector[r.tick][r.term], freq[r.tick, r.term] = r.value, r.freq
    ticks = sorted(r.tick for r in ch.timed(ch.ticks.select("k")).collect())
    snap = {r.tick: (round(r.score, 5), r.important_count, r.is_event) for r in ch.snapshots().collect()}
    assert snap.pop(ticks[0]) == (0.0, 0, False) and any(x[2] for x in snap.values())
    want = fold(ticks, vector, freq, detector)
    assert {t: x[1:] for t, x in snap.items()} == {t: x[1:] for t, x in want.items()}
    assert {t: x[0] for t, x in snap.items()} == pytest.approx({t: x[0] for t, x in want.items()}, abs=2e-5)
    found = ch.found().collect()
    assert all(r.history <= 12 and r["rank"] <= 2 for r in found) and len(found) == sum(x[1] for x in snap.values())


def test_no_comment_and_no_word(spark):
    for rows in ([], [(5, " ")]):
        _, ch = made(spark, rows, start="2024-01-01 00:00", end="2024-01-01 01:00")
        snaps = ch.snapshots().collect()
        assert len(snaps) == 6 * len(rows) and all(r.tfidf_terms == 0 and not r.is_event for r in snaps)
    with pytest.raises(ValueError):
        made(spark, [], start="2024-01-01 00:00", end="2024-01-01 01:00", grain="7min")
