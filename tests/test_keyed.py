"""The detector with state by term against the batch detector."""

import random

import pandas as pd
import pytest

from threadlens.operators import bursts, changes
from threadlens.streaming import keyed

from .test_arguments import comments


def shown(df):
    return sorted((r.tick, r.n_msgs, r.tfidf_terms, round(r.score, 6), tuple(r.important_terms), r.is_event) for r in df.collect())


@pytest.mark.parametrize("end", ["2024-01-01 05:04", "2024-01-01 05:00"])
def test_stream_equals_batch(spark, end):
    rng = random.Random(2)
    rows = [(m, rng.choice(["uno dos", "tres", "cuatro uno", " "]) + (" fuego" * 3 if m > 250 else "")) for m in (rng.choice([rng.randrange(90), rng.randrange(140, 300)]) for _ in range(300))]
    rows = [(m, " " if 20 <= m < 75 else x) for m, x in rows]  # some windows hold blank comments only
    w = bursts.Sliding("2024-01-01 00:00", end, "10min", "30min", zone="UTC", top_n=3)
    detector = bursts.Detector(baseline=4, k_sigma=0.5, min_history=2, sigma_floor=0.01)
    df = comments(spark, rows)
    want = shown(changes.detect(df, w, detector))
    snaps, events = keyed.bursts_once(df, w, detector)
    assert shown(snaps) == want and any(r[-1] for r in want)
    assert events.count() == sum(r[-1] for r in want)


class Kept:
    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows


def test_history_is_bounded_and_equals_a_loop():
    rng, state = random.Random(4), keyed.History(5)
    state.past = Kept()
    ds = [round(rng.random() * 3, 9) for _ in range(40)]
    out = []
    for a in range(0, 40, 7):
        part = pd.DataFrame({"term": "t", "seq": range(a, min(a + 7, 40)), "now": 0.0, "before": 0.0, "freq": 1, "d": ds[a : a + 7]}).sample(frac=1, random_state=a)
        out += [tuple(r) for f in state.handleInputRows(("t",), iter([part.iloc[:3], part.iloc[3:]]), None) for r in f[["history", "mu", "sigma"]].itertuples(index=False)]
        assert len(state.past.rows) <= 5
    for k, (n, mu, sigma) in enumerate(out):
        past = pd.Series(ds[max(0, k - 5) : k])
        assert n == len(past) and mu == pytest.approx(past.mean() if n else 0) and sigma == pytest.approx(past.std(ddof=0) if n else 0, abs=1e-12)


def test_results_replace_failures_and_killed_runs_count_as_none(spark, tmp_path):
    from threadlens.sources import sinks

    schema, path = "id bigint, classification string", str(tmp_path / "results")
    rows = lambda *xs: spark.createDataFrame(list(xs), schema)
    got = lambda: sorted(tuple(r) for r in sinks.latest_results(spark, path, schema, "id").collect())
    assert got() == []
    sinks.write_run(rows((1, "2"), (2, "error")), path, 1)
    work = rows((1, "x"), (2, "x"), (3, "x"))
    todo = sinks.pending(work, sinks.latest_results(spark, path, schema, "id"), "id", retry="error")
    assert sorted(r.id for r in todo.collect()) == [2, 3]
    for _ in range(2):  # a repeated run replaces itself
        sinks.write_run(rows((2, "5"), (3, "1")), path, 2)
    assert got() == [(1, "2", 1), (2, "5", 2), (3, "1", 2)]
    rows((1, "half")).write.parquet(f"{path}/run=3")
    (tmp_path / "results" / "run=3" / "_SUCCESS").unlink()
    assert got() == [(1, "2", 1), (2, "5", 2), (3, "1", 2)]
