"""What a chart shows of a long series, and its document."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest

from threadlens.operators import charts

WIDTH = 40


def drawn(points, step, start):
    """The lowest and highest place of a line within each pixel column, and where it enters and leaves."""
    out = {}

    def add(col, y):
        low, high = out.get(col, (y, y))
        out[col] = (min(low, y), max(high, y))

    for at, y in points:
        add((at - start) // step, y)
    for (a, x), (b, y) in zip(points, points[1:]):
        first, last = (a - start) // step, (b - start) // step
        for edge in range(first + 1, last + 1):  # the line crosses from column to column
            place = round(x + (y - x) * (start + edge * step - a) / (b - a), 6)
            add(edge - 1, place)
            add(edge, place)
    return out


@pytest.mark.parametrize("n", [1, 2, 30, 3000])
def test_line_is_that_of_all_points(spark, n):
    rng = random.Random(n)
    base = datetime(2024, 1, 1)
    rows = sorted((rng.randrange(10**9), round(rng.gauss(0, 5), 3)) for _ in range(n))
    rows += rows[: n // 10]  # repeated points
    table = [(base + timedelta(microseconds=at), y, k % 2 and "a" or None) for k, (at, y) in enumerate(rows)]
    bad = [(None, 1.0, "a"), (base, None, "a"), (base, float("nan"), "a"), (base - timedelta(days=9), float("inf"), "a")]
    df = spark.createDataFrame([*table, *bad], "ts timestamp_ntz, y double, name string")
    got = charts.reduced(df, "ts", "y", "name", WIDTH).collect()
    micros = lambda t: round(t.replace(tzinfo=timezone.utc).timestamp() * 1e6)
    start, end = (f(micros(t) for t, _, _ in table) for f in (min, max))
    step = -(-(end - start + 1) // WIDTH)
    for name in {s for _, _, s in table}:
        every = sorted((micros(t), y) for t, y, s in table if s == name)
        some = sorted((micros(r["at"]), r["value"]) for r in got if r["series"] == name)
        assert len(some) <= 4 * WIDTH and set(some) <= set(every)
        assert drawn(some, step, start) == drawn(sorted(set(every)), step, start)


def test_no_points_no_rows(spark):
    none = spark.createDataFrame([], "ts timestamp_ntz, y double, name string")
    assert charts.reduced(none, "ts", "y", "name").count() == 0
    assert charts.lines(charts.reduced(none, "ts", "y", "name"), "t").count() == 0
    assert charts.histogram(none, "t", "name").count() == 0
    assert charts.bars_and_line(none.selectExpr("ts", "1L a", "2L b"), "t", "ts", "a", "b").count() == 0
    with pytest.raises(ValueError):
        charts.reduced(none, "ts", "y", "name", 0)


def test_documents(spark):
    base = datetime(2024, 1, 1)
    df = spark.createDataFrame([(base + timedelta(hours=k), float(k % 5), "s") for k in range(48)], "ts timestamp_ntz, y double, name string")
    doc = json.loads(charts.lines(charts.reduced(df, "ts", "y", "name", 400), 'a "title"').first()["document"])
    assert doc["title"] == 'a "title"' and doc["mark"] == "line"
    assert [v["y"] for v in doc["data"]["values"]] == [float(k % 5) for k in range(48)]
    assert doc["data"]["values"][1]["x"] == "2024-01-01T01:00:00.000000"
    both = json.loads(charts.bars_and_line(df.selectExpr("ts", "cast(y as bigint) n", "2L m"), "t", "ts", "n", "m").first()["document"])
    assert [x["mark"] for x in both["layer"]] == ["bar", "line"] and both["resolve"]["scale"]["y"] == "independent"
    assert [(v["bars"], v["line"]) for v in both["data"]["values"]] == [(k % 5, 2) for k in range(48)]
    names = spark.createDataFrame([('q"\n}',), ('q"\n}',), (None,), ("é",), ("",)], "name string")
    bars = json.loads(charts.histogram(names, "t", "name").first()["document"])["data"]["values"]
    assert bars[0] == {"x": 'q"\n}', "y": 2}
    assert sorted((v["x"] or "", v["y"]) for v in bars[1:]) == [("", 1), ("", 1), ("é", 1)]
