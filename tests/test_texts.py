"""Comments that name their text: the same results as comments that hold it, and each text is handled once."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from threadlens import catalog
from threadlens.functions import text as X
from threadlens.operators import bursts, changes, cleaning, termstats, timebuckets
from threadlens.plans import fixtures as fx
from threadlens.sources import sinks

SAID = ["uno dos dos", "Dos tres https://x.co/a", ":) 12", "los los tres cuatro", None]


@pytest.fixture(scope="module")
def forms(spark):
    """(comments with text, comments with text_id, texts)."""
    rng = random.Random(3)
    rows = [(f"c{i}", i % 3 != 0, f"c{i - i % 3}" if i % 3 else None, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(4000)), i, rng.randrange(5)) for i in range(300)]
    named = spark.createDataFrame(rows, "comment_id string, is_reply boolean, reply_to_comment_id string, local_ts timestamp_ntz, row_pos bigint, text_id bigint")
    texts = spark.createDataFrame(list(enumerate(SAID)), "text_id bigint, text string")
    return named.join(texts, "text_id").drop("text_id"), named, texts.select("text_id", X.cleaned(F.col("text")).alias("cleaned_comment"))


def rows(df):
    return sorted(map(str, df.collect()))


def test_cleaning(forms):
    held, named, texts = forms
    columns = ["comment_id", "local_ts", "cleaned_comment"]
    assert rows(cleaning.clean_by_text(named, texts, columns)) == rows(cleaning.clean_comments(held, columns))


@pytest.mark.parametrize("kind", ["weekly", "daily"])
def test_series_and_volume(forms, kind):
    held, named, texts = forms
    held = cleaning.with_cleaned(held)
    assert rows(timebuckets.volume(named, kind, texts=texts)) == rows(timebuckets.volume(held, kind))
    for mine, other in zip(termstats.series(named, kind, 3, ["los"], texts=texts), termstats.series(held, kind, 3, ["los"]), strict=True):
        assert rows(mine) == rows(other)


@pytest.mark.parametrize("hot", [5_000, 3])
def test_windows(forms, monkeypatch, hot):
    monkeypatch.setattr(changes, "HOT", hot)
    held, named, texts = forms
    grid = changes.Grid(bursts.Sliding("2024-01-01 01:00", "2024-01-02 05:03", zone="UTC"))
    assert rows(changes.counted(named, grid, ["los"], texts)) == rows(changes.counted(cleaning.with_cleaned(held), grid, ["los"]))


def test_queries_clean_a_text_once(spark, sf, monkeypatch):
    """What is cleaned has a row for each text, not for each comment."""
    made = []
    texts = fx.texts
    monkeypatch.setattr(fx, "texts", lambda *a, **k: made.append(texts(*a, **k)) or made[-1])
    assert catalog.queries()["daily_volume"](spark, sf).count()
    assert [t.count() for t in made] == [fx.table(spark, sf, "documents").count() + 1]


def test_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "RECORDS", 10)
    sinks.write_csv(spark.range(95).coalesce(1), str(tmp_path / "csv"))
    files = list((tmp_path / "csv").glob("part-*"))
    assert len(files) == 10 and all(len(f.read_text().splitlines()) <= 11 for f in files)


def test_digests_of_documents_in_parts(spark):
    """A bucket's digest is that of its whole document, and no row holds the whole."""
    rows = [(dt.datetime(2024, 1, 1 + i % 2 * 2, i % 24), i, f"ñ{i}") for i in range(90)]
    parts = timebuckets.documents(spark.createDataFrame(rows, "local_ts timestamp_ntz, row_pos bigint, cleaned_comment string"), "daily", 7)
    got = {r.bucket.day: r.document_sha256 for r in timebuckets.digests(parts).collect()}
    whole = {day: " ".join(t for *_, t in sorted(r for r in rows if r[0].day == day)) for day in (1, 2, 3)}
    assert got == {day: hashlib.sha256(text.encode()).hexdigest() for day, text in whole.items()}
    assert parts.count() == 15


def test_digests_of_named_texts(spark):
    """The same digests where comments name their text, and no text is sent as it is."""
    rows = [(dt.datetime(2024, 1, 1 + i % 2 * 2, i % 24), i, i % 4) for i in range(90)]
    named = spark.createDataFrame(rows, "local_ts timestamp_ntz, row_pos bigint, text_id bigint")
    texts = spark.createDataFrame(list(enumerate(["uno", "ñu dos", "", "tres " * 50])), "text_id bigint, cleaned_comment string")
    want = timebuckets.digests(timebuckets.documents(named.join(texts, "text_id"), "daily", 7)).collect()
    got = timebuckets.text_digests(named, texts, "daily")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) == 3
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["sliding_counts", "stream_bursts", "stream_events"])
def test_sql_has_all_ticks(name):
    """No stretch of the events and no last window is left out."""
    assert "2024-01-10" not in catalog.oracle_sql()[name] and "WHERE k <=" not in catalog.oracle_sql()[name]
