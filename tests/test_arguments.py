"""Arguments, windows of any length, detectors of one's own, and registered queries on whole texts."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadlens import catalog
from threadlens.functions import intervals
from threadlens.operators import bursts, termstats, timebuckets
from threadlens.streaming import live


def comments(spark, rows):
    """Rows (minutes after midnight, text), in UTC."""
    at = lambda m: str(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m))
    df = spark.createDataFrame([(at(m), t, k) for k, (m, t) in enumerate(rows)], "published_at string, cleaned_comment string, row_pos long")
    return timebuckets.localised(df, zone="UTC")


def test_lengths_and_moments():
    assert intervals.micros("2H") == intervals.micros("120min") == intervals.micros(120) == intervals.micros(dt.timedelta(hours=2)) == 7_200_000_000
    assert intervals.micros("1h 30min") == 5_400_000_000 and intervals.micros("1D") == 86_400_000_000 and intervals.micros("90s") == 90_000_000
    for bad in ("", "soon", "10 parsecs", "-5min", 0, "0min"):
        with pytest.raises(ValueError):
            intervals.micros(bad)
    assert str(intervals.local("2024-01-01T03:00:00Z", "America/Bogota")) == "2023-12-31 22:00:00"
    assert str(intervals.local("2024-01-01 03:00", "America/Bogota")) == "2024-01-01 03:00:00"
    assert str(intervals.local(dt.datetime(2024, 1, 1, 3, tzinfo=dt.UTC), "Europe/Madrid")) == "2024-01-01 04:00:00"


def test_guards(spark):
    df = comments(spark, [(60, "hola mundo"), (70, "  "), (2000, "los las")])
    for start, end in (("2024-13-01", "2024-01-02"), ("2024-01-03", "2024-01-02"), ("x", "y")):
        with pytest.raises(ValueError):
            timebuckets.between(df, start, end)
        with pytest.raises(ValueError):
            termstats.top_terms_by_days(df, start, end)
        with pytest.raises(ValueError):
            bursts.Sliding(start, end)
    for wrong in ({"step": "0min"}, {"window": "wide"}, {"grain": -1}, {"top_n": 0}):
        with pytest.raises(ValueError):
            bursts.Sliding("2024-01-01", "2024-01-02", **wrong)
    with pytest.raises(ValueError, match="no comment"):
        termstats.top_terms_24h(df, "2024-03-01")
    with pytest.raises(ValueError, match="no term"):
        termstats.top_terms_24h(df, "2024-01-02", stop_words=["los", "las"])
    with pytest.raises(ValueError):
        termstats.top_terms_24h(df, "not a day")
    counts, _ = termstats.top_terms_24h(df, "2024-01-01T12:00:00Z", zone="UTC")
    assert counts.count() == 48 and termstats.top_terms_by_days(df, "2024-01-01", "2024-01-02", zone="UTC")[0].select("bucket").distinct().count() == 2


def test_zones_in_text(spark):
    rows = [("2024-01-01 10:00:00",), ("2024-01-01T10:00:00Z",), ("2024-01-01T12:00:00+02:00",), ("soon",), (None,)]
    df = timebuckets.localised(spark.createDataFrame(rows, "published_at string"), zone="America/Bogota")
    assert [str(r.local_ts) for r in df.collect()] == ["2024-01-01 05:00:00"] * 3


@pytest.mark.parametrize(("step", "window", "grain"), [("10min", "2h", "10min"), ("7min", "25min", "5min"), ("25min", "70min", "50min"), ("30min", "10min", "1h"), ("90s", "4min", "7min")])
def test_windows_equal_a_loop(spark, step, window, grain):
    rng = random.Random(hash((step, window)) % 100)
    rows = [(rng.choice([rng.randrange(600), rng.randrange(60) * 10, rng.randrange(2400) / 4]), rng.choice(["uno dos", "dos tres", " ", "tres tres"])) for _ in range(150)]
    w = bursts.Sliding("2024-01-01 01:03:00", "2024-01-01 08:11:00", step, window, grain, zone="UTC")
    counts, bins, sizes = bursts.windowed(comments(spark, rows), w)
    start, end = dt.datetime(2024, 1, 1, 1, 3), dt.datetime(2024, 1, 1, 8, 11)
    step, window, grain = (dt.timedelta(microseconds=x) for x in (w.step_us, w.window_us, w.grain_us))
    want, n, seen, t = Counter(), {}, set(), start
    while t < end:
        t = min(t + step, end)
        inside = sorted((at, text) for m, text in rows if t - window < (at := dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) < t)
        if inside:
            n[t] = len(inside)
            origin = inside[0][0].replace(hour=0, minute=0, second=0, microsecond=0)
            for at, text in inside:
                at = origin + (at - origin) // grain * grain
                if text.strip():
                    seen.add((t, at))
                for word in text.split():
                    want[t, at, word] += 1
    assert {tuple(r) for r in sizes.collect()} == set(n.items())
    assert {(r.tick, r.bin, r.term): r.n for r in counts.collect()} == want
    assert {tuple(r) for r in bins.collect()} == seen
    every = comments(spark, rows).select(F.explode(bursts.ticks_of(F.col("local_ts"), w)).alias("tick")).groupBy("tick").count()
    assert {tuple(r) for r in every.collect()} == set(n.items())


class Moody:
    def __init__(self):
        self.seen = []

    def __call__(self, view):
        self.seen.append(view["n_msgs"])
        if view["n_msgs"] == 2:
            raise RuntimeError("two is too many")
        assert all(t["freq"] > 0 for t in view["terms"])
        return {"score": float(sum(self.seen)), "is_event": view["n_msgs"] > 2, "other": 1}


def test_a_failing_detector_leaves_the_others(spark):
    rows = [(5, "uno"), (15, "dos"), (16, "dos tres"), (25, "uno"), (26, "uno"), (27, "uno")]
    w = bursts.Sliding("2024-01-01 00:00", "2024-01-01 00:40", "10min", "10min", zone="UTC")
    view = bursts.views(*bursts.windowed(comments(spark, rows), w), w)
    got = [tuple(r)[1:] for r in bursts.hooked(view, Moody()).orderBy("tick").collect()]
    assert got == [(1, 1.0, False, None), (2, None, False, "two is too many"), (3, 6.0, True, None)]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(300), rng.choice(["uno dos", "tres", "cuatro uno"]) + (" fuego" * 3 if m > 250 else "")) for m in range(300)]
    w = bursts.Sliding("2024-01-01 00:00", "2024-01-01 05:04", "10min", "30min", zone="UTC", top_n=3)
    detector = bursts.Detector(baseline=4, k_sigma=0.5, min_history=2, sigma_floor=0.01)
    df = comments(spark, rows)
    marked = F.concat(F.split("cleaned_comment", " "), F.array(F.lit(live.MESSAGE), F.lit(live.SAID)))
    ticks = df.select(F.explode(bursts.ticks_of(F.col("local_ts"), w)).alias("tick"), bursts.bin_of(F.col("local_ts"), w).alias("bin"), marked.alias("terms"))
    every = ticks.select("tick", "bin", F.explode("terms").alias("term")).groupBy("tick", "bin", "term").agg(F.count("*").alias("n"))
    sink = live.Detection(str(tmp_path), w, detector)
    cuts = [F.col("tick") < F.lit("2024-01-01 01:35").cast("timestamp_ntz"), F.lit(False), F.col("tick").between(F.lit("2024-01-01 01:35").cast("timestamp_ntz"), F.lit("2024-01-01 03:00").cast("timestamp_ntz")), F.col("tick") > F.lit("2024-01-01 03:00").cast("timestamp_ntz")]
    for number, cut in enumerate(cuts):
        for _ in range(2 if number == 2 else 1):
            sink(every.where(cut), number)
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/snapshots")
    shown = lambda df: sorted((r.tick, r.n_msgs, r.tfidf_terms, round(r.score, 6), tuple(r.important_terms), r.is_event) for r in df.collect())
    want = shown(bursts.detect(df, w, detector))
    assert shown(got) == want and any(r[-1] for r in want)
    events = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/events")
    assert events.count() == sum(r[-1] for r in want)
    state = spark.read.parquet(f"{tmp_path}/state/batch=3").where("kind = 'past'").groupBy("term").count()
    assert state.agg(F.max("count")).first()[0] <= detector.baseline


def table(spark, folder, texts, stamps):
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    events = spark.createDataFrame([(k, at, k % 2, 1.0) for k, at in stamps], "event_id bigint, ts string, user_id bigint, value double")
    events.selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "value").write.parquet(f"{folder}/events.parquet")


def test_no_word_and_no_comment_is_cut(spark, tmp_path):
    """Nine comments of 3,000 words on nine days; the last word is the only one of its kind."""
    texts = [" ".join([f"{'abcd'[k % 4]}word"] * 2999 + [f"last{'xyz'[k % 3]}"]) for k in range(3)]
    table(spark, tmp_path, texts, [(k, f"2024-01-{1 + 3 * k:02} 12:00:00") for k in range(1, 10)])
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert Counter(r.cleaned_comment.split()[-1] for r in run("clean_comments")) == {"lastx": 3, "lasty": 3, "lastz": 3}
    assert {len(r.cleaned_comment.split()) for r in run("clean_comments")} == {3000}
    for kind, buckets in (("monthly", 1), ("daily", 25), ("hourly", 24 * 24 + 1)):
        rows = run(f"{kind}_volume")
        assert len(rows) == buckets and sum(r.n_comments for r in rows) == 9 and sum(r.n_words for r in rows) == 27_000
    counts = defaultdict(int)
    for r in run("top_terms_monthly"):
        counts[r.term] += r.n
    assert counts == {"aword": 8997, "bword": 8997, "cword": 8997, "lastx": 3, "lasty": 3}


def test_windows_keep_800_terms(spark):
    words = [f"w{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"]
    w = bursts.Sliding("2024-01-01 00:00", "2024-01-01 01:00", zone="UTC")
    counts, _, _ = bursts.windowed(comments(spark, [(5, " ".join(words) + " " + words[999])]), w)
    top = bursts.top_by_tick(counts, w.top_n).where("tick = timestamp_ntz'2024-01-01 00:10:00'").collect()
    assert {(r.rank, r.term) for r in top} == {(1, words[999]), *((k + 2, x) for k, x in enumerate(words[:799]))}
