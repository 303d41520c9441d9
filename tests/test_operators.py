"""Operators on hand-written rows."""

import json
from collections import defaultdict
from statistics import pstdev

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens import schemas
from threadlens.functions import labels, text as X
from threadlens.operators import bursts, cleaning, collect, graph, models, privacy, termstats, timebuckets
from threadlens.sources import api, files, sinks


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_cleaning_steps(spark):
    rows = [(None,), ("",), ("Hola :D ;-) =) visita https://x.co/aé?b=1 y www.foo.com  él ñu año no  SÍ",), ("rock&roll",), ("niño_2",), ("a b c",), ("uno dos tres",)]
    got = [r[0] for r in values(spark, rows, "t string", X.cleaned(F.col("t")))]
    assert got == ["", "", "hola visita año", "rockroll", "niño", "", "uno dos tres"]


def test_cleaning_twice_changes_nothing(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet="abcñÑé :;)D/.\n1&wW", max_size=60), min_size=30, max_size=30))
    def check(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.cleaned(F.col("t")).alias("c"))
        assert df.where(~F.col("c").eqNullSafe(X.cleaned(F.col("c")))).count() == 0

    check()


def test_cascade(spark):
    rows = [("p1", "1", False, None), ("r1", "hola mundo", True, "p1"), ("p2", "hola mundo", False, None), ("r2", "!!", True, "p2"), ("r3", "hola mundo", True, None), ("r4", "hola mundo", True, "zz")]
    df = spark.createDataFrame(rows, "comment_id string, text string, is_reply boolean, reply_to_comment_id string")
    assert {r.comment_id for r in cleaning.clean_comments(df).collect()} == {"p2", "r3", "r4"}
    assert tuple(cleaning.removed_counters(df).first()) == (6, 2, 1, 3)


def test_lemmas(spark):
    df = spark.createDataFrame([("a", "los niños corrían hacer mucho"), ("b", "los")], "comment_id string, cleaned_comment string")
    lexicon = spark.createDataFrame([("los", "el", "DET", False), ("niños", "niño", "NOUN", False), ("corrían", "correr", "VERB", False), ("mucho", "mucho", "ADV", True)], "form string, lemma string, pos string, is_stop boolean")
    assert dict(cleaning.lemmatised(df, lexicon).select("comment_id", "cleaned_comment").collect()) == {"a": "niño correr", "b": ""}


def test_iso_durations(spark):
    rows = [("PT0S",), ("PT45S",), ("PT1H2M3S",), ("P1DT1H",), (None,)]
    assert [r[0] for r in values(spark, rows, "d string", X.iso_seconds(F.col("d")))] == [0, 45, 3723, 90000, None]


def test_labels(spark):
    rows = [(0.05,), (-0.05,), (0.0501,), (-0.2,)]
    assert [r[0] for r in values(spark, rows, "s double", labels.from_compound(F.col("s")))] == ["Neutral", "Neutral", "Positive", "Negative"]
    rows = [("0",), ("5",), ("3.0",), ("error",), (None,)]
    assert [r[0] for r in values(spark, rows, "s string", labels.likert_tag(F.col("s")))] == [None, "completamente de acuerdo", None, None, None]
    rows = [("3,1",), ("3",), ("3,1,2",), (None,)]
    assert [tuple(r[0]) for r in values(spark, rows, "s string", labels.answer(F.col("s")))] == [("3", "1"), ("error", "error"), ("error", "error"), ("error", "error")]
    rows = [(1,), (0,), (-1,), (7,)]
    assert [r[0] for r in values(spark, rows, "s int", labels.weight(F.col("s"), only_default=False))] == [2.0, 1.5, 1.0, 1.5]


def test_modes_take_the_first_on_ties(spark):
    rows = [("a", "Neg", 1), ("a", "Pos", 2), ("a", "Pos", 3), ("a", "Neg", 4), ("b", None, 1), ("b", "Pos", 2), ("c", "Neu", 1)]
    df = spark.createDataFrame(rows, "k string, v string, row_pos long")
    assert dict(graph.modal(df, ["k"], "v").collect()) == {"a": "Neg", "b": None, "c": "Neu"}


GRAPH = "comment_id string, author_id string, video_id string, is_reply boolean, reply_to_comment_id string, sentiment string, row_pos long"


def test_graphs(spark, tmp_path):
    rows = [("c1", "u1", "v1", False, None, "Positive", 1), ("c2", "u1", "v1", True, "c1", "Negative", 2), ("c3", "u2", "v2", True, "zz", "Neutral", 3), ("c4", "u2", "v1", True, "c1", "Positive", 4), ("c5", "u2", "v2", True, "c1", "Negative", 5)]
    df = spark.createDataFrame(rows, GRAPH)
    vertices, edges = graph.comment_video(df)
    assert {(r.src, r.dst, r.sentiment_score) for r in edges.collect()} == {("c1", "v1", 1), ("c2", "c1", -1), ("c3", "zz", 0), ("c4", "c1", 1), ("c5", "c1", -1)}
    assert dict(vertices.collect())["zz"] is None
    vertices, edges = graph.user_video(df)
    got = {(r.src, r.dst): r.sentiment_score for r in edges.collect()}
    assert got[("u1", "u1")] == -1 and got[("u2", "u1")] == -1 and len(got) == 5  # a self-loop; the later video decides
    path = str(tmp_path / "g")
    sinks.write_graphml(vertices, edges, path)
    import glob
    import xml.etree.ElementTree as ET

    document = ET.fromstring("".join(open(f).read() for f in sorted(glob.glob(path + "/part-*"))))
    assert len(document.findall(".//{*}edge")) == 5


def test_pseudonyms_round_trip(spark, tmp_path):
    rows = [("c1", "u1", None, "v1", "x"), ("c2", None, "c1", "v1", "y")]
    df = spark.createDataFrame(rows, "comment_id string, author_id string, reply_to_comment_id string, video_id string, text string")
    salt = privacy.new_salt()
    hidden, mapping = privacy.anonymized(df, salt), privacy.id_mapping(df, salt)
    got = {r.comment_id: r for r in hidden.collect()}
    assert len(salt) == 32 and "text" not in hidden.columns and any(r.reply_to_comment_id in got for r in got.values())
    path = str(tmp_path / "m")
    sinks.write_mapping(mapping, path)
    target = files.joined_parts(spark, path, str(tmp_path / "mapping.json"))
    text = open(target, encoding="utf-8").read()
    want = defaultdict(dict)
    for r in mapping.collect():
        want[r["column"]][r.anon] = r.original
    assert text == json.dumps(want, ensure_ascii=False, indent=4, sort_keys=True) + "\n"
    back = privacy.deanonymized(hidden, files.read_mapping(spark, target))
    assert sorted(map(tuple, back.select("comment_id", "author_id", "reply_to_comment_id", "video_id").collect())) == sorted(((a, b, c, d) for a, b, c, d, _ in rows), key=str)


def test_local_time_and_spines(spark):
    rows = [("2024-01-01T04:59:59Z", "hola mundo", 1), ("2024-01-01T05:00:00Z", "hola", 2), ("no time", "x", 3), ("2024-03-05T12:00:00Z", "hola hola", 4)]
    df = timebuckets.localised(spark.createDataFrame(rows, "published_at string, cleaned_comment string, row_pos long"))
    assert df.count() == 3
    got = [(str(r.bucket)[:10], r.n_comments, r.n_words) for r in timebuckets.volume(df, "monthly").orderBy("bucket").collect()]
    assert got == [("2023-12-01", 1, 2), ("2024-01-01", 1, 1), ("2024-02-01", 0, 0), ("2024-03-01", 1, 2)]
    assert timebuckets.volume(df, "hourly", "2024-01-01", "2024-01-02").count() == 24


def test_tfidf_rows_have_length_one(spark):
    rows = [("2024-01-01T12:00:00Z", "uno dos tres uno", 1), ("2024-01-02T12:00:00Z", "dos cuatro", 2), ("2024-01-04T12:00:00Z", "los", 3)]
    df = timebuckets.localised(spark.createDataFrame(rows, "published_at string, cleaned_comment string, row_pos long"))
    counts, tfidf = termstats.series(df, "daily", 3, ["los"])
    assert counts.count() == tfidf.count() == 4 * 3
    lengths = {round(r[0], 9) for r in tfidf.groupBy("bucket").agg(F.sqrt(F.sum(F.col("tfidf") ** 2))).select(F.col("sqrt(sum(POWER(tfidf, 2)))")).collect()}
    assert lengths == {0.0, 1.0}
    assert "los" not in {r.term for r in counts.collect()} and len(termstats.spanish_stop_words()) > 100


def fold(ticks, vec, freq, d):
    """The detector as a loop over ticks."""
    history, previous, out = defaultdict(list), None, {}
    for tick in ticks:
        now = vec.get(tick, {})
        if previous is not None:
            scores, important = [], []
            for term in sorted(set(now) | set(previous)):
                change = abs(now.get(term, 0.0) - previous.get(term, 0.0))
                past = history[term][-d.baseline :]
                mu, sd = (sum(past) / len(past), pstdev(past)) if past else (0.0, 0.0)
                eff = max(sd, d.sigma_floor)
                z = (change - mu) / eff
                scores.append((z, freq.get((tick, term), 0) >= d.min_count_window))
                if len(past) >= d.min_history and scores[-1][1] and change > mu + d.k_sigma * eff:
                    important.append(term)
                history[term].append(change)
            valid = [z for z, ok in scores if ok]
            score = max(valid) if valid else max([0.0, *(z for z, _ in scores)])
            count = min(len(important), d.top_k or len(important))
            out[tick] = (round(score, 6), count, count >= d.require_min_terms)
        previous = now
    return out


def test_detector_equals_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(500):
        minute = rng.randrange(900)
        if 400 < minute < 500:
            continue
        rows.append((f"2024-01-01T{10 + minute // 100:02d}:{minute % 60:02d}:{rng.choice([0, 0, 30]):02d}Z", " ".join(rng.choice(["uno", "dos", "tres", "cuatro", "cinco"]) for _ in range(rng.randrange(4))) + (" fuego fuego" if minute > 800 else ""), i))
    df = timebuckets.localised(spark.createDataFrame(rows, "published_at string, cleaned_comment string, row_pos long"), zone="UTC").cache()
    w = bursts.Sliding("2024-01-01 10:07:00", "2024-01-01 18:58:00", window="30min", top_n=4, zone="UTC")
    d = bursts.Detector(baseline=12, k_sigma=1.0, min_history=3, sigma_floor=0.02, top_k=2)
    counts, bins, sizes = bursts.windowed(df, w)
    import datetime as dt

    start, end = dt.datetime(2024, 1, 1, 10, 7), dt.datetime(2024, 1, 1, 18, 58)
    ticks = []
    while not ticks or ticks[-1] < end:
        ticks.append(min((ticks[-1] if ticks else start) + dt.timedelta(minutes=10), end))
    times = [r.local_ts for r in df.collect()]
    want = {t: n for t in ticks if (n := sum(t - dt.timedelta(minutes=30) < x < t for x in times))}
    assert {r.tick: r.n_msgs for r in sizes.collect()} == want
    top = bursts.top_by_tick(counts, w.top_n)
    vector = defaultdict(dict)
    for r in bursts.vectors(bursts.tick_tfidf(counts, bins, top), bins, "sum", w.grain_us).collect():
        vector[r.tick][r.term] = r.value
    freq = {(r.tick, r.term): r.freq for r in top.collect()}
    snap = {r.tick: (round(r.score, 6), r.important_count, r.is_event) for r in bursts.detect(df, w, d).collect()}
    first, *others = sorted(want)
    assert snap.pop(first) == (0.0, 0, False)
    looped = fold(sorted(want), vector, freq, d)
    assert {t: x[1:] for t, x in snap.items()} == {t: x[1:] for t, x in looped.items()}
    assert {t: x[0] for t, x in snap.items()} == pytest.approx({t: x[0] for t, x in looped.items()}, abs=1e-5)


def test_paging_and_batches(spark):
    book = {None: {"items": [{"id": {"videoId": "a"}}, {"id": {"videoId": "b"}}], "nextPageToken": "2"}, "2": {"items": [{"id": {"videoId": "c"}}]}}

    def transport(endpoint, parameters):
        if endpoint == "search":
            return book[parameters.get("pageToken")]
        return {"items": [{"id": x, "n": len(parameters["id"].split(","))} for x in parameters["id"].split(",")]}

    found = api.search(spark, transport, api.Search("q", max_videos=3))
    assert {r[0] for r in found.collect()} == {"a", "b", "c"}
    assert len(list(api.pages(transport, "search", {}, 1))) == 1
    items = [json.loads(r[0]) for r in api.lookup(found.coalesce(1), "video_id", transport, "videos", 2).collect()]
    assert {x["id"] for x in items} == {"a", "b", "c"} and max(x["n"] for x in items) <= 2
    said = api.transcripts(found, lambda e, p: {"items": [{"text": "hola  "}, {"text": p["videoId"]}]} if p["videoId"] != "b" else 1 / 0)
    assert {r[0] for r in said.select(X.transcript_text(F.coalesce("snippets", F.array().cast("array<struct<text:string>>")))).collect()} == {"hola . a. ", "", "hola . c. "}
    said = lambda n: {"id": n, "snippet": {"textDisplay": n}}
    page = lambda e, p: {"items": [{"snippet": {"topLevelComment": said(p["videoId"] + str(i))}, "replies": {"comments": [said(p["videoId"] + str(i) + "r")] * 2}} for i in range(3)]}
    threads = api.comment_threads(found, page, 4)
    assert threads.count() == 6 and collect.flat_threads(threads, 4).groupBy("video_id").count().where("count = 4").count() == 3
    assert collect.flat_threads(api.comment_threads(found, page)).count() == 27
    assert list(api.chunks([1, 2, 3], 2)) == [[1, 2], [3]]


def test_csv_round_trip(spark, tmp_path):
    rows = [("v", "c1", 'línea "uno"\ndos, tres', "a", "u", None, 3, True, None)]
    df = spark.createDataFrame(rows, schemas.COMMENTS)
    sinks.write_csv(df, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), schemas.COMMENTS).first().text == rows[0][2]


def test_csv_keeps_what_its_readers_lose(spark, tmp_path):
    """An empty text is not null, NUL stays before quotes too, and an escape stands for itself."""
    texts = ["", None, "a\x00\"b", "\x00", "\x1b", "\x1bn", "\x1b0", "\x1be\x1b\x1b", "\r", "a\r\n", " ", "\\\"", "after"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "c"))
    found = files.read_csv(spark, str(tmp_path / "c"), T.StructType.fromDDL("id string, text string"))
    assert [r.text for r in sorted(found.collect(), key=lambda r: int(r.id))] == texts


def test_model_calls(spark):
    clock = [0.0]
    window = models.TokenWindow(100, 60, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    for n in (60, 60, 500):
        window.wait(n)
        window.spend(n)
    assert clock[0] == 120.0
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError
        return "3,1", 7

    assert models.retried(flaky, sleep=lambda s: None) == ("3,1", 7) and len(tries) == 3
    assert models.retried(lambda: 1 / 0, sleep=lambda s: None) == (None, 0)
    df = spark.createDataFrame([("a", "p", "m"), ("b", "p", "bad")], "comment_id string, prompt string, message string")
    got = models.classified(df, lambda p, m: ("4,2", 5) if m == "m" else ("?", 5), "comment_id", sleep=lambda s: None)
    assert {tuple(r) for r in got.collect()} == {("a", "4", "2"), ("b", "error", "error")}
    done = spark.createDataFrame([("a", "4"), ("b", "error")], "comment_id string, classification string")
    assert [r.comment_id for r in sinks.pending(df, done, "comment_id", retry="error").collect()] == ["b"]
    assert models.lsa_sentences("  ") == models.EMPTY_TEXT and models.lsa_sentences("Uno. Dos.") == "Uno. Dos."


def test_threads_keep_parent_and_replies(spark):
    said = lambda name, who, n: {"id": name, "snippet": {"textDisplay": "hola", "authorDisplayName": who, "publishedAt": "2024-01-01T00:00:00Z", "likeCount": n, "authorChannelId": {"value": "UC" + who}}}
    items = [{"snippet": {"topLevelComment": said("c1", "ana", 1)}, "replies": {"comments": [said("c2", "eva", 2)]}}, {"snippet": {"topLevelComment": said("c3", "ana", 0)}}, {"snippet": {}}]
    df = spark.createDataFrame([("v", k, json.dumps(x)) for k, x in enumerate(items)], "video_id string, page_pos long, item string")
    rows = collect.flat_threads(df).orderBy("comment_id").collect()
    assert rows[0].asDict().keys() == {f.name for f in schemas.COMMENTS}
    assert [(r.comment_id, r.author_id, r.likes, r.is_reply, r.reply_to_comment_id) for r in rows] == [("c1", "UCana", 1, False, None), ("c2", "UCeva", 2, True, "c1"), ("c3", "UCana", 0, False, None)]


def test_removed_repeats(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    kept, counts = collect.without_repeats(df)
    assert kept.count() == 2 and tuple(counts.first()) == (3, 2, 1)
    assert tuple(collect.without_repeats(df.where("false"))[1].first()) == (0, 0, 0)


def test_valences():
    lexicon = {"good": 2.0, "bad": -2.0}
    score = lambda text: models.compound(text, lexicon)
    at = lambda total: pytest.approx(total / (total * total + 15) ** 0.5)
    assert score("") == 0 and score("good") == at(2.0) and score("Good.") == at(2.0)
    assert score("very good") == at(2.293) and score("barely good") == at(1.707) and score("very a good") == at(2 + 0.293 * 0.95)
    assert score("not good") == at(-1.48) and score("not a very good") == at((2 + 0.293) * -0.74)
    assert score("GOOD day") == at(2.733) and score("GOOD") == at(2.0)
    assert score("good but bad") == at(1.0 - 3.0) and score("bad pero good") == at(-1.0 + 3.0)
    assert score("good!!") == at(2 + 2 * 0.292) and score("bad!!!!!!") == at(-2 - 4 * 0.292) and score("good??") == at(2.36) and score("good????") == at(2.96)


def test_summaries_take_the_longest_vectors(spark):
    text = "A b. C d e f g. H. I i i i. J k l. M n o p. Q r s."
    assert models.lsa_sentences(text) == "A b. C d e f g. J k l. M n o p. Q r s."
    long = " ".join(f"palabra{k} otra{k % 7}." for k in range(20000))
    assert len(models.lsa_sentences(long).split(".")) == 6  # no matrix: a text of 20,000 sentences takes no time
    videos = spark.createDataFrame([("a", None), ("b", "kept"), ("c", None), ("d", None)], "video_id string, summary string")
    told = spark.createDataFrame([("a", [("Uno",), ("dos",)]), ("d", [])], "video_id string, snippets array<struct<text: string>>")
    assert dict(models.summaries(videos, told).collect()) == {"a": "Uno. dos.", "b": "kept", "c": models.NO_SUMMARY, "d": models.EMPTY_TEXT}


def test_classification_resumes(spark):
    comments = spark.createDataFrame([("c1", "v1", None, "uno", None, 1), ("c2", "v1", "c1", "dos", "4", 2), ("c3", "v2", "zz", "tres", "error", 3), ("c4", "v2", "c2", None, None, 4)], "comment_id string, video_id string, reply_to_comment_id string, text string, classification string, row_pos long")
    videos = spark.createDataFrame([("v1", "5", "1", 1), ("v1", "1", "1", 2)], "video_id string, classification string, polarity string, row_pos long")
    seen = {r.comment_id: r.prompt for r in models.comment_prompts(comments, videos, "ctx", "tema").collect()}
    assert "completamente de acuerdo frente" in seen["c1"] and "negativo" in seen["c1"] and "responde" not in seen["c1"]
    assert "responde a este otro: uno\n" in seen["c2"] and "responde" not in seen["c3"] and "desconocida" in seen["c3"] and "otro: dos" in seen["c4"]
    client = lambda prompt, message: ("2,3", 5) if message else ("?", 1)
    got = lambda retry: {r.comment_id: (r.classification, r.polarity) for r in models.classified_comments(comments, videos, client, "ctx", "tema", retry, sleep=lambda s: None).collect()}
    assert got(None) == {"c1": ("2", "3"), "c2": ("4", None), "c3": ("error", None), "c4": ("error", "error")}
    assert got("error")["c3"] == ("2", "3")
