"""The operators' own interfaces, on small fixtures."""

import dataclasses
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from threadlens.llm import byte_bpe, components, decontam, jaccard_join, langid, licenses, quality_knn, quality_rules, scratch, secrets, substring_dedup, token_store, wordscan

from . import plain


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def test_words_and_hashes():
    texts = ["Ab cd\tñ.é", "", "x" * 5000, "a b"]
    for table, fold, pattern in ((wordscan.NONSPACE, False, plain.words2), (wordscan.ALNUM, True, plain.words1)):
        words = wordscan.Words([t.encode() for t in texts], table, fold)
        got = [[words.word(i).decode() for i in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:])]
        assert got == [pattern(t) for t in texts]
    rng = random.Random(1)
    strings = list({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(20000)})
    words = wordscan.Words([" ".join(strings).encode()], wordscan.NONSPACE, False)
    assert len(set(words.hashes().tolist())) == len(strings)
    again = wordscan.Words([b"zz", " ".join(strings).encode()], wordscan.NONSPACE, False)
    assert (again.hashes()[1:] == words.hashes()).all()


def test_positional_index(spark):
    df = docs_of(spark, ["the quick brown fox jumps", "brown the quick, fox", "quick the", None])
    index = scratch.durable(decontam.build(df), "postings")
    got = decontam.near(index, ["quick", "fox"], 3).collect()
    assert {tuple(r) for r in got} == {(0, 1, 3), (1, 2, 2)}
    assert decontam.near(index, ["quick", "cat"], 9).count() == 0
    items = spark.createDataFrame([(1, "Quick brown fox"), (2, "fox jumps"), (3, "the quick")], "item_id int, text string")
    rows = {r.doc_id: r for r in decontam.contamination(df, items).collect()}
    assert rows[0]["items"] == ["1", "2", "3"] and [tuple(s) for s in rows[0].spans] == [(0, 5)]
    assert rows[1]["items"] == ["3"] and [tuple(s) for s in rows[1].spans] == [(1, 2)] and rows[3].n_words == 0


def test_ledger_policies(spark):
    good = " ".join(f"word{i}" for i in range(60))
    df = docs_of(spark, [good, "short", " ".join(["same thing"] * 60), good.upper(), " ".join(f"w{i} |" for i in range(60)), None])
    rows = scratch.durable(quality_rules.ledger(df), "ledger")
    kept = lambda p: {r.doc_id for r in quality_rules.verdicts(rows, p).where("kept").collect()}
    assert kept("base") == {0, 3, 4} and kept("2024-1") == {0, 3} and kept("2024-2") == {0}
    ablation = {r.rule: tuple(r)[1:] for r in quality_rules.ablation(rows).collect()}
    assert ablation["upper_case"] == (1, 1, 2) and ablation["few_words"] == (2, 2, 3) and ablation["repeated_windows"][0] == 1
    extra = df.withColumn("n_words", F.lit("mine")).withColumn("bits", F.lit(9))
    assert [tuple(r) for r in quality_rules.passing(extra).collect()] == [(0, good, "mine", 9)]


def test_quality_votes(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(40)]
        good = i % 3 > 0
        texts.append(" ".join(words) if good else " ".join(w + "###" for w in words))
        labels.append((i, int(good)))
    table = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id bigint, quality int")
    rows = quality_knn.op3(docs_of(spark, texts), table).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == labels[r.doc_id][1] for r in held)
    nothing = quality_knn.op3(docs_of(spark, texts[:3]), table.where("false")).collect()
    assert {r.score for r in nothing} == {0.5}


def test_bit_packing():
    rng = np.random.default_rng(3)
    for width in (1, 5, 13, 16, 17, 24):
        ids = rng.integers(0, 1 << width, 1000)
        packed = token_store.pack(ids, width)
        assert len(packed) == -(-1000 * width // 8)
        for start, n in ((0, 1000), (1, 1), (7, 500), (999, 1), (5, 0)):
            assert (token_store.unpack(packed, width, start, n) == ids[start : start + n]).all()


def test_store_random_access(spark, tmp_path):
    texts = ["hello world", None, "it's " * 50, "naïve CAFÉ <|endoftext|> Ω"]
    store = str(tmp_path / "store")
    token_store.write(docs_of(spark, texts, 10), store, P.path("word_bpe_49k.json"))
    library = token_store.coder(P.path("word_bpe_49k.json")).library
    for k, t in enumerate(texts):
        assert token_store.fetch(spark, store, 10 + k) == [[*library.encode(t or "", add_special_tokens=False).ids, 2]]
    assert token_store.fetch(spark, store, 99) == []
    rows = [(None, "first"), (0, "zero"), (None, "other"), (0, "again"), (5, "five")]  # blocks that begin with a null
    token_store.write(spark.createDataFrame(rows, "doc_id bigint, text string"), store, P.path("word_bpe_49k.json"))
    for doc in (None, 0, 5):
        want = sorted([*library.encode(t, add_special_tokens=False).ids, 2] for d, t in rows if d == doc)
        assert sorted(token_store.fetch(spark, store, doc)) == want
    old = token_store.BLOCK_IDS
    try:  # many small blocks
        token_store.BLOCK_IDS = 5
        token_store.write(docs_of(spark, texts * 5, 0), store, P.path("word_bpe_49k.json"))
    finally:
        token_store.BLOCK_IDS = old
    rows = token_store.read(spark, store).orderBy("doc_id").collect()
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist() and len(rows) == 20


def test_languages(spark):
    rng = random.Random(4)
    alphabet = {"aa": "abcdeé", "bb": "vwxyzñ"}
    rows = [(i, "".join(rng.choice(alphabet[k] + " ") for _ in range(60)), k) for i in range(200) for k in [rng.choice(["aa", "bb"])]]
    rows += [(900, None, "aa"), (901, "123 !!", "bb"), (902, "vwxyz", None), (None, "abcde", "aa")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.op5(df).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:200])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[902].lang_pred == "bb" and got[None].lang_pred == "aa"


def test_incremental_scans(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = docs_of(spark, ["password=hunter22", "nothing", "password=hunter22", None])
    assert secrets.update(spark, one, path).count() == 3
    two = docs_of(spark, ["nothing", "-----BEGIN RSA PRIVATE KEY----- token: abcdef1"], 10)
    assert secrets.scan(two, spark.read.parquet(path)).count() == 1
    ledger = secrets.update(spark, two, path)
    assert ledger.count() == 4 and secrets.update(spark, two, path).count() == 4
    every = one.unionByName(two)
    spans = {r.doc_id: r.s for r in secrets.by_path(every, ledger, "doc_id").select("doc_id", secrets.spelled(F.col("found")).alias("s")).collect()}
    assert spans == {0: "assign:0:17", 1: "", 2: "assign:0:17", 3: "", 10: "", 11: "pem:0:31,assign:32:46"}
    clean = {r.doc_id: r.text for r in secrets.redacted(every, ledger).collect()}
    assert clean[0] == "[secret]" and clean[11] == "[secret] [secret]" and clean[3] is None and clean[1] == "nothing"
    # a new version of one rule asks for that rule alone, and its old findings no longer count
    newer = tuple(dataclasses.replace(r, version="2", least=20) if r.kind == "assign" else r for r in secrets.RULES)
    asked = secrets.scan(two, ledger, newer).collect()
    assert len(asked) == 2 and {tuple(r.rules) for r in asked} == {("assign@2",)}
    ledger = secrets.update(spark, every, path, newer)
    spans = {r.doc_id: r.s for r in secrets.by_path(every, ledger, "doc_id", rules=newer).select("doc_id", secrets.spelled(F.col("found")).alias("s")).collect()}
    assert spans == {0: "", 1: "", 2: "", 3: "", 10: "", 11: "pem:0:31"}
    # a pair that two runs have both appended counts once
    again = ledger.unionByName(ledger)
    assert secrets.by_path(every, again, "doc_id").count() == 6
    assert {r.doc_id: r.n for r in secrets.by_path(every, again, "doc_id").select("doc_id", F.size("found").alias("n")).collect()} == {0: 1, 1: 0, 2: 1, 3: 0, 10: 0, 11: 2}


def test_redaction_of_clashing_columns_and_many_findings(spark):
    text = "".join(f"é token=abc{k:05} " for k in range(3000)) + "password=secret=abcdefgh end"
    names = ["_blob", "_found", "found", "blob", "spans", "pieces", "own", "bad", "_bad"]
    df = docs_of(spark, [text, None, "", text]).select("*", *[F.lit(name).alias(name) for name in names])
    ledger = secrets.update(spark, df, scratch.new_path(spark, "ledger"))
    rows = secrets.redacted(df, ledger).collect()
    want = "é [secret] " * 3000 + "[secret] end"
    assert sorted((r.doc_id, r.text) for r in rows if r.text) == [(0, want), (3, want)] and sum(not r.text for r in rows) == 2
    assert all(r[name] == name for r in rows for name in names)


def test_chunks_resynchronise(spark):
    rng = random.Random(6)
    pieces = ["hello", " world", "  ", "\n\n", "a" * 60, " 1234", "'s", "é", "!?", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(300))) for _ in range(40)] + ["x" * 900, " " * 500 + "y", "\n" * 300]
    df = docs_of(spark, [*texts, texts[0]])
    small = byte_bpe.encoded(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 50, 20)
    whole = byte_bpe.encoded(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, whole.collect()))
    back = byte_bpe.decoded(small, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert {(r.doc_id, bytes(r.raw).decode()) for r in back} == {(i, t) for i, t in enumerate([*texts, texts[0]])}
    twice = docs_of(spark, [texts[0]]).unionByName(docs_of(spark, [texts[0]]))
    assert byte_bpe.encoded(twice, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 50, 20).count() == 2


def test_factors_name_their_source(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    df = docs_of(spark, [f"a b c {passage} d", f"{passage} x y {passage}", "short"])
    rows = {r.doc_id: r for r in substring_dedup.deduplicated(df).collect()}
    assert rows[0].n_removed == 0 and rows[1].kept == "x y" and rows[2].kept == "short"
    assert [tuple(f) for f in rows[1].factors] == [(0, 40, 0, 3), (42, 40, 0, 3)]


@pytest.mark.parametrize(
    ("text", "names", "permissive"),
    [
        ("MIT", ["mit"], True),
        ("GPL-2.0-only OR MIT", ["gpl-2.0-only", "mit"], True),
        ("GPL-2.0-only AND (MIT OR Apache-2.0)", ["apache-2.0", "gpl-2.0-only", "mit"], False),
        ("MIT OR GPL-3.0 AND Zlib", ["gpl-3.0", "mit", "zlib"], True),
        ("(MIT) and more prose", ["mit"], True),
        ("MIT and see the file", ["mit"], True),
        ("mit or apache-2.0 with llvm-exception and isc", ["apache-2.0 with llvm-exception", "isc", "mit"], True),
        ("GPL-2.0+ AND LicenseRef-own.1 OR", ["gpl-2.0+", "licenseref-own.1"], False),
        ("MIT OR (GPL-3.0 AND", ["mit"], True),
        ("GPL-2.0 WITH Classpath-exception-2.0 */", ["gpl-2.0 with classpath-exception-2.0"], False),
    ],
)
def test_expressions(text, names, permissive):
    assert licenses.evaluate(text) == (names, permissive)


def test_broken_expressions():
    for text in ("", "AND MIT", "see the file", "(MIT", "( )", "WITH llvm-exception"):
        with pytest.raises(ValueError):
            licenses.evaluate(text)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(components.labels(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.labels(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_join_finds_every_similar_pair():
    """Index entries of similar sets meet, for sets of all sizes and at the very threshold."""
    rng = np.random.default_rng(8)
    for x in [*range(1, 60), 71, 72, 90, 108, 150, 163, 400, 1000]:
        for _ in range(6):
            a = rng.integers(1, 1 << 63, x, dtype=np.uint64)
            drop = int(rng.integers(0, x // 9 + 1))
            add = 0
            while 100 * (x - drop) >= 80 * (x + add + 1):
                add += 1
            add = int(rng.integers(0, add + 1))
            b = np.concatenate((a[drop:], rng.integers(1, 1 << 63, add, dtype=np.uint64)))
            if 100 * (x - drop) < 80 * (x + add):
                continue
            keys = [set(jaccard_join.entries(np.unique(v))[0].tolist()) for v in (a, b)]
            assert keys[0] & keys[1], (x, drop, add)
            bits = [[jaccard_join.bitmap(v)] for v in (a, b)]
            assert jaccard_join.may_link(np.array([x]), np.array([len(b)]), *bits)[0]


def test_frequent_entries_and_copies(spark):
    """A passage in many documents, many copies and a hub that alone links its copies."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = [" ".join([*[word() for _ in range(rng.randrange(5, 60))], *passage]) for _ in range(150)]
    hub = [word() for _ in range(120)]
    for _ in range(90):
        copy = list(hub)
        for i in rng.sample(range(120), 2):
            copy[i] = word()
        rows.append(" ".join(copy))
    rows += [rows[0]] * 40 + [" ".join(hub)]
    rng.shuffle(rows)
    want = plain.op10(list(enumerate(rows)))
    got = jaccard_join.op10(docs_of(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len({c for _, _, c in want}) < 155


def test_representatives_keep_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = docs_of(spark, [text, text + " more", "other words entirely here now", None]).withColumn("component_id", F.lit(5)).withColumn("node", F.lit("x"))
    assert sorted(r.doc_id for r in jaccard_join.representatives(df).collect()) == [0, 2, 3]
    assert jaccard_join.representatives(df).columns == df.columns
