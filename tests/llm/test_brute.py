"""Models and verdicts against plain versions that look at everything."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadlens.llm import byte_bpe, langid, licenses, quality_knn, quality_rules, secrets, wordscan

from . import plain


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize("k", [1, 3, 9])
def test_nearest_takes_the_first_of_equals(k):
    rng = np.random.default_rng(k)
    cosine = rng.integers(0, 4, (50, 40)).astype(np.float32) / 4
    want = [sorted(sorted(range(40), key=lambda i: (-row[i], i))[:k]) for row in cosine]
    assert quality_knn.nearest(cosine, k).tolist() == want


def test_votes_equal_all_cosines(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["uno", "dos", "tres", "cuatro", "###", "Cinco", "6"]) for _ in range(rng.randrange(1, 40))) for _ in range(150)] + ["", "uno dos", "uno dos", "uno dos"]
    texts += [texts[3]] * 12  # more equal neighbours than have a vote
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))] + [(4, 0), (None, 1)], "doc_id bigint, quality int")
    df = docs_of(spark, texts)
    model = quality_knn.fit(df.unionByName(df.where("doc_id < 9")), labels)
    assert len(model.labels) == len(texts)
    ids = [i for i in range(len(texts))]
    vectors = model.project([texts[i].encode() for i in ids])
    assert np.allclose(vectors, model.vectors, atol=1e-4)
    got = model.score([t.encode() for t in texts])
    cosines = vectors @ model.vectors.T
    for i, t in enumerate(texts):
        near = sorted(range(len(ids)), key=lambda j: (-cosines[i][j], j))[: quality_knn.NEIGHBOURS]
        weight = [max(float(cosines[i][j]), 1e-6) ** 4 for j in near]
        assert got[i] == pytest.approx(sum(w * model.labels[j] for w, j in zip(weight, near)) / sum(weight), abs=1e-6)


def ngrams(text):
    text = re.sub(r"[^a-d]+", " ", (text or "").lower()).lstrip(" ")
    return [text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)]


def test_languages_equal_plain_bayes(spark):
    rng = random.Random(5)
    weights = {"aa": (8, 1, 1, 1), "bb": (1, 8, 2, 1), "cc": (1, 1, 6, 6), "dd": (3, 3, 3, 3), "ee": (1, 4, 1, 8)}
    rows = []
    for i in range(300):
        lang = rng.choice(["aa", "aa", "aa", *weights])
        rows.append((i, "".join(rng.choice([*rng.choices("abcd", weights[lang], k=4), "  "]) for _ in range(rng.randrange(1, 25))), lang))
    rows += [(900, None, "aa"), (901, "1 !", "bb"), (902, "Dc", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    known = {g for _, t, _ in rows for g in ngrams(t)}
    buckets = {g: int(wordscan.mix(np.array([sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))], np.uint64), len(g))[0]) >> 48 for g in known}
    assert len(set(buckets.values())) == len(known)  # otherwise the plain counts below would differ
    counts, sizes = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        if lang and text is not None:
            counts[lang].update(ngrams(text))
            sizes[lang] += 1
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    model = langid.fit(df)
    for columns in (64, 2):
        got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(df, model, columns).collect()}
        for doc, text, _ in rows:
            found = ngrams(text)
            if not found:
                assert got[doc] == ("und", 0.0)
                continue
            evidence = {lang: sum(math.log((counts[lang][g] + 0.5) / (total[lang] + 0.5 * langid.BUCKETS)) for g in found) for lang in sorted(sizes)}
            prior = {lang: math.log(sizes[lang] / sum(sizes.values())) for lang in sizes}
            best = max(evidence, key=lambda lang: round(evidence[lang] + prior[lang], 4))
            assert got[doc][0] == best
            tempered = {lang: evidence[lang] / math.sqrt(len(found)) + prior[lang] for lang in evidence}
            assert got[doc][1] == pytest.approx(1 / sum(math.exp(tempered[lang] - tempered[best]) for lang in tempered), abs=1e-3)


def test_more_languages_than_one_block_holds(spark):
    rows = [(k, f"{chr(0x4E00 + k)}{chr(0x5E00 + k)}" * 3, f"l{k:03}") for k in range(450)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predicted(df, langid.fit(df)).collect()}
    assert got == {k: lang for k, _, lang in rows}


def test_rules_equal_plain_rules(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10**6, None), (10**6 + 1, "A B " * 60), (10**6 + 2, "| x " * 60)]
    got = {r.doc_id: (r.fail_bits, r.kept) for r in quality_rules.op2(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for (doc, n, chars, symbols, dup, repeat, _), (_, text) in zip(plain.op2(docs), docs, strict=True):
        lines = sum(bool(plain.SPACED.search(x)) for x in (text or "").split("\n"))
        upper = sum("A" <= c <= "Z" for c in text or "")
        failed = [n < 50, 100 * repeat > 50 * n, 4 * symbols > n, lines >= 4 and 100 * dup > 50 * lines, chars < 2 * n or chars > 15 * n, 2 * upper > chars]
        assert got[doc] == (sum(f << b for b, f in enumerate(failed)), not any(failed))


EXTRA = [("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), ("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"), ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}")]


def test_all_spans_equal_plain_spans(spark):
    texts = ["é eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12 + " ghp_" + "Z9" * 20, "xoxb-1234567890-abc token=xoxp-1234567890 -----BEGIN PRIVATE KEY-----", "ghp_" + "a" * 35, "", None, "password: " + "0123456789abcdef" * 2]
    got = {r.doc_id: r.spans for r in secrets.op6(docs_of(spark, texts)).collect()}
    kinds = [("assign", plain.ASSIGN.pattern, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), *[(k, p, 0, 0) for k, p in EXTRA]]
    for doc, text in enumerate(texts):
        spans = sorted((m.start(), rank, m.end(), kind) for rank, (kind, p, group, least) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m[group]) >= least)
        assert got[doc] == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def test_labels_of_license_scans(spark):
    texts = [
        "SPDX-License-Identifier: MIT OR GPL-2.0-only\n the mit license", "// spdx-license-identifier: (Apache-2.0 WITH LLVM-exception) AND Zlib and so on", "SPDX-License-Identifier: see the file",
        "SPDX-License-Identifier:\nMIT", "gnu lesser general public license, all rights reserved", "summit license", "", None, "SPDX-License-Identifier: GPL-3.0-or-later\nSPDX-License-Identifier: ISC",
    ]
    got = {r.doc_id: (r.labels, r.permissive) for r in licenses.op9(docs_of(spark, texts)).collect()}
    assert got == {
        0: ("mit,spdx:gpl-2.0-only,spdx:mit", True), 1: ("spdx:apache-2.0 with llvm-exception,spdx:zlib", True), 2: ("spdx:invalid", None), 3: ("spdx:invalid", None),
        4: ("all-rights-reserved,lgpl", None), 5: ("", None), 6: ("", None), 7: ("", None), 8: ("spdx:gpl-3.0-or-later,spdx:isc", False),
    }
    long = "MIT OR (" * 3000 + "MIT" + ")" * 3000
    assert licenses.evaluate(long) == (["mit"], True)
    many = " OR ".join(["MIT WITH LLVM-exception"] * 5000)
    assert licenses.evaluate(many) == (["mit with llvm-exception"], True)


def test_endless_runs_are_split_a_few_times_only(monkeypatch):
    import public_tokenizers as P

    code = byte_bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    size, overlap = 64, 16
    text = "go " + "a" * 40_000 + " on " + "b" * 5000
    chunks = [(a, text[a : a + size + overlap], byte_bpe.boundaries(code.pattern, text[a : a + size + overlap])) for a in range(0, len(text), size)]
    read = []
    monkeypatch.setattr(byte_bpe, "boundaries", lambda pattern, t, own=byte_bpe.boundaries: (read.append(len(t)), own(pattern, t))[1])
    ends = [e for e, _, _ in byte_bpe.stitched(code.pattern, chunks, size)]
    assert ends == [m.end() for m in code.pattern.finditer(text)]
    assert sum(read) < 6 * len(text)


def test_pipeline_on_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklm", k=5)) for _ in range(n))
    one, two, three, item = words(80), words(80), words(90), words(30)
    secret = words(60) + " password=hunter22 AKIA" + "A" * 20
    rows = [(None, one), (None, one + " more"), (None, two), (5, two), (5, two), (5, three), (6, secret), (7, None), (8, ""), (9, "few words"), (None, words(70) + " " + item), (10, item + " " + words(60)), (11, words(20000)), (12, "ñ é " + words(60))]
    names = ["own", "h", "bad", "blob", "bits", "node", "row", "spans"]
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id bigint, text string, place int").select("*", *[F.lit(n).alias(n) for n in names])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (None, "null id"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, places = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        got = docs.collect()
        assert all(r[n] == n for r in got for n in names)
        places.append(sorted(r.place for r in got))
    assert places[0] == [0, 1, 2, 3, 4, 5, 6, 10, 11, 12, 13]
    assert len(places[1]) == 8 and len({0, 1} & set(places[1])) == 1 and len({3, 4} & set(places[1])) == 1 and 2 not in places[1] and {5, 6, 10, 11, 12, 13} <= set(places[1])
    assert {10, 11} & set(places[2]) == set() and len(places[2]) == 6 and places[3] == places[2]
    assert next(r.text for r in got if r.place == 6) == rows[6][1].split(" password")[0] + " [secret] [secret]"
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == 6 and all(r.same and len(r.ids) == 4 * r.n_tokens for r in out)
    assert sorted(r.decoded_sha256 for r in out) == sorted(plain.sha(r.text) for r in got)
