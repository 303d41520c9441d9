"""The parse of op8: factors and literals give the texts back, and factors are the longest there are."""

import random

from threadlens.llm import substring_dedup

from . import plain


def check(spark, rows, longest=False):
    found = substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = {r[0]: r[2] for r in plain.op8(rows)}
    words = {d: plain.words2(t) for d, t in rows}
    for r in found:
        own, out, at = words[r.doc_id], [], 0
        literals = iter(r.kept.split())
        assert r.n_removed == want[r.doc_id]
        for f in r.factors:
            assert f["size"] >= 20 and (f["source"], f["source_start"]) < (r.doc_id, f["start"])
            source = words[f["source"]][f["source_start"] : f["source_start"] + f["size"]]
            while at < f["start"]:
                out.append(next(literals))
                at += 1
            out += source[at - f["start"] :] if f["start"] + f["size"] > at else []
            at = max(at, f["start"] + f["size"])
        assert out + list(literals) == own
    return {r.doc_id: [tuple(f) for f in r.factors] for r in found}


def test_longest_among_sources(spark):
    passage = [f"p{k}" for k in range(60)]
    rows = [(0, " ".join(passage[11:31])), (1, " ".join(passage[:40])), (2, "x " + " ".join(passage)), (3, "y z " + " ".join(passage) + " end"), (4, "q " + " ".join(passage[:55]) + " end")]
    got = check(spark, rows)
    assert got[0] == [] and got[1] == [(11, 20, 0, 0)]
    assert got[2] == [(1, 40, 1, 0)]
    assert got[3] == [(2, 40, 1, 0), (42, 20, 2, 41)]
    assert got[4] == [(1, 40, 1, 0), (22, 34, 2, 22)]  # what begins inside the first factor and crosses its end


def test_periodic_and_shared_texts(spark):
    rng = random.Random(7)
    passages = [" ".join(f"p{i}x{k}" for k in range(rng.randrange(20, 70))) for i in range(6)]
    rows = [(k, " ".join(part for _ in range(rng.randrange(1, 6)) for part in (" ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(25))), rng.choice(passages)))) for k in range(60)]
    rows += [(100, "a " * 300), (101, "a b " * 200), (102, "a " * 45), (103, " ".join(["b a"] * 80)), (104, ""), (105, "one")]
    cuts = [r[1].split() for r in rows[:20]]
    rows += [(200 + k, " ".join(w[rng.randrange(5) : len(w) - rng.randrange(5)])) for k, w in enumerate(cuts)]
    check(spark, rows)


def test_parts_of_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PAIRS", 50)
    passage = " ".join(f"p{k}" for k in range(300))
    got = check(spark, [(0, passage), (1, f"x {passage} y {passage}"), (2, passage * 2)])
    assert got[1] == [(1, 300, 0, 0), (302, 300, 0, 0)]
