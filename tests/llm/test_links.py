"""Numbers of links against every pair of rows."""

import random

import pytest

from pyspark.sql import functions as F

from threadlens.llm import jaccard_join

from . import plain


def brute(texts):
    sets = [plain.shingles(t) for t in texts]
    near = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    return [sum(bool(near(x, y)) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)]


@pytest.mark.parametrize("block", [512, 7])
def test_every_link_counts(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "LINK_BLOCK", block)
    rng = random.Random(12)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 200, 10)]  # n similar texts, all of them different
    chain = [f"c{k}" for k in range(150)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 50, 5)]  # each is similar to its neighbours only
    texts += [texts[0]] * 3 + [texts[25].upper()] * 2 + ["one two", "ONE two", "", None, " "]
    texts += [" ".join(f"r{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(None if k % 11 == 0 else k % 40, t) for k, t in enumerate(texts)], "doc_id bigint, text string")  # ids null and repeated
    got = sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in jaccard_join.linked(docs).collect())
    want = brute(texts)
    assert got == sorted((str(None if k % 11 == 0 else k % 40), len(plain.shingles(t)), n) for k, (t, n) in enumerate(zip(texts, want)))
    assert max(want) >= 22 and sum(want) // 2 > 2 * len(texts)
    _, _, spanning, _ = jaccard_join.joined(docs)
    assert spanning.count() < sum(want) // 2
    assert jaccard_join.linked(docs.where("false")).count() == 0


def test_sets_that_share_a_hash(spark, monkeypatch):
    """Different sets with one number: each becomes a node of its own, and copies stay together."""
    made = jaccard_join.sets
    monkeypatch.setattr(jaccard_join, "sets", lambda docs: made(docs).withColumn("node", F.pmod("node", F.lit(3))))
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base[: 5 * k], f"x{k}", *base[5 * k :]]) for k in range(8)] + [f"a{k} b c d e f" for k in range(8)]
    texts += [*texts[:4], *texts[9:11], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = [r.n_links for r in jaccard_join.linked(docs).orderBy("doc_id").collect()]
    assert got == brute(texts) and max(got) > 5
    kept = {r.doc_id for r in jaccard_join.representatives(docs).collect()}
    assert len({texts[k] for k in kept if texts[k]}) == len([k for k in kept if texts[k]])
