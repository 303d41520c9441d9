"""Words that structured hashes take for one another, against the plain versions."""

import random

import numpy as np
import pytest

import public_tokenizers as P
from threadlens.llm import decontam, jaccard_join, substring_dedup, token_store, wordscan

from . import plain


def thue_morse(order, a="a", b="b"):
    """Two different words on which any polynomial hash modulo a power of two agrees from some order on."""
    one, two = a, b
    for _ in range(order):
        one, two = one + two, two + one
    return one, two


PAIR = thue_morse(10)
MORE = thue_morse(11, "x", "y")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_halves_tell_words_apart():
    words = wordscan.Words([" ".join([*PAIR, *MORE]).encode()], wordscan.NONSPACE, False)
    assert all(len(set(words.hashes(half).tolist())) == 4 for half in (0, 1))
    rng = random.Random(3)
    many = wordscan.Words([" ".join({f"w{rng.randrange(10**9)}" for _ in range(50000)}).encode()], wordscan.NONSPACE, False)
    low, high = many.hashes(0), many.hashes(1)
    # no 64-bit mixing of one half gives the other
    assert all((wordscan.mix(low, seed) != high).all() for seed in range(20))
    for k in (5, 12, 13, 20):
        assert len(np.unique(wordscan.windows(low, k))) == len(low) - k + 1
    # windows over two words in Thue-Morse order
    sequence = np.array([low[0] if c == "a" else low[1] for c in PAIR[0] + PAIR[1]])
    for k in (5, 16, 20):
        names = [(PAIR[0] + PAIR[1])[i : i + k] for i in range(len(sequence) - k + 1)]
        assert len(set(wordscan.windows(sequence, k).tolist())) == len(set(names))


@pytest.mark.parametrize("k", [1, 2, 5, 7, 20])
def test_window_numbers_are_exact(k):
    rng = random.Random(k)
    text = [rng.choice("abc") for _ in range(300)]
    numbers = wordscan.window_numbers(wordscan.Words([" ".join(text).encode()], wordscan.NONSPACE, False), k)
    seen = {}
    for i, n in enumerate(numbers.tolist()):
        assert seen.setdefault(n, text[i : i + k]) == text[i : i + k]
    assert len(seen) == len({tuple(text[i : i + k]) for i in range(len(numbers))})


def test_no_operator_confuses_them(spark):
    tail = [f"t{k}" for k in range(30)]
    swapped = lambda pair: " ".join([*tail[:10], pair, *tail[10:]])
    texts = [swapped(PAIR[0]), swapped(PAIR[1]), " ".join([PAIR[0]] * 25), " ".join([PAIR[1]] * 25), f"{MORE[0]} {PAIR[0]} it's", f"{MORE[1]} {PAIR[1]} it's", PAIR[0], PAIR[1]]
    df, rows = docs_of(spark, texts), list(enumerate(texts))
    items = [(1, swapped(PAIR[0])), (2, PAIR[1]), (None, " ".join([PAIR[1]] * 25)), (4, None), (5, MORE[1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontam.op1(df, bench).collect()}
    named = {r[0]: r[2:5] for r in plain.op1(rows, [(i, t) for i, t in items if i is not None])}
    hits = {r[0]: r[2] for r in plain.op1(rows, items)}
    assert got == {d: (hits[d], *named[d][1:]) for d in got}
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(tuple(r) for r in substring_dedup.op8(df).select(*columns).collect()) == sorted(plain.op8(rows))
    assert sorted(tuple(r) for r in jaccard_join.op10(df).collect()) == sorted(plain.op10(rows))
    coder = token_store.WordCoder(P.path("word_bpe_49k.json"))
    for text, ids in zip(texts, coder.encode(texts, 2), strict=True):
        assert np.frombuffer(ids, coder.kind).tolist() == [*coder.library.encode(text, add_special_tokens=False).ids, 2]


def test_empty_benchmark_and_many_query_blocks(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(60)) for _ in range(30)]
    rows = list(enumerate(texts))
    items = [(k, texts[k][:40] if k % 2 else f"w{k}") for k in range(20)]
    schema = "item_id bigint, text string"
    found = decontam.contamination(docs_of(spark, texts), spark.createDataFrame(items, schema), limit=10)
    got = {r.doc_id: (sum(s["size"] for s in r.spans), len(r["items"])) for r in found.collect()}
    assert got == {r[0]: (r[2], r[3]) for r in plain.op1(rows, items)}
    none = decontam.op1(docs_of(spark, texts), spark.createDataFrame([], schema)).collect()
    assert len(none) == 30 and not any(r.n_hit or r.n_items or r.contaminated for r in none)
