"""Truncated latent semantic analysis against a dense decomposition."""

import random

import numpy as np
import pytest

from threadlens.operators import latent


def plain(sentences, n, rank):
    """Weights from a filled matrix."""
    matrix = latent.TermMatrix(sentences).dense()
    _, s, v = np.linalg.svd(matrix, full_matrices=False)
    k = (s >= latent.HALF * s[0]).sum() if rank is None else min(rank, (s > 1e-9 * s[0]).sum())
    weight = np.round(np.sqrt(((s[:k, None] * v[:k]) ** 2).sum(0)), 7)
    return s[:k], weight


def texts(count, seed=3):
    rng = random.Random(seed)
    for _ in range(count):
        words = [f"w{k}" for k in range(rng.choice((3, 20, 90)))]
        yield [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) + "." for _ in range(rng.choice((2, 6, 25, 70)))]


@pytest.mark.parametrize("rank", [None, 1, 3, 8, 500])
def test_values_and_weights(rank):
    for sentences in texts(25):
        matrix = latent.TermMatrix(sentences)
        values, vectors = latent.truncated(matrix, rank)
        want, weight = plain(sentences, 5, rank)
        assert np.allclose(values, want, atol=1e-7 * want[0])
        dense = np.linalg.svd(matrix.dense(), compute_uv=False)
        k = len(want)
        if k == len(dense) or dense[k - 1] - dense[k] > 1e-6 * dense[0]:  # else the space is not one
            assert np.allclose(np.sqrt(((values[:, None] * vectors) ** 2).sum(0)), weight, atol=1e-5)


def test_matrix_is_the_filled_one():
    for sentences in texts(5, 9):
        sentences = [*sentences, "...", "!"]  # sentences without a word have no weight
        m = latent.TermMatrix(sentences)
        x, y = np.arange(m.shape[1]) - 2.5, np.arange(m.shape[0]) * 0.5
        assert np.allclose(m.times(x), m.dense() @ x) and np.allclose(m.turned(y), m.dense().T @ y)
        assert (m.dense()[:, -2:] == 0).all() and (m.dense()[:, 0] >= latent.SMOOTH).all()


def test_all_dimensions_give_the_columns():
    for sentences in texts(8, 5):
        values, vectors = latent.truncated(latent.TermMatrix(sentences), 10_000)
        assert np.allclose(np.sqrt(((values[:, None] * vectors) ** 2).sum(0)), np.linalg.norm(latent.TermMatrix(sentences).dense(), axis=0))


def test_repeated_values():
    sentences = [f"a{k} b{k}." for k in range(12)]  # one value twelve times but for the smoothing
    values, _ = latent.truncated(latent.TermMatrix(sentences), 12)
    assert np.allclose(values, np.linalg.svd(latent.TermMatrix(sentences).dense(), compute_uv=False))


def test_summaries(spark):
    long = " ".join(f"word{k % 97} again{k % 7} the {'x' * (k % 5 + 1)}." for k in range(3000))
    rows = [(1, "One. Two. Three."), (2, None), (3, ""), (None, " \n"), (3, "... !!! ..."), (4, long), (4, long)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("summary", df_lit())
    got = {(r.doc_id, r.summary, r.n_dims) for r in latent.summarised(df, "text").collect()}
    assert (1, "One. Two. Three.", 0) in got and (2, latent.EMPTY_TEXT, 0) in got and (None, latent.EMPTY_TEXT, 0) in got
    (made,) = {(s, n) for k, s, n in got if k == 4}
    assert made[1] >= 1 and made[0].count(".") == 5 and latent.summary(long) == made
    assert latent.summarised(df.where("false"), "text").count() == 0
    with pytest.raises(ValueError):
        latent.summarised(df, "text", rank=0)


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_query_equals_a_dense_decomposition(spark, sf):
    from threadlens import catalog
    from threadlens.operators.models import BLANKS, _SENTENCE

    said = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = 0
    for r in catalog.queries()["lsa_ranked_summary"](spark, sf).collect():
        sentences = [s for x in _SENTENCE.findall(said.pop(r.doc_id) or "") if (s := x.strip(BLANKS))]
        if 5 < len(sentences) <= 300:
            s, weight = plain(sentences, 5, None)
            gap = np.sort(-weight)
            assert r.n_dims == len(s)
            if gap[5] - gap[4] > 1e-5:
                best = np.sort(np.argsort(-weight, kind="stable")[:5])
                assert r.summary == " ".join(sentences[i] for i in best)
                seen += 1
    assert not said and seen > 20
