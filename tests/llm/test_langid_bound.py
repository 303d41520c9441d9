"""What op5 learns from is bounded exactly, whatever rows share."""

import pytest

from threadlens.llm import langid


@pytest.mark.parametrize("rows", [[(None, f"text {k}") for k in range(400)], [(7, "one text")] * 400, [(None, "one text")] * 400, [(k, f"text {k}") for k in range(400)]])
def test_bound_holds(spark, monkeypatch, rows):
    seen, true = [], langid.sample

    def spy(*given):
        seen.append(true(*given))
        return seen[0]

    monkeypatch.setattr(langid, "sample", spy)
    df = spark.createDataFrame([(i, t, "en") for i, t in rows] + [(1, "ein text", "de"), (2, None, "de")], "doc_id bigint, text string, lang string").repartition(4)
    assert langid.fit(df, 10).languages == ["de", "en"]
    got = {r.lang: r["count"] for r in seen[0].groupBy("lang").count().collect()}
    assert got["de"] == 1 and 1 <= got["en"] <= 10
    if len(set(rows)) == 400:
        assert got["en"] == 10
