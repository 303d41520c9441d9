"""Stages on rows with null and repeated doc_id."""

import corpus_pipeline
from threadlens.llm import jaccard_join


def words(name, n=60):
    return " ".join(f"{name}{k}" for k in range(n))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, place int")


def test_only_contaminated_rows_go(spark, tmp_path):
    item = words("item", 30)
    spark.createDataFrame([(1, item)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item, 0), (None, words("a"), 1), (None, None, 2), (7, item, 3), (7, words("b"), 4), (7, "", 5), (8, words("c"), 6), (9, item, 7)]
    kept = corpus_pipeline.decontaminate(spark, table(spark, rows), str(tmp_path))
    assert sorted(r.place for r in kept.collect()) == [1, 2, 4, 5, 6]


def test_one_row_of_each_class(spark):
    near = words("a") + " more"
    rows = [(None, words("a"), 0), (None, words("a"), 1), (None, near, 2), (None, words("b"), 3), (5, words("b"), 4), (5, words("b"), 5)]
    rows += [(5, words("c"), 6), (4, words("c") + " more", 7), (6, words("d"), 8), (None, None, 9), (None, "", 10), (3, " ", 11), (3, " ", 12), (6, words("e"), 13)]
    kept = [r.place for r in jaccard_join.representatives(table(spark, rows)).collect()]
    assert len(kept) == len(set(kept))
    kept = set(kept)
    assert len(kept & {0, 1, 2}) == 1 and len(kept & {4, 5}) == 1
    assert kept - {0, 1, 2, 4, 5} == {7, 8, 9, 10, 11, 12, 13}
    assert jaccard_join.representatives(table(spark, []).where("false")).count() == 0
