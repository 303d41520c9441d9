"""Videos are walked by many tasks, and their comments are cut at the very number where they are."""

from pyspark.sql import functions as F

from threadlens.operators import collect
from threadlens.sources import api


def said(name):
    return {"id": name, "snippet": {"textDisplay": name}}


def page(endpoint, asked):
    tops = [{"snippet": {"topLevelComment": said(f"{asked['videoId']}-{k}")}, "replies": {"comments": [said(f"{asked['videoId']}-{k}-r")] * (k % 3)}} for k in range(40)]
    return {"items": [{"snippet": {}}, *tops]}  # the first document has no top comment and counts as none


def test_many_tasks_and_no_order_by_video(spark):
    ids = spark.range(400).select(F.concat(F.lit("v"), "id").alias("video_id"))
    threads = api.comment_threads(ids, page, 25)
    tasks = threads.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat = collect.flat_threads(threads, 25)
    assert "Window" not in flat._jdf.queryExecution().optimizedPlan().toString()
    by_window = collect.flat_threads(threads.drop("before"), 25)
    rows = lambda df: sorted((r.video_id, r.comment_id) for r in df.collect())
    assert rows(flat) == rows(by_window) and flat.count() == 400 * 25
