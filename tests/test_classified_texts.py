"""Comments that name their text are asked the same questions as comments that hold it, and their texts are not written for each of them."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from threadlens import catalog, shared
from threadlens.operators import models

TEXTS = ["uno", "dos\n", "", None, "ñandú", "seis", "siete", "ocho"]


def client(prompt, message):
    return f"{zlib.crc32(prompt.encode()) % 1000},{zlib.crc32((message or '-').encode()) % 1000}", 5


@pytest.mark.parametrize("frequent", [5_000, 10])
def test_same_questions(spark, monkeypatch, frequent):
    monkeypatch.setattr(models, "BLOCK", 2)
    monkeypatch.setattr(models, "FREQUENT", frequent)
    rng = random.Random(8)
    rows = [(f"c{i % 110}", f"v{i % 4}", f"c{rng.randrange(150)}" if i % 3 else None, rng.choice([None, "error", "4"]), "2", i, rng.choice([0, rng.randrange(8)])) for i in range(120)]
    named = spark.createDataFrame(rows, "comment_id string, video_id string, reply_to_comment_id string, classification string, polarity string, row_pos long, text_id long").dropDuplicates(["comment_id"])
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "text_id bigint, text string")
    videos = spark.createDataFrame([("v1", "5", "1", 1), ("v2", "1", "3", 2)], "video_id string, classification string, polarity string, row_pos long")
    named = shared.durable(named, "named")
    got = lambda df, **more: sorted((r.comment_id, r.classification, r.polarity) for r in models.classified_comments(df, videos, client, "ctx", "tema", "error", **more).collect())
    assert got(named, texts=texts) == got(named.join(texts, "text_id").drop("text_id"))


def test_no_written_table_has_a_text_a_comment(spark, sf, monkeypatch):
    made = {}
    durable = shared.durable
    monkeypatch.setattr(shared, "durable", lambda df, name: made.setdefault(name, durable(df, name)))
    out = catalog.queries()["classified_comments"](spark, sf)
    assert [name for name, t in made.items() if "text" in t.columns] == ["texts"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert out.count() == spark.read.parquet(f"{sf}/events.parquet").count() and out.where(F.col("classification").isNull()).count() == 0


def test_a_call_does_not_add_up_all_calls_before():
    window = models.TokenWindow(10, 60.0, clock=lambda: 0.0)
    window.used = type("Counted", (type(window.used),), {"__iter__": lambda self: pytest.fail("added up anew")})()
    for _ in range(5):
        window.wait(1)
        window.spend(1)
    assert window.total == 5
