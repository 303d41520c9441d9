"""Streams whose comments name their text: the same results as from batches, and no text is written for each comment."""

import random

import pytest
from pyspark.sql import functions as F

from threadlens import shared
from threadlens.operators import bursts, changes
from threadlens.streaming import keyed

from .test_arguments import comments
from .test_keyed import shown

SAID = ["uno dos dos", "tres fuego", " ", "cuatro uno fuego fuego"]


def test_named_texts(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice([rng.randrange(300), rng.randrange(0, 300, 10)]), str(rng.randrange(4))) for _ in range(200)]
    texts = spark.createDataFrame(list(enumerate(SAID)), "text_id bigint, cleaned_comment string")
    named = comments(spark, rows).withColumn("text_id", F.col("cleaned_comment").cast("bigint")).drop("cleaned_comment")
    whole = shared.durable(named.join(texts, "text_id"), "whole")
    w = bursts.Sliding("2024-01-01 00:00", "2024-01-01 05:04", "10min", "30min", zone="UTC", top_n=3)
    made = {}
    durable = shared.durable
    monkeypatch.setattr(shared, "durable", lambda df, name: made.setdefault(name, durable(df, name)))
    got = sorted(tuple(r) for r in keyed.counts_once(named, w, ["dos"], texts, parts=1).collect())
    want = bursts.windowed(whole, w, ["dos"])[0].groupBy("tick", "term").agg(F.sum("n").alias("n"))
    assert got == sorted(tuple(r) for r in want.collect())
    assert "cleaned_comment" not in made["replay"].columns and made["text-lines"].count() == len(SAID)


def test_bursts_of_named_texts(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(200), str(rng.randrange(4))) for _ in range(150)]
    texts = spark.createDataFrame(list(enumerate(SAID)), "text_id bigint, cleaned_comment string")
    named = comments(spark, rows).withColumn("text_id", F.col("cleaned_comment").cast("bigint")).drop("cleaned_comment")
    w = bursts.Sliding("2024-01-01 00:00", "2024-01-01 03:24", "10min", "30min", zone="UTC", top_n=3)
    detector = bursts.Detector(baseline=4, k_sigma=0.5, min_history=2, sigma_floor=0.01)
    assert shown(keyed.bursts_once(named, w, detector, texts=texts)[0]) == shown(changes.detect(named.join(texts, "text_id"), w, detector))


def test_a_pane_counts_texts_and_not_words(spark):
    """State has a row for each text of an open pane, however many words it has."""
    rows = spark.createDataFrame([(m, m % 2) for m in (1, 2, 3, 11)], "m int, text_id bigint")
    said = rows.select((F.lit("2024-01-01 00:00").cast("timestamp_ntz") + F.make_dt_interval(mins="m")).alias("local_ts"), "text_id", F.lit(None).cast("boolean").alias("beat"))
    w = bursts.Sliding("2024-01-01 00:00", "2024-01-01 03:24", "10min", "30min", zone="UTC")
    assert sorted((r.place, r.text_id, r.n) for r in keyed.pane_counts(said, w).collect()) == [(1, 0, 1), (1, 1, 2), (3, 1, 1)]
