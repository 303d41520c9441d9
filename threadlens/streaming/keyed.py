"""Bursts on a stream with state by term: panes, then windows, then a detector that keeps each term's own history.

First query: comments are counted by pane; a pane leaves once the watermark has
passed it (``pane_counts``), so state holds open panes only.  ``Windows`` takes
the closed panes of each batch: it keeps them while a window may hold them, makes
the ticks that are complete now by ``operators.changes`` and writes their changes.
From batch to batch it needs the last tick's vector, at most top_n rows, and the
panes of one window; older panes and states are deleted.

Second query: changes go by term through ``History``, a stateful processor whose
list holds the last ``baseline`` changes of its term (``transformWithState`` on
RocksDB: a batch writes the terms that changed, never the whole state).  Each
change leaves with its history, mean, deviation and z score; ``Snapshots`` makes
one row a tick of them.

Batches are written under their numbers, so a repeated batch replaces itself.  A
beat is a row without a comment which tells that time has passed: two of them
after the end close the last windows.  Comments later than ``late`` are dropped.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import shared
from ..functions import intervals
from ..functions import text as X
from ..operators import bursts, changes, panes
from . import live

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def text_lines(texts: DataFrame, stop_words: list[str] | None) -> DataFrame:
    """(text_id, line): the terms of each text (text_id, cleaned_comment), found once, as a written table."""
    return shared.durable(texts.select("text_id", X.told(F.col("cleaned_comment"), stop_words).alias("line")), "text-lines")


def pane_counts(comments: DataFrame, w: bursts.Sliding, late: str = live.LATE) -> DataFrame:
    """(closes, place, late, bin, text_id, n) of every pane that the watermark has closed; ``comments`` is a stream with local_ts, rows of null ``beat`` are comments.

    Comments name their text, so state holds how often an open pane says each text and no words; a beat has no text.
    """
    since = bursts._us(F.col("local_ts")) - w.start_us
    pane = F.floor(since / w.pane_us)
    place = 2 * pane + F.when(F.pmod(since, F.lit(w.pane_us)) == 0, 0).otherwise(1)
    closes = bursts._at((pane + 1) * w.pane_us + w.start_us).cast("timestamp")
    rows = comments.select(
        closes.alias("closes"), place.alias("place"), (since > w.end_us - w.start_us - w.window_us).alias("late"), F.floor(bursts._us(F.col("local_ts")) / w.grain_us).alias("bin"),
        F.when(F.col("beat").isNull(), F.col("text_id")).alias("text_id"),
    )
    watermarked = rows.withWatermark("closes", f"{intervals.micros(late) // 1000} milliseconds")
    return watermarked.groupBy("closes", "place", "late", "bin", "text_id").agg(F.count("*").alias("n"))


PANES = "closes timestamp, place bigint, late boolean, bin bigint, text_id bigint, n bigint"
SEEN = "k bigint, seq bigint, term string, freq bigint, rank int, value double"
HELD = "batch int, closed bigint"
CHANGE = "term string, seq bigint, now double, before double, freq bigint, d double"
TICK = "k bigint, seq bigint, n_msgs bigint, n_terms bigint"


@dataclass
class Windows:
    """A ``foreachBatch`` function: the ticks that a batch of closed panes completes, and what changes in them."""

    path: str
    w: bursts.Sliding
    texts: panes.Texts
    agg: str = "sum"

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, grid, w = batch.sparkSession, changes.Grid(self.w), self.w
        batch.write.mode("overwrite").parquet(f"{self.path}/panes/batch={number}")
        seen, held = self._state(spark, "seen", SEEN, number - 1), self._state(spark, "held", HELD, number - 1)
        done, before = seen.agg(F.coalesce(F.max("k"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
        mine = spark.read.schema(PANES).parquet(f"{self.path}/panes/batch={number}").agg(F.max(bursts._us(F.col("closes").cast("timestamp_ntz"))).alias("closed")).select(F.lit(number).alias("batch"), "closed").where("closed is not null")
        # one row for each batch whose panes a coming window may still hold
        every_held = [(r.batch, r.closed) for r in held.unionByName(mine).collect()]
        first = (done + 1) * grid.step - grid.panes
        needed = [(k, at) for k, at in every_held if at > w.start_us + first * w.pane_us]
        closed = max((at for _, at in every_held), default=None)
        closed_panes = spark.read.schema(PANES).option("recursiveFileLookup", True).parquet(*[f"{self.path}/panes/batch={k}" for k, _ in needed or [(number, 0)]])
        # a tick is complete once all panes before it are closed; the one at an end off the grid once a beat says so
        until = 0 if closed is None else min(grid.last, (closed - w.start_us) // w.step_us)
        if grid.ending and closed is not None and closed >= w.end_us:
            until = grid.ending
        said = closed_panes.where((F.col("place") >= 2 * first) & F.col("text_id").isNotNull()).withColumn("late", F.col("late") & F.lit(until == grid.ending))
        if until > done and not said.isEmpty():  # ticks without comments do not exist
            made = changes.Tops(self.texts.packed(said, grid), self.texts.terms, grid, w.top_n, (F.col("k") > done) & (F.col("k") <= until))
            tick = made.ticks.withColumn("seq", F.col("seq") + F.lit(before))
            vector = shared.durable(made.vectors(self.agg), "stream-vectors")
            names = ["k", "term", "freq", "rank", "value"]
            known = vector.select(names).unionByName(seen.where("term is not null").select(names))
            numbers = tick.select("k", F.col("seq").cast("bigint").alias("seq")).unionByName(seen.select("k", "seq").distinct())
            moved = changes.moved(known, numbers).where(F.col("seq") > before)
            moved.select("term", "seq", "now", "before", "freq", "d").write.mode("overwrite").parquet(f"{self.path}/changes/batch={number}")
            tick.select("k", F.col("seq").cast("bigint").alias("seq"), "n_msgs", "n_terms").write.mode("overwrite").parquet(f"{self.path}/ticks/batch={number}")
            newest = tick.agg(F.max("k").alias("k"), F.max("seq").cast("bigint").alias("seq")).where("k is not null")
            newest = newest.join(vector.select(names), "k", "left").select("k", "seq", "term", "freq", "rank", "value")
            seen = newest if before == 0 or not newest.isEmpty() else seen
        seen.write.mode("overwrite").parquet(f"{self.path}/seen/batch={number}")
        spark.createDataFrame(needed, HELD).write.mode("overwrite").parquet(f"{self.path}/held/batch={number}")
        for name in (f"seen/batch={number - 2}", f"held/batch={number - 2}", *[f"panes/batch={k}" for k, _ in every_held if k != number and k not in dict(needed)]):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def _state(self, spark: SparkSession, name: str, schema: str, number: int) -> DataFrame:
        """What the batch before has left: the vector of the last tick (``seen``), the batches of panes that are still needed (``held``)."""
        return spark.createDataFrame([], schema) if number < 0 else spark.read.schema(schema).parquet(f"{self.path}/{name}/batch={number}")


JUDGED = f"{CHANGE}, history bigint, mu double, sigma double"


class History(StatefulProcessor):
    """The last ``baseline`` changes of a term, in billionths; each change leaves with the mean and deviation of those before it."""

    def __init__(self, baseline: int):
        self.baseline = baseline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "u bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows).sort_values("seq")
        past = deque((u for (u,) in self.past.get()), self.baseline)
        s, q = sum(past), sum(u * u for u in past)
        history, mu, sigma = [], [], []
        for d in frame["d"]:
            n, u = len(past), round(d * changes.UNIT)
            history.append(n)
            mu.append(s / (n * changes.UNIT) if n else 0.0)
            sigma.append(sqrt(n * q - s * s) / (n * changes.UNIT) if n else 0.0)
            if n == self.baseline:
                s, q = s - past[0], q - past[0] ** 2
            past.append(u)
            s, q = s + u, q + u * u
        self.past.put([(int(u),) for u in past])
        yield frame.assign(history=history, mu=mu, sigma=sigma)[["term", "seq", "now", "before", "freq", "d", "history", "mu", "sigma"]]

    def close(self) -> None:
        pass


def judged(moved: DataFrame, detector: bursts.Detector) -> DataFrame:
    """Each change of a stream with z score and whether its term is important, by the history that its term's state holds."""
    moved.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    told = moved.groupBy("term").transformWithStateInPandas(statefulProcessor=History(detector.baseline), outputStructType=JUDGED, outputMode="append", timeMode="none")
    return changes.scored(told, detector)


@dataclass
class Snapshots:
    """A ``foreachBatch`` function: one row a tick from its judged changes; ticks without any term leave with the next change."""

    path: str
    w: bursts.Sliding
    detector: bursts.Detector

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, shared.durable(batch, "judged-changes")
        before = spark.read.schema("seq bigint").parquet(f"{self.path}/told/batch={number - 1}").first()[0] if number else 0
        until = max(before, rows.agg(F.max("seq")).first()[0] or 0)
        tick = spark.read.schema(TICK).option("recursiveFileLookup", True).parquet(f"{self.path}/ticks")
        met = tick.where((F.col("seq") > before) & (F.col("seq") <= until))  # also ticks without any term
        snaps = changes.summed(rows, met, changes.Grid(self.w), self.w.top_n, self.detector)
        snaps.write.mode("overwrite").parquet(f"{self.path}/snapshots/batch={number}")
        bursts.events(snaps).write.mode("overwrite").parquet(f"{self.path}/events/batch={number}")
        spark.createDataFrame([(until,)], "seq bigint").write.mode("overwrite").parquet(f"{self.path}/told/batch={number}")


def with_beats(comments: DataFrame, w: bursts.Sliding, parts: int, late: str = live.LATE) -> DataFrame:
    """(turn, local_ts, text_id, beat): the comments that a window holds in ``parts`` turns by time, and three beats after the end in two turns more.

    What the second beat makes late leaves in the batch that brings the third one.
    """
    since = bursts._us(F.col("local_ts")) - w.start_us
    turn = F.least(F.floor((since + w.window_us) * parts / (w.end_us - w.start_us + w.window_us)), F.lit(parts - 1)).cast("int")
    inside = comments.where((since > -w.window_us) & (since < w.end_us - w.start_us)).select(turn.alias("turn"), "local_ts", "text_id", F.lit(None).cast("boolean").alias("beat"))
    after = bursts._at(F.lit(w.end_us + w.pane_us) + F.col("id") * (3 * w.pane_us + intervals.micros(late)))
    beats = comments.sparkSession.range(3).select((parts + F.floor(F.col("id") / 2)).cast("int").alias("turn"), after.alias("local_ts"), F.lit(None).cast("bigint").alias("text_id"), F.lit(True).alias("beat"))
    return shared.durable(inside.unionByName(beats), "replay")


def _named(comments: DataFrame, stop_words: list[str] | None, texts: DataFrame | None) -> tuple[DataFrame, panes.Texts]:
    """Comments that name their text, and the texts."""
    if texts is None:
        comments = shared.durable(comments.withColumn("text_id", F.monotonically_increasing_id()), "replayed-comments")
        texts = comments
    return comments, panes.Texts(text_lines(texts, stop_words))


def _replayed(comments: DataFrame, w: bursts.Sliding, path: str, sink, parts: int) -> None:
    """Panes of a replay of ``comments`` in order of time, into a ``foreachBatch`` sink."""
    spark, turns = comments.sparkSession, with_beats(comments, w, parts)
    for turn in range(parts + 2):  # each run takes what has come and goes on from its checkpoint
        turns.where(F.col("turn") == turn).drop("turn").write.mode("overwrite").parquet(f"{path}/in/turn={turn:04}")
        stream = spark.readStream.schema(turns.drop("turn").schema).parquet(f"{path}/in/*")
        live.started(pane_counts(stream, w), sink, f"{path}/state-panes").awaitTermination()


def counts_once(comments: DataFrame, w: bursts.Sliding, stop_words: list[str] | None = None, texts: DataFrame | None = None, parts: int = 4) -> DataFrame:
    """(tick, term, n) of all windows between start and end: a stream counts panes, and a window is the sum of its closed panes.

    With ``texts`` (text_id, cleaned_comment) comments name their text by text_id.
    """
    spark, grid = comments.sparkSession, changes.Grid(w)
    path, (comments, known) = shared.new_path(spark, "stream-counts"), _named(comments, stop_words, texts)
    _replayed(comments, w, path, live.to_table(f"{path}/panes"), parts)
    said = spark.read.schema(PANES).option("recursiveFileLookup", True).parquet(f"{path}/panes").where("text_id is not null")
    rows = panes.freqs(known.packed(said.withColumn("late", F.col("late") & F.lit(not grid.whole)), grid), known.terms, grid)
    return rows.select(grid.moment(F.col("k")).alias("tick"), "term", "n")


def bursts_once(comments: DataFrame, w: bursts.Sliding, detector: bursts.Detector, stop_words: list[str] | None = None, parts: int = 2, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapshots, events) of all ticks between start and end, by both queries over a replay of ``comments`` in order of time.

    With ``texts`` (text_id, cleaned_comment) comments name their text by text_id.
    """
    spark = comments.sparkSession
    path, (comments, known) = shared.new_path(spark, "stream-bursts"), _named(comments, stop_words, texts)
    _replayed(comments, w, path, Windows(path, w, known, detector.agg), parts)
    moved = spark.readStream.schema(CHANGE).option("recursiveFileLookup", True).parquet(f"{path}/changes")
    live.started(judged(moved, detector), Snapshots(path, w, detector), f"{path}/state-history").awaitTermination()
    read = lambda schema, name: spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/{name}")
    snaps = read("tick timestamp_ntz, n_msgs bigint, tfidf_terms bigint, score double, important_count bigint, important_terms array<string>, is_event boolean", "snapshots")
    return snaps, read("tick timestamp_ntz, score double, important_terms string, important_count bigint", "events")
