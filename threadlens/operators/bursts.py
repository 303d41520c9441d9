"""Sliding windows over comments and the detection of bursting terms.

A window of length ``window`` ends at each tick start + step, start + 2 step, …
and at ``end``; it holds the comments with tick - window < time < tick.  Comments
are first counted by pane, the longest stretch that divides step and window: a
window is then the sum of its panes, so nothing is counted once a tick.  The
lower bound is open, hence what lies exactly on a pane's edge is counted apart.
An ``end`` off the grid makes a last window of its own.

A term's history is made of its own changes only, so the detector needs no
state: ticks are numbered, each tick's vector meets the one before it in a full
join, and mean and deviation come from a frame of earlier rows.  Scores that
decide an order or a threshold are compared after rounding to PLACES, so sums
taken in another order change nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from math import gcd

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import intervals
from ..functions import text as X
from . import termstats
from .timebuckets import ZONE

PLACES = 9
DAY = 86_400_000_000
_EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Sliding:
    """Windows from ``start`` to ``end``; lengths as intervals like ``10min`` or ``2H``, or in minutes."""

    start: str | datetime
    end: str | datetime
    step: str | int = "10min"
    window: str | int = "2h"
    grain: str | int = "10min"
    top_n: int = 800
    zone: str = ZONE

    def __post_init__(self) -> None:
        intervals.span(self.start, self.end, self.zone)
        if min(self.step_us, self.window_us, self.grain_us) <= 0 or self.top_n < 1:
            raise ValueError("lengths and top_n must be above zero")

    step_us = property(lambda self: intervals.micros(self.step))
    window_us = property(lambda self: intervals.micros(self.window))
    grain_us = property(lambda self: intervals.micros(self.grain))
    start_us = property(lambda self: (intervals.local(self.start, self.zone) - _EPOCH) // timedelta(microseconds=1))
    end_us = property(lambda self: (intervals.local(self.end, self.zone) - _EPOCH) // timedelta(microseconds=1))
    pane_us = property(lambda self: gcd(self.step_us, self.window_us))
    last = property(lambda self: -(-(self.end_us - self.start_us) // self.step_us))  # the tick at ``end``


@dataclass(frozen=True)
class Detector:
    baseline: int = 30
    k_sigma: float = 3.0
    min_history: int = 5
    agg: str = "sum"
    top_k: int | None = 10
    require_min_terms: int = 1
    require_min_score: float | None = None
    sigma_floor: float = 0.05
    min_count_window: int = 2


def _at(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def _us(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def ticks_of(local_ts: Column, w: Sliding, bounded: bool = True) -> Column:
    """array<timestamp_ntz>: the ticks whose windows hold a moment; without ``bounded`` the grid goes on after ``end``."""
    since = _us(local_ts) - w.start_us
    low, high = F.floor(since / w.step_us) + 1, F.ceil((since + w.window_us) / w.step_us) - 1
    low = F.greatest(low, F.lit(1))
    high = F.least(high, F.lit(w.last - 1)) if bounded else high
    grid = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: _at(k * w.step_us + w.start_us))).otherwise(F.array().cast("array<timestamp_ntz>"))
    ending = (since > w.end_us - w.start_us - w.window_us) & (since < w.end_us - w.start_us)
    if not bounded:  # there the tick at ``end`` may be one of the grid's
        ending = ending & F.lit(bool((w.end_us - w.start_us) % w.step_us))
    return F.concat(grid, F.when(ending, F.array(_at(F.lit(w.end_us)))).otherwise(F.array().cast("array<timestamp_ntz>")))


def bin_of(local_ts: Column, w: Sliding, first: Column | None = None) -> Column:
    """The start of the grain that holds a moment, from the midnight of ``first`` (of the moment itself where grains divide a day)."""
    origin = F.floor(_us(local_ts if first is None else first) / DAY) * DAY
    return _at(origin + F.floor((_us(local_ts) - origin) / w.grain_us) * w.grain_us)


def windowed(comments: DataFrame, w: Sliding, stop_words: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tick, bin, term, n), (tick, bin): non-blank grain bins, and (tick, n_msgs); written tables."""
    since = _us(F.col("local_ts")) - w.start_us
    reach = comments.where((since > -w.window_us) & (since < w.end_us - w.start_us))
    said = ~X.is_blank(F.col("cleaned_comment"))
    if DAY % w.grain_us:  # bins then depend on each window's first comment
        return _by_window(shared.durable(reach.select("local_ts", "cleaned_comment", said.alias("said")), "window-comments"), w, stop_words)
    pane, edge = F.floor(since / w.pane_us), F.pmod(since, F.lit(w.pane_us)) == 0
    rows = reach.select(pane.alias("pane"), edge.alias("edge"), bin_of(F.col("local_ts"), w).alias("bin"), since.alias("since"), F.col("cleaned_comment"), said.alias("said"))
    # what lies in the last window, off the grid, is counted once more for it
    ending = rows.where(F.col("since") > w.end_us - w.start_us - w.window_us).withColumns({"pane": F.lit(None).cast("long"), "edge": F.lit(False)})
    rows = shared.durable(rows.unionByName(ending).drop("since"), "window-comments")
    steps, panes = w.step_us // w.pane_us, w.window_us // w.pane_us
    # tick k ends after k * steps panes: it has the panes from k * steps - panes on, the first one without its edge
    low, high = F.floor(F.col("pane") / steps) + 1, F.floor((F.col("pane") + panes) / steps)
    ticks = F.when(F.col("pane").isNull(), F.array(F.lit(w.last))).otherwise(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))

    def spread(counted: DataFrame) -> DataFrame:
        every = counted.withColumn("k", F.explode(ticks))
        grid = (F.col("k") >= 1) & (F.col("k") < w.last) & ~(F.col("edge") & (F.col("k") * steps == F.col("pane") + panes))
        tick = F.least(F.col("k") * w.step_us + w.start_us, F.lit(w.end_us))
        return every.where(F.col("pane").isNull() | grid).withColumn("tick", _at(tick))

    terms = shared.durable(termstats.term_counts(rows.where("said"), ["pane", "edge", "bin"], stop_words), "pane-counts")
    counts = spread(terms).groupBy("tick", "bin", "term").agg(F.sum("n").alias("n"))
    bins = spread(rows.where("said").select("pane", "edge", "bin").distinct()).select("tick", "bin").distinct()
    sizes = spread(rows.groupBy("pane", "edge").agg(F.count("*").alias("m"))).groupBy("tick").agg(F.sum("m").alias("n_msgs"))
    return shared.durable(counts, "window-counts"), shared.durable(bins, "window-bins"), shared.durable(sizes, "window-sizes")


def _by_window(rows: DataFrame, w: Sliding, stop_words: list[str] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same where a grain does not divide a day: every comment goes to its windows before it is counted."""
    every = rows.withColumn("tick", F.explode(ticks_of(F.col("local_ts"), w)))
    sizes = shared.durable(every.groupBy("tick").agg(F.count("*").alias("n_msgs"), F.min("local_ts").alias("first")), "window-sizes")
    placed = every.where("said").join(sizes.select("tick", "first"), "tick").withColumn("bin", bin_of(F.col("local_ts"), w, F.col("first")))
    counts = termstats.term_counts(placed, ["tick", "bin"], stop_words)
    return shared.durable(counts, "window-counts"), shared.durable(placed.select("tick", "bin").distinct(), "window-bins"), sizes.select("tick", "n_msgs")


def top_by_tick(counts: DataFrame, top_n: int) -> DataFrame:
    """(tick, term, freq, rank) of each tick's most frequent terms, ties by name."""
    totals = counts.groupBy("tick", "term").agg(F.sum("n").alias("freq"))
    rank = F.row_number().over(Window.partitionBy("tick").orderBy(F.desc("freq"), "term"))
    return totals.withColumn("rank", rank).where(F.col("rank") <= top_n)


def tick_tfidf(counts: DataFrame, bins: DataFrame, top: DataFrame) -> DataFrame:
    """(tick, bin, term, n, tfidf) over each tick's own vocabulary and bins."""
    kept = counts.join(top.select("tick", "term"), ["tick", "term"])
    return termstats.weighted(kept, bins.groupBy("tick").agg(F.count("*").alias("n_docs")), ["tick", "bin"], ["tick"])


def vectors(tfidf: DataFrame, bins: DataFrame, agg: str, grain_us: int) -> DataFrame:
    """(tick, term, value): TF-IDF of the bins added up, or their mean over all bins from the first to the last."""
    total = tfidf.groupBy("tick", "term").agg(F.sum("tfidf").alias("value"))
    if agg == "sum":
        return total
    if agg != "mean":
        raise ValueError(f"sum or mean, not {agg!r}")
    span = (_us(F.max("bin")) - _us(F.min("bin"))) / grain_us + 1
    return total.join(bins.groupBy("tick").agg(span.alias("rows")), "tick").select("tick", "term", (F.col("value") / F.col("rows")).alias("value"))


def numbered(sizes: DataFrame, before: int = 0) -> DataFrame:
    """(tick, seq): the non-empty ticks in order.  Ticks are one short row each, whatever the number of comments."""
    return sizes.select("tick", (F.row_number().over(Window.orderBy("tick")) + before).alias("seq"))


def changes(vector: DataFrame, seq: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """(tick, seq, term, now, before, d): each non-empty tick against the non-empty tick before it, absent terms as 0.

    ``last`` (seq, term, value) is the vector of the tick before the first one, where that is known.
    """
    mine = vector.join(seq, "tick").select("seq", "term", "value")
    known = mine if last is None else mine.unionByName(last.select("seq", "term", "value"))
    moved = known.select((F.col("seq") + 1).alias("seq"), "term", F.col("value").alias("before"))
    both = mine.withColumnRenamed("value", "now").join(moved, ["seq", "term"], "full").where("seq > 1").join(seq, "seq")
    now, before = F.coalesce("now", F.lit(0.0)), F.coalesce("before", F.lit(0.0))
    return both.select("tick", "seq", "term", now.alias("now"), before.alias("before"), F.abs(now - before).alias("d"))


def judged(change: DataFrame, top: DataFrame, detector: Detector, past: DataFrame | None = None) -> DataFrame:
    """Each change with its term's history, z score and whether the term is important; ``past`` (seq, term, d) are earlier changes."""
    frame = Window.partitionBy("term").orderBy("seq").rowsBetween(-detector.baseline, -1)
    rows = change if past is None else change.unionByName(past.select("seq", "term", "d"), allowMissingColumns=True)
    rows = rows.withColumns({"history": F.count("d").over(frame), "mu": F.coalesce(F.avg("d").over(frame), F.lit(0.0)), "sigma": F.coalesce(F.stddev_pop("d").over(frame), F.lit(0.0))})
    rows = rows.where("tick is not null").join(top.select("tick", "term", "freq"), ["tick", "term"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    floor = F.greatest("sigma", F.lit(detector.sigma_floor))
    jump = F.round(F.col("d") - F.col("mu") - detector.k_sigma * floor, PLACES) > 0
    important = (F.col("history") >= detector.min_history) & (F.col("freq") >= detector.min_count_window) & jump
    return rows.withColumns({"z": F.round((F.col("d") - F.col("mu")) / floor, PLACES), "important": important})


def burst_terms(judgement: DataFrame, detector: Detector) -> DataFrame:
    """The important terms of each tick, largest z first, then by name, at most top_k."""
    rank = F.row_number().over(Window.partitionBy("tick").orderBy(F.desc("z"), "term"))
    rows = judgement.where("important").withColumn("rank", rank)
    return rows.where(F.col("rank") <= detector.top_k) if detector.top_k else rows


def snapshots(seq: DataFrame, sizes: DataFrame, vector: DataFrame, judgement: DataFrame, bursts: DataFrame, detector: Detector) -> DataFrame:
    """One row a non-empty tick: messages, terms with a weight, score, important terms and whether it is an event."""
    scores = judgement.groupBy("tick").agg(F.greatest(F.lit(0.0), F.max("z")).alias("max_z"), F.max(F.when(F.col("freq") >= detector.min_count_window, F.col("z"))).alias("max_z_valid"))
    listed = bursts.groupBy("tick").agg(F.count("*").alias("important_count"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("important_terms"))
    weighed = vector.groupBy("tick").agg(F.count("*").alias("tfidf_terms"))
    rows = seq.join(sizes, "tick").join(scores, "tick", "left").join(listed, "tick", "left").join(weighed, "tick", "left")
    score, count = F.coalesce("max_z_valid", "max_z", F.lit(0.0)), F.coalesce("important_count", F.lit(0))
    event = count >= detector.require_min_terms
    if detector.require_min_score is not None:
        event = event & (score >= detector.require_min_score)
    return rows.select("tick", "n_msgs", F.coalesce("tfidf_terms", F.lit(0)).alias("tfidf_terms"), score.alias("score"), count.alias("important_count"), F.coalesce("important_terms", F.array()).alias("important_terms"), ((F.col("seq") > 1) & event).alias("is_event"))


def events(snapshot: DataFrame, max_terms: int = 8) -> DataFrame:
    return snapshot.where("is_event").select("tick", "score", F.array_join(F.slice("important_terms", 1, max_terms), ", ").alias("important_terms"), "important_count")


@dataclass
class Steps:
    """What the detector makes of counted windows, step by step; written tables where several later steps read them."""

    counts: DataFrame
    bins: DataFrame
    sizes: DataFrame
    w: Sliding
    detector: Detector
    before: int = 0  # ticks seen earlier, with ...
    last: DataFrame | None = None  # ... the last one's vector (seq, term, value) ...
    past: DataFrame | None = None  # ... and earlier changes (seq, term, d)

    def __post_init__(self) -> None:
        self.top = shared.durable(top_by_tick(self.counts, self.w.top_n), "window-top")
        self.tfidf = tick_tfidf(self.counts, self.bins, self.top)
        self.seq = numbered(self.sizes, self.before)

    def weighed(self) -> Steps:
        self.vector = shared.durable(vectors(self.tfidf, self.bins, self.detector.agg, self.w.grain_us), "window-vectors")
        return self

    def changed(self) -> Steps:
        self.change = shared.durable(changes(self.weighed().vector, self.seq, self.last), "window-changes")
        return self

    def judged(self) -> Steps:
        self.judgement = shared.durable(judged(self.changed().change, self.top, self.detector, self.past), "window-judgements")
        self.found = burst_terms(self.judgement, self.detector)
        return self

    def snapshots(self) -> DataFrame:
        self.judged()
        return snapshots(self.seq, self.sizes, self.vector, self.judgement, self.found, self.detector)


def detect_windows(counts: DataFrame, bins: DataFrame, sizes: DataFrame, w: Sliding, detector: Detector) -> DataFrame:
    """Snapshots from what ``windowed`` gives, or from the counts that a stream has left."""
    return Steps(counts, bins, sizes, w, detector).snapshots()


def detect(comments: DataFrame, w: Sliding, detector: Detector, stop_words: list[str] | None = None) -> DataFrame:
    """Snapshots of all ticks."""
    return detect_windows(*windowed(comments, w, stop_words), w, detector)


VIEW = "tick timestamp_ntz, n_msgs bigint, terms array<struct<term: string, freq: bigint, value: double>>"


def views(counts: DataFrame, bins: DataFrame, sizes: DataFrame, w: Sliding, agg: str = "sum") -> DataFrame:
    """One row a non-empty tick with its top terms, their counts and weights: what a detector of one's own gets."""
    top = top_by_tick(counts, w.top_n)
    vector = vectors(tick_tfidf(counts, bins, top), bins, agg, w.grain_us)
    listed = top.join(vector, ["tick", "term"], "left").groupBy("tick").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term", "freq", F.coalesce("value", F.lit(0.0)).alias("value")))), lambda x: F.struct(x["term"].alias("term"), x["freq"].alias("freq"), x["value"].alias("value"))).alias("terms"))
    none = F.array().cast("array<struct<term: string, freq: bigint, value: double>>")
    return sizes.join(listed, "tick", "left").select("tick", "n_msgs", F.coalesce("terms", none).alias("terms"))


def hooked(view: DataFrame, detector: Callable[[dict], dict | None]) -> DataFrame:
    """(tick, n_msgs, score, is_event, detector_error) by a callable that gets each tick's view as a dict, in order.

    It may keep state, so all ticks (one row each, of at most top_n terms) go through one task.  It gives a
    dict with ``score`` and ``is_event``; None leaves the tick as it is.  If it raises, the tick is no event and
    keeps the error's text, and the next ticks go on.
    """

    kinds = pa.schema({"tick": pa.timestamp("us"), "n_msgs": pa.int64(), "score": pa.float64(), "is_event": pa.bool_(), "detector_error": pa.string()})

    def run(batches):
        for batch in batches:
            out = []
            for tick, n_msgs, terms in zip(*[batch[c] for c in ("tick", "n_msgs", "terms")]):  # a tick at a time becomes Python objects
                row = {"tick": tick.as_py(), "n_msgs": n_msgs.as_py(), "score": None, "is_event": None, "detector_error": None}
                try:
                    row |= {k: v for k, v in (detector({"tick": pd.Timestamp(row["tick"]), "n_msgs": row["n_msgs"], "terms": terms.as_py()}) or {}).items() if k in ("score", "is_event")}
                except Exception as error:  # the hook's own, whatever it is
                    row |= {"detector_error": str(error), "is_event": False}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, kinds)

    return view.select("tick", "n_msgs", "terms").repartition(1).sortWithinPartitions("tick").mapInArrow(run, "tick timestamp_ntz, n_msgs bigint, score double, is_event boolean, detector_error string")
