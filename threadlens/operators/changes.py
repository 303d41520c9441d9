"""Sliding windows made of changes, and bursts found in them.

Comments are counted once by pane, the longest stretch that divides step and
window of a ``bursts.Sliding``.  A window's lower bound is open, so what lies
exactly on a pane's edge is counted apart: pane p has the places 2 p (its edge)
and 2 p + 1, and the window of tick k holds the places from 2 k s - 2 n + 1 to
2 k s - 1, for s panes a step and n panes a window.

Ticks are dealt in slices of SLICE times the ticks that a pane lies in.  Comments
go, as texts, to the slices whose ticks hold them and are counted there; those of
panes with more than HOT comments are counted before, so that no pane weighs more
than its vocabulary.  The counts are a table in buckets of slices: all steps up to
the weights of each tick read it bucket by bucket, and nothing is sent again.

A count enters a term's window at one tick and leaves it at another.  Running
sums of these two signed changes give ranges of ticks in which the term's
frequency stands (``ranges``); the same sums over ranges give, for each tick, the
frequency that its top_n-th term has (``thresholds``).  Terms that cannot reach
it in their slice are never looked at again, the others are expanded over ticks
only where they reach it (``ranked``), each with the cells of its window.  So what
is sorted a tick is about top_n rows, however many terms a window has.  An ``end``
off the grid makes a last window of its own.

A term's weights in order of ticks give its changes (``moved``), and running sums
of whole billionths the mean and deviation of the ``baseline`` changes before
each (``judged``): no frame is summed anew for every row.  Both go by term, so
that they share one exchange.  Changes are rounded to PLACES, hence sums taken in
another order change nothing.

Null and blank comments count as messages and hold no terms; ticks without a
message do not exist; ties of frequency and of scores go to the smaller name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as X
from . import panes
from .bursts import DAY, PLACES, Detector, Sliding, _at, _us

MESSAGE, SAID = "\x01", "\x02"  # stand among the terms: one for each comment, one for each that is not blank
SLICE = 4
CHUNK = 62  # ticks of a mask
HOT = 5_000  # comments from which a pane is counted before it is dealt
UNIT = 10**PLACES
_LOW = (1 << 32) - 1


@dataclass(frozen=True)
class Grid:
    """A Sliding in panes; its ticks are numbered from 1, ``ending`` is the one at an end off the grid."""

    w: Sliding

    def __post_init__(self) -> None:
        if DAY % self.w.grain_us:
            raise ValueError("here the grain must divide a day")

    step = property(lambda self: self.w.step_us // self.w.pane_us)
    panes = property(lambda self: self.w.window_us // self.w.pane_us)
    whole = property(lambda self: (self.w.end_us - self.w.start_us) % self.w.step_us == 0)
    last = property(lambda self: self.w.last if self.whole else self.w.last - 1)
    ending = property(lambda self: None if self.whole else self.w.last)
    slice_ticks = property(lambda self: SLICE * (-(-self.panes // self.step) + 1))  # SLICE times the most ticks that a pane lies in

    def enters(self, place: Column) -> Column:
        return F.greatest(F.floor(place / (2 * self.step)) + 1, F.lit(1))

    def leaves(self, place: Column) -> Column:
        """The last tick that holds a place."""
        return F.least(F.floor((place + 2 * self.panes - 1) / (2 * self.step)), F.lit(self.last))

    def slice(self, tick: Column) -> Column:
        return F.floor(tick / self.slice_ticks)

    def moment(self, tick: Column) -> Column:
        return _at(F.least(tick * self.w.step_us + self.w.start_us, F.lit(self.w.end_us)))

    def bin_moment(self, b: Column) -> Column:
        return _at(b * self.w.grain_us)


def counted(comments: DataFrame, grid: Grid, stop_words: list[str] | None = None, texts: DataFrame | None = None, bin: Column | None = None) -> DataFrame:
    """(slice, place, bin, term, n), a written table in buckets of slices; place is null for what lies in a window at an end off the grid.

    With ``texts`` (text_id, cleaned_comment) comments name their text by text_id; ``bin`` stands for the number of the grain.
    """
    w = grid.w
    since = _us(F.col("local_ts")) - w.start_us
    inside = comments.where((since > -w.window_us) & (since < w.end_us - w.start_us))
    pane = F.floor(since / w.pane_us)
    place = 2 * pane + F.when(F.pmod(since, F.lit(w.pane_us)) == 0, 0).otherwise(1)
    late = F.lit(False) if grid.whole else since > w.end_us - w.start_us - w.window_us
    bin = F.floor(_us(F.col("local_ts")) / w.grain_us) if bin is None else bin
    line = X.told(F.col("cleaned_comment"), stop_words).alias("line")
    name = line if texts is None else F.col("text_id")
    lines = None if texts is None else texts.select("text_id", line)  # a text's terms are found once
    met = lambda rows: rows if lines is None else rows.join(lines, "text_id").drop("text_id")
    marked = F.concat(X.told_terms(F.col("line")), F.array(F.lit(MESSAGE)), F.when(F.col("line").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit(SAID))))
    rows = inside.select(pane.alias("pane"), place.alias("place"), late.alias("late"), bin.alias("bin"), name)
    first, last = grid.enters(F.col("place")), grid.leaves(F.col("place"))
    slices = F.when(first <= last, F.sequence(grid.slice(first), grid.slice(last))).otherwise(F.array().cast("array<bigint>"))
    at = F.transform(slices, lambda x: F.struct(x.alias("slice"), F.col("place").alias("place")))
    if grid.ending:
        end = F.struct(grid.slice(F.lit(grid.ending)).cast("bigint").alias("slice"), F.lit(None).cast("bigint").alias("place"))
        at = F.when(F.col("late"), F.array_append(at, end)).otherwise(at)
    dealt = lambda rows, *rest: rows.select(F.explode(at).alias("at"), "bin", *rest).select("at.*", "bin", *rest)
    hot = shared.durable(rows.groupBy("pane").agg(F.count("*").alias("m")).where(F.col("m") > HOT).select("pane", F.ceil(F.col("m") / max(HOT, 1)).alias("pieces")), "hot-panes")
    cold = rows if hot.isEmpty() else rows.join(hot.select("pane"), "pane", "left_anti")
    told = met(dealt(cold, "line" if texts is None else "text_id")).select("slice", "place", "bin", "line", F.lit(None).cast("string").alias("term"), F.lit(1).cast("bigint").alias("n"))
    if not hot.isEmpty():
        # a hot pane is counted in pieces of about HOT comments, each by one task, so that counts and not words are dealt
        pieces = met(rows.join(hot, "pane").withColumn("piece", F.floor(F.rand(7) * F.col("pieces")))).repartition("pane", "piece")
        counts = pieces.select("pane", "piece", "place", "late", "bin", F.explode(marked).alias("term")).groupBy("pane", "piece", "place", "late", "bin", "term").agg(F.count("*").alias("n"))
        told = told.unionByName(dealt(counts, "term", "n").withColumn("line", F.lit(None).cast("string")))
    parts = int(comments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = told.repartition(parts, "slice").select("slice", "place", "bin", "n", F.explode(F.when(F.col("term").isNull(), marked).otherwise(F.array("term"))).alias("term"))
    return shared.bucketed(each.groupBy("slice", "place", "bin", "term").agg(F.sum("n").alias("n")), "pane-counts", "slice", parts, "term", "place")


def _terms(counts: DataFrame) -> DataFrame:
    return counts.where(~F.col("term").isin(MESSAGE, SAID))


def _placed(counts: DataFrame, grid: Grid) -> DataFrame:
    """Counts on the grid with the first and the last tick of their slice that holds them."""
    low = F.col("slice") * grid.slice_ticks
    first, last = F.greatest(grid.enters(F.col("place")), low), F.least(grid.leaves(F.col("place")), low + grid.slice_ticks - 1)
    return counts.where("place is not null").withColumns({"first": first, "last": last}).where("first <= last")


def _signed(rows: DataFrame, key: str, n: Column) -> DataFrame:
    """(slice, key, k, d): n more at the first tick, n less after the last one."""
    change = F.explode(F.array(F.struct(F.col("first").alias("k"), n.alias("d")), F.struct((F.col("last") + 1).alias("k"), (-n).alias("d")))).alias("c")
    return rows.select("slice", key, change).groupBy("slice", key, "c.k").agg(F.sum("c.d").alias("d"))


def ranges(counts: DataFrame, grid: Grid) -> DataFrame:
    """(slice, term, freq, first, last): the ticks of the grid in which a term's frequency stands, without those where it is 0."""
    by_term = Window.partitionBy("slice", "term").orderBy("k")
    moves = _signed(_placed(_terms(counts), grid), "term", F.col("n"))
    stands = moves.select("slice", "term", F.sum("d").over(by_term).alias("freq"), F.col("k").alias("first"), (F.lead("k").over(by_term) - 1).alias("last"))
    return stands.where("freq > 0")


def thresholds(stands: DataFrame, top_n: int) -> DataFrame:
    """(k, least, n_terms): each tick's number of terms and, where that is top_n or more, the frequency of the top_n-th; else 1."""
    by_level = Window.partitionBy("slice", "freq").orderBy("k")  # at most one row a tick
    levels = _signed(stands, "freq", F.lit(1)).select("slice", "freq", F.sum("d").over(by_level).alias("m"), F.col("k").alias("first"), (F.lead("k").over(by_level) - 1).alias("last")).where("m > 0")
    each = levels.select("slice", "freq", "m", F.explode(F.sequence("first", "last")).alias("k"))
    reached = each.withColumn("above", F.sum("m").over(Window.partitionBy("slice", "k").orderBy(F.desc("freq"))))
    return reached.groupBy("slice", "k").agg(F.coalesce(F.max(F.when(F.col("above") >= top_n, F.col("freq"))), F.lit(1)).alias("least"), F.sum("m").alias("n_terms")).drop("slice")


def _terms_by_tick(present: DataFrame, grid: Grid) -> DataFrame:
    """(slice, k, n_terms) of the ticks that have terms, from the masks of ``present``."""
    bits = min(CHUNK, grid.slice_ticks)
    each = present.groupBy("slice", "chunk").agg(F.array(*[F.sum(F.shiftright("mask", i).bitwiseAND(F.lit(1))) for i in range(bits)]).alias("m"))
    rows = each.select("slice", "chunk", F.posexplode("m").alias("at", "n_terms")).where("n_terms > 0")
    return rows.select("slice", (F.col("slice") * grid.slice_ticks + F.col("chunk") * CHUNK + F.col("at")).alias("k"), "n_terms")


def able(counts: DataFrame, grid: Grid, top_n: int) -> tuple[DataFrame, DataFrame]:
    """The counts of the terms that may be among a tick's top_n, a written table, and ``thresholds`` of all terms.

    One pass makes each term's total in its slice, and a mask of the slice's ticks that it is in.  The top_n-th of
    the slice's 2 top_n most frequent terms at a tick is no more than the top_n-th of all.  So terms whose total lies
    below the least of these at the slice's ticks are among no tick's top_n, and only the others are followed over time.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = F.col("slice") * grid.slice_ticks
    first, last = F.greatest(grid.enters(F.col("place")), low) - low, F.least(grid.leaves(F.col("place")), low + grid.slice_ticks - 1) - low
    rows = _terms(counts).select("slice", "term", "n", first.alias("a"), last.alias("b"))
    inside = F.col("a") <= F.col("b")  # null for what has no place
    chunks = F.when(inside, F.sequence(F.floor(F.col("a") / CHUNK), F.floor(F.col("b") / CHUNK))).otherwise(F.array(F.lit(0).cast("bigint")))
    rows = rows.withColumn("chunk", F.lit(0).cast("bigint") if grid.slice_ticks <= CHUNK else F.explode(chunks))
    a, b = F.greatest(F.col("a") - F.col("chunk") * CHUNK, F.lit(0)), F.least(F.col("b") - F.col("chunk") * CHUNK, F.lit(CHUNK - 1))
    shifted = lambda x, by: F.call_function("shiftleft", x, by.cast("int"))
    mask = F.when(inside, shifted(shifted(F.lit(1).cast("bigint"), b - a + 1) - 1, a)).otherwise(F.lit(0).cast("bigint"))
    once = F.when(inside & (F.col("chunk") > F.floor(F.col("a") / CHUNK)), F.lit(0).cast("bigint")).otherwise(F.col("n"))
    present = shared.bucketed(rows.groupBy("slice", "term", "chunk").agg(F.bit_or(mask).alias("mask"), F.sum(once).alias("n")), "term-totals", "slice", parts)
    totals = present.groupBy("slice", "term").agg(F.sum("n").alias("total"))
    leading = totals.withColumn("rn", F.row_number().over(Window.partitionBy("slice").orderBy(F.desc("total"), "term"))).where(F.col("rn") <= 2 * top_n)
    met = lambda some: counts.join(some.select("slice", "term").hint("shuffle_hash"), ["slice", "term"], "left_semi")
    n_terms = shared.durable(_terms_by_tick(present, grid), "tick-terms")  # a short row a tick
    bound = thresholds(ranges(met(leading), grid), top_n).select("k", "least")
    lows = n_terms.join(bound, "k", "left").select("slice", F.coalesce("least", F.lit(1)).alias("low"))
    if grid.ending:  # all terms of the window at an end off the grid may be among its top
        lows = lows.unionByName(counts.sparkSession.range(1).select(grid.slice(F.lit(grid.ending)).cast("bigint").alias("slice"), F.lit(1).cast("bigint").alias("low")))
    lows = shared.durable(lows.groupBy("slice").agg(F.min("low").alias("low")), "slice-lows")
    kept = shared.bucketed(met(totals.join(F.broadcast(lows), "slice").where("total >= low")), "able-counts", "slice", parts, "term", "place")  # one row a slice
    least = n_terms.drop("slice").join(thresholds(ranges(kept, grid), top_n).select("k", "least"), "k", "left")
    return kept, least.select("k", F.coalesce("least", F.lit(1)).alias("least"), "n_terms")


def spans(counts: DataFrame, grid: Grid) -> DataFrame:
    """(slice, bin, term, n, first, last): counts with the ticks of their slice whose windows hold them."""
    names = ["slice", "bin", "term", "n", "first", "last"]
    rows = _placed(_terms(counts), grid).select(names)
    if grid.ending:
        end = F.lit(grid.ending).cast("bigint")
        rows = rows.unionByName(_terms(counts).where("place is null").withColumns({"first": end, "last": end}).select(names))
    return rows


def ticks(counts: DataFrame, least: DataFrame, grid: Grid) -> DataFrame:
    """(k, seq, n_msgs, n_docs, low, high, least, n_terms): a row for each tick with messages, numbered in order; a written table.

    Ticks follow from the length of time alone: one short row each, whatever the number of comments.
    """
    marks = counts.where(F.col("term").isin(MESSAGE, SAID))
    spread = _placed(marks, grid).withColumn("k", F.explode(F.sequence("first", "last"))).select("slice", "k", "bin", "term", "n")
    if grid.ending:
        spread = spread.unionByName(marks.where("place is null").select("slice", F.lit(grid.ending).cast("bigint").alias("k"), "bin", "term", "n"))
        last = _terms(counts).where("place is null").agg(F.count_distinct("term").alias("n_terms")).select(F.lit(grid.ending).cast("bigint").alias("k"), F.lit(1).cast("bigint").alias("least"), "n_terms")
        least = least.unionByName(last)
    said = F.when(F.col("term") == SAID, F.col("bin"))
    rows = spread.groupBy("k").agg(F.sum(F.when(F.col("term") == MESSAGE, F.col("n"))).alias("n_msgs"), F.count_distinct(said).alias("n_docs"), F.min(said).alias("low"), F.max(said).alias("high"))
    numbered = rows.withColumn("seq", F.row_number().over(Window.orderBy("k")))
    return shared.durable(numbered.join(least, "k", "left").withColumns({"least": F.coalesce("least", F.lit(1)), "n_terms": F.coalesce("n_terms", F.lit(0))}), "window-ticks")


def ranked(counts: DataFrame, tick: DataFrame, grid: Grid, top_n: int) -> DataFrame:
    """(slice, k, term, freq, rank, cells): each tick's top terms; ``cells`` holds bin and count of each place as one number."""
    cell = F.shiftleft(F.col("bin").cast("bigint"), 32).bitwiseOR(F.col("n"))
    packed = _terms(counts).withColumn("cell", cell)
    # no window has more of a term than the slice's counts together, so terms below the slice's least threshold go
    low = tick.groupBy(grid.slice(F.col("k")).alias("slice")).agg(F.min("least").alias("low"))
    total = F.sum("n").over(Window.partitionBy("slice", "term"))
    low_tick, width = F.col("slice") * grid.slice_ticks, 2 * grid.step
    first, last = F.greatest(grid.enters(F.col("place")), low_tick), F.least(grid.leaves(F.col("place")), low_tick + grid.slice_ticks - 1)
    able = packed.withColumns({"first": first, "last": last, "total": total}).join(F.broadcast(low), "slice").where((F.col("total") >= F.col("low")) & (F.col("place").isNull() | (F.col("first") <= F.col("last"))))  # one row a slice
    # a marker stands at each tick at which something enters or leaves; its window is a stretch of places before it
    # an end off the grid has a marker of its own, so far on that its cells, just before it, are in no other window
    beyond, by_term = width * (grid.last + 1 + 2 * grid.slice_ticks), Window.partitionBy("slice", "term").orderBy("at")
    mark = lambda at: F.struct(at.cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("cell"))
    told = lambda at: F.struct(at.cast("bigint").alias("at"), F.col("cell").alias("cell"))
    on_grid = F.array(told(F.col("place")), mark(F.col("first") * width), mark((F.col("last") + 1) * width))
    line = able.select("slice", "term", F.explode(F.when(F.col("place").isNull(), F.array(told(F.lit(beyond - 1)), mark(F.lit(beyond)))).otherwise(on_grid)).alias("x")).select("slice", "term", "x.*")
    held = line.withColumn("cells", F.collect_list("cell").over(by_term.rangeBetween(1 - 2 * grid.panes, -1))).where("cell is null")
    end = (F.col("slice") + 1) * grid.slice_ticks  # ticks from here on are other slices'
    following = F.lead("at").over(by_term)  # of equal markers the last one counts
    until = F.least(F.coalesce(F.floor(following / width), end), end, F.lit(grid.last + 1)) - 1
    closing = F.col("at") == beyond
    start, stop = F.when(closing, F.lit(grid.ending)).otherwise(F.floor(F.col("at") / width)), F.when(closing & following.isNull(), F.lit(grid.ending)).when(~closing, until)
    stretch = held.select("slice", "term", "cells", start.cast("bigint").alias("from"), stop.cast("bigint").alias("to")).where((F.size("cells") > 0) & (F.col("from") <= F.col("to")))
    spread = stretch.select("slice", "term", "cells", F.explode(F.sequence("from", "to")).alias("k"))
    summed = spread.withColumn("freq", F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, c: a + c.bitwiseAND(F.lit(_LOW))))
    reaching = summed.join(tick.select("k", "least"), "k").where(F.col("freq") >= F.col("least")).drop("least")
    rank = F.row_number().over(Window.partitionBy("slice", "k").orderBy(F.desc("freq"), "term"))
    return reaching.withColumn("rank", rank).where(F.col("rank") <= top_n)


def weighed(top: DataFrame, tick: DataFrame) -> DataFrame:
    """(k, bin, term, freq, rank, n, tfidf) of the top terms over each tick's own vocabulary and bins; nothing leaves its slice's task."""
    cells = top.select("slice", "k", "term", "freq", "rank", F.explode("cells").alias("cell"))
    keys = ["slice", "k", "bin", "term", "freq", "rank"]
    each = cells.select("slice", "k", "term", "freq", "rank", F.shiftright("cell", 32).alias("bin"), F.col("cell").bitwiseAND(F.lit(_LOW)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("n"))
    known = each.withColumn("df", F.count("*").over(Window.partitionBy("slice", "k", "term"))).join(tick.select("k", "n_docs"), "k")
    w = F.col("n") * (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0)
    unit = known.withColumn("w", w).withColumn("tfidf", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("slice", "k", "bin"))))
    return unit.select(*keys, "n", "tfidf")


def vectors(tfidf: DataFrame, tick: DataFrame, agg: str) -> DataFrame:
    """(k, term, freq, rank, value): weights of the bins added up, or their mean over all bins from the first to the last."""
    total = tfidf.groupBy("slice", "k", "term", "freq", "rank").agg(F.sum("tfidf").alias("value")).drop("slice")
    return total if agg == "sum" else meant(total, tick, agg)


def meant(total: DataFrame, tick: DataFrame, agg: str) -> DataFrame:
    """Sums of weights over all bins from the first to the last."""
    if agg != "mean":
        raise ValueError(f"sum or mean, not {agg!r}")
    return total.join(tick.select("k", (F.col("high") - F.col("low") + 1).alias("bins")), "k").withColumn("value", F.col("value") / F.col("bins")).drop("bins")


def moved(vector: DataFrame, tick: DataFrame) -> DataFrame:
    """(term, seq, now, before, freq, d): each tick against the one before it, absent terms as 0; the first tick has none."""
    mine = vector.join(tick.select("k", F.col("seq").cast("bigint").alias("seq")), "k").select("term", "seq", "freq", "value")
    by_term = Window.partitionBy("term").orderBy("seq")
    near = mine.withColumns({"left": F.lag("seq").over(by_term), "was": F.lag("value").over(by_term), "next": F.lead("seq").over(by_term)})
    here = F.struct("seq", F.col("value").alias("now"), F.when(F.col("left") == F.col("seq") - 1, F.col("was")).otherwise(0.0).alias("before"), "freq")
    gone = F.struct((F.col("seq") + 1).alias("seq"), F.lit(0.0).alias("now"), F.col("value").alias("before"), F.lit(0).cast("bigint").alias("freq"))
    both = F.when(F.col("next") == F.col("seq") + 1, F.array(here)).otherwise(F.array(here, gone))
    rows = near.select("term", F.explode(both).alias("x")).select("term", "x.*").where("seq > 1")
    end = tick.agg(F.max("seq").alias("end"))  # one row
    return rows.join(F.broadcast(end), F.col("seq") <= F.col("end")).drop("end").withColumn("d", F.round(F.abs(F.col("now") - F.col("before")), PLACES))


def judged(change: DataFrame, detector: Detector) -> DataFrame:
    """Each change with its term's history, z score and whether the term is important."""
    by_term = Window.partitionBy("term").orderBy("seq")
    unit = F.round(F.col("d") * UNIT).cast("decimal(19,0)")
    summed = change.withColumn("u", unit).withColumns({"at": F.row_number().over(by_term), "s": F.sum("u").over(by_term.rowsBetween(Window.unboundedPreceding, 0)), "q": F.sum(F.col("u") * F.col("u")).over(by_term.rowsBetween(Window.unboundedPreceding, 0))})
    before = lambda c: (F.coalesce(F.lag(c, 1).over(by_term), F.lit(0)) - F.coalesce(F.lag(c, detector.baseline + 1).over(by_term), F.lit(0)))
    rows = summed.withColumns({"history": F.least(F.col("at") - 1, F.lit(detector.baseline)).cast("bigint"), "s": before("s").cast("decimal(19,0)"), "q": before("q").cast("decimal(30,0)")})
    some, n = F.col("history") > 0, F.col("history").cast("decimal(5,0)")
    mu = F.when(some, F.col("s").cast("double") / (F.col("history") * float(UNIT))).otherwise(0.0)
    sigma = F.when(some, F.sqrt((n * F.col("q") - F.col("s") * F.col("s")).cast("double")) / (F.col("history") * float(UNIT))).otherwise(0.0)
    rows = rows.select("term", "seq", "now", "before", "freq", "d", "history", mu.alias("mu"), sigma.alias("sigma"))
    return scored(rows, detector)


def scored(rows: DataFrame, detector: Detector) -> DataFrame:
    """z score and importance of changes that have their term's history, mu and sigma."""
    floor = F.greatest("sigma", F.lit(detector.sigma_floor))
    jump = F.round(F.col("d") - F.col("mu") - detector.k_sigma * floor, PLACES) > 0
    important = (F.col("history") >= detector.min_history) & (F.col("freq") >= detector.min_count_window) & jump
    return rows.withColumns({"z": F.round((F.col("d") - F.col("mu")) / floor, PLACES), "important": important})


def summed(judgement: DataFrame, tick: DataFrame, grid: Grid, top_n: int, d: Detector) -> DataFrame:
    """One row for each of ``tick`` (k, seq, n_msgs, n_terms): messages, terms with a weight, score, important terms and whether it is an event."""
    # a tick has at most 2 top_n changes, so its important ones fit a row
    told = judgement.groupBy("seq").agg(F.greatest(F.lit(0.0), F.max("z")).alias("max_z"), F.max(F.when(F.col("freq") >= d.min_count_window, F.col("z"))).alias("max_z_valid"), F.array_sort(F.collect_list(F.when(F.col("important"), F.struct((-F.col("z")).alias("z"), "term")))).alias("found"))
    terms = F.transform("found", lambda x: x["term"])
    listed = F.coalesce(F.slice(terms, 1, d.top_k) if d.top_k else terms, F.array().cast("array<string>"))
    rows = tick.withColumn("tfidf_terms", F.least("n_terms", F.lit(top_n))).join(told, "seq", "left").withColumn("important_terms", listed)
    score, count = F.coalesce("max_z_valid", "max_z", F.lit(0.0)), F.size("important_terms").cast("bigint")
    event = count >= d.require_min_terms
    if d.require_min_score is not None:
        event = event & (score >= d.require_min_score)
    return rows.select(grid.moment(F.col("k")).alias("tick"), "n_msgs", "tfidf_terms", score.alias("score"), count.alias("important_count"), "important_terms", ((F.col("seq") > 1) & event).alias("is_event"))


class Tops:
    """What a pass over packed counts (``panes``) gives for the ticks that ``asked`` lets through; the tables are written."""

    def __init__(self, packed: DataFrame, terms: DataFrame, grid: Grid, top_n: int, asked: Column | None = None):
        made = panes.tops(packed, grid, top_n)
        self.made = shared.durable(made if asked is None else made.where(asked), "window-top")
        told = self.made.where("id is null").withColumn("seq", F.row_number().over(Window.orderBy("k")))
        self.ticks = shared.durable(told.select("k", "seq", "n_msgs", "n_docs", "low", "high", "n_terms"), "window-ticks")  # a short row a tick
        self.terms = shared.durable(terms.join(self.made.select("id").distinct(), "id", "left_semi"), "top-terms")

    def _named(self, *columns: str | Column) -> DataFrame:
        return self.made.where("id is not null").select("id", *columns).join(self.terms, "id").drop("id")

    def top(self) -> DataFrame:
        """(k, term, freq, rank): each tick's top terms."""
        return self._named("k", "freq", "rank")

    def tfidf(self) -> DataFrame:
        """(k, bin, term, freq, rank, n, tfidf) of the top terms over each tick's own vocabulary and bins."""
        cells = self._named("k", "freq", "rank", F.explode(F.arrays_zip("bins", "ns", "weights")).alias("x"))
        return cells.select("k", F.col("x.bins").alias("bin"), "term", "freq", "rank", F.col("x.ns").alias("n"), F.col("x.weights").alias("tfidf"))

    def vectors(self, agg: str) -> DataFrame:
        """``vectors``: (k, term, freq, rank, value)."""
        total = self._named("k", "freq", "rank", "value")
        return total if agg == "sum" else meant(total, self.ticks, agg)


@dataclass
class Changes:
    """The steps from comments to events; what several later steps read is written."""

    comments: DataFrame
    w: Sliding
    detector: Detector = Detector()
    stop_words: list[str] | None = None
    texts: DataFrame | None = None  # (text_id, cleaned_comment), where comments name their text by text_id

    def __post_init__(self) -> None:
        self.grid = Grid(self.w)
        self.tops = Tops(*panes.packed(self.comments, self.grid, self.stop_words, self.texts), self.grid, self.w.top_n)
        self.ticks, self.top, self.tfidf = self.tops.ticks, self.tops.top, self.tops.tfidf

    def ranges(self) -> DataFrame:
        return ranges(counted(self.comments, self.grid, self.stop_words, self.texts), self.grid)

    def vectors(self, agg: str | None = None) -> DataFrame:
        return self.tops.vectors(agg or self.detector.agg)

    def views(self) -> DataFrame:
        """``bursts.views``: one row a tick with messages, with its top terms, their counts and weights."""
        told = F.array_sort(F.collect_list(F.struct("rank", "term", "freq", "value")))
        listed = self.vectors().groupBy("k").agg(F.transform(told, lambda x: F.struct(x["term"].alias("term"), x["freq"].alias("freq"), x["value"].alias("value"))).alias("terms"))
        none = F.array().cast("array<struct<term: string, freq: bigint, value: double>>")
        return self.ticks.join(listed, "k", "left").select(self.grid.moment(F.col("k")).alias("tick"), "n_msgs", F.coalesce("terms", none).alias("terms"))

    def changes(self) -> DataFrame:
        return moved(self.vectors(), self.ticks)

    def judged(self) -> DataFrame:
        return judged(self.changes(), self.detector)

    def timed(self, rows: DataFrame) -> DataFrame:
        """Rows of k or seq with the moment of their tick."""
        key = "k" if "k" in rows.columns else "seq"
        return rows.join(self.ticks.select(key, self.grid.moment(F.col("k")).alias("tick")), key)

    def found(self) -> DataFrame:
        """The important terms of each tick, largest z first, then by name, at most top_k."""
        rank = F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("z"), "term"))
        rows = self.judged().where("important").withColumn("rank", rank)
        return self.timed(rows.where(F.col("rank") <= self.detector.top_k) if self.detector.top_k else rows)

    def snapshots(self) -> DataFrame:
        """One row a tick with messages: messages, terms with a weight, score, important terms and whether it is an event."""
        return summed(self.judged(), self.ticks, self.grid, self.w.top_n, self.detector)


def detect(comments: DataFrame, w: Sliding, detector: Detector, stop_words: list[str] | None = None) -> DataFrame:
    """Snapshots of all ticks."""
    return Changes(comments, w, detector, stop_words).snapshots()


def stretches(stands: DataFrame) -> DataFrame:
    """(term, freq, first, last): ranges of a slice that follow each other at one frequency as one."""
    by_term = Window.partitionBy("slice", "term").orderBy("first")
    same = (F.lag("freq").over(by_term) == F.col("freq")) & (F.lag("last").over(by_term) == F.col("first") - 1)
    part = stands.withColumn("opens", F.when(same, 0).otherwise(1)).withColumn("part", F.sum("opens").over(by_term))
    return part.groupBy("slice", "term", "part").agg(F.first("freq").alias("freq"), F.min("first").alias("first"), F.max("last").alias("last")).select("term", "freq", "first", "last")


def digests(rows: DataFrame, key: str, named: list[str], values: list[str], n: str, digest: str) -> DataFrame:
    """One row a tick: how many ``rows`` it has and the SHA-256 of all, ``named:values`` in order, values in whole millionths."""
    cells = F.concat_ws(":", *[F.col(c).cast("string") for c in named], *[F.round(F.col(c) * 1_000_000).cast("bigint").cast("string") for c in values])
    return rows.groupBy(key).agg(F.count("*").alias(n), F.sha2(F.array_join(F.array_sort(F.collect_list(cells)), ","), 256).alias(digest))


class _Ticks:
    """The digests of a slice's ticks, fed with cells in order."""

    def __init__(self) -> None:
        self.n, self.hashes = {}, {}

    def feed(self, cells: pa.Array, n: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Sorted cells with their counts and ranges of ticks; equal cells of one tick are added up."""
        names = cells.dictionary_encode()
        group = names.indices.to_numpy(zero_copy_only=False)
        lines = self._lines(cells, n)
        for k in range(int(first.min()), int(last.max()) + 1):
            at = np.flatnonzero((first <= k) & (last >= k))
            if not len(at):
                continue
            opens = np.flatnonzero(np.diff(group[at], prepend=-1))
            if len(opens) == len(at):
                told = lines.take(pa.array(at))
            else:
                told = self._lines(cells.take(pa.array(at[opens])), np.add.reduceat(n[at], opens))
            data = memoryview(told.buffers()[2])[: int(np.frombuffer(told.buffers()[1], np.int32)[len(told)])]
            new = k not in self.n
            if new:
                self.n[k], self.hashes[k] = 0, hashlib.sha256()
            self.n[k] += len(opens)
            self.hashes[k].update(data[1:] if new else data)

    @staticmethod
    def _lines(cells: pa.Array, n: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise("", pc.binary_join_element_wise(cells, pc.cast(pa.array(n), pa.string()), ":"), ",")


def digested(rows: DataFrame, parts: int, n: str, digest: str) -> DataFrame:
    """(k, n, digest) as ``digests`` has them, of rows (slice, cell, n, first, last): a cell and its count stand in each tick from first to last.

    A slice's cells are sorted once and pass through its task in order, each into the digests of the ticks that hold
    it: no tick is put together as a whole and no cell is copied for each of its ticks.  All ticks of a row are its slice's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ticks, left = None, _Ticks(), None  # left: the last cell's rows, which the next batch may go on with

        def out() -> pa.RecordBatch:
            ks = sorted(ticks.n)
            return pa.RecordBatch.from_pydict({"k": pa.array(ks, pa.int64()), n: pa.array([ticks.n[k] for k in ks], pa.int64()), digest: pa.array([ticks.hashes[k].hexdigest() for k in ks], pa.string())})

        def feed(rows: pa.Table) -> None:
            if rows.num_rows:
                rows = rows.combine_chunks()
                ticks.feed(rows["cell"].chunk(0), *[rows[c].to_numpy() for c in ("n", "first", "last")])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            edges = [0, *(np.flatnonzero(np.diff(table["slice"].to_numpy())) + 1).tolist(), table.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = table.slice(a, b - a)
                if part["slice"][0].as_py() != name:
                    if left is not None:
                        feed(left)
                        yield out()
                    name, ticks, left = part["slice"][0].as_py(), _Ticks(), None
                part = part if left is None else pa.concat_tables([left, part])
                same = pc.equal(part["cell"], part["cell"][-1])
                whole = part.num_rows - pc.sum(same).as_py()
                feed(part.slice(0, whole))
                left = part.slice(whole)
        if left is not None:
            feed(left)
            yield out()

    ordered = rows.select("slice", "cell", "n", "first", "last").repartition(parts, "slice").sortWithinPartitions("slice", "cell")
    return ordered.mapInArrow(run, f"k bigint, {n} bigint, {digest} string")


def counts_digests(counts: DataFrame, grid: Grid, n: str = "n_cells", digest: str = "counts_sha256") -> DataFrame:
    """(tick, n, digest) of every window's counts by bin and term, from ``counted``."""
    cell = F.concat_ws(":", "term", F.date_format(grid.bin_moment(F.col("bin")), "yyyyMMddHHmm"))
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * (grid.w.last // grid.slice_ticks + 1))
    told = digested(spans(counts, grid).withColumn("cell", cell), parts, n, digest)
    return told.select(grid.moment(F.col("k")).alias("tick"), n, digest)


def odd_counts_digests(comments: DataFrame, w: Sliding, stop_words: list[str] | None = None, texts: DataFrame | None = None) -> DataFrame:
    """``counts_digests`` where grains do not divide a day: bins then start from the midnight of each window's first comment.

    Comments are counted by pane and by the stretch of time that lies in one bin from whichever midnight it may be
    numbered, at most those of a window's days.  A stretch has its bin's moment once a tick's midnight is known.
    """
    grid, us = Grid(replace(w, grain=1)), _us(F.col("local_ts"))
    origin = lambda back: F.floor(us / DAY) * DAY - back * DAY
    start = lambda at: at + F.floor((us - at) / w.grain_us) * w.grain_us
    rows, terms = panes.packed(comments, grid, stop_words, texts, F.greatest(*[start(origin(back)) for back in range(-(-w.window_us // DAY) + 1)]), ":")
    return panes.digests(rows, terms, grid, "n_cells", "counts_sha256", w.grain_us)


def all_counts_digests(comments: DataFrame, grid: Grid, stop_words: list[str] | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(tick, n_cells, counts_sha256) of every window's counts by bin and term."""
    rows, terms = panes.packed(comments, grid, stop_words, texts, after=":")
    return panes.digests(rows, terms, grid, "n_cells", "counts_sha256")
