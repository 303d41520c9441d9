"""Sliding term counts and bursts on a stream.

Each comment goes to the ticks whose windows hold it, also to a last tick off
the grid; the counts of a tick leave in append mode once the watermark has passed
it.  ``foreachBatch`` writes them, keyed by batch, so a repeated batch replaces
itself.  The detector goes on from a bounded state: the last tick's vector and
the last ``baseline`` changes of each term, written with every batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import intervals
from ..functions import text as X
from ..operators import bursts

LATE = "10 minutes"
MESSAGE, SAID = "\x01", "\x02"  # stand among the terms: one for each comment, one for each that is not blank
COUNTS = "tick timestamp, bin timestamp, term string, n bigint"


def _closing(ticks: DataFrame, w: bursts.Sliding, late: str) -> DataFrame:
    """Watermarked by tick: a tick is over when a comment ``late`` after it has been seen, whose own last tick is a window later."""
    return ticks.withWatermark("tick", f"{(w.window_us + intervals.micros(late)) // 1000} milliseconds")


def sliding_counts(comments: DataFrame, w: bursts.Sliding, stop_words: list[str] | None = None, late: str = LATE) -> DataFrame:
    """(tick, term, n) of every window that the watermark has closed; ``comments`` is a stream with local_ts."""
    ticks = F.explode(bursts.ticks_of(F.col("local_ts"), w, bounded=False).cast("array<timestamp>")).alias("tick")
    rows = _closing(comments.select(ticks, X.terms(F.col("cleaned_comment"), stop_words).alias("terms")), w, late)
    return rows.select("tick", F.explode("terms").alias("term")).groupBy("tick", "term").agg(F.count("*").alias("n"))


def grain_counts(comments: DataFrame, w: bursts.Sliding, stop_words: list[str] | None = None, late: str = LATE) -> DataFrame:
    """(tick, bin, term, n) of every window that the watermark has closed, with MESSAGE and SAID among the terms.

    Bins start from midnight, so grains must divide a day here.
    """
    if bursts.DAY % w.grain_us:
        raise ValueError("on a stream the grain must divide a day")
    text = F.col("cleaned_comment")
    marked = F.concat(X.terms(text, stop_words), F.array(F.lit(MESSAGE)), F.when(X.is_blank(text), F.array().cast("array<string>")).otherwise(F.array(F.lit(SAID))))
    ticks = F.explode(bursts.ticks_of(F.col("local_ts"), w, bounded=False).cast("array<timestamp>")).alias("tick")
    rows = _closing(comments.select(ticks, bursts.bin_of(F.col("local_ts"), w).cast("timestamp").alias("bin"), marked.alias("terms")), w, late)
    return rows.select("tick", "bin", F.explode("terms").alias("term")).groupBy("tick", "bin", "term").agg(F.count("*").alias("n"))


def _parts(rows: DataFrame, w: bursts.Sliding) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts, bins and sizes of the ticks up to ``end`` from rows of ``grain_counts``."""
    rows = rows.select(F.col("tick").cast("timestamp_ntz").alias("tick"), F.col("bin").cast("timestamp_ntz").alias("bin"), "term", "n")
    rows = rows.where(F.unix_micros(F.col("tick").cast("timestamp")) <= w.end_us)
    sizes = rows.where(F.col("term") == MESSAGE).groupBy("tick").agg(F.sum("n").alias("n_msgs"))
    bins = rows.where(F.col("term") == SAID).select("tick", "bin").distinct()
    return rows.where(~F.col("term").isin(MESSAGE, SAID)), bins, sizes


def snapshots_of(rows: DataFrame, w: bursts.Sliding, detector: bursts.Detector) -> DataFrame:
    """Detector snapshots from a whole table of ``grain_counts``."""
    return bursts.detect_windows(*_parts(rows, w), w, detector)


@dataclass
class Detection:
    """A ``foreachBatch`` function: snapshots and events of the ticks that a batch closes, each to a folder of its own.

    State and results are written under the batch's number and a batch reads the
    state of the one before it, so a repeated batch gives the same again.  State
    is bounded by terms times ``baseline``, however long the stream has run.
    """

    path: str
    w: bursts.Sliding
    detector: bursts.Detector

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = self._state(spark, number - 1)
        rows = shared.durable(batch, "closed-windows")
        if rows.isEmpty():
            steps = None
        else:
            steps = bursts.Steps(*_parts(rows, self.w), self.w, self.detector, *state)
            snaps = shared.durable(steps.snapshots(), "snapshots")
            snaps.write.mode("overwrite").parquet(f"{self.path}/snapshots/batch={number}")
            bursts.events(snaps).write.mode("overwrite").parquet(f"{self.path}/events/batch={number}")
        self._keep(spark, number, state, steps)

    def _state(self, spark: SparkSession, number: int) -> tuple[int, DataFrame | None, DataFrame | None]:
        if number < 0:
            return 0, None, None
        rows = spark.read.schema("kind string, seq bigint, term string, value double").parquet(f"{self.path}/state/batch={number}")
        before = rows.where("kind = 'seq'").agg(F.max("seq")).first()[0] or 0
        return before, rows.where("kind = 'last'").select("seq", "term", "value"), rows.where("kind = 'past'").select("seq", "term", F.col("value").alias("d"))

    def _keep(self, spark: SparkSession, number: int, state: tuple, steps: bursts.Steps | None) -> None:
        before, last, past = state
        kinds = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("seq").cast("long").alias("seq"), "term", F.col(df.columns[-1]).alias("value"))
        if steps is not None:
            before = steps.seq.agg(F.max("seq")).first()[0] or before
            mine = steps.vector.join(steps.seq, "tick").select("seq", "term", "value")
            last = mine.where(F.col("seq") == before)
            deltas = steps.change.select("seq", "term", "d")
            every = deltas if past is None else deltas.unionByName(past)
            newest = F.row_number().over(bursts.Window.partitionBy("term").orderBy(F.desc("seq")))
            past = every.withColumn("rn", newest).where(F.col("rn") <= self.detector.baseline).select("seq", "term", "d")
        out = spark.range(1).select(F.lit("seq").alias("kind"), F.lit(before).cast("long").alias("seq"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("value"))
        for rows, kind in ((last, "last"), (past, "past")):
            if rows is not None:
                out = out.unionByName(kinds(rows, kind))
        out.write.mode("overwrite").parquet(f"{self.path}/state/batch={number}")


def to_table(path: str):
    """A ``foreachBatch`` function that writes each batch under its own number."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def started(stream: DataFrame, sink, checkpoint: str, pace: str | None = None):
    """Start a query into a ``foreachBatch`` sink; with ``pace`` one batch each such interval, otherwise all there is and then stop."""
    trigger = {"processingTime": pace} if pace else {"availableNow": True}
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def replay(comments: DataFrame, w: bursts.Sliding, folder: str, parts: int = 4) -> DataFrame:
    """A stream of the comments that any window holds, in order of time, ``parts`` batches and one that closes the last windows.

    The first window is full from the start: what lies less than a window before ``start`` comes with it.
    """
    spark = comments.sparkSession
    since = F.unix_micros(F.col("local_ts").cast("timestamp")) - w.start_us
    reach = comments.where((since > -w.window_us) & (since < w.end_us - w.start_us)).select("local_ts", "cleaned_comment")
    turn = F.least(F.floor((since + w.window_us) * parts / (w.end_us - w.start_us + w.window_us)), F.lit(parts - 1)).cast("int")
    # rows of a batch go into one folder; folders are read in the order in which they were written
    placed = shared.durable(reach.withColumn("turn", turn), "replay")
    for part in range(parts):
        placed.where(F.col("turn") == part).drop("turn").coalesce(1).write.mode("overwrite").parquet(f"{folder}/part={part:04}")
    closing = spark.range(1).select((F.timestamp_micros(F.lit(w.end_us)).cast("timestamp_ntz") + F.expr("INTERVAL 30 DAYS")).alias("local_ts"), F.lit("closing words").alias("cleaned_comment"))
    closing.coalesce(1).write.mode("overwrite").parquet(f"{folder}/part={parts:04}")
    return spark.readStream.schema(reach.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*")


def _once(comments: DataFrame, w: bursts.Sliding, count, sink) -> None:
    root = shared.new_path(comments.sparkSession, "stream")
    started(count(replay(comments, w, f"{root}/in")), sink, f"{root}/state").awaitTermination()


def sliding_counts_once(comments: DataFrame, w: bursts.Sliding, stop_words: list[str] | None = None) -> DataFrame:
    """(tick, term, n) of all windows between start and end, counted by a stream."""
    spark = comments.sparkSession
    path = shared.new_path(spark, "stream-counts")
    _once(comments, w, lambda s: sliding_counts(s, w, stop_words), to_table(path))
    rows = spark.read.schema("tick timestamp, term string, n bigint").option("recursiveFileLookup", True).parquet(path)
    return rows.where(F.unix_micros("tick") <= w.end_us).select(F.col("tick").cast("timestamp_ntz").alias("tick"), "term", "n")


def bursts_once(comments: DataFrame, w: bursts.Sliding, detector: bursts.Detector, stop_words: list[str] | None = None) -> DataFrame:
    """Snapshots of all ticks between start and end, made batch by batch as a stream closes them."""
    spark = comments.sparkSession
    path = shared.new_path(spark, "stream-bursts")
    _once(comments, w, lambda s: grain_counts(s, w, stop_words), Detection(path, w, detector))
    return spark.read.schema("tick timestamp_ntz, n_msgs bigint, tfidf_terms bigint, score double, important_count bigint, important_terms array<string>, is_event boolean").option("recursiveFileLookup", True).parquet(f"{path}/snapshots")
