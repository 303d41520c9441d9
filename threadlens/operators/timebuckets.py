"""Calendar buckets in local time, and series without gaps."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import intervals
from ..functions import text as X

ZONE = "America/Bogota"
UNITS = {"monthly": "MONTH", "daily": "DAY", "hourly": "HOUR"}


def localised(comments: DataFrame, column: str = "published_at", zone: str = ZONE) -> DataFrame:
    """``local_ts`` without zone from a UTC time or its text; rows whose time cannot be read go.

    Text may name a zone of its own; text that names none is UTC.
    """
    source = F.col(column)
    if dict(comments.dtypes)[column] == "string":
        named = source.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})\s*$")
        plain = F.convert_timezone(F.lit("UTC"), F.current_timezone(), source.try_cast("timestamp_ntz")).cast("timestamp")
        moment = F.when(named, F.try_to_timestamp(source)).otherwise(plain)
        source = F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), source.cast("timestamp_ntz"))
    return comments.withColumn("local_ts", local).where("local_ts is not null")


def between(comments: DataFrame, start: str, end: str, zone: str = ZONE) -> DataFrame:
    """local_ts in [start, end); ends that name a zone are converted, ValueError for what is no time or out of order."""
    start, end = intervals.span(start, end, zone)
    return comments.where((F.col("local_ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("local_ts") < F.lit(end).cast("timestamp_ntz")))


def _week(anchor: Column) -> Column:
    days = F.floor(F.datediff("local_ts", anchor) / 7) * 7
    return F.date_add(anchor, days.cast("int")).cast("timestamp_ntz")


def bucketed(comments: DataFrame, kind: str) -> DataFrame:
    """``bucket``: the start of the month, week, day or hour; weeks count from 1 January of the first year."""
    if kind == "weekly":
        anchor = comments.agg(F.make_date(F.min(F.year("local_ts")), F.lit(1), F.lit(1)).alias("_anchor"))
        return comments.crossJoin(F.broadcast(anchor)).withColumn("bucket", _week(F.col("_anchor"))).drop("_anchor")  # one row
    return comments.withColumn("bucket", F.date_trunc(UNITS[kind], "local_ts").cast("timestamp_ntz"))


STEPS = {"monthly": "INTERVAL 1 MONTH", "weekly": "INTERVAL 7 DAYS", "daily": "INTERVAL 1 DAY", "hourly": "INTERVAL 1 HOUR"}


def spine(buckets: DataFrame, kind: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Every bucket from the first to the last one (or over [start, end)), also those without rows."""
    if start is not None:
        ends = buckets.sparkSession.range(1).select(F.lit(start).cast("timestamp_ntz").alias("a"), (F.lit(end).cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND")).alias("b"))
    else:
        ends = buckets.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr(STEPS[kind]))).alias("bucket"))


def volume(comments: DataFrame, kind: str, start: str | None = None, end: str | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Comments and words of each bucket, zeros where there are none; with ``texts`` (text_id, cleaned_comment) comments name their text by text_id."""
    n_words = F.size(X.words(F.col("cleaned_comment"))).cast("long").alias("words")
    if texts is None:
        rows = bucketed(comments, kind).select("bucket", n_words)
    else:  # words are counted once a text; numbers are joined, not texts
        rows = bucketed(comments, kind).select("bucket", "text_id").join(texts.select("text_id", n_words), "text_id")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n_comments"), F.sum("words").alias("n_words"))
    return spine(counts, kind, start, end).join(counts, "bucket", "left").select("bucket", F.coalesce("n_comments", F.lit(0)).alias("n_comments"), F.coalesce("n_words", F.lit(0)).alias("n_words"))


def documents(comments: DataFrame, kind: str, piece: int = 10_000) -> DataFrame:
    """(bucket, part, document): the comments of each bucket joined by blanks in time order, '' where there are none.

    A document is cut into parts of ``piece`` comments, numbered from 0, so that no
    bucket has to fit into one row; joined by blanks in order they are the bucket's
    text.  Everything else here works on bags of terms; this is for exports.
    """
    rows = bucketed(comments, kind).select("bucket", "local_ts", "row_pos", "cleaned_comment")
    hours = rows.withColumn("cell", F.date_trunc("HOUR", "local_ts"))
    # places are numbered by the hour and shifted by the hours before, so a bucket is never ordered in one task
    within = F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("local_ts", "row_pos"))
    before = hours.groupBy("bucket", "cell").agg(F.count("*").alias("m")).withColumn("before", F.sum("m").over(Window.partitionBy("bucket").orderBy("cell")) - F.col("m")).drop("m")
    placed = hours.withColumn("rn", within).join(before, ["bucket", "cell"]).withColumn("part", F.floor((F.col("rn") - 1 + F.col("before")) / piece).cast("int"))
    joined = placed.groupBy("bucket", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("local_ts", "row_pos", "cleaned_comment"))), lambda x: x["cleaned_comment"]), " ").alias("document"))
    return spine(joined.select("bucket"), kind).join(joined, "bucket", "left").select("bucket", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("document", F.lit("")).alias("document"))


def digests(parts: DataFrame) -> DataFrame:
    """(bucket, document_sha256) of ``documents``: a bucket's parts pass through its task in order, none is put together as a whole."""
    import pyarrow as pa

    def run(batches):
        name, state = None, None
        out = lambda: pa.RecordBatch.from_pydict({"bucket": pa.array([name], pa.timestamp("us")), "document_sha256": pa.array([state.hexdigest()], pa.string())})
        for batch in batches:
            for bucket, document in zip(batch.column(0), batch.column(1)):
                if state is None or bucket.as_py() != name:
                    if state is not None:
                        yield out()
                    name, state = bucket.as_py(), hashlib.sha256()
                else:
                    state.update(b" ")
                state.update(document.as_py().encode())
        if state is not None:
            yield out()

    ordered = parts.repartition("bucket").sortWithinPartitions("bucket", "part").select("bucket", "document")
    return ordered.mapInArrow(run, "bucket timestamp_ntz, document_sha256 string")


def text_digests(comments: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """``digests`` of ``documents`` where comments name their text (text_id, cleaned_comment) by text_id.

    A text is packed once; packed texts are sent once a comment, to their bucket, and opened one at a time as they pass.
    """
    import pyarrow as pa

    def press(batches):
        for batch in batches:
            raw = [t.as_py().encode() for t in batch["cleaned_comment"]]
            yield pa.RecordBatch.from_pydict({"text_id": batch["text_id"], "size": pa.array([len(t) for t in raw], pa.int32()), "data": pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in raw], pa.binary())})

    def run(batches):
        name, state = None, None
        out = lambda: pa.RecordBatch.from_pydict({"bucket": pa.array([name], pa.timestamp("us")), "document_sha256": pa.array([state.hexdigest()], pa.string())})
        for batch in batches:
            for bucket, size, data in zip(*[batch[c] for c in ("bucket", "size", "data")]):
                if state is None or bucket.as_py() != name:
                    if state is not None:
                        yield out()
                    name, state = bucket.as_py(), hashlib.sha256()
                else:
                    state.update(b" ")
                state.update(pa.decompress(data.as_buffer(), size.as_py(), codec="zstd"))
        if state is not None:
            yield out()

    pressed = shared.durable(texts.where("cleaned_comment is not null").select("text_id", "cleaned_comment").mapInArrow(press, "text_id bigint, size int, data binary"), "packed-texts")
    rows = bucketed(comments, kind).select("bucket", "local_ts", "row_pos", "text_id").join(pressed, "text_id").drop("text_id")
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "local_ts", "row_pos").select("bucket", "size", "data")
    found = shared.durable(ordered.mapInArrow(run, "bucket timestamp_ntz, document_sha256 string"), "bucket-digests")  # a short row a bucket
    return spine(found, kind).join(found, "bucket", "left").select("bucket", F.coalesce("document_sha256", F.sha2(F.lit(""), 256)).alias("document_sha256"))
