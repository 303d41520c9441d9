"""Chart documents: long series cut down to what a drawing shows, and written as chart specifications.

A line over ``width`` pixel columns is drawn the same from four points a column,
the first, the last, the lowest and the highest, as from all points (Jugel and
others, "M4", 2014).  So a series of any length leaves at most 4 * width rows,
found by one grouping whose partial results are as small.

Rows without a moment or a value are not drawn, nor are values that are no finite
number; a null series is a series of its own.  Of points at one moment the lower
ones come first.  A table without points gives no rows and no document.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "https://vega.github.io/schema/vega-lite/v5.json"
#: what is drawn of a column, in this order where two are one point
ROLES = ("first", "low", "high", "last")


def reduced(points: DataFrame, at: str, value: str, series: str, width: int = 800) -> DataFrame:
    """(series, col, at, value) of the points that a line over ``width`` pixel columns needs.

    Columns are stretches of equal length, in microseconds, from the first point of all
    series on; ``col`` counts from 0.
    """
    if width < 1:
        raise ValueError("a chart needs at least one pixel column")
    moment = F.unix_micros(F.col(at).cast("timestamp"))
    real = ~F.isnan("value") & (F.abs("value") < float("inf"))  # null for null
    rows = points.select(F.col(series).alias("series"), moment.alias("at"), F.col(value).cast("double").alias("value")).where(F.col("at").isNotNull() & real)
    ends = rows.agg(F.min("at").alias("_a"), F.max("at").alias("_b"))
    step = F.expr(f"(_b - _a + {int(width)}) div {int(width)}")
    placed = rows.crossJoin(F.broadcast(ends.select("_a", step.alias("_step")))).withColumn("col", F.expr("(at - _a) div _step"))  # one row
    along, up = F.struct("at", "value"), F.struct("value", "at")
    four = placed.groupBy("series", "col").agg(F.min(along).alias("first"), F.min(up).alias("low"), F.max(F.struct("value", F.negative("at").alias("early"))).alias("high"), F.max(along).alias("last"))
    point = lambda c: F.struct(F.col(f"{c}.at").alias("at"), F.col(f"{c}.value").alias("value"))
    high = F.struct((-F.col("high.early")).alias("at"), F.col("high.value").alias("value"))
    each = F.array_distinct(F.array(*[high if c == "high" else point(c) for c in ROLES]))
    return four.select("series", F.col("col").cast("int").alias("col"), F.explode(each).alias("p")).select("series", "col", F.timestamp_micros("p.at").cast("timestamp_ntz").alias("at"), F.col("p.value").alias("value"))


def _quoted(text: Column) -> Column:
    """A JSON string."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def _document(mark: str | list, head: dict, values: Column) -> Column:
    """The specification as text: ``head`` with the collected ``values``, texts of JSON objects, as its data."""
    before, after = json.dumps({"$schema": SCHEMA, **head, **({"layer": mark} if isinstance(mark, list) else {"mark": mark}), "data": {"values": "?"}}, ensure_ascii=False).split('"?"')
    return F.concat(F.lit(before), F.lit("["), F.array_join(values, ","), F.lit("]"), F.lit(after))


def _time(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def _collected(x: Column, text: Column, *more: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(x.alias("x"), *more, text.alias("text")))), lambda v: v["text"])


def lines(points: DataFrame, title: str, x: str = "time", y: str = "value") -> DataFrame:
    """(series, document): a line chart of each series of ``reduced`` points, at most 4 * width of them."""
    text = F.concat(F.lit('{"x":"'), _time(F.col("at")), F.lit('","y":'), F.col("value").cast("string"), F.lit("}"))
    head = {"title": title, "encoding": {"x": {"field": "x", "type": "temporal", "title": x}, "y": {"field": "y", "type": "quantitative", "title": y}}}
    # points of one column at one moment are drawn upwards
    return points.groupBy("series").agg(_document("line", head, _collected(F.col("at"), text, F.col("value"))).alias("document"))


def bars_and_line(buckets: DataFrame, title: str, x: str, bars: str, line: str) -> DataFrame:
    """One row (document): ``bars`` of each bucket ``x`` with ``line`` over them on an axis of its own.

    Buckets are those of a calendar series, so their number is that of its span.
    """
    text = F.concat(F.lit('{"x":"'), _time(F.col(x)), F.lit('","bars":'), F.col(bars).cast("string"), F.lit(',"line":'), F.col(line).cast("string"), F.lit("}"))
    axis = lambda name, kind, field: {"mark": kind, "encoding": {"y": {"field": field, "type": "quantitative", "title": name}}}
    head = {"title": title, "encoding": {"x": {"field": "x", "type": "temporal", "title": x}}, "resolve": {"scale": {"y": "independent"}}}
    return buckets.where(F.col(x).isNotNull()).agg(_document([axis(bars, "bar", "bars"), axis(line, "line", "line")], head, _collected(F.col(x), text)).alias("document"), F.count("*").alias("_n")).where("_n > 0").drop("_n")


def histogram(rows: DataFrame, title: str, name: str) -> DataFrame:
    """One row (document): how many rows have each value of ``name``, the most frequent first; null is a bar of its own."""
    counts = rows.groupBy(F.col(name).cast("string").alias("name")).agg(F.count("*").alias("n"))
    text = F.concat(F.lit('{"x":'), F.coalesce(_quoted(F.col("name")), F.lit("null")), F.lit(',"y":'), F.col("n").cast("string"), F.lit("}"))
    head = {"title": title, "encoding": {"x": {"field": "x", "type": "nominal", "title": name, "sort": None}, "y": {"field": "y", "type": "quantitative", "title": "rows"}}}
    return counts.agg(_document("bar", head, _collected(-F.col("n"), text)).alias("document"), F.count("*").alias("_n")).where("_n > 0").drop("_n")
