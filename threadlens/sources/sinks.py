"""Sinks: CSV, mapping documents, GraphML, and results that resume where a run stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


RECORDS = 10_000  # of a file: quoted line feeds keep a reader from splitting it, so a file is one task's


def write_csv(df: DataFrame, path: str, index: str | None = None) -> None:
    """CSV with a header; with ``index`` that column (a time, say) comes first, in its order. No file has more than RECORDS rows.

    Values are quoted, null is nothing; ``text.escaped`` keeps what ``files.read_csv`` would not get back.
    """
    if index is not None:
        df = df.select(index, *[c for c in df.columns if c != index]).repartitionByRange(index).sortWithinPartitions(index)
    df = df.select(*[X.escaped(F.col(f"`{name}`")).alias(name) if kind == "string" else F.col(f"`{name}`") for name, kind in df.dtypes])
    df.write.mode("overwrite").options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxRecordsPerFile=RECORDS).csv(path)


def _quoted(column: F.Column) -> F.Column:
    """A JSON string; characters outside ASCII stay as they are."""
    listed = F.to_json(F.array(column))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def mapping_lines(mapping: DataFrame) -> DataFrame:
    """(o, column, anon, value): the lines of one document {column: {anon: original}}, indented by four, in order of the other three.

    A line knows whether it is its column's last one from an aggregate, so no column has to fit anywhere as a whole.
    """
    known = mapping.where(F.col("anon").isNotNull())
    ends = known.groupBy("column").agg(F.max("anon").alias("_last"))
    final = ends.agg(F.max("column").alias("_final"))  # one row
    heads = ends.select(F.lit(1).alias("o"), "column", F.lit("").alias("anon"), F.concat(F.lit("    "), _quoted(F.col("column")), F.lit(": {")).alias("value"))
    comma = lambda last: F.when(last, "").otherwise(",")
    rows = known.join(F.broadcast(ends), "column")  # a row for each column of a table
    entries = rows.select(F.lit(1).alias("o"), "column", "anon", F.concat(F.lit("        "), _quoted(F.col("anon")), F.lit(": "), _quoted(F.col("original")), comma(F.col("anon") == F.col("_last"))).alias("value"))
    feet = ends.crossJoin(F.broadcast(final)).select(F.lit(1).alias("o"), "column", F.lit("\uffff").alias("anon"), F.concat(F.lit("    }"), comma(F.col("column") == F.col("_final"))).alias("value"))
    braces = mapping.sparkSession.createDataFrame([(0, "", "", "{"), (2, "", "", "}")], "o int, column string, anon string, value string")
    return braces.unionByName(heads).unionByName(entries).unionByName(feet)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """The mapping document as part files: put together in the order of their names they are the document."""
    order = ["o", "column", "anon"]
    mapping_lines(mapping).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def _xml(column) -> F.Column:
    out = column.cast("string")
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A directed GraphML document as ordered part files: header, nodes, edges, footer."""
    data = lambda key, value: F.when(value.isNull(), "").otherwise(F.concat(F.lit(f'<data key="{key}">'), _xml(value), F.lit("</data>")))
    head = '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "".join(
        f'<key id="{k}" for="{on}" attr.name="{name}" attr.type="{kind}"/>\n' for k, on, name, kind in (("d0", "node", "type", "string"), ("d1", "edge", "weight", "double"), ("d2", "edge", "sentiment_score", "long"))
    )
    spark = vertices.sparkSession
    node = vertices.select(F.lit(1).alias("o"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), data("d0", F.col("type")), F.lit("</node>")).alias("value"))
    edge = edges.select(F.lit(2).alias("o"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('">'), data("d1", F.col("weight")), data("d2", F.col("sentiment_score")), F.lit("</edge>")).alias("value"))
    ends = spark.createDataFrame([(0, head + '<graph edgedefault="directed">'), (3, "</graph>\n</graphml>")], "o int, value string")
    lines = ends.unionByName(node).unionByName(edge)
    # files sort by range: concatenated in name order they are the document
    lines.repartitionByRange("o", "value").sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


def pending(work: DataFrame, done: DataFrame | None, key: str, retry: str | None = None) -> DataFrame:
    """Rows of ``work`` that have no result yet; results equal to ``retry`` count as none."""
    if done is None:
        return work
    finished = done if retry is None else done.where(F.col("classification") != retry)
    return work.join(finished.select(key), key, "left_anti")


def append_results(spark: SparkSession, results: DataFrame, path: str) -> DataFrame:
    results.write.mode("append").parquet(path)
    return spark.read.schema(results.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_run(results: DataFrame, path: str, run: int) -> None:
    """Results of one run under its number; the same run again replaces itself, one that was killed counts as none."""
    results.write.mode("overwrite").parquet(f"{path}/run={run}")


def latest_results(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """One row for each ``key``, that of the latest run which has it, with its ``run``; only runs whose job was committed are read."""
    fs, where = _hadoop(spark, path)
    found = [str(f.getPath().getName()) for f in fs.listStatus(where)] if fs.exists(where) else []
    runs = [name for name in found if name.startswith("run=") and fs.exists(_hadoop(spark, f"{path}/{name}/_SUCCESS")[1])]
    rows = spark.createDataFrame([], f"{schema}, run int")
    for name in runs:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{path}/{name}").withColumn("run", F.lit(int(name[4:]))))
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "run").alias("r"))
    return newest.select(key, "r.*")
