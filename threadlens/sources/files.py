"""Scans of landed files. Schemas are declared and a row that does not fit fails the read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions import text as X


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header; quoted fields may hold line feeds and doubled quotes. Nothing is null; ``text.escaped`` tells what '' is."""
    rows = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', mode="FAILFAST").csv(path)
    return rows.select(*[X.unescaped(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in schema])


def read_json(spark: SparkSession, path: str, schema: StructType, lines: bool = False) -> DataFrame:
    """JSON documents, one a file, or one a line with ``lines``."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(column, anon, original) of a mapping document {column: {anon: original}} in one file."""
    text = spark.read.text(path, wholetext=True)
    outer = text.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("column", "m"))
    return outer.select("column", F.explode("m").alias("anon", "original"))


def joined_parts(spark: SparkSession, path: str, target: str) -> str:
    """The part files of ``path`` in the order of their names as one file ``target``, copied by the file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    names = sorted(x.getPath().getName() for x in fs.listStatus(source) if x.getPath().getName().startswith("part-"))
    out = fs.create(jvm.org.apache.hadoop.fs.Path(target), True)
    try:
        for name in names:
            part = fs.open(jvm.org.apache.hadoop.fs.Path(source, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()
    return target


def secret(name: str) -> str:
    """A credential from the environment; never put into a plan."""
    value = os.environ.get(name)
    if not value:
        raise KeyError(f"set {name} in the environment")
    return value
