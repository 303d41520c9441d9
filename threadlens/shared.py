"""Tables in the folder that all executors share, for what several parts of a plan read.

The cluster names that folder in ``spark.checkpoint.dir``.  Only where it is
unset and Spark runs in one process (tests, a laptop) a temporary folder is used.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_tables: list[str] = []


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or f"{tempfile.gettempdir()}/threadlens").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; what is there goes when the driver ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: its rows are computed once, here, and a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, *order: str) -> DataFrame:
    """``df`` as a table in buckets of ``key``: what groups, ranks or windows by it afterwards sends nothing."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).sortWithinPartitions(key, *order).write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    _tables.append(table)
    return spark.table(table)


@atexit.register
def _end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    with contextlib.suppress(Exception):  # the session may be closing; the folder is the cluster's to clean then
        conf = spark._jsc.hadoopConfiguration()
        for table in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        for name in _written:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
