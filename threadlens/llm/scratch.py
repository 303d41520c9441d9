"""Intermediate tables in the folder that all executors share.

The cluster names that folder in ``spark.checkpoint.dir``.  Only where it is
unset and Spark runs in one process (tests, a laptop) a folder of this module's
own is used; elsewhere that is an error.  A table written here cuts the lineage:
a lost executor costs the tasks it ran, not the stages before them.

Each table belongs to the ``Run`` that is open when it is written, or else to
the process, whose tables go when it ends.  Runs never touch each other's.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Run:
    """The tables of one run."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def sweep(self, spark: SparkSession, keep: int = 0) -> None:
        """Delete this run's tables but for the last ``keep``; only when what derives from them has been written."""
        until = len(self.paths) - keep
        for name in self.paths[:until]:
            _delete(spark, name)
        del self.paths[:until]


_process = Run()
_current: ContextVar[Run] = ContextVar("run", default=_process)


@contextlib.contextmanager
def run() -> Iterator[Run]:
    """Tables written inside belong to a run of their own."""
    own = Run()
    token = _current.set(own)
    try:
        yield own
    finally:
        _current.reset(token)


def adopt(run: Run) -> None:
    """Leave what a run still has to the run outside, or to the process."""
    _current.get().paths.extend(run.paths)
    run.paths = []


@atexit.register
def _end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may be closing; the folder is the cluster's to clean then
            _process.sweep(spark)


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or f"{tempfile.gettempdir()}/threadlens-scratch").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that the current run will delete."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _current.get().paths.append(path)
    return path


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is executed inside hands Python at most BATCH_BYTES at once (one row at least)."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table; the rows are computed once, here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete a table that ``durable`` has written; only when what derives from it has been written."""
    names = {file.rpartition("/")[0] for file in table.inputFiles()}
    held = _current.get()
    for path in [p for p in held.paths if any(name.endswith(p.rpartition("/")[2]) for name in names)]:
        _delete(table.sparkSession, path)
        held.paths.remove(path)
