"""Every registered query against its SQL, on the smallest tables."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from threadlens import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(x):
    return "NULL" if x is None else f"{x:.5f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(name, spark, sf, duck):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    sql = catalog.oracle_sql()[name]
    kinds = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert {f.name: KINDS.get(f.dataType.simpleString()) for f in df.schema} == kinds
    want = sorted(tuple(map(shown, r)) for r in duck.execute(f'SELECT {", ".join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})').fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(name, spark, sf):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_hooked_detector_sees_all_ticks(spark, sf):
    """From the first event to the window at the end, not only three days."""
    first, last = catalog.queries()["hooked_detector"](spark, sf).agg(F.min("tick"), F.max("tick")).first()
    since, until = spark.read.parquet(f"{sf}/events.parquet").agg(F.min("ts"), F.max("ts")).first()
    assert last - first > until - since - dt.timedelta(days=1)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].comment_count >= rows[-1].comment_count
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['threadlens.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'user_activity' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])
