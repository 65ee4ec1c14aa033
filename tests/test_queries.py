"""Every query with SQL is compared on the smallest tables; the slow rest is run by tools/check.py."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]
import __spark_entry__ as entry  # noqa: E402
from check import TABLES, table  # noqa: E402


@pytest.fixture(scope="module")
def db(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(entry.oracle_sql()[name])
    assert got == table([d[0] for d in cur.description], cur.fetchall())
    spark.catalog.clearCache()
