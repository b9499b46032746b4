"""Every registered query runs; those with SQL equal DuckDB on the same files."""

import datetime as dt
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]
ROWS_ONLY = sorted(set(entry.queries()) - set(entry.oracle_sql()))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    if isinstance(value, dt.datetime):
        return value.isoformat(" ")
    return str(value) if isinstance(value, dt.date) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    res = duck.execute(entry.oracle_sql()[name])
    want = table([c[0] for c in res.description], res.fetchall())
    df = entry.queries()[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_runs(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows and all(v is None or v == v for r in rows for v in r)


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()


def test_no_oracle_without_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
