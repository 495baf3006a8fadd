"""Every registered query with a SQL twin matches DuckDB on the smallest scale factor."""

import os

import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("test data missing")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_oracle(spark, duck, key):
    got = entry.queries()[key](spark, SF).toPandas()
    want = duck.sql(SQL[key]).df()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_round_table_matches_sql_types(duck):
    from tessera.plans import load_all
    from tessera.plans.oracle_types import ROUND_COLS
    _, raw = load_all()
    for key, sql in raw.items():
        desc = duck.sql(f"DESCRIBE {sql}").fetchall()
        floats = [r[0] for r in desc if r[1] in ("DOUBLE", "FLOAT", "REAL") or r[1].startswith("DECIMAL")]
        assert floats == ROUND_COLS.get(key, []), key
