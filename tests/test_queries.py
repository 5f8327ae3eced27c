"""Registered queries against their SQL at the smallest size. FULL=1 runs all of them, else one per family."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

DATA = "/root/testdata/sf0.001"
SOME = ["q01_job_search", "q02_companies_hiring", "a12_daily_cells", "j16_near_names", "w15_refusal_windows", "m01_merge_snapshot", "s02_read_index", "p10_personio", "t36_breaking_lines", "r08_guard_stream", "v15_path_allowed", "k01_newest_first"]
NAMES = list(entry.queries()) if os.environ.get("FULL") else SOME


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
