"""Operators that SQL can express, on the smallest tables against DuckDB."""

import os

import duckdb
import pytest

from graphloom.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", [n for n in QUERIES if ORACLES.get(n)])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    got = QUERIES[name](spark, DIR)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda names, rows: sorted(str([round(v, 4) if isinstance(v := r[names.index(c)], float) else v for c in sorted(names)]) for r in rows)
    assert key(got.columns, [tuple(r) for r in got.collect()]) == key(columns, cursor.fetchall())
