"""Queries at the smallest scale against DuckDB."""

import os

import duckdb
import pytest

from graphloom.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
SLOW = {"incremental_equals_clean"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(r[i], 4) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert bag(got.columns, [tuple(r) for r in got.collect()]) == bag(columns, cursor.fetchall())
