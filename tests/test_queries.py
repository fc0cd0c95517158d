"""Every registered query against the same question asked in SQL on another engine."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry
from grovelark.plans.catalogue import QUERIES
from oracles import oracle_sql

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


def _plain(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else f"{value:.9g}"
    return str(value)


def _normal(rows):
    return sorted(tuple(_plain(v) for v in r) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    out = entry(spark)
    assert out.columns == ["repo", "affected_files", "affected_dirs"] and out.count() == 4


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = _normal([[r[c] for c in cols] for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = _normal([[r[i] for i in at] for r in cur.fetchall()])
    assert got == want
    assert got, "the query should have rows at this scale"
