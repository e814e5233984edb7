"""Registered queries against their SQL in DuckDB, row by row."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from inkgrid.plans import ORACLES, QUERIES
from tools.check import TABLES, norm

NAMES = list(ORACLES)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    order = sorted(df.columns)
    mine = sorted(tuple(norm(row[c]) for c in order) for row in df.collect())
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == order
    index = [names.index(c) for c in order]
    theirs = sorted(tuple(norm(row[i]) for i in index) for row in result.fetchall())
    assert mine == theirs


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
