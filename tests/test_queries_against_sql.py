"""Each query with SQL gives the same rows as DuckDB."""

from __future__ import annotations

import decimal

import duckdb
import pytest

from palisade.plans.oracle import ORACLES
from palisade.plans.python_queries import QUERIES as PYTHON
from palisade.plans.queries import QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    return (None if v != v else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got, want = (QUERIES | PYTHON)[name](spark, SF), duck.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    mine = sorted(repr([plain(r[c]) for c in cols]) for r in got.collect())
    assert mine == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted((set(QUERIES) | set(PYTHON)) - set(ORACLES)))
def test_runs(spark, name):
    assert (QUERIES | PYTHON)[name](spark, SF).collect()
