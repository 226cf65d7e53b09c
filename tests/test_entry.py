"""Driver contract: entry() runs, every registered query matches its DuckDB
oracle on the sf0.001 tables (same columns, rows and values)."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

from conftest import ROOT, SF0001

sys.path.insert(0, os.path.join(ROOT, "scripts"))

import __spark_entry__ as contract  # noqa: E402
from check_oracle import TABLES, _digest  # noqa: E402

QUERIES = contract.queries()
ORACLE = contract.oracle_sql()


def test_entry_smoke(spark):
    df = contract.entry(spark)
    assert df.columns == ["customer_id", "total_events", "total_anomalies", "mean_latency_ms", "risk_factor"]
    assert df.count() == 15


def test_every_oracle_key_is_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 27


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF0001)
    srows = [tuple(r) for r in sdf.collect()]
    if name not in ORACLE:
        assert srows, f"{name} returned no rows"
        return
    rel = duck.sql(ORACLE[name])
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    assert _digest(srows, sdf.columns)[0] == _digest(drows, rel.columns)[0]
