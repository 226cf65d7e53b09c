"""Plan shapes that the scale design relies on, read from ``explain``.

Every registered query is planned on the sf0.001 tables (the streaming and
refresh keys run their jobs while being built, as they do for the driver).
"""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from conftest import SF0001
import __spark_entry__ as contract

QUERIES = contract.queries()


def _plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: _plan(fn(spark, SF0001)) for name, fn in QUERIES.items()}


def test_no_pair_generating_joins(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_no_row_at_a_time_python(plans):
    for name, text in plans.items():
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name
        assert "MapInPandas" not in text, name  # k-NN writes its blocks' candidates; its plan reads and merges them


def test_gold_is_one_exchange_with_partial_aggregation(plans):
    text = plans["gold_customer_analytics"]
    main = text.split("===== Subqueries =====")[0]
    tree = main.split("\n\n")[0]
    assert tree.count("Exchange") == 1
    assert re.search(r"HashAggregate[^\n]*\n\s*\+- Exchange[^\n]*\n\s*\+- HashAggregate", tree)
    assert "Functions [3]: [partial_count(1), partial_avg" in main


def test_top_k_keeps_k_rows_per_task(plans):
    for name in ("recent_feed", "top_customers_by_latency"):
        assert "TakeOrderedAndProject" in plans[name], name


def test_registry_broadcast_calls_not_shuffled(plans):
    text = plans["governance_decisions"]
    assert "BroadcastHashJoin" in text and "BroadcastExchange" in text
    assert "hashpartitioning(function" not in text.split("BroadcastExchange")[0]


def test_silver_rules_and_lookup_reach_the_scan(spark, scratch):
    from telemetry_lake import adapters
    from telemetry_lake.operators import analytics, medallion
    root = scratch("pushdown")
    adapters.load_bronze(spark, SF0001).write.parquet(f"{root}/bronze")
    silver = medallion.silver(spark.read.parquet(f"{root}/bronze"))
    text = _plan(silver)
    assert "PushedFilters: [IsNotNull(customer_id), In(event_type, [click,error,purchase,search])]" in text
    silver.write.parquet(f"{root}/silver")
    gold = medallion.gold(spark.read.parquet(f"{root}/silver"))
    lookup = _plan(analytics.score_lookup(spark, gold, "CUST_004"))
    assert "EqualTo(customer_id,CUST_004)" in lookup
    assert "ReadSchema: struct<customer_id:string,latency_ms:double>" in lookup
    assert "ReadSchema: struct<latency_ms:double>" in lookup
