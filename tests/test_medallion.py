"""Silver / gold / scores / fleet summary: golden numbers and edge cases."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF0001, SF001, rows
from telemetry_lake import adapters
from telemetry_lake.functions import sql_functions
from telemetry_lake.operators import analytics, medallion
from telemetry_lake.schemas import BRONZE

GOLDEN = {
    # sf: (silver rows, gold rows, anomalies, customers risk>0, risk>=50, top customer, top risk)
    SF0001: (608, 15, 32, 1, 1, "CUST_004", 78.05),
    SF001: (5937, 150, 92, 11, 3, "CUST_054", 79.07),
}


@pytest.mark.parametrize("sf_dir", [SF0001, SF001])
def test_golden_medallion_numbers(spark, sf_dir):
    silver_rows, gold_rows, anomalies, risky, high, top_id, top_risk = GOLDEN[sf_dir]
    silver = medallion.silver(adapters.load_bronze(spark, sf_dir)).cache()
    gold = medallion.gold(silver)
    s = analytics.scores(gold).cache()
    assert silver.count() == silver_rows
    assert s.count() == gold_rows
    assert s.agg(F.sum("total_anomalies")).first()[0] == anomalies
    assert s.where("risk_factor > 0").count() == risky
    assert s.where("risk_factor >= 50").count() == high
    top = s.orderBy(F.desc("risk_factor"), "customer_id").first()
    assert (top["customer_id"], top["risk_factor"]) == (top_id, top_risk)
    fleet = analytics.fleet_summary(silver).first()
    assert fleet["total_events"] == silver_rows and fleet["total_anomalies"] == anomalies
    assert fleet["distinct_customers"] == gold_rows


def test_masking_and_typing(spark):
    silver = medallion.silver(adapters.load_bronze(spark, SF001)).cache()
    assert silver.where("is_pii").count() == 2973
    # Masked rows are exactly the 64-hex SHA-256 digests; clear rows keep the payload.
    bad = silver.where(F.col("is_pii") & ~F.col("masked_payload").rlike("^[0-9a-f]{64}$")).count()
    assert bad == 0
    assert silver.where(~F.col("is_pii") & ~F.col("masked_payload").startswith("{")).count() == 0
    assert "payload" not in silver.columns and "context" not in silver.columns
    assert dict(silver.dtypes)["event_time"] == "timestamp"
    assert dict(silver.dtypes)["timestamp_date"] == "date"


def _bronze(spark, data):
    return spark.createDataFrame(data, BRONZE)


def test_offset_timestamp_crossing_midnight(spark):
    b = _bronze(spark, [("CUST_001", "2024-01-01T23:30:00-05:00", "click", (10.0, False), "p")])
    r = medallion.silver(b).first()
    assert r["timestamp_date"] == dt.date(2024, 1, 2)
    assert r["event_time"] == dt.datetime(2024, 1, 2, 4, 30)


def test_null_pii_left_in_clear_unless_asked(spark):
    b = _bronze(spark, [("CUST_001", "2024-01-01T00:00:00+00:00", "click", (10.0, None), "secret")])
    assert medallion.silver(b).first()["masked_payload"] == "secret"
    masked = medallion.silver(b, mask_unknown=True).first()["masked_payload"]
    assert len(masked) == 64 and masked != "secret"


def test_missing_context_reads_as_null(spark):
    b = _bronze(spark, [("CUST_001", "2024-01-01T00:00:00+00:00", "click", None, "p")])
    r = medallion.silver(b).first()
    assert r["latency_ms"] is None and r["is_pii"] is None


def test_one_row_population(spark):
    b = _bronze(spark, [("CUST_001", "2024-01-01T00:00:00+00:00", "click", (10.0, False), "p")])
    s = medallion.silver(b)
    base = medallion.baseline(s).first()
    assert base["pop_stddev"] is None and base["anomaly_threshold_ms"] == 10.0
    g = medallion.gold(s).first()
    assert (g["total_events"], g["total_anomalies"]) == (1, 0)


def test_empty_silver_fleet_summary_is_zeros(spark):
    s = medallion.silver(_bronze(spark, []))
    r = analytics.fleet_summary(s).first()
    assert tuple(r) == (0, 0.0, 0, 0, 0.0)
    assert medallion.gold(s).count() == 0


def test_strict_greater_than_threshold(spark):
    # Four events: mean 25, sample sd ~ 12.9; sigma 1 -> threshold ~ 37.9.
    data = [("CUST_001", "2024-01-01T00:00:00+00:00", "click", (float(v), False), "p")
            for v in (10, 20, 30, 40)]
    s = medallion.silver(_bronze(spark, data))
    g = medallion.gold(s, sigma=1.0).first()
    assert g["total_anomalies"] == 1
    t = medallion.baseline(s, sigma=0.0).first()["anomaly_threshold_ms"]
    assert t == 25.0
    assert medallion.gold(s, sigma=0.0).first()["total_anomalies"] == 2  # 30 and 40; 25 itself is not >


def test_uncastable_latency_ansi_raises_and_try_cast_routes(spark):
    schema = "customer_id string, timestamp string, event_type string, " \
             "context struct<latency:string,pii:boolean>, payload string"
    b = spark.createDataFrame([("CUST_001", "2024-01-01T00:00:00+00:00", "click", ("fast", False), "p")],
                              schema)
    with pytest.raises(Exception):
        medallion.silver(b).collect()
    assert medallion.silver(b, safe_casts=True).first()["latency_ms"] is None


def test_score_function_ddl_and_lateral(spark):
    gold = medallion.gold(medallion.silver(adapters.load_bronze(spark, SF0001)))
    gold.createOrReplaceTempView("gold_t")
    name = sql_functions.register_score_function(spark, "gold_t", name="score_t")
    one = sql_functions.call_score_function(spark, "CUST_004", name=name).collect()
    assert len(one) == 1 and one[0]["risk_factor"] == 78.05
    assert sql_functions.call_score_function(spark, "CUST_004' OR '1'='1", name=name).count() == 0
    spark.createDataFrame([(1, "CUST_004"), (2, "CUST_999"), (3, "CUST_004")],
                          "call_id long, target_id string").createOrReplaceTempView("req_t")
    lat = sql_functions.lateral_scores(spark, "req_t", name=name)
    assert rows(lat, "call_id", "customer_id") == [(1, "CUST_004"), (3, "CUST_004")]
    ddl = dict(spark.sql("SELECT * FROM score_t('CUST_004')").dtypes)
    assert ddl == {"customer_id": "string", "total_events": "bigint", "total_anomalies": "bigint",
                   "mean_latency_ms": "double", "risk_factor": "double"}


def test_known_customers_rank_is_total_order(spark):
    gold = medallion.gold(medallion.silver(adapters.load_bronze(spark, SF001)))
    k = analytics.known_customers(gold).orderBy("rank").collect()
    assert [r["rank"] for r in k] == list(range(1, 151))
    keys = [(-r["total_events"], r["customer_id"]) for r in k]
    assert keys == sorted(keys)


def test_event_flags_agree_with_gold(spark):
    silver = medallion.silver(adapters.load_bronze(spark, SF001))
    flagged = medallion.event_flags(silver).where("is_anomaly").count()
    assert flagged == 92


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(max_size=30), st.sampled_from([True, False, None])), min_size=1, max_size=20))
def test_property_masking(spark, events):
    """pii true -> SHA-256 hex of the payload; false or NULL -> payload unchanged."""
    import hashlib
    data = [("CUST_001", "2024-01-01T00:00:00+00:00", "click", (1.0, pii), payload) for payload, pii in events]
    got = [r["masked_payload"] for r in medallion.silver(_bronze(spark, data)).collect()]
    want = [hashlib.sha256(p.encode()).hexdigest() if pii else p for p, pii in events]
    assert sorted(got) == sorted(want)
