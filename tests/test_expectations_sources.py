"""Expectations (drop / fail / warn / report / quarantine) and the NDJSON
landing zone (write, read, corrupt lines, empty zone, schema growth)."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF0001, SF001, rows
from telemetry_lake import adapters
from telemetry_lake.operators import expectations as ex
from telemetry_lake.operators import medallion
from telemetry_lake.schemas import BRONZE, BRONZE_KEYED
from telemetry_lake.sources import landing, tables


@pytest.mark.parametrize("sf_dir,null_ids,bad_types,rejected", [
    (SF0001, 11, 387, 392), (SF001, 104, 3999, 4063)])
def test_report_and_quarantine_golden(spark, sf_dir, null_ids, bad_types, rejected):
    bronze = adapters.load_bronze(spark, sf_dir)
    rep = {r["rule"]: r for r in ex.expectation_report(bronze).collect()}
    assert rep["valid_customer_id"]["violations"] == null_ids
    assert rep["valid_event_type"]["violations"] == bad_types
    assert ex.quarantine(bronze).count() == rejected
    assert ex.apply_expectations(bronze).count() + rejected == bronze.count()
    quoted = ex.expect("it's \"quoted\"", "event_id >= 0")
    assert ex.expectation_report(bronze, [quoted]).first()["rule"] == quoted.name
    assert ex.expectation_report(bronze, []).count() == 0


def test_observed_violations_without_second_scan(spark):
    bronze = adapters.load_bronze(spark, SF001)
    watched, obs = ex.observe_violations(bronze)
    medallion.silver(watched).write.format("noop").mode("overwrite").save()
    got = obs.get
    assert got == {"rows": 10000, "valid_customer_id": 104, "valid_event_type": 3999}


def _fail_rules():
    return (ex.expect_or_drop("valid_customer_id", "customer_id IS NOT NULL"),
            ex.expect_or_fail("valid_event_type", "event_type IN ('click','purchase','search','error')"))


def test_expect_or_fail_aborts_the_write_and_publishes_nothing(spark, scratch):
    root = scratch("fail")
    bronze = adapters.load_bronze(spark, SF0001)
    with pytest.raises(Exception, match="valid_event_type"):
        tables.publish(medallion.silver(bronze, _fail_rules()), root, "silver")
    assert tables.current_version(spark, root, "silver") is None
    # A clean input publishes.
    clean = bronze.where(F.col("event_type").isin("click", "purchase", "search", "error"))
    tables.publish(medallion.silver(clean, _fail_rules()), root, "silver")
    assert tables.read_published(spark, root, "silver").count() == 608


def test_expect_or_fail_fires_under_count_and_extra_filters(spark):
    bronze = adapters.load_bronze(spark, SF0001)
    checked = ex.apply_expectations(bronze, _fail_rules())
    with pytest.raises(Exception, match="valid_event_type"):
        checked.count()
    with pytest.raises(Exception, match="valid_event_type"):
        checked.where("customer_id = 'CUST_004'").collect()


def test_limit_short_circuits_fail_rule(spark):
    """Why fail rules are enforced at the table write: a limit may stop the
    scan before the first violating row is evaluated."""
    data = [("CUST_001", "t", "click", (1.0, False), "p"), ("CUST_002", "t", "view", (1.0, False), "p")]
    one_part = spark.createDataFrame(data, BRONZE).coalesce(1)
    checked = ex.apply_expectations(one_part, _fail_rules())
    assert len(checked.limit(1).collect()) == 1
    with pytest.raises(Exception, match="valid_event_type"):
        checked.collect()


def test_warn_keeps_rows(spark):
    bronze = adapters.load_bronze(spark, SF0001)
    rules = [r.with_action("warn") for r in ex.SILVER_RULES]
    assert ex.apply_expectations(bronze, rules).count() == 1000
    assert {r["violations"] for r in ex.expectation_report(bronze, rules).collect()} == {11, 387}


def test_unknown_action_rejected():
    with pytest.raises(ValueError):
        ex.Expectation("x", "true", "explode")


def test_null_predicate_is_violation(spark):
    df = spark.createDataFrame([("a",), (None,)], "event_type string")
    rules = [ex.expect_or_drop("t", "event_type IN ('a')")]
    assert rows(ex.apply_expectations(df, rules)) == [("a",)]
    assert ex.quarantine(df, rules).first()["failed_rules"] == ["t"]


# --- landing zone ----------------------------------------------------------

def test_ndjson_round_trip(spark, scratch):
    path = scratch("land")
    bronze = adapters.load_bronze(spark, SF0001)
    landing.write_events(bronze, path, mode="error")
    back = landing.read_landing(spark, path, BRONZE_KEYED, mode="FAILFAST")
    assert rows(back) == rows(bronze)


def test_empty_or_missing_landing_zone(spark, scratch):
    missing = scratch("missing")
    with pytest.raises(FileNotFoundError):
        landing.read_landing(spark, missing)
    empty = scratch("empty")
    os.makedirs(empty)
    with pytest.raises(FileNotFoundError):
        landing.read_landing(spark, empty)


def _write_lines(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as fh:
        fh.write("\n".join(lines) + "\n")


GOOD = '{"customer_id":"CUST_001","timestamp":"2024-01-01T00:00:00+00:00","event_type":"click",' \
       '"context":{"latency":12.5,"pii":false},"payload":"x"}'


def test_blank_and_corrupt_lines(spark, scratch):
    path = scratch("corrupt")
    _write_lines(path, "a.json", [GOOD, "", "   ", '{"customer_id": "CUST_002", oops', GOOD])
    df = landing.read_landing(spark, path).cache()
    good, bad = landing.split_corrupt(df)
    assert good.count() == 2
    assert [r["raw_line"] for r in bad.collect()] == ['{"customer_id": "CUST_002", oops']
    with pytest.raises(Exception):
        landing.read_landing(spark, path, mode="FAILFAST").collect()


def test_dashboard_frame_defaults(spark, scratch):
    path = scratch("dash")
    _write_lines(path, "a.json", [GOOD, '{"customer_id":"CUST_002","timestamp":"2024-01-01T00:00:01+00:00",'
                                        '"event_type":"click","payload":"y"}'])
    frame = landing.dashboard_frame(landing.read_landing(spark, path))
    got = {r["customer_id"]: (r["latency"], r["is_pii"]) for r in frame.collect()}
    assert got == {"CUST_001": (12.5, False), "CUST_002": (0.0, False)}


def test_schema_merge_adds_nullable_fields():
    stored = BRONZE
    incoming = T.StructType(BRONZE.fields[:3] + [
        T.StructField("context", T.StructType(list(BRONZE["context"].dataType.fields) +
                                              [T.StructField("region", T.StringType())])),
        T.StructField("payload", T.StringType()), T.StructField("session_key", T.LongType())])
    merged = landing.merge_schema(stored, incoming)
    assert merged.fieldNames() == BRONZE.fieldNames() + ["session_key"]
    assert merged["context"].dataType.fieldNames() == ["latency", "pii", "region"]
    assert landing.added_columns(stored, merged) == ["context.region", "session_key"]
    assert all(f.nullable for f in merged.fields)


def test_evolving_read_old_rows_null(spark, scratch):
    path = scratch("evolve")
    _write_lines(path, "a.json", [GOOD])
    s1 = landing.infer_schema(spark, path)
    _write_lines(path, "b.json", [GOOD[:-1] + ',"session_key":7}'])
    s2 = landing.merge_schema(s1, landing.infer_schema(spark, path))
    assert "session_key" in s2.fieldNames()
    rows = landing.read_landing(spark, path, s2).collect()
    assert sorted((r["session_key"] is None) for r in rows) == [False, True]


def test_types_widen_and_the_change_is_told():
    a = T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.LongType()),
                      T.StructField("x", T.StructType([T.StructField("y", T.LongType())]))])
    b = T.StructType([T.StructField("n", T.DoubleType()), T.StructField("s", T.StringType()),
                      T.StructField("x", T.StructType([T.StructField("y", T.DoubleType())]))])
    merged = landing.merge_schema(a, b)
    assert [merged[c].dataType.simpleString() for c in "nsx"] == ["double", "string", "struct<y:double>"]
    assert landing.merge_schema(b, a) == merged
    assert landing.widened_columns(a, merged) == ["n: bigint -> double", "s: bigint -> string", "x.y: bigint -> double"]


def test_publish_keeps_comment_properties_and_the_last_version(spark, scratch):
    root = scratch("publish")
    assert tables.describe(spark, root, "t") is None
    first = tables.publish(spark.range(3), root, "t", comment="three", properties={"quality": "gold"})
    record = tables.describe(spark, root, "t")
    assert (record["version"], record["comment"], record["properties"]) == (first, "three", {"quality": "gold"})
    bad = spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        tables.publish(bad, root, "t")
    assert tables.current_version(spark, root, "t") == first and tables.read_published(spark, root, "t").count() == 3
    second = tables.publish(spark.range(5), root, "t")
    assert tables.current_version(spark, root, "t") == second != first
    with pytest.raises(FileNotFoundError):
        tables.read_published(spark, root, "other")


def test_batch_refresh_publishes_every_layer(spark, scratch):
    from telemetry_lake.plans.refresh import refresh
    root = scratch("refresh")
    zone = f"{root}/landing"
    landing.write_events(adapters.load_bronze(spark, SF0001), zone)
    _write_lines(zone, "broken.json", ['{"customer_id": "CUST_001", oops'])
    out = refresh(spark, zone, root, schema=BRONZE_KEYED)
    assert out["expectations"] == {"rows": 1000, "valid_customer_id": 11, "valid_event_type": 387}
    read = lambda name: tables.read_published(spark, root, name)
    assert read("bronze_telemetry_raw").count() == 1001
    assert [r["raw_line"] for r in read("bronze_corrupt_lines").collect()] == ['{"customer_id": "CUST_001", oops']
    silver = read("silver_telemetry_cleaned")
    assert silver.count() == 608 and "timestamp_date" in silver.columns
    quarantined = read("silver_quarantine")
    assert quarantined.count() == 392
    assert "payload" not in quarantined.columns and "context" not in quarantined.columns
    gold = read("gold_customer_analytics")
    assert gold.count() == 15 and gold.agg(F.sum("total_anomalies")).first()[0] == 32
    # A second refresh publishes new versions; readers switch only at the end.
    first = tables.current_version(spark, root, "gold_customer_analytics")
    refresh(spark, zone, root, schema=BRONZE_KEYED)
    assert tables.current_version(spark, root, "gold_customer_analytics") != first


def test_audit_append_partitioned_by_control(spark, scratch):
    from telemetry_lake.operators import governance
    path = scratch("audit")
    calls = adapters.calls_from_events(adapters.read_table(spark, SF0001, "events"))
    decided = governance.decide(calls, governance.registry_frame(spark))
    governance.write_audit(decided, path)
    governance.write_audit(decided, path)
    back = spark.read.parquet(path)
    assert back.count() == 2000
    assert {r["control"] for r in back.select("control").distinct().collect()} == \
        {"FUNCTION_GRANT", "SQL_INTERDICTION", "PARAMETER_SCHEMA"}
    folders = sorted(d for d in os.listdir(path) if not d.startswith((".", "_")))
    assert folders == ["control=FUNCTION_GRANT", "control=PARAMETER_SCHEMA", "control=SQL_INTERDICTION"]
