"""Governance boundary: table-driven controls, edge cases, properties."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF0001, SF001
from telemetry_lake import adapters
from telemetry_lake.constants import BOUNDARY_SQL_SYMBOLS, BOUNDARY_SQL_WORDS
from telemetry_lake.operators import governance

FN = "get_customer_anomaly_score"


def _decide(spark, calls):
    df = spark.createDataFrame([(i, f, p) for i, (f, p) in enumerate(calls)],
                               "call_id long, function string, params_json string")
    out = governance.decide(df, governance.registry_frame(spark))
    got = {r["call_id"]: r for r in out.collect()}
    return [got[i] for i in range(len(calls))]


CASES = [
    # (function, params_json, allowed, control, detail fragment)
    (FN, '{"target_id":"CUST_123"}', True, "FUNCTION_GRANT", "EXECUTE granted on main.telemetry."),
    (None, None, False, "FUNCTION_GRANT", "No EXECUTE grant for None"),
    ("", "{}", False, "FUNCTION_GRANT", "No EXECUTE grant for ''"),
    (FN, None, False, "PARAMETER_SCHEMA", "Required parameter 'target_id' was not supplied."),
    (FN, "{}", False, "PARAMETER_SCHEMA", "Required parameter 'target_id' was not supplied."),
    (FN, '{"target_id":5}', False, "PARAMETER_SCHEMA", "must be a string, received int"),
    (FN, '{"target_id":5.5}', False, "PARAMETER_SCHEMA", "must be a string, received float"),
    (FN, '{"target_id":true}', False, "PARAMETER_SCHEMA", "must be a string, received bool"),
    (FN, '{"target_id":null}', False, "PARAMETER_SCHEMA", "must be a string, received NoneType"),
    (FN, '{"target_id":["CUST_123"]}', False, "PARAMETER_SCHEMA", "must be a string, received list"),
    (FN, '{"target_id":"CUST_1234"}', False, "PARAMETER_SCHEMA", "does not satisfy the declared pattern"),
    (FN, '{"target_id":"cust_123"}', False, "PARAMETER_SCHEMA", "does not satisfy the declared pattern"),
    (FN, '{"target_id":"CUST_001\' OR \'1\'=\'1"}', False, "PARAMETER_SCHEMA",
     "value \"CUST_001' OR '1'='1\" does not satisfy"),
    (FN, '{"target_id":"x; y"}', False, "SQL_INTERDICTION", "Parameter 'target_id' contains SQL"),
    (FN, '{"target_id":"a /* b"}', False, "SQL_INTERDICTION", ""),
    (FN, '{"target_id":"UNION all"}', False, "SQL_INTERDICTION", ""),
    (FN, '{"target_id":"selection"}', False, "PARAMETER_SCHEMA", "does not satisfy"),
    # SQL check runs before the schema check and also sees undeclared keys.
    (FN, '{"target_id":"CUST_123","note":"drop it"}', False, "SQL_INTERDICTION", "Parameter 'note'"),
    (FN, '{"b":"x","a":"y","target_id":"CUST_123"}', False, "PARAMETER_SCHEMA",
     "Undeclared parameters rejected: ['a', 'b']."),
    # Not an object / duplicate keys.
    (FN, '[1,2]', False, "PARAMETER_SCHEMA", "JSON object"),
    (FN, '"CUST_123"', False, "PARAMETER_SCHEMA", "JSON object"),
    (FN, '{"target_id":"CUST_123","target_id":"CUST_124"}', False, "PARAMETER_SCHEMA", "JSON object"),
    (FN, 'not json', False, "PARAMETER_SCHEMA", "JSON object"),
    # Full match: a trailing newline does not pass; Unicode digits are digits (Python semantics).
    (FN, '{"target_id":"CUST_404\\n"}', False, "PARAMETER_SCHEMA", "does not satisfy"),
    (FN, '{"target_id":"CUST_٤٠٤"}', True, "FUNCTION_GRANT", "EXECUTE granted"),
]


def test_control_table(spark):
    got = _decide(spark, [(f, p) for f, p, *_ in CASES])
    for (f, p, allowed, control, frag), r in zip(CASES, got):
        assert (r["allowed"], r["control"]) == (allowed, control), (f, p, r["detail"])
        assert frag in r["detail"], (f, p, r["detail"])


def test_python_fullmatch_agrees_on_pattern_cases(spark):
    values = ["CUST_123", "CUST_12", "CUST_1234", "CUST_404\n", "\nCUST_404", "CUST_٤٠٤",
              "cust_123", "CUST_12a", " CUST_123"]
    import json
    got = _decide(spark, [(FN, json.dumps({"target_id": v})) for v in values])
    for v, r in zip(values, got):
        assert r["allowed"] == bool(re.fullmatch(r"CUST_\d{3}", v)), (v, r["detail"])


@pytest.mark.parametrize("sf_dir,expected", [
    (SF0001, {"allowed": 125, "FUNCTION_GRANT": 250, "SQL_INTERDICTION": 125, "PARAMETER_SCHEMA": 500}),
    (SF001, {"allowed": 1250, "FUNCTION_GRANT": 2500, "SQL_INTERDICTION": 1250, "PARAMETER_SCHEMA": 5000}),
])
def test_golden_call_counts(spark, sf_dir, expected):
    calls = adapters.calls_from_events(adapters.read_table(spark, sf_dir, "events"))
    d = governance.decide(calls, governance.registry_frame(spark))
    counts = {r["control"]: r["n"] for r in
              d.where(~F.col("allowed")).groupBy("control").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts["allowed"] = d.where("allowed").count()
    assert counts == expected


def test_registry_of_any_size(spark):
    rows = [(f"f{i}", None, 0, "p", "x+", True, None) for i in range(12_000)]
    calls = spark.createDataFrame([(i, f"f{i * 1000}", '{"p":"xx"}') for i in range(13)],
                                  "call_id long, function string, params_json string")
    got = {r["call_id"]: r["allowed"] for r in governance.decide(calls, governance.registry_frame(spark, rows)).collect()}
    assert got == {i: i < 12 for i in range(13)}


def test_grant_denial_lists_the_registered_functions(spark):
    reg = governance.registry_frame(spark, governance.DEFAULT_REGISTRY + [("b'c", None, 0, "p", ".*", True, None)])
    calls = spark.createDataFrame([(0, "no\\such\n", "{}")], "call_id long, function string, params_json string")
    detail = governance.decide(calls, reg).first()["detail"]
    names = str(sorted([governance.SCORE_FUNCTION, "b'c"]))
    assert detail.startswith("No EXECUTE grant for " + repr("no\\such\n")) and names in detail


def test_registry_with_two_functions_and_optional_param(spark):
    reg = governance.registry_frame(spark, governance.DEFAULT_REGISTRY + [
        ("lookup_region", None, 0, "region", "[A-Z]{2}", True, None),
        ("lookup_region", None, 1, "limit", r"\d+", False, None),
    ])
    df = spark.createDataFrame([(0, "lookup_region", '{"region":"EU"}'),
                                (1, "lookup_region", '{"region":"EU","limit":"10"}'),
                                (2, "lookup_region", '{"region":"EU","limit":"ten"}'),
                                (3, "lookup_region", '{"limit":"10"}')],
                               "call_id long, function string, params_json string")
    got = {r["call_id"]: r for r in governance.decide(df, reg).collect()}
    assert got[0]["allowed"] and got[1]["allowed"]
    assert not got[2]["allowed"] and "'limit'" in got[2]["detail"]
    assert not got[3]["allowed"] and "Required parameter 'region'" in got[3]["detail"]


_SQL = re.compile(r"(?i)\b(?:" + "|".join(BOUNDARY_SQL_WORDS) + r")\b|" +
                  "|".join(re.escape(s) for s in BOUNDARY_SQL_SYMBOLS))

_alphabet = st.sampled_from(list("CUST_0123456789 ;-/*'abcdelopruxDROPSELECT\n"))
_values = st.one_of(st.text(_alphabet, max_size=14),
                    st.from_regex(r"CUST_\d{3}", fullmatch=True).filter(str.isascii),
                    st.sampled_from(["select", "a--b", "x/*", "drop table", "executed"]))


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from(["target_id", "extra"]),
                                st.one_of(_values, st.integers(-5, 5)), max_size=2),
                min_size=1, max_size=12))
def test_property_allowed_means_clean(spark, batch):
    """allowed => exactly the declared key, a string fully matching the
    pattern, with no SQL token; and a SQL token in any string value =>
    never allowed."""
    import json
    got = _decide(spark, [(FN, json.dumps(p)) for p in batch])
    for params, r in zip(batch, got):
        strings = [v for v in params.values() if isinstance(v, str)]
        if r["allowed"]:
            assert set(params) == {"target_id"}
            v = params["target_id"]
            assert isinstance(v, str) and re.fullmatch(r"CUST_\d{3}", v)
            assert not _SQL.search(v)
        if any(_SQL.search(v) for v in strings):
            assert not r["allowed"] and r["control"] == "SQL_INTERDICTION", (params, r["detail"])
