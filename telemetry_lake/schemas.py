"""Pinned schemas of the medallion tables and of the request tables."""

from pyspark.sql import types as T

# Landing / bronze event (the wire format of the landing zone).
CONTEXT = T.StructType([
    T.StructField("latency", T.DoubleType(), True),
    T.StructField("pii", T.BooleanType(), True),
])
BRONZE = T.StructType([
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("context", CONTEXT, True),
    T.StructField("payload", T.StringType(), True),
])
# Bronze as produced by the test-data adapter: the event key rides along.
BRONZE_KEYED = T.StructType([T.StructField("event_id", T.LongType(), True)] + BRONZE.fields)

# Governed-function result, as declared by the table function.
SCORE_TABLE_DDL = ("customer_id STRING, total_events BIGINT, total_anomalies BIGINT, "
                   "mean_latency_ms DOUBLE, risk_factor DOUBLE")

# Proposed calls: one row per request.
CALLS = T.StructType([
    T.StructField("call_id", T.LongType(), True),
    T.StructField("function", T.StringType(), True),
    T.StructField("params_json", T.StringType(), True),
])

# Registry of granted functions: one row per declared parameter.
REGISTRY = T.StructType([
    T.StructField("function", T.StringType(), False),
    T.StructField("function_description", T.StringType(), True),
    T.StructField("position", T.IntegerType(), False),
    T.StructField("param", T.StringType(), False),
    T.StructField("pattern", T.StringType(), False),
    T.StructField("required", T.BooleanType(), False),
    T.StructField("param_description", T.StringType(), True),
])
