"""The governed SQL table function (FUN-1).

``get_customer_anomaly_score(target_id STRING) RETURNS TABLE(...)`` is a SQL
function over a gold table or view.  Callers bind the argument; a hostile
value is an inert string.  A temporary function may read a temporary view; a
persistent one must read a saved table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..constants import SCORE_FUNCTION
from ..schemas import SCORE_TABLE_DDL

_BODY = (
    "SELECT customer_id, total_events, total_anomalies, mean_latency_ms, "
    "coalesce(round(100.0D * total_anomalies / nullif(total_events, 0), 2), 0.0D) AS risk_factor "
    "FROM {source} WHERE customer_id = target_id"
)


def register_score_function(spark: SparkSession, gold_source: str, *, name: str = SCORE_FUNCTION,
                            temporary: bool = True) -> str:
    """Create (or replace) the table function reading ``gold_source``."""
    kind = "TEMPORARY FUNCTION" if temporary else "FUNCTION"
    spark.sql(
        f"CREATE OR REPLACE {kind} {name}(target_id STRING) "
        f"RETURNS TABLE({SCORE_TABLE_DDL}) "
        "LANGUAGE SQL READS SQL DATA "
        "COMMENT 'Anomaly counts and risk factor of one customer over the gold layer.' "
        f"RETURN {_BODY.format(source=gold_source)}")
    return name


def call_score_function(spark: SparkSession, target_id: str, *, name: str = SCORE_FUNCTION) -> DataFrame:
    """Invoke the function with a bound argument."""
    return spark.sql(f"SELECT * FROM {name}(:target_id)", args={"target_id": target_id})


def lateral_scores(spark: SparkSession, requests_view: str, id_col: str = "target_id", *,
                   name: str = SCORE_FUNCTION) -> DataFrame:
    """Every request joined with the function's rows (Catalyst decorrelates to a join)."""
    return spark.sql(
        f"SELECT r.*, s.total_events, s.total_anomalies, s.mean_latency_ms, s.risk_factor, "
        f"s.customer_id FROM {requests_view} r, LATERAL {name}(r.{id_col}) s")
