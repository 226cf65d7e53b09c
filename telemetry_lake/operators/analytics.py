"""Governed analytics over gold: scores, lookups, fleet summary, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ANOMALY_SIGMA
from ..functions.expressions import present2, risk_factor
from .medallion import baseline, is_anomaly, threshold_value
from .ranking import global_rank


def scores(gold_df: DataFrame) -> DataFrame:
    """Every customer scored: the governed function at table scale (FUN-2)."""
    return gold_df.select(
        "customer_id", "total_events", "total_anomalies", "mean_latency_ms",
        risk_factor(F.col("total_anomalies"), F.col("total_events")).alias("risk_factor"),
    )


def score_lookup(spark: SparkSession, gold_df: DataFrame, target_id: str) -> DataFrame:
    """One customer's score with the id as a bound parameter, never text.

    A hostile value cannot change the statement; it simply matches no rows.
    The equality reaches the Parquet scan as a pushed filter.
    """
    return spark.sql(
        "SELECT customer_id, total_events, total_anomalies, mean_latency_ms, "
        "coalesce(round(100.0D * total_anomalies / nullif(total_events, 0), 2), 0.0D) AS risk_factor "
        "FROM {gold} WHERE customer_id = :target_id",
        args={"target_id": target_id}, gold=gold_df)


def fleet_summary(silver_df: DataFrame, sigma: float = ANOMALY_SIGMA) -> DataFrame:
    """One row: events, mean latency, anomalies, distinct customers, threshold.

    Means and threshold are rounded to 2 as presented; an empty silver gives
    zeros.  The distinct count is exact (two-level aggregate on customer_id).
    """
    t = threshold_value(silver_df, sigma)
    return silver_df.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.coalesce(present2(F.avg("latency_ms")), F.lit(0.0)).alias("mean_latency_ms"),
        F.count_if(is_anomaly(F.col("latency_ms"), t)).alias("total_anomalies"),
        F.count_distinct("customer_id").alias("distinct_customers"),
        F.coalesce(present2(F.max(t)), F.lit(0.0)).alias("anomaly_threshold_ms"),
    )


def fleet_context(silver_df: DataFrame, sigma: float = ANOMALY_SIGMA) -> DataFrame:
    """The two fleet numbers an answer is grounded in (presented mean and
    threshold), taken from the population baseline itself: one partial and
    final aggregate over the latency column, with none of the fleet
    summary's distinct count or anomaly recount.  Same values as
    ``fleet_summary``'s mean and threshold."""
    b = baseline(silver_df, sigma)
    return b.select(F.coalesce(present2(F.col("pop_mean")), F.lit(0.0)).alias("mean_latency_ms"),
                    F.coalesce(present2(F.col("anomaly_threshold_ms")), F.lit(0.0)).alias("anomaly_threshold_ms"))


def known_customers(gold_df: DataFrame) -> DataFrame:
    """Customers by activity, most events first, ties by id (D16), with rank."""
    return global_rank(gold_df.select("customer_id", "total_events", "total_anomalies"),
                       [F.desc("total_events"), F.asc("customer_id")])


