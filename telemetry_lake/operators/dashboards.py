"""Dashboard queries over the flattened bronze frame (DSH-1..4).

They read bronze, not silver: the dashboard threshold is computed over all
landed rows with missing latency as 0 (decision D8), separately from the
governed fleet summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ANOMALY_SIGMA
from ..functions.expressions import anomaly_threshold, present2
from .ranking import global_rank


def kpis(frame: DataFrame, sigma: float = ANOMALY_SIGMA) -> DataFrame:
    """One row: events, mean latency, events above mean + sigma*sd, PII events."""
    t = frame.agg(anomaly_threshold(F.avg("latency"), F.stddev("latency"), sigma)).scalar()
    return frame.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.avg("latency").alias("mean_latency_ms"),
        F.count_if(F.col("latency") > t).alias("anomalies"),
        F.count_if(F.col("is_pii")).alias("pii_events"),
        F.max(t).alias("anomaly_threshold_ms"),
    )


def latency_series(frame: DataFrame) -> DataFrame:
    """(timestamp, latency) in time order with its position (``rank``): a distributed range-partitioned sort."""
    keys = [c for c in ("event_id",) if c in frame.columns]
    order = [F.asc("timestamp"), *[F.asc(c) for c in keys], F.asc("latency")]
    return global_rank(frame.select(*keys, "timestamp", "latency"), order)


def top_customers_by_latency(frame: DataFrame, k: int = 10) -> DataFrame:
    """Top-k customers by mean latency rounded to 2, ties by id (D16).

    Partial aggregation per task, one exchange on customer_id, then a
    TakeOrderedAndProject of k rows: the top-k is the feature here.
    """
    agg = (frame.where(F.col("customer_id").isNotNull())
                .groupBy("customer_id")
                .agg(F.count("latency").alias("events"),
                     present2(F.avg("latency")).alias("mean_latency_ms")))
    top = agg.orderBy(F.desc("mean_latency_ms"), F.asc("customer_id")).limit(k)
    w = Window.orderBy(F.desc("mean_latency_ms"), F.asc("customer_id"))
    return top.withColumn("rank", F.row_number().over(w))


def recent_feed(frame: DataFrame, k: int = 10) -> DataFrame:
    """The k most recent events (latest timestamp first, ties by event key)."""
    keys = [c for c in ("event_id",) if c in frame.columns]
    order = [F.desc("timestamp")] + [F.desc(c) for c in keys]
    top = (frame.select(*keys, "timestamp", "customer_id", "event_type", "latency", "is_pii")
                .orderBy(*order).limit(k))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # over k rows
