"""Bronze -> silver -> gold, as plain DataFrame functions.

The same ``silver`` serves a batch DataFrame and a streaming one.  ``gold``
needs the population threshold first; it is planned as a scalar subquery
(one partial/final aggregate over one column, evaluated once and inlined),
so there is no driver round trip while the plan is defined and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ANOMALY_SIGMA
from ..functions.expressions import anomaly_threshold, masked_payload
from .expectations import SILVER_RULES, apply_expectations


def silver(bronze: DataFrame, rules=SILVER_RULES, *, mask_unknown: bool = False,
           keep=("event_id",), ingest_time: bool = False, safe_casts: bool = False) -> DataFrame:
    """Validated, typed, PII-masked events.

    Projects explicitly: raw ``payload`` and ``context`` never leave bronze
    (decision D3).  ``event_time`` is a cast of the ISO string (offset
    honoured, session time zone UTC) and ``timestamp_date`` its date (D5).
    ``keep`` passes through key columns that exist in bronze (the test
    adapter's ``event_id``).  ``safe_casts`` uses ``try_cast`` (uncastable
    values become NULL and can be caught by a rule) instead of ANSI casts
    that abort the job (D19).
    """
    cast = (lambda c, t: c.try_cast(t)) if safe_casts else (lambda c, t: c.cast(t))
    checked = apply_expectations(bronze, rules)
    event_time = cast(F.col("timestamp"), "timestamp")
    cols = [F.col(c) for c in keep if c in bronze.columns]
    cols += [
        F.col("customer_id"),
        event_time.alias("event_time"),
        F.to_date(event_time).alias("timestamp_date"),
        F.col("event_type"),
        cast(F.col("context.latency"), "double").alias("latency_ms"),
        cast(F.col("context.pii"), "boolean").alias("is_pii"),
        masked_payload(F.col("context.pii"), F.col("payload"), mask_unknown).alias("masked_payload"),
    ]
    if ingest_time:
        cols.append(F.current_timestamp().alias("ingest_time"))
    return checked.select(*cols)


def baseline(silver_df: DataFrame, sigma: float = ANOMALY_SIGMA) -> DataFrame:
    """One row: population mean, sample standard deviation and threshold."""
    stats = silver_df.agg(F.avg("latency_ms").alias("pop_mean"),
                          F.stddev("latency_ms").alias("pop_stddev"))
    return stats.withColumn("anomaly_threshold_ms",
                            anomaly_threshold(F.col("pop_mean"), F.col("pop_stddev"), sigma))


def threshold_value(silver_df: DataFrame, sigma: float = ANOMALY_SIGMA) -> Column:
    """The threshold as a scalar-subquery column (NULL for an empty input)."""
    return baseline(silver_df, sigma).select("anomaly_threshold_ms").scalar()


def is_anomaly(latency: Column, threshold: Column) -> Column:
    """Strict ``>`` against the threshold (D7); NULL latency is not anomalous."""
    return F.coalesce(latency > threshold, F.lit(False))


def gold(silver_df: DataFrame, sigma: float = ANOMALY_SIGMA, threshold: Column | None = None) -> DataFrame:
    """One row per customer: total_events, mean_latency_ms, total_anomalies.

    One scan of two columns, partial aggregation per task, one exchange on
    ``customer_id``.  A hot customer costs nothing extra: partial aggregates
    collapse it to one row per task before the shuffle.
    """
    t = threshold_value(silver_df, sigma) if threshold is None else threshold
    return silver_df.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.count_if(is_anomaly(F.col("latency_ms"), t)).alias("total_anomalies"),
    )


def event_flags(silver_df: DataFrame, sigma: float = ANOMALY_SIGMA) -> DataFrame:
    """Silver rows with the per-event ``is_anomaly`` flag (no shuffle)."""
    t = threshold_value(silver_df, sigma)
    return silver_df.withColumn("is_anomaly", is_anomaly(F.col("latency_ms"), t))
