"""Full medallion refresh as one batch job (MED-5, SNK-2, SNK-3).

landing NDJSON -> bronze -> silver (+ quarantine, corrupt lines) -> gold, each
published as a new Parquet version behind a pointer, so readers never see a
half-written table and a failed run (a ``fail`` expectation firing, a lost
job) leaves the previous versions in place.  Silver is written once and gold
is computed from the written silver, so the landing zone is parsed once.

Layout at scale: silver is partitioned by ``timestamp_date`` and sorted by
``customer_id`` inside each file, so date filters prune directories and
customer lookups skip row groups by min/max statistics.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ANOMALY_SIGMA
from ..functions.expressions import masked_payload
from ..operators import expectations as ex
from ..operators import medallion
from ..schemas import BRONZE
from ..sources import landing, tables


def refresh(spark: SparkSession, landing_dir: str, root: str, *, schema: T.StructType = BRONZE,
            rules=ex.SILVER_RULES, sigma: float = ANOMALY_SIGMA) -> dict:
    """Rebuild every layer from the landing zone; returns published versions
    and the expectation counts observed while silver was written."""
    root = root.rstrip("/")
    raw = landing.read_landing(spark, landing_dir, schema)  # PERMISSIVE: malformed lines kept
    versions = {"bronze": tables.publish(raw, root, "bronze_telemetry_raw",
                                         comment="Landed telemetry events as parsed; malformed lines "
                                                 "keep their text in _corrupt_record.")}
    bronze, corrupt = landing.split_corrupt(tables.read_published(spark, root, "bronze_telemetry_raw"))
    versions["corrupt"] = tables.publish(corrupt, root, "bronze_corrupt_lines",
                                         comment="Landing lines that are not valid JSON.")

    watched, obs = ex.observe_violations(bronze, rules, name="silver_refresh")
    versions["silver"] = tables.publish(
        medallion.silver(watched, rules), root, "silver_telemetry_cleaned",
        partition_by=["timestamp_date"], sort_within=["timestamp_date", "customer_id"],
        comment="Validated, typed and PII-masked events.",
        properties={"quality": "silver", "expectations": ",".join(r.name for r in rules)})
    drop_rules = [r for r in rules if r.action == "drop"]
    if drop_rules:
        q = ex.quarantine(bronze, drop_rules)
        keep = [c for c in ("event_id", "customer_id", "timestamp", "event_type") if c in q.columns]
        versions["quarantine"] = tables.publish(
            q.select(*keep, masked_payload(F.col("context.pii"), F.col("payload"), True).alias("masked_payload"),
                     F.array_join("failed_rules", ",").alias("failed_rules")),
            root, "silver_quarantine",
            comment="Rows removed by drop expectations, with the rules they failed; payload masked.")

    silver = tables.read_published(spark, root, "silver_telemetry_cleaned")
    versions["baseline"] = tables.publish(medallion.baseline(silver, sigma), root, "population_baseline",
                                          comment="Population mean, deviation and anomaly threshold: one row.")
    threshold = tables.read_published(spark, root, "population_baseline").select("anomaly_threshold_ms").scalar()
    versions["gold"] = tables.publish(
        medallion.gold(silver, sigma, threshold), root, "gold_customer_analytics", sort_within=["customer_id"],
        comment="Per-customer totals, mean latency and anomalies against the population threshold.",
        properties={"quality": "gold", "sigma": str(sigma)})
    return {"versions": versions, "expectations": obs.get}
