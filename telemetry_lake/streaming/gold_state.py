"""Gold kept up to date from the batches that are new, not from all of silver (STR-4, MED-4).

A new event moves the population threshold and can reclassify any earlier one, so gold is no plain streaming aggregate.  What
is kept makes it one nevertheless:

* the population's moments (count, mean, sum of squared deviations), merged with those of the new rows;
* ``gold_state``: per customer and band of latency the number of events, of latencies and their sum.  Bands grow
  geometrically; a band wholly above the threshold counts as it stands;
* ``latency_bands``: (customer, latency) in one folder per band, one part per refresh.  Only the band that holds the
  threshold is read, to count the latencies above it.

A refresh reads the silver batches committed since the last one, the state (one row per customer and band) and one band.  The
published state names the batches it has absorbed and the parts that belong to it, so a refresh that dies leaves the previous
state and nothing is counted twice.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ANOMALY_SIGMA
from ..sources import tables
from . import commits

STATE, BANDS = "gold_state", "latency_bands"
#: Bands per doubling of the latency, and the range of bands.
STEPS, LOWEST, HIGHEST = 4, -40, 200
NO_LATENCY = LOWEST - 2
ROWS = T.StructType([T.StructField("customer_id", T.StringType()), T.StructField("latency_ms", T.DoubleType())])


def band(latency: Column) -> Column:
    """The band of a latency: it never falls as the latency grows."""
    step = F.floor(F.log2(latency) * STEPS)
    return (F.when(latency.isNull(), NO_LATENCY).when(latency <= 0, LOWEST - 1)
            .otherwise(F.least(F.lit(HIGHEST), F.greatest(F.lit(LOWEST), step))).cast("int"))


def merged_moments(a: dict, b: dict) -> dict:
    """Count, mean and sum of squared deviations of two disjoint sets of values."""
    n = a["n"] + b["n"]
    if not a["n"] or not b["n"]:
        return a if a["n"] else b
    delta = b["mean"] - a["mean"]
    return {"n": n, "mean": a["mean"] + delta * b["n"] / n, "m2": a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / n}


def threshold(moments: dict, sigma: float) -> float | None:
    if not moments["n"]:
        return None
    deviation = math.sqrt(moments["m2"] / (moments["n"] - 1)) if moments["n"] > 1 else 0.0
    return moments["mean"] + sigma * deviation


def absorbed(record: dict | None) -> dict:
    """Per stream the number of the last batch that the state holds."""
    return record["properties"]["absorbed"] if record else {}


def new_batches(spark: SparkSession, log: str, seen: dict) -> list[str]:
    """Committed batches after those of ``seen``, by stream and number."""
    names = sorted(commits.committed(spark, log))
    return [n for n in names if int(n.rsplit("-", 1)[1]) > seen.get(n.rsplit("-", 1)[0], -1)]


def refresh_gold_incremental(spark: SparkSession, silver_dir: str, commits_dir: str, root: str, *, sigma: float = ANOMALY_SIGMA,
                             name: str = "gold_customer_analytics") -> dict:
    """Absorb the silver batches committed since the last refresh and publish the state and gold.

    Returns the published gold version, the batches read, and the threshold.
    """
    root = root.rstrip("/")
    record = tables.describe(spark, root, STATE)
    seen = absorbed(record)
    names = new_batches(spark, commits_dir, seen)
    moments = record["properties"]["moments"] if record else {"n": 0, "mean": 0.0, "m2": 0.0}
    parts = list(record["properties"]["parts"]) if record else []
    counts = [F.count(F.lit(1)).alias("events"), F.count("latency_ms").alias("latencies"), F.sum("latency_ms").alias("total")]
    rows = commits.read_batches(spark, silver_dir, names, ROWS).select("customer_id", "latency_ms")
    old = tables.read_published(spark, root, STATE) if record else None
    if names or old is None:
        seen = {**seen, **{n.rsplit("-", 1)[0]: int(n.rsplit("-", 1)[1]) for n in names}}
        part = uuid.uuid4().hex[:12]
        banded = rows.withColumn("band", band(F.col("latency_ms")))
        banded.where(F.col("band") != NO_LATENCY).hint("rebalance", "band").write.partitionBy("band").parquet(f"{root}/{BANDS}/{part}")
        parts.append(part)
        got = rows.agg(F.count("latency_ms").alias("n"), F.avg("latency_ms").alias("mean"),
                       (F.var_pop("latency_ms") * F.count("latency_ms")).alias("m2")).first()
        moments = merged_moments(moments, {"n": got["n"], "mean": got["mean"] or 0.0, "m2": got["m2"] or 0.0})
        state = banded.groupBy("customer_id", "band").agg(*counts)
        if old is not None:
            state = (old.unionByName(state).groupBy("customer_id", "band")
                     .agg(*[F.sum(c).alias(c) for c in ("events", "latencies", "total")]))
        tables.publish(state, root, STATE, sort_within=["customer_id"], comment="Events, latencies and their sum per customer and band.",
                       properties={"absorbed": seen, "moments": moments, "parts": parts})
    limit = threshold(moments, sigma)
    version = tables.publish(_gold(spark, root, parts, limit), root, name, sort_within=["customer_id"],
                             comment="Per-customer totals, mean latency and anomalies (population threshold).",
                             properties={"threshold": limit, "absorbed": seen})
    return {"gold_version": version, "batches": names, "threshold": limit}


def _gold(spark: SparkSession, root: str, parts: list[str], limit: float | None) -> DataFrame:
    """Gold from the stored state and the one band that holds the threshold."""
    state = tables.read_published(spark, root, STATE)
    if limit is None:
        edge, above = NO_LATENCY, spark.createDataFrame([], "customer_id string, near long")
    else:
        edge = spark.range(1).select(band(F.lit(float(limit)))).first()[0]
        paths = [p for p in (f"{root}/{BANDS}/{part}/band={edge}" for part in parts) if tables.path_exists(spark, p)]
        held = spark.read.schema(ROWS).parquet(*paths) if paths else spark.createDataFrame([], ROWS)
        above = held.where(F.col("latency_ms") > limit).groupBy("customer_id").agg(F.count(F.lit(1)).alias("near"))
    over = F.sum(F.when(F.col("band") > edge, F.col("latencies")).otherwise(0)) if limit is not None else F.lit(0).cast("long")
    totals = state.groupBy("customer_id").agg(F.sum("events").alias("total_events"),
                                              (F.sum("total") / F.nullif(F.sum("latencies"), F.lit(0))).alias("mean_latency_ms"),
                                              over.alias("over"))
    return totals.join(above, "customer_id", "left").select(
        "customer_id", "total_events", "mean_latency_ms",
        (F.col("over") + F.coalesce("near", F.lit(0))).alias("total_anomalies"))
