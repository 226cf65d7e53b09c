"""Hot keys: one customer with a third of all events, and the prompts-to-gold
join planned as a sort-merge join (no broadcast) — same answers as the
brute-force / broadcast versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from conftest import SF001, rows
from telemetry_lake import adapters
from telemetry_lake.operators import analytics, governance, medallion, prompts


def test_hot_customer_gold_matches_brute_force(spark):
    events = adapters.read_table(spark, SF001, "events")
    # Every third event is re-assigned to user 7: CUST_007 holds a third of all rows.
    hot = events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")))
    silver = medallion.silver(adapters.bronze_from_events(hot)).cache()
    got = {r["customer_id"]: (r["total_events"], r["total_anomalies"], round(r["mean_latency_ms"], 9))
           for r in medallion.gold(silver).collect()}

    pdf = silver.select("customer_id", "latency_ms").toPandas()
    lat = pdf["latency_ms"].to_numpy(dtype=np.float64)
    threshold = lat.mean() + 3.0 * lat.std(ddof=1)
    pdf["anom"] = lat > threshold
    want = {cid: (len(g), int(g["anom"].sum()), round(float(g["latency_ms"].mean()), 9))
            for cid, g in pdf.groupby("customer_id")}
    assert got == want
    n_hot = got["CUST_007"][0]
    assert n_hot > sum(v[0] for v in got.values()) / 4


def test_routing_identical_under_sort_merge_join(spark):
    events = adapters.read_table(spark, SF001, "events")
    silver = medallion.silver(adapters.load_bronze(spark, SF001))
    gold = medallion.gold(silver)
    prompt_df = adapters.prompts_from_events(events)
    cols = ("prompt_id", "status", "control", "verdict", "total_events", "risk_factor", "answer")

    def run():
        out = prompts.route(prompt_df, gold, analytics.fleet_context(silver), governance.registry_frame(spark))
        return out

    broadcast_rows = rows(run(), *cols)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    saved = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        smj = run()
        buf = smj._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in buf
        assert rows(smj, *cols) == broadcast_rows
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
