"""Streaming ingestion (chunked = batch, exactly-once reruns, fail rules in a
stream), knowledge index sync / embedding / k-NN, ranking, dashboards."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF0001, SF001, rows
from telemetry_lake import adapters
from telemetry_lake.operators import dashboards, expectations as ex, knowledge, medallion
from telemetry_lake.operators.ranking import global_rank
from telemetry_lake.schemas import BRONZE_KEYED
from telemetry_lake.sources import landing, tables
from telemetry_lake.streaming import ingest


def _land(spark, zone, edges):
    events = adapters.read_table(spark, SF0001, "events")
    day = F.dayofmonth("ts")
    bounds = [0, *edges, 32]
    for lo, hi in zip(bounds, bounds[1:]):
        landing.write_events(adapters.bronze_from_events(events.where((day > lo) & (day <= hi))), zone)


@pytest.mark.parametrize("edges", [(), (8, 16, 24)])
def test_stream_in_chunks_equals_batch(spark, scratch, edges):
    root = scratch("stream")
    _land(spark, f"{root}/landing", edges)
    out = ingest.run_available_now(spark, f"{root}/landing", root, schema=BRONZE_KEYED)
    assert out["bronze_rows"] == 1000
    assert out["expectations"] == {"rows": 1000, "valid_customer_id": 11, "valid_event_type": 387}
    batch_silver = medallion.silver(adapters.load_bronze(spark, SF0001))
    streamed = spark.read.parquet(f"{root}/silver").drop("ingest_time")
    assert rows(streamed, *batch_silver.columns) == rows(batch_silver)
    gold = tables.read_published(spark, root, "gold_customer_analytics")
    want = medallion.gold(batch_silver)
    assert rows(gold, "customer_id", "total_events", "total_anomalies") == \
        rows(want, "customer_id", "total_events", "total_anomalies")


def test_rerun_adds_nothing_then_new_files_only(spark, scratch):
    root = scratch("rerun")
    zone = f"{root}/landing"
    events = adapters.read_table(spark, SF0001, "events")
    landing.write_events(adapters.bronze_from_events(events.where("event_id % 2 = 0")), zone)
    first = ingest.run_available_now(spark, zone, root, schema=BRONZE_KEYED)
    again = ingest.run_available_now(spark, zone, root, schema=BRONZE_KEYED)
    assert again["bronze_rows"] == 0
    landing.write_events(adapters.bronze_from_events(events.where("event_id % 2 = 1")), zone)
    third = ingest.run_available_now(spark, zone, root, schema=BRONZE_KEYED)
    assert first["bronze_rows"] + third["bronze_rows"] == 1000
    assert spark.read.parquet(f"{root}/silver").count() == 608


def test_fail_rule_stops_the_stream_and_commits_nothing(spark, scratch):
    root = scratch("sfail")
    zone = f"{root}/landing"
    landing.write_events(adapters.load_bronze(spark, SF0001), zone)
    ingest.landing_to_bronze(spark, zone, f"{root}/bronze", f"{root}/_ck/bronze", schema=BRONZE_KEYED)
    rules = (ex.expect_or_drop("valid_customer_id", "customer_id IS NOT NULL"),
             ex.expect_or_fail("valid_event_type", "event_type IN ('click','purchase','search','error')"))
    with pytest.raises(Exception, match="valid_event_type"):
        ingest.bronze_to_silver(spark, f"{root}/bronze", f"{root}/silver", f"{root}/_ck/silver",
                                schema=BRONZE_KEYED, rules=rules)
    try:
        n = spark.read.parquet(f"{root}/silver").count()
    except Exception:  # noqa: BLE001 - no committed file at all
        n = 0
    assert n == 0


def _put(zone, name, lines, age_days=0):
    import os
    import time
    os.makedirs(zone, exist_ok=True)
    path = os.path.join(zone, name)
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    if age_days:
        old = time.time() - age_days * 86400
        os.utime(path, (old, old))


def _line(i, **extra):
    import json
    return json.dumps({"event_id": i, "customer_id": f"CUST_{i % 9:03d}" if i % 10 else None,
                       "timestamp": "2024-01-01T00:00:00+00:00", "event_type": "click" if i % 7 else "odd",
                       "context": {"latency": 1.5, "pii": i % 2 == 0}, "payload": f"p{i}", **extra})


def test_counts_are_exact_beyond_the_progress_buffer(spark, scratch):
    """130 micro-batches with blank, malformed and late lines: kept + rejected + corrupt = lines landed."""
    root = scratch("many")
    zone = f"{root}/landing"
    for i in range(130):
        _put(zone, f"f{i:03d}.json", [_line(2 * i), "", _line(2 * i + 1)] + (['{"event_id": 5, "cust'] if i % 13 == 0 else []),
             age_days=40 if i % 5 == 0 else 0)
    b = ingest.landing_to_bronze(spark, zone, f"{root}/bronze", f"{root}/_ck/b", schema=BRONZE_KEYED, max_files_per_trigger=1)
    assert (b["rows"], b["corrupt"]) == (270, 10)
    s = ingest.bronze_to_silver(spark, f"{root}/bronze", f"{root}/silver", f"{root}/_ck/s", schema=BRONZE_KEYED,
                                max_files_per_trigger=1)
    ids = [i for i in range(260)]
    assert (s["rows"], s["corrupt"]) == (260, 10)
    assert s["violations"] == {"valid_customer_id": sum(i % 10 == 0 for i in ids), "valid_event_type": sum(i % 7 == 0 for i in ids)}
    silver = spark.read.parquet(f"{root}/silver")
    rejected = spark.read.parquet(f"{root}/silver_rejected")
    assert silver.count() + rejected.count() == 270
    assert {r["raw_line"] for r in rejected.where("kind = 'corrupt'").collect()} == {'{"event_id": 5, "cust'}
    odd = rejected.where("kind = 'quarantine' AND event_id % 2 = 0").first()
    assert len(odd["masked_payload"]) == 64
    assert silver.where("ingest_time IS NULL").count() == 0


def test_late_file_is_ingested(spark, scratch):
    root = scratch("late")
    zone = f"{root}/landing"
    _put(zone, "a.json", [_line(1), _line(2)])
    first = ingest.landing_to_bronze(spark, zone, f"{root}/bronze", f"{root}/_ck/b", schema=BRONZE_KEYED)
    _put(zone, "old.json", [_line(3)], age_days=60)
    second = ingest.landing_to_bronze(spark, zone, f"{root}/bronze", f"{root}/_ck/b", schema=BRONZE_KEYED)
    assert (first["rows"], second["rows"]) == (2, 1)


def test_run_available_now_grows_the_schema_and_refuses_narrow_bronze(spark, scratch):
    root = scratch("auto")
    zone = f"{root}/landing"
    _put(zone, "a.json", [_line(i, amount=3) for i in range(1, 6)])
    ingest.run_available_now(spark, zone, root, schema=None)
    _put(zone, "b.json", [_line(i, amount=4, extra="new") for i in range(11, 16)], age_days=90)
    out = ingest.run_available_now(spark, zone, root, schema=None)
    assert out["added_columns"] == ["extra"] and out["bronze_rows"] == 5
    assert spark.read.option("mergeSchema", "true").parquet(f"{root}/bronze").where("extra = 'new'").count() == 5
    _put(zone, "c.json", [_line(21, amount=2.5)])
    with pytest.raises(ValueError, match="amount: bigint -> double"):
        ingest.run_available_now(spark, zone, root, schema=None)
    fresh = ingest.run_available_now(spark, zone, scratch("auto2"), schema=None)
    assert fresh["bronze_rows"] == 11


# --- knowledge index ---------------------------------------------------------

def test_sync_plan_ops(spark):
    old, new = adapters.knowledge_snapshots(adapters.read_table(spark, SF001, "documents"))
    index = knowledge.apply_sync(None, knowledge.sync_plan(None, old), old).cache()
    plan = knowledge.sync_plan(index, new).cache()
    ops = {r["op"]: r["n"] for r in plan.groupBy("op").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert ops == {"insert": 100, "delete": 100, "update": 100, "keep": 700}
    by_digit = plan.select((F.col("id") % 10).alias("d"), "op").distinct().collect()
    expect = {0: "insert", 1: "delete", 2: "update"}
    for r in by_digit:
        assert r["op"] == expect.get(r["d"], "keep")
    synced = knowledge.apply_sync(index, plan, new).cache()
    assert synced.count() == 900
    # Kept rows keep their vectors untouched; updated rows get fresh ones.
    before = {r["id"]: r["embedding"] for r in index.collect()}
    after = {r["id"]: (r["embedding"], r["text_hash"]) for r in synced.collect()}
    for i, (vec, _) in after.items():
        if i % 10 >= 3:
            assert vec == before[i]
    assert knowledge.sync_plan(synced, new).where("op <> 'keep'").count() == 0


def test_sync_job_creates_then_updates_the_stored_index(spark, scratch):
    root = scratch("index")
    old, new = adapters.knowledge_snapshots(adapters.read_table(spark, SF001, "documents"))
    first = knowledge.sync_index(spark, old, root)
    second = knowledge.sync_index(spark, new, root)
    index = tables.read_published(spark, root, "knowledge_index")
    assert first != second and index.count() == 900
    assert knowledge.sync_plan(index, new).where("op <> 'keep'").count() == 0


def test_sync_plan_moves_no_text(spark):
    old, new = adapters.knowledge_snapshots(adapters.read_table(spark, SF001, "documents"))
    plan = knowledge.sync_plan(knowledge.sync_plan(None, old).select("id", "text_hash"), new)
    text = plan._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in text.splitlines() if "Exchange" in line]
    assert exchanges
    above = text.split("Exchange")[0]
    assert "text_chunk" not in above and "text#" not in above


def test_embeddings_are_unit_length_and_deterministic(spark):
    src = adapters.knowledge_source(adapters.read_table(spark, SF0001, "documents"))
    a = {r["id"]: r["embedding"] for r in knowledge.embed(src).collect()}
    b = {r["id"]: r["embedding"] for r in knowledge.embed(src).collect()}
    assert a == b and len(a) == 200
    norms = [float(np.linalg.norm(np.asarray(v, dtype=np.float64))) for v in a.values() if any(v)]
    assert norms and max(abs(n - 1.0) for n in norms) < 1e-5
    assert {len(v) for v in a.values()} == {knowledge.DEFAULT_DIM}


def _brute_topk(vectors, queries, k, exclude_self):
    out = {}
    for qid, q in queries.items():
        scored = [(-float(np.dot(np.asarray(q, np.float64), np.asarray(v, np.float64))), i)
                  for i, v in vectors.items() if not (exclude_self and i == qid)]
        out[qid] = [i for _, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("chunk_queries", [knowledge.CHUNK_QUERIES, 2])
def test_knn_matches_brute_force(spark, chunk_queries):
    emb = adapters.read_table(spark, SF0001, "embeddings")
    vectors = {r["vec_id"]: r["embedding"] for r in emb.collect()}
    queries = emb.where("vec_id < 5").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    hits = knowledge.knn(emb, queries, 3, id_col="vec_id", vec_col="embedding", qid_col="qid",
                         qvec_col="qv", exclude_self=True, chunk_queries=chunk_queries)
    got = {}
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["vec_id"])
    want = _brute_topk(vectors, {i: vectors[i] for i in range(5)}, 3, True)
    assert got == want


def test_knn_keeps_every_query_over_several_chunks(spark):
    rng = np.random.default_rng(0)
    index = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    queries = [(i, rng.normal(size=4).tolist()) for i in range(9000)]
    hits = knowledge.knn(spark.createDataFrame(index, "id long, embedding array<double>"),
                         spark.createDataFrame(queries, "query_id long, query_vec array<double>"), 2, chunk_queries=3000)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    x, q = np.asarray([v for _, v in index]), np.asarray([v for _, v in queries])
    order = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :2]
    assert len(got) == 9000 and all(got[i] == order[i].tolist() for i in range(9000))


def test_knn_sets_aside_vectors_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    index = [(i, [float(i), 1.0]) for i in range(10)] + [(90, [nan, 1.0]), (91, [inf, 1.0]), (92, None), (93, [None, 1.0])]
    queries = [(1, [1.0, 0.0]), (2, [nan, 0.0]), (3, None)]
    hits = knowledge.knn(spark.createDataFrame(index, "id long, embedding array<double>"),
                         spark.createDataFrame(queries, "query_id long, query_vec array<double>"), 3)
    assert [(r["query_id"], r["id"]) for r in hits.orderBy("query_id", "rank").collect()] == [(1, 9), (1, 8), (1, 7)]


def test_centroids_match_numpy(spark):
    emb = adapters.read_table(spark, SF0001, "embeddings")
    got = {r["label"]: r["centroid"] for r in knowledge.centroids(emb, "label").collect()}
    data = emb.collect()
    for label, c in got.items():
        vs = np.asarray([r["embedding"] for r in data if r["label"] == label], dtype=np.float64)
        assert np.allclose(vs.mean(axis=0), c, atol=1e-9)


# --- ranking and dashboards ------------------------------------------------------

def test_global_rank_is_dense_total_order(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5003).alias("k"), "id")
    ranked = global_rank(df, [F.desc("k"), F.asc("id")]).collect()
    order = sorted(((-r["k"], r["id"]) for r in ranked))
    by_rank = sorted(ranked, key=lambda r: r["rank"])
    assert [r["rank"] for r in by_rank] == list(range(1, 5001))
    assert [(-r["k"], r["id"]) for r in by_rank] == order


@pytest.mark.parametrize("partitions", [16, 64])
def test_global_rank_carries_other_columns(spark, partitions):
    """Columns outside the sort keys, adaptive execution on: every row once, with its exact position."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        n = 250_000
        df = spark.range(0, n, numPartitions=5).select(
            (F.col("id") * 7919 % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("other"),
            (F.col("id") % 3).alias("few"))
        got = global_rank(df, [F.asc("k")]).select("k", "rank", F.length("other").alias("n")).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == n and (got["rank"] == got["k"] + 1).all() and (got["n"] == 64).all()


def test_dashboards_on_sf0001(spark):
    frame = landing.dashboard_frame(adapters.load_bronze(spark, SF0001))
    k = dashboards.kpis(frame).first()
    assert (k["total_events"], k["anomalies"], k["pii_events"]) == (1000, 55, 494)
    assert round(k["anomaly_threshold_ms"], 6) == 519.116907
    top = dashboards.top_customers_by_latency(frame).orderBy("rank").collect()
    assert len(top) == 10 and [r["rank"] for r in top] == list(range(1, 11))
    means = [r["mean_latency_ms"] for r in top]
    assert means == sorted(means, reverse=True)
    feed = dashboards.recent_feed(frame).collect()
    ts = [r["timestamp"] for r in feed]
    assert len(feed) == 10 and ts == sorted(ts, reverse=True)


def test_stream_restart_after_schema_growth_keeps_old_rows(spark, scratch):
    """New files add a column: merge the stored schema, restart the bronze
    stream on the same checkpoint; old rows stay, the new column is NULL for
    them and filled for the new ones, nothing is ingested twice."""
    root = scratch("grow")
    zone = f"{root}/landing"
    events = adapters.read_table(spark, SF0001, "events")
    landing.write_events(adapters.bronze_from_events(events.where("event_id % 2 = 0")), zone)
    schema1, _, _ = ingest.evolve_schema(spark, zone, f"{root}/_schema")
    first = ingest.landing_to_bronze(spark, zone, f"{root}/bronze", f"{root}/_ck/bronze", schema=schema1)
    later = adapters.bronze_from_events(events.where("event_id % 2 = 1")).withColumn("session_key", F.lit(7))
    landing.write_events(later, zone)
    schema2, added, widened = ingest.evolve_schema(spark, zone, f"{root}/_schema")
    assert added == ["session_key"] and widened == []
    second = ingest.landing_to_bronze(spark, zone, f"{root}/bronze", f"{root}/_ck/bronze", schema=schema2)
    assert first["rows"] + second["rows"] == 1000
    bronze = spark.read.option("mergeSchema", "true").parquet(f"{root}/bronze")
    counts = {r["has"]: r["n"] for r in bronze.groupBy(F.col("session_key").isNotNull().alias("has"))
                                              .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {False: first["rows"], True: second["rows"]}


def test_schema_inference_reads_every_new_file_whatever_its_age(spark, scratch):
    root = scratch("incr")
    zone = f"{root}/landing"
    _put(zone, "a.json", [_line(1)])
    ingest.evolve_schema(spark, zone, f"{root}/_schema")
    _put(zone, "old.json", [_line(2, late_col=1)], age_days=300)
    _put(zone, "new.json", [_line(3, fresh_col=2)])
    s2, added, widened = ingest.evolve_schema(spark, zone, f"{root}/_schema")
    assert sorted(added) == ["fresh_col", "late_col"] and widened == []
    s3, added3, _ = ingest.evolve_schema(spark, zone, f"{root}/_schema")  # nothing new: nothing is read
    assert added3 == [] and s3 == s2
    _put(zone, "wide.json", [_line(4, fresh_col=2.5)])
    s4, _, widened = ingest.evolve_schema(spark, zone, f"{root}/_schema")
    assert widened == ["fresh_col: bigint -> double"] and s4["fresh_col"].dataType.simpleString() == "double"


def test_knn_executors_need_no_package(tmp_path):
    """Executors on a cluster do not have this package: the k-NN task must
    ship by value.  Run it from another folder with the package importable on
    the driver only (sys.path), never on the Python workers."""
    import os
    import subprocess
    import sys
    from conftest import ROOT
    script = f'''
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession, functions as F
from telemetry_lake.operators import knowledge
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false") \\
    .config("spark.checkpoint.dir", {str(tmp_path / "ck")!r}).getOrCreate()
emb = spark.read.parquet("{SF0001}/embeddings.parquet")
q = emb.where("vec_id < 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
print("ROWS", knowledge.knn(emb, q, 2, id_col="vec_id", vec_col="embedding", qid_col="qid", qvec_col="qv").count())
'''
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=str(tmp_path), env=env, capture_output=True,
                         text=True, timeout=300)
    assert "ROWS 6" in out.stdout, out.stderr[-2000:]
