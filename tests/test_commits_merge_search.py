"""One commit per micro-batch, schema groups, incremental gold, Bloom filters, the bucketed index, block search."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from conftest import SF0001, rows
from pyspark.sql import functions as F
from test_streaming_knowledge import _line, _put

from telemetry_lake import adapters
from telemetry_lake.operators import expectations as ex
from telemetry_lake.operators import knowledge, medallion, vector_search
from telemetry_lake.schemas import BRONZE_KEYED
from telemetry_lake.sources import tables
from telemetry_lake.streaming import commits, gold_state, index_merge, ingest

RULES = (*ex.SILVER_RULES, ex.expect("even_event", "event_id % 2 = 0"))


def _zone(root, files=6):
    zone = f"{root}/landing"
    for i in range(files):
        _put(zone, f"f{i}.json", [_line(4 * i + j) for j in range(4)] + (['{"event_id": 5, "cust'] if i % 2 else []))
    return zone


def _silver_run(spark, root):
    return ingest.bronze_to_silver(spark, f"{root}/bronze", f"{root}/silver", f"{root}/_ck/s", schema=BRONZE_KEYED, rules=RULES,
                                   max_files_per_trigger=1)


def _committed(spark, root):
    log = f"{root}/silver_commits"
    return (commits.read_committed(spark, f"{root}/silver", log, ingest.silver_schema(spark, BRONZE_KEYED, RULES)),
            commits.read_committed(spark, f"{root}/silver_rejected", log, ingest.rejected_schema(spark, BRONZE_KEYED, RULES)))


@pytest.mark.parametrize("crash", ["between the sinks", "before the commit", "after the commit"])
def test_a_crash_leaves_both_sinks_at_one_commit(spark, scratch, monkeypatch, crash):
    """Readers never see half a batch; after the restart kept + rejected + corrupt = landed, and so say the counts."""
    root = scratch("crash")
    b = ingest.landing_to_bronze(spark, _zone(root), f"{root}/bronze", f"{root}/_ck/b", schema=BRONZE_KEYED, max_files_per_trigger=1)
    assert (b["rows"], b["corrupt"]) == (27, 3)
    calls = {"n": 0}

    def failing(fn, at, after=False):
        def call(*args, **kw):
            calls["n"] += 1
            if calls["n"] == at and not after:
                raise RuntimeError("power cut")
            out = fn(*args, **kw)
            if calls["n"] == at and after:
                raise RuntimeError("power cut")
            return out
        return call

    with monkeypatch.context() as patch:
        if crash == "between the sinks":
            patch.setattr(ingest, "_write", failing(ingest._write, 6))  # the rejected table of the third batch
        else:
            patch.setattr(commits, "commit", failing(commits.commit, 3, after=crash == "after the commit"))
        with pytest.raises(Exception, match="power cut"):
            _silver_run(spark, root)
    whole = 3 if crash == "after the commit" else 2
    kept, refused = _committed(spark, root)
    log = commits.log_frame(spark, f"{root}/silver_commits", ingest.SILVER_LOG)
    seen = log.agg(F.sum("kept"), F.sum("rejected"), F.sum("corrupt"), F.count("*")).first()
    assert seen[3] == whole and kept.count() == seen[0] and refused.count() == seen[1] + seen[2]
    again = _silver_run(spark, root)
    assert len(again["batches"]) == 6 - whole
    kept, refused = _committed(spark, root)
    assert kept.count() + refused.count() == 27 and refused.where("kind = 'corrupt'").count() == 3
    ids = [r["event_id"] for r in kept.collect()] + [r["event_id"] for r in refused.where("kind <> 'corrupt'").collect()]
    assert sorted(ids) == list(range(24))
    log = commits.log_frame(spark, f"{root}/silver_commits", ingest.SILVER_LOG)
    total = log.agg(F.sum("kept"), F.sum("rejected"), F.sum("corrupt"), F.sum("rows")).first()
    assert total[0] == kept.count() and total[0] + total[1] == total[3] == 24 and total[2] == 3
    odd = log.select(F.explode("violations").alias("rule", "n")).where("rule = 'even_event'").agg(F.sum("n")).first()[0]
    assert odd == kept.where("event_id % 2 = 1").count()
    # what is read without the log agrees, now that no batch is in flight
    assert spark.read.parquet(f"{root}/silver").count() == kept.count()
    assert _silver_run(spark, root)["batches"] == []


def test_a_bronze_batch_repeated_after_a_crash_counts_once(spark, scratch, monkeypatch):
    root = scratch("bcrash")
    zone = _zone(root)
    run = lambda: ingest.landing_to_bronze(spark, zone, f"{root}/bronze", f"{root}/_ck/b", schema=BRONZE_KEYED,
                                           max_files_per_trigger=2)
    with monkeypatch.context() as patch:
        patch.setattr(commits, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("power cut")))
        with pytest.raises(Exception, match="power cut"):
            run()
    assert commits.in_flight(spark, f"{root}/bronze", f"{root}/bronze_commits")
    got = run()
    assert (got["rows"], got["corrupt"]) == (27, 3) and not commits.in_flight(spark, f"{root}/bronze", f"{root}/bronze_commits")
    s = _silver_run(spark, root)
    assert s["rows"] == 24 and s["corrupt"] == 3


def test_archived_files_leave_the_zone(spark, scratch):
    """With an archive a run lists its own files and those of the last batch before it, not the history of the zone."""
    root = scratch("archive")
    zone = f"{root}/landing"
    for i in range(6):
        _put(zone, f"f{i}.json", [_line(i)])
        got = ingest.landing_to_bronze(spark, zone, f"{root}/bronze", f"{root}/_ck/b", schema=BRONZE_KEYED,
                                       archive_dir=f"{root}/archive")
        assert got["rows"] == 1 and len(got["batches"]) == 1
    left = [f for f in os.listdir(zone) if f.endswith(".json")]
    assert len(left) <= 2
    log = commits.log_frame(spark, f"{root}/bronze_commits", ingest.BRONZE_LOG)
    assert log.agg(F.sum("rows")).first()[0] == 6


def test_widened_types_start_a_group_and_nothing_is_refused(spark, scratch):
    """Whole numbers, then decimals, then text in one field: one root, every row readable in the widest type."""
    root = scratch("groups")
    zone = f"{root}/landing"
    run = lambda: ingest.run_available_now(spark, zone, root, schema=None, widened="group", gold="incremental")
    _put(zone, "a.json", [_line(i, amount=3) for i in (1, 2, 3)])
    run()
    _put(zone, "b.json", [_line(i, amount=2.5, extra="new") for i in (11, 12)])
    out = run()
    assert out["bronze_rows"] == 2 and out["added_columns"] == ["extra"]
    _put(zone, "c.json", [_line(22, amount="many"), _line(23, amount="few", context={"latency": 9.5, "pii": False, "deep": 4})])
    assert run()["bronze_rows"] == 2
    assert run()["bronze_rows"] == 0
    schema = tables.load_schema(spark, f"{root}/_schema/versions")
    assert [g for g, _ in ingest.bronze_groups(spark, root, schema)] == [1, 2, 3]
    bronze = {r["event_id"]: r for r in ingest.read_bronze(spark, root, schema).collect()}
    assert {i: r["amount"] for i, r in bronze.items()} == {1: "3", 2: "3", 3: "3", 11: "2.5", 12: "2.5", 22: "many", 23: "few"}
    assert bronze[23]["context"]["deep"] == 4 and bronze[1]["context"]["deep"] is None and bronze[11]["extra"] == "new"
    silver = spark.read.parquet(f"{root}/silver")
    assert {r["event_id"] for r in silver.collect()} == {1, 2, 3, 11, 12, 22, 23}
    assert silver.where("event_id = 23").first()["latency_ms"] == 9.5
    assert tables.read_published(spark, root, "gold_customer_analytics").agg(F.sum("total_events")).first()[0] == 7


def test_gold_of_ten_increments_equals_the_full_recompute(spark, scratch):
    """The threshold moves with every increment; earlier silver files are gone, so none can have been read again."""
    root = scratch("gold10")
    rng = random.Random(11)
    schema = "event_id long, customer_id string, latency_ms double"
    seen = []
    for step in range(10):
        scale = rng.choice([1, 30, 400])
        batch = [(100 * step + i, rng.choice(["CUST_001", f"CUST_{rng.randint(2, 30):03d}"]),
                  rng.choice([None, 0.0, -2.5, round(rng.expovariate(1 / scale), 3)]) if i % 9 == 0 else rng.expovariate(1 / scale))
                 for i in range(100)]
        seen += batch
        name = commits.batch_name("0" * 32, step)
        spark.createDataFrame(batch, schema).write.parquet(commits.batch_path(f"{root}/silver", name))
        commits.commit(spark, f"{root}/log", name, {})
        out = gold_state.refresh_gold_incremental(spark, f"{root}/silver", f"{root}/log", root)
        assert out["batches"] == [name]
        want = medallion.gold(spark.createDataFrame(seen, schema))
        got = tables.read_published(spark, root, "gold_customer_analytics")
        cols = ["customer_id", "total_events", F.round("mean_latency_ms", 9), "total_anomalies"]
        assert rows(got, *cols) == rows(want, *cols)
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(commits.batch_path(f"{root}/silver", name))
    again = gold_state.refresh_gold_incremental(spark, f"{root}/silver", f"{root}/log", root)
    assert again["batches"] == [] and rows(tables.read_published(spark, root, "gold_customer_analytics"), *cols) == rows(want, *cols)


def test_incremental_gold_of_nothing(spark, scratch):
    root = scratch("gold0")
    out = gold_state.refresh_gold_incremental(spark, f"{root}/silver", f"{root}/log", root)
    assert out["threshold"] is None and tables.read_published(spark, root, "gold_customer_analytics").count() == 0


def _scanned(df):
    """Rows that the file scans of a query returned."""
    df._jdf.collectToPython()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_bloom_filters_skip_row_groups(spark, scratch):
    """A value inside every row group's range and in none of them: without the filter all rows are read, with it none."""
    root = scratch("bloom")
    df = spark.range(20_000).select(F.format_string("CUST_%06d", F.col("id") * 7 % 20_000 * 2).alias("customer_id"), "id")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scanned = {}
        for name, bloom in (("plain", None), ("bloom", {"customer_id": 20_000})):
            tables.publish(df, root, name, bloom=bloom)
            scanned[name] = _scanned(tables.read_published(spark, root, name).where("customer_id = 'CUST_010001'"))
            assert tables.read_published(spark, root, name).where("customer_id = 'CUST_010002'").count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert scanned == {"plain": 20_000, "bloom": 0}


# --- bucketed index -------------------------------------------------------------------

def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def _by_range(key, buckets):
    return F.floor(key / 10).cast("int") % buckets


def _index(spark, root):
    return {r["id"]: (r["text_hash"], tuple(r["embedding"])) for r in index_merge.read_index(spark, root).collect()}


def test_one_percent_of_the_keys_rewrites_one_percent_of_the_buckets(spark, scratch):
    root = scratch("merge")
    source = spark.range(1000).select("id", F.concat_ws(" ", F.lit("chunk"), F.sha2(F.col("id").cast("string"), 256)).alias("text_chunk"))
    merge = lambda: index_merge.merge_changes(spark, f"{root}/changes", f"{root}/index", buckets=100, bucket_of=_by_range)
    index_merge.upserts(source, 1).write.mode("append").parquet(f"{root}/changes")
    first = merge()
    assert first["insert"] == 1000 and first["buckets_written"] == 100
    full = _bytes(f"{root}/index/data")
    changed = source.where("id BETWEEN 500 AND 509").withColumn("text_chunk", F.concat("text_chunk", F.lit(" rev")))
    same = source.where("id < 100")
    index_merge.upserts(changed.unionByName(same), 2).write.mode("append").parquet(f"{root}/changes")
    second = merge()
    assert second["update"] == 10 and second["keep"] == 100 and second["buckets_written"] == 1
    assert _bytes(f"{root}/index/data") - full < 0.03 * full
    index_merge.deletes(source.where("id BETWEEN 990 AND 999"), 3).write.mode("append").parquet(f"{root}/changes")
    third = merge()
    assert third["delete"] == 10 and third["buckets_written"] == 1 and merge()["buckets_written"] == 0
    now = source.where("id < 990 AND NOT id BETWEEN 500 AND 509").unionByName(changed)
    want = knowledge.apply_sync(None, knowledge.sync_plan(None, now), now)
    assert _index(spark, f"{root}/index") == {r["id"]: (r["text_hash"], tuple(r["embedding"])) for r in want.collect()}
    assert index_merge.read_index(spark, f"{root}/index", buckets=[50]).count() == 10
    assert len(index_merge.vacuum(spark, f"{root}/index", keep=1)) == 2
    assert len(_index(spark, f"{root}/index")) == 990


def test_merge_takes_the_last_change_and_survives_a_crash(spark, scratch, monkeypatch):
    root = scratch("mcrash")
    schema = index_merge.changes_schema()
    spark.createDataFrame([(1, "a b", False, 1), (1, "c d", False, 3), (1, "e f", False, 2), (2, "g", False, 1), (2, None, True, 2),
                           (3, None, False, 1), (None, "lost", False, 1), (4, "h", None, None)], schema).write.parquet(f"{root}/changes/1")
    merge = lambda: index_merge.merge_changes(spark, f"{root}/changes/*", f"{root}/index", buckets=4)
    with monkeypatch.context() as patch:
        patch.setattr(tables, "_append_record", lambda *a: (_ for _ in ()).throw(RuntimeError("power cut")))
        with pytest.raises(Exception, match="power cut"):
            merge()
    assert index_merge.manifest(spark, f"{root}/index") is None
    out = merge()
    assert out["without_key"] == 1 and out["insert"] == 3
    assert {i: h for i, (h, _) in _index(spark, f"{root}/index").items()} == {
        1: _sha("c d"), 3: None, 4: _sha("h")}
    assert merge()["buckets_written"] == 0


def _sha(text):
    import hashlib
    return hashlib.sha256(text.encode()).hexdigest()


# --- block search ---------------------------------------------------------------------------

def _clustered(rng, n, d, clusters, spread):
    centre = rng.normal(size=(clusters, d)) * 8
    return centre[rng.integers(0, clusters, n)] + rng.normal(size=(n, d)) * spread


def _brute(index, queries, k, exclude_self=False):
    out = {}
    for qid, q in queries:
        scored = sorted((-float(np.einsum("d,d->", np.asarray(q), np.asarray(v))), i) for i, v in index if not (exclude_self and i == qid))
        out[qid] = [i for _, i in scored[:k]]
    return out


def _hits(df, qid="query_id", hit="id"):
    got = {}
    for r in df.orderBy(qid, "rank").collect():
        got.setdefault(r[qid], []).append(r[hit])
    return got


@pytest.mark.parametrize("exclude_self", [False, True])
def test_block_search_equals_brute_force(spark, monkeypatch, exclude_self):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vector_search, "CHUNK", 16)
    rng = np.random.default_rng(4)
    vectors = np.round(_clustered(rng, 700, 6, 9, 0.5), 2)
    vectors[100:160] = vectors[100]  # ties
    index = [(i, v.tolist()) for i, v in enumerate(vectors)]
    queries = [(i, v) for i, v in index[:60]] + [(10_000, [0.0] * 6)]
    got = vector_search.knn_blocks(spark.createDataFrame(index, "id long, embedding array<double>"),
                                   spark.createDataFrame(queries, "query_id long, query_vec array<double>"), 4,
                                   exclude_self=exclude_self, sample_rows=120, centres=12)
    assert _hits(got) == _brute(index, queries, 4, exclude_self)


def test_block_search_skips_blocks_and_scans_the_index_once(spark):
    rng = np.random.default_rng(5)
    vectors = _clustered(rng, 4000, 8, 20, 0.2)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(0, 4000, 8)], "query_id long, query_vec array<double>")
    index = vector_search.build(table, sample_rows=512, centres=32)
    seen = vector_search.route(index, asked, 3, qid_col="query_id", qvec_col="query_vec").count()
    assert 500 <= seen < 0.2 * 500 * len(index.block)
    plan = vector_search.search(index, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("vector-blocks") == 1 and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


def test_block_search_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    index = [(i, [float(i), 1.0]) for i in range(10)] + [(90, [nan, 1.0]), (91, [inf, 1.0]), (92, None), (93, [None, 1.0])]
    queries = [(1, [1.0, 0.0]), (2, [nan, 0.0]), (3, None)]
    q = spark.createDataFrame(queries, "query_id long, query_vec array<double>")
    got = vector_search.knn_blocks(spark.createDataFrame(index, "id long, embedding array<double>"), q, 20)
    assert _hits(got) == {1: list(range(9, -1, -1))}
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    assert vector_search.knn_blocks(empty, q, 3).count() == 0
    assert vector_search.knn_blocks(spark.createDataFrame(index, "id long, embedding array<double>"), q.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="dimension"):
        vector_search.knn_blocks(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "id long, embedding array<double>"), q, 3).count()


def test_search_over_the_merged_index(spark, scratch):
    """Texts asked for again are their own best hits in the index that the change files built."""
    root = scratch("search")
    source = adapters.knowledge_source(adapters.read_table(spark, SF0001, "documents"))
    index_merge.upserts(source, 1).write.parquet(f"{root}/changes")
    index_merge.merge_changes(spark, f"{root}/changes", f"{root}/index", buckets=8)
    index = index_merge.read_index(spark, f"{root}/index")
    asked = index.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    best = vector_search.knn_blocks(index, asked, 5).where("rank = 1")
    by_text = {r["id"]: r["text_hash"] for r in index.collect()}
    got = {r["query_id"]: r for r in best.collect()}
    assert len(got) == asked.where(F.exists("query_vec", lambda x: x != 0)).count() or len(got) == asked.count()
    assert all(abs(r["score"] - 1) < 1e-6 or r["score"] == 0 for r in got.values())
    assert sum(by_text[q] == by_text[r["id"]] for q, r in got.items()) >= 0.9 * len(got)


def test_queries_travel_once_for_neighbouring_blocks(spark, monkeypatch):
    """vectors without structure are in every block's reach; a query is sent once a group, and the search stays exact."""
    monkeypatch.setattr(vector_search, "CELLS", 700)
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(900, 24))
    vectors[::30] = vectors[0]  # equal vectors in many places
    index = [(int(i), v.tolist()) for i, v in zip(rng.permutation(900), vectors)]
    table = spark.createDataFrame(index, "id long, embedding array<double>")
    queries = [*index[:40], (10_000, [0.0] * 24)]
    asked = spark.createDataFrame(queries, "query_id long, query_vec array<double>")
    built = vector_search.build(table, sample_rows=200, centres=24)
    group = vector_search.gathered(built.count, 300)
    held = np.bincount(group, weights=built.count)
    assert (np.diff(group) >= 0).all() and held.max() <= 300 and 3 <= len(held) <= 6
    assert vector_search.gathered(np.array([500, 10, 10, 400]), 300).tolist() == [0, 1, 1, 2]
    routed = vector_search.route(built, asked, 4, qid_col="query_id", qvec_col="query_vec", group=group)
    seen = [(r["query_id"], r["block"]) for r in routed.collect()]
    assert len(seen) == len(set(seen)) <= len(held) * len(queries)
    for rows in (vector_search.GATHER_ROWS, 300):
        monkeypatch.setattr(vector_search.gathered, "__defaults__", (rows,))
        for exclude_self in (False, True):
            got = vector_search.search(built, asked, 4, exclude_self=exclude_self)
            assert _hits(got) == _brute(index, queries, 4, exclude_self)
