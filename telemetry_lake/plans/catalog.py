"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Each key reads the driver's full tables through the adapters and runs one
operator family end to end.  Column names and presentation rounding match
the DuckDB SQL in ``oracle.py`` (same key), which is the correctness gate.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters
from ..operators import (analytics, dashboards, distinct, expectations, governance, knowledge, medallion, prompts, text_weights,
                         vector_search)
from ..session import scratch_path
from ..sources import landing, tables
from ..schemas import BRONZE_KEYED
from ..functions import sql_functions
from ..constants import VALID_EVENT_TYPES
from . import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _mean9(c: str = "mean_latency_ms"):
    return F.round(F.col(c), 9).alias(c)


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.silver(adapters.load_bronze(spark, sf_dir))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.gold(_silver(spark, sf_dir))


def _view(df: DataFrame, stem: str) -> str:
    name = f"{stem}_{uuid.uuid4().hex[:8]}"
    df.createOrReplaceTempView(name)
    return name


@register("silver_telemetry", oracle.SILVER_TELEMETRY)
def silver_telemetry(spark, sf_dir):
    s = _silver(spark, sf_dir)
    return s.select("event_id", "customer_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"),
                    "timestamp_date", "event_type", "latency_ms", "is_pii", "masked_payload")


@register("expectation_report", oracle.EXPECTATION_REPORT)
def expectation_report(spark, sf_dir):
    return expectations.expectation_report(adapters.load_bronze(spark, sf_dir))


@register("quarantine_rows", oracle.QUARANTINE_ROWS)
def quarantine_rows(spark, sf_dir):
    q = expectations.quarantine(adapters.load_bronze(spark, sf_dir))
    return q.select("event_id", "customer_id", "event_type",
                    F.array_join("failed_rules", ",").alias("failed_rules"))


@register("gold_customer_analytics", oracle.GOLD_CUSTOMER_ANALYTICS)
def gold_customer_analytics(spark, sf_dir):
    return _gold(spark, sf_dir).select("customer_id", "total_events", _mean9(), "total_anomalies")


@register("event_anomaly_flags", oracle.EVENT_ANOMALY_FLAGS)
def event_anomaly_flags(spark, sf_dir):
    return medallion.event_flags(_silver(spark, sf_dir)).select(
        "event_id", "customer_id", "latency_ms", "is_anomaly")


def _scores_out(df: DataFrame) -> DataFrame:
    return df.select("customer_id", "total_events", "total_anomalies", _mean9(), "risk_factor")


@register("anomaly_scores_all", oracle.ANOMALY_SCORES_ALL)
def anomaly_scores_all(spark, sf_dir):
    return _scores_out(analytics.scores(_gold(spark, sf_dir)))


def _stored_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold published once, sorted by customer, and read back: what a lookup scans."""
    root = scratch_path(spark, "gold")
    tables.publish(_gold(spark, sf_dir), root, "gold_customer_analytics", sort_within=["customer_id"])
    return tables.read_published(spark, root, "gold_customer_analytics")


@register("anomaly_score_lookup", oracle.ANOMALY_SCORE_LOOKUP)
def anomaly_score_lookup(spark, sf_dir):
    """One id against stored gold: the equality reaches the scan, raw events are not read."""
    return _scores_out(analytics.score_lookup(spark, _stored_gold(spark, sf_dir), oracle.LOOKUP_ID))


@register("anomaly_score_hostile_id", oracle.ANOMALY_SCORE_HOSTILE_ID)
def anomaly_score_hostile_id(spark, sf_dir):
    return _scores_out(analytics.score_lookup(spark, _stored_gold(spark, sf_dir), oracle.HOSTILE_ID))


def _score_requests(spark, sf_dir) -> DataFrame:
    calls = adapters.calls_from_events(adapters.read_table(spark, sf_dir, "events"))
    return (calls.where(F.col("function") == sql_functions.SCORE_FUNCTION)
                 .select("call_id", F.get_json_object("params_json", "$.target_id").alias("target_id")))


@register("anomaly_scores_governed", oracle.ANOMALY_SCORES_LATERAL)
def anomaly_scores_governed(spark, sf_dir):
    """The persistent governed function over a saved gold table, applied to every request.

    The answers are written before the function and the table's entry in the catalog are dropped again.
    """
    stem = uuid.uuid4().hex[:8]
    (_gold(spark, sf_dir).sortWithinPartitions("customer_id").write
     .option("path", scratch_path(spark, "saved-gold")).saveAsTable(f"gold_{stem}"))
    fn = f"governed_score_{stem}"
    try:
        sql_functions.register_score_function(spark, f"gold_{stem}", name=fn, temporary=False)
        joined = sql_functions.lateral_scores(spark, _view(_score_requests(spark, sf_dir), "requests"), name=fn)
        out = joined.select("call_id", "customer_id", "total_events", "total_anomalies", _mean9(), "risk_factor")
        path = scratch_path(spark, "governed-scores")
        out.write.parquet(path)
        return spark.read.schema(out.schema).parquet(path)
    finally:
        spark.sql(f"DROP FUNCTION IF EXISTS {fn}")
        spark.sql(f"DROP TABLE IF EXISTS gold_{stem}")


@register("anomaly_scores_lateral", oracle.ANOMALY_SCORES_LATERAL)
def anomaly_scores_lateral(spark, sf_dir):
    requests = _score_requests(spark, sf_dir)
    gold_view = _view(_gold(spark, sf_dir), "gold")
    fn = f"score_{uuid.uuid4().hex[:8]}"
    sql_functions.register_score_function(spark, gold_view, name=fn)
    joined = sql_functions.lateral_scores(spark, _view(requests, "requests"), name=fn)
    return joined.select("call_id", "customer_id", "total_events", "total_anomalies", _mean9(), "risk_factor")


@register("fleet_summary", oracle.FLEET_SUMMARY)
def fleet_summary(spark, sf_dir):
    return analytics.fleet_summary(_silver(spark, sf_dir))


@register("known_customers", oracle.KNOWN_CUSTOMERS)
def known_customers(spark, sf_dir):
    return analytics.known_customers(_gold(spark, sf_dir))


@register("bronze_telemetry", oracle.BRONZE_TELEMETRY)
def bronze_telemetry(spark, sf_dir):
    """Land the adapter rows as NDJSON in a fresh folder, scan them back."""
    path = scratch_path(spark, "landing")
    landing.write_events(adapters.load_bronze(spark, sf_dir), path, mode="error")
    bronze = landing.read_landing(spark, path, BRONZE_KEYED, mode="FAILFAST")
    return bronze.select("event_id", "customer_id", "timestamp", "event_type",
                         F.col("context.latency").alias("latency"), F.col("context.pii").alias("pii"), "payload")


def _frame(spark, sf_dir):
    return landing.dashboard_frame(adapters.load_bronze(spark, sf_dir))


def _ntz(c="timestamp"):
    return F.col(c).cast("timestamp_ntz").alias(c)


@register("dashboard_kpis", oracle.DASHBOARD_KPIS)
def dashboard_kpis(spark, sf_dir):
    k = dashboards.kpis(_frame(spark, sf_dir))
    return k.select("total_events", _mean9(), "anomalies", "pii_events",
                    F.round("anomaly_threshold_ms", 9).alias("anomaly_threshold_ms"))


@register("latency_series", oracle.LATENCY_SERIES)
def latency_series(spark, sf_dir):
    return dashboards.latency_series(_frame(spark, sf_dir)).select("event_id", _ntz(), "latency", "rank")


@register("top_customers_by_latency", oracle.TOP_CUSTOMERS_BY_LATENCY)
def top_customers_by_latency(spark, sf_dir):
    return dashboards.top_customers_by_latency(_frame(spark, sf_dir))


@register("recent_feed", oracle.RECENT_FEED)
def recent_feed(spark, sf_dir):
    return dashboards.recent_feed(_frame(spark, sf_dir)).select(
        "event_id", _ntz(), "customer_id", "event_type", "latency", "is_pii", "rank")


@register("governance_decisions", oracle.GOVERNANCE_DECISIONS)
def governance_decisions(spark, sf_dir):
    calls = adapters.calls_from_events(adapters.read_table(spark, sf_dir, "events"))
    decided = governance.decide(calls, governance.registry_frame(spark))
    return decided.select("call_id", "function", "allowed", "control")


def _prompts(spark, sf_dir):
    return adapters.prompts_from_events(adapters.read_table(spark, sf_dir, "events"))


@register("prompt_intents", oracle.PROMPT_INTENTS)
def prompt_intents(spark, sf_dir):
    return prompts.resolve_intents(_prompts(spark, sf_dir)).select("prompt_id", "target_id", "function", "has_sql")


@register("conversation_intents", oracle.CONVERSATION_INTENTS)
def conversation_intents(spark, sf_dir):
    """Intent resolution over free text: every turn of every conversation."""
    turns = adapters.read_table(spark, sf_dir, "conversations")
    return prompts.resolve_intents(turns, "text").select("conv_id", "turn", "target_id", "function", "has_sql")


def _routed(spark, sf_dir):
    silver = _silver(spark, sf_dir)
    return prompts.route(_prompts(spark, sf_dir), medallion.gold(silver), analytics.fleet_context(silver),
                         governance.registry_frame(spark))


@register("prompt_answers", oracle.PROMPT_ANSWERS)
def prompt_answers(spark, sf_dir):
    r = _routed(spark, sf_dir)
    return r.select("prompt_id", "target_id", "has_sql", "executed", "status", "control", "verdict",
                    "total_events", "total_anomalies", "risk_factor", "mean_latency_ms",
                    F.round("latency_ratio", 9).alias("latency_ratio"),
                    F.size("trace").alias("trace_steps"))


@register("prompt_audit_records", oracle.PROMPT_AUDIT_RECORDS)
def prompt_audit_records(spark, sf_dir):
    """Answer text, complete decision record and ordered trace, written to the audit table and read back."""
    r = _routed(spark, sf_dir)
    path = scratch_path(spark, "audit")
    governance.write_audit(r.select(
        "prompt_id", "prompt", "status", "answer", "allowed", "control", "detail", "function", "parameters", "executed",
        F.array_join(F.transform("trace", lambda t: F.concat_ws(" | ", t["step"], t["status"], t["detail"])), "\n")
        .alias("trace"), "serving_mode"), path)
    return spark.read.parquet(path).select(
        "prompt_id", "prompt", "status", "answer", "allowed", "control", "detail", "function", "parameters", "executed",
        "trace", "serving_mode", F.col("audited_at").isNotNull().alias("audited"))


def _snapshots(spark, sf_dir):
    return adapters.knowledge_snapshots(adapters.read_table(spark, sf_dir, "documents"))


def _shape(vector: str = "embedding") -> list:
    """What a vector's oracle can tell: its dimension and its length."""
    square = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return [F.size(vector).alias("dimension"), F.round(F.sqrt(square), 4).alias("norm")]


@register("knowledge_sync_plan", oracle.KNOWLEDGE_SYNC_PLAN)
def knowledge_sync_plan(spark, sf_dir):
    """Plan the sync of an index built from the old snapshot against the new one."""
    old, new = _snapshots(spark, sf_dir)
    index = knowledge.sync_plan(None, old).select("id", "text_hash")
    return knowledge.sync_plan(index, new).select("id", "op")


@register("knowledge_embeddings", oracle.KNOWLEDGE_EMBEDDINGS)
def knowledge_embeddings(spark, sf_dir):
    """Default embedder over every knowledge chunk."""
    src = adapters.knowledge_source(adapters.read_table(spark, sf_dir, "documents"))
    return knowledge.embed(src).select("id", *_shape())


@register("knowledge_index_sync", oracle.KNOWLEDGE_INDEX_SYNC)
def knowledge_index_sync(spark, sf_dir):
    """The sync job twice: it creates the index from the old snapshot, then brings it up to the new one."""
    old, new = _snapshots(spark, sf_dir)
    root = scratch_path(spark, "index")
    knowledge.sync_index(spark, old, root)
    knowledge.sync_index(spark, new, root)
    return tables.read_published(spark, root, "knowledge_index").select("id", "text_hash", *_shape())


@register("vector_topk", oracle.VECTOR_TOPK)
def vector_topk(spark, sf_dir):
    """Top-3 vectors nearest to each label's centroid (dot product in DOUBLE)."""
    emb = adapters.read_table(spark, sf_dir, "embeddings")
    queries = knowledge.centroids(emb, "label").select(F.col("label").alias("query_label"),
                                                       F.col("centroid"))
    hits = knowledge.knn(emb, queries, 3, id_col="vec_id", vec_col="embedding",
                         qid_col="query_label", qvec_col="centroid")
    return hits.select("query_label", "vec_id", F.round("score", 6).alias("score"), "rank")


def _backdate(spark, folder: str, days: int = 30) -> None:
    """Give the files of a folder an old modification time, as copied or late files have."""
    fs, path, jvm = tables._fs(spark, folder)
    old = jvm.System.currentTimeMillis() - days * 86_400_000
    for status in fs.listStatus(path):
        fs.setTimes(status.getPath(), old, -1)


def _malformed(events: DataFrame) -> DataFrame:
    """A cut-off line for every 101st event and a blank line for every 103rd."""
    k = F.col("event_id")
    return (events.where((k % 101 == 0) | (k % 103 == 0))
            .select(F.when(k % 101 == 0, F.concat(F.lit('{"event_id": '), k.cast("string"), F.lit(', "customer_id"')))
                    .otherwise(F.lit("")).alias("value")))


def _land_chunk(spark, sf_dir, zone: str, number: int, chunks: int = 3) -> None:
    """Append one chunk of the events (by event id), with malformed and blank lines, to a folder of the zone."""
    events = adapters.read_table(spark, sf_dir, "events").where(F.pmod("event_id", F.lit(chunks)) == number)
    folder = f"{zone}/chunk={number}"
    landing.write_events(adapters.bronze_from_events(events), folder, mode="append")
    _malformed(events).write.mode("append").text(folder)


def _streamed_medallion(spark, sf_dir):
    """Two runs of the streams; the second finds files that are older than all files of the first."""
    from ..streaming import ingest
    root = scratch_path(spark, "stream")
    zone = f"{root}/landing"
    _land_chunk(spark, sf_dir, zone, 0)
    _land_chunk(spark, sf_dir, zone, 1)
    ingest.run_available_now(spark, f"{zone}/*", root, schema=BRONZE_KEYED)
    _land_chunk(spark, sf_dir, zone, 2)
    _backdate(spark, f"{zone}/chunk=2")
    ingest.run_available_now(spark, f"{zone}/*", root, schema=BRONZE_KEYED)
    return root


@register("streaming_silver", oracle.STREAMING_SILVER)
def streaming_silver(spark, sf_dir):
    """Silver produced by the availableNow streams; every row has the time of its batch."""
    root = _streamed_medallion(spark, sf_dir)
    s = spark.read.parquet(f"{root}/silver")
    return s.select("event_id", "customer_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"),
                    "timestamp_date", "event_type", "latency_ms", "is_pii", "masked_payload",
                    F.col("ingest_time").isNotNull().alias("has_ingest_time"))


@register("streaming_quarantine", oracle.STREAMING_QUARANTINE)
def streaming_quarantine(spark, sf_dir):
    """What the streams did not keep: rows that failed a rule and malformed lines with their text."""
    root = _streamed_medallion(spark, sf_dir)
    return spark.read.parquet(f"{root}/rejected").select(
        "kind", "event_id", "customer_id", "event_type", "failed_rules", "raw_line",
        F.col("masked_payload").isNotNull().alias("has_payload"))


@register("batch_refresh_gold", oracle.BATCH_REFRESH_GOLD)
def batch_refresh_gold(spark, sf_dir):
    """Full batch refresh from an NDJSON landing zone; gold read back from
    its published version."""
    from .refresh import refresh
    root = scratch_path(spark, "refresh")
    for number in range(3):
        _land_chunk(spark, sf_dir, f"{root}/landing", number)
    refresh(spark, f"{root}/landing", root, schema=BRONZE_KEYED)
    g = tables.read_published(spark, root, "gold_customer_analytics")
    return g.select("customer_id", "total_events", _mean9(), "total_anomalies")


@register("streaming_gold_refresh", oracle.STREAMING_GOLD_REFRESH)
def streaming_gold_refresh(spark, sf_dir):
    """Gold republished from the streamed silver table."""
    root = _streamed_medallion(spark, sf_dir)
    g = tables.read_published(spark, root, "gold_customer_analytics")
    return g.select("customer_id", "total_events", _mean9(), "total_anomalies")


def _land_growing(spark, sf_dir, folder: str, parity: int) -> None:
    """Events of one parity: even ones with whole amounts; odd ones, in files of an old date, with decimals and new fields."""
    events = adapters.read_table(spark, sf_dir, "events").where(F.pmod("event_id", F.lit(2)) == parity)
    rows, amount = adapters.bronze_from_events(events), F.col("context.latency")
    if parity == 0:
        landing.write_events(rows.withColumn("amount", F.floor(amount).cast("bigint")), folder)
        return
    landing.write_events(rows.withColumns({
        "amount": amount, "session_key": F.get_json_object("payload", "$.k").cast("bigint"),
        "context": F.struct("context.latency", "context.pii", (F.col("event_id") % 10).alias("digit"))}), folder)
    _backdate(spark, folder)


def _grown(bronze: DataFrame) -> DataFrame:
    return bronze.select("event_id", "customer_id", "event_type", F.col("context.latency").alias("latency"), "amount",
                         "session_key", F.col("context.digit").alias("digit"))


@register("schema_evolution", oracle.SCHEMA_EVOLUTION)
def schema_evolution(spark, sf_dir):
    """Later, older-dated files add a top-level and a nested field and hold decimals where whole numbers were: the
    stored schema is widened, and earlier rows read the new fields as NULL."""
    from ..streaming import ingest
    root = scratch_path(spark, "evolve")
    zone = f"{root}/landing"
    _land_growing(spark, sf_dir, f"{zone}/early", 0)
    ingest.evolve_schema(spark, f"{zone}/*", f"{root}/_schema")
    _land_growing(spark, sf_dir, f"{zone}/later", 1)
    merged, _, _ = ingest.evolve_schema(spark, f"{zone}/*", f"{root}/_schema")
    return _grown(landing.read_landing(spark, zone, merged, mode="FAILFAST", recursive=True))


@register("strict_silver", oracle.SILVER_TELEMETRY)
def strict_silver(spark, sf_dir):
    """Events of known types under the rule set that fails on any other: published and read back."""
    bronze = adapters.load_bronze(spark, sf_dir).where(F.col("event_type").isin(*VALID_EVENT_TYPES))
    root = scratch_path(spark, "strict")
    tables.publish(medallion.silver(bronze, expectations.STRICT_SILVER_RULES), root, "silver", partition_by=["timestamp_date"])
    s = tables.read_published(spark, root, "silver")
    return s.select("event_id", "customer_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"),
                    "timestamp_date", "event_type", "latency_ms", "is_pii", "masked_payload")


@register("streaming_batch_log", oracle.STREAMING_BATCH_LOG)
def streaming_batch_log(spark, sf_dir):
    """What the commit records of all micro-batches add up to: landed, kept, rejected and malformed rows."""
    from ..streaming import commits, ingest
    root = _streamed_medallion(spark, sf_dir)
    landed = commits.log_frame(spark, f"{root}/_commits/bronze", ingest.BRONZE_LOG)
    checked = commits.log_frame(spark, f"{root}/_commits/silver", ingest.SILVER_LOG)
    total = landed.agg(F.sum("rows").alias("landed"))
    return checked.agg(*[F.sum(c).alias(c) for c in ("kept", "rejected", "corrupt")]).select(
        total.scalar().alias("landed"), "kept", "rejected", "corrupt")


@register("schema_widening_stream", oracle.SCHEMA_EVOLUTION)
def schema_widening_stream(spark, sf_dir):
    """The growth of ``schema_evolution`` through the streams: the later run finds stored bronze of a narrower type, starts
    a new group of files, and all rows are read in the widened schema."""
    from ..streaming import ingest
    root = scratch_path(spark, "widening")
    zone = f"{root}/landing"
    _land_growing(spark, sf_dir, f"{zone}/early", 0)
    ingest.run_available_now(spark, f"{zone}/*", root, schema=None, widened="group", gold="none")
    _land_growing(spark, sf_dir, f"{zone}/later", 1)
    ingest.run_available_now(spark, f"{zone}/*", root, schema=None, widened="group", gold="none")
    merged = tables.load_schema(spark, f"{root}/_schema/versions")
    return _grown(ingest.read_bronze(spark, root, merged))


@register("streaming_gold_incremental", oracle.STREAMING_GOLD_REFRESH)
def streaming_gold_incremental(spark, sf_dir):
    """Gold brought up to date after each of three runs from the batches that were new."""
    from ..streaming import ingest
    root = scratch_path(spark, "gold-state")
    for number in range(3):
        _land_chunk(spark, sf_dir, f"{root}/landing", number)
        ingest.run_available_now(spark, f"{root}/landing/*", root, schema=BRONZE_KEYED, gold="incremental")
    g = tables.read_published(spark, root, "gold_customer_analytics")
    return g.select("customer_id", "total_events", _mean9(), "total_anomalies")


@register("customer_events_lookup", oracle.CUSTOMER_EVENTS_LOOKUP)
def customer_events_lookup(spark, sf_dir):
    """All events of one customer from published silver in order of time: Bloom filters skip the other row groups."""
    root = scratch_path(spark, "silver")
    tables.publish(_silver(spark, sf_dir), root, "silver", sort_within=["event_time"], bloom={"customer_id": 100_000})
    found = tables.read_published(spark, root, "silver").where(F.col("customer_id") == oracle.LOOKUP_ID)
    return found.select("event_id", "customer_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "latency_ms")


@register("knowledge_index_merge", oracle.KNOWLEDGE_INDEX_SYNC)
def knowledge_index_merge(spark, sf_dir):
    """The index of ``knowledge_index_sync`` kept by change files: the triggered stream rewrites touched buckets only."""
    from ..streaming import index_merge
    old, new = _snapshots(spark, sf_dir)
    root = scratch_path(spark, "index-merge")
    index_merge.upserts(old, 1).write.parquet(f"{root}/changes/run=1")
    index_merge.merge_changes(spark, f"{root}/changes/*", f"{root}/index")
    gone = old.join(new.select("id"), "id", "left_anti")
    index_merge.upserts(new, 2).unionByName(index_merge.deletes(gone, 2)).write.parquet(f"{root}/changes/run=2")
    index_merge.merge_changes(spark, f"{root}/changes/*", f"{root}/index")
    return index_merge.read_index(spark, f"{root}/index").select("id", "text_hash", *_shape())


@register("vector_topk_blocks", oracle.VECTOR_TOPK)
def vector_topk_blocks(spark, sf_dir):
    """``vector_topk`` over blocks that bounds let it skip; the queries stay a table."""
    emb = adapters.read_table(spark, sf_dir, "embeddings")
    queries = knowledge.centroids(emb, "label").select(F.col("label").alias("query_label"), F.col("centroid"))
    hits = vector_search.knn_blocks(emb, queries, 3, id_col="vec_id", qid_col="query_label", qvec_col="centroid")
    return hits.select("query_label", "vec_id", F.round("score", 6).alias("score"), "rank")


@register("knowledge_term_weights", oracle.KNOWLEDGE_TERM_WEIGHTS)
def knowledge_term_weights(spark, sf_dir):
    """Frequency and corpus weight of every term of every knowledge chunk."""
    w = text_weights.term_weights(adapters.knowledge_source(adapters.read_table(spark, sf_dir, "documents")))
    return w.select("id", "term", "tf", F.round("weight", 9).alias("weight"))


@register("customers_in_week", oracle.CUSTOMERS_IN_WEEK)
def customers_in_week(spark, sf_dir):
    """Distinct customers of each day and the six days before it, from bitmaps that three increments built."""
    root = scratch_path(spark, "distinct")
    silver = _silver(spark, sf_dir)
    for number in range(3):
        distinct.absorb(spark, silver.where(F.pmod("event_id", F.lit(3)) == number), root)
    return distinct.distinct_in_window(spark, root, 7).select(F.col("day").alias("timestamp_date"), "customers")


def _stored_calls(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "calls")
    governance.store_calls(adapters.calls_from_events(adapters.read_table(spark, sf_dir, "events")), path)
    return spark.read.parquet(path)


@register("stored_call_decisions", oracle.GOVERNANCE_DECISIONS)
def stored_call_decisions(spark, sf_dir):
    """The decisions of ``governance_decisions`` over calls whose parameters were stored as shredded VARIANT."""
    decided = governance.decide(_stored_calls(spark, sf_dir), governance.registry_frame(spark))
    return decided.select("call_id", "function", "allowed", "control")


@register("stored_call_scores", oracle.ANOMALY_SCORES_LATERAL)
def stored_call_scores(spark, sf_dir):
    """Scores for the targets of stored calls: the scan reads the one shredded parameter."""
    asked = _stored_calls(spark, sf_dir).where(F.col("function") == sql_functions.SCORE_FUNCTION)
    asked = asked.select("call_id", governance.stored_parameter("target_id").alias("customer_id"))
    return _scores_out(analytics.scores(_gold(spark, sf_dir))).join(asked, "customer_id").select(
        "call_id", "customer_id", "total_events", "total_anomalies", "mean_latency_ms", "risk_factor")


@register("knowledge_search", oracle.KNOWLEDGE_SEARCH)
def knowledge_search(spark, sf_dir):
    """Retrieval over the index that change files built: the five best scores of every hundredth chunk of the new snapshot."""
    from ..streaming import index_merge
    old, new = _snapshots(spark, sf_dir)
    root = scratch_path(spark, "search")
    embedder = text_weights.weighted_embedder(new, oracle.SEARCH_BUCKETS)
    index_merge.upserts(old, 1).write.parquet(f"{root}/changes/run=1")
    index_merge.merge_changes(spark, f"{root}/changes/*", f"{root}/index", embedder=embedder)
    gone = old.join(new.select("id"), "id", "left_anti")
    index_merge.upserts(new, 2).unionByName(index_merge.deletes(gone, 2)).write.parquet(f"{root}/changes/run=2")
    index_merge.merge_changes(spark, f"{root}/changes/*", f"{root}/index", embedder=embedder)
    asked = embedder(new.where(F.pmod("id", F.lit(100)) == 0)).where(F.exists("embedding", lambda x: x != 0))
    hits = vector_search.knn_blocks(index_merge.read_index(spark, f"{root}/index"),
                                    asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec")), 5)
    return hits.select("query_id", "rank", F.round("score", 5).alias("score"))
