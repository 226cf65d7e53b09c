"""Incremental medallion ingestion with Structured Streaming.

* landing NDJSON -> bronze Parquet: file source with a pinned schema, each
  file processed once (checkpointed file log), ``trigger(availableNow)``;
  a malformed line becomes a bronze row that keeps its text (STR-1, SRC-2)
* bronze -> silver and rejected: one stream, the same ``silver`` function on
  each micro-batch, partitioned by date; malformed lines and rows removed by
  drop rules go to the rejected table with the rules they failed and the
  payload masked; ``fail`` rules abort the stream (STR-2, SRC-6, SCL-7, EXP-4)
* one commit per micro-batch (``commits``): kept, rejected and corrupt rows
  of a batch are visible together or not at all, with their counts, so
  kept + rejected + corrupt = landed also after a crash between the sinks.  A
  run reports the counts of the batches it committed and scans nothing (STR-3)
* gold refresh: batch recompute over the whole silver table and publish a
  new version (STR-4).  Gold cannot be a streaming aggregate: one new event
  moves the population threshold and can reclassify any past event.
* schema growth: files not yet inferred (by a log of their paths) are
  inferred and merged with the stored schema, and the stream restarts on the
  same checkpoint with the merged schema.

Checkpoints live under the shared ``spark.checkpoint.dir``; a lost executor
or a restarted driver resumes from the last committed micro-batch.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ANOMALY_SIGMA
from ..functions.expressions import masked_payload
from ..operators import medallion
from ..operators.expectations import SILVER_RULES, apply_expectations, failed_rules
from ..schemas import BRONZE
from ..session import scratch_path
from ..sources import landing, tables
from . import commits, gold_state

RUN = "ingest_run"
# A file's age never decides whether it is ingested; only the log of seen files does.
NO_AGE_LIMIT = "36500d"
# Files whose schema is inferred in one pass.
INFERRED = 10_000
# Distinct customers expected in a row group of silver: sizes its Bloom filter, which lookups skip files by.
CUSTOMERS = 100_000
CORRUPT_KIND, QUARANTINE_KIND = "corrupt", "quarantine"


# The commit records of the two streams, read as tables.
BRONZE_LOG = T.StructType([T.StructField("batch", T.StringType()), T.StructField("run", T.StringType()),
                           T.StructField("rows", T.LongType()), T.StructField("corrupt", T.LongType())])
SILVER_LOG = T.StructType([*BRONZE_LOG.fields, T.StructField("kept", T.LongType()), T.StructField("rejected", T.LongType()),
                           T.StructField("violations", T.MapType(T.StringType(), T.LongType()))])


def stored_bronze(schema: T.StructType) -> T.StructType:
    """The bronze table's schema: the landed fields, the text of a malformed line, the run."""
    return T.StructType(landing.with_corrupt(schema).fields + [T.StructField(RUN, T.StringType(), True)])


def _run(stream: DataFrame, sink, checkpoint: str) -> None:
    """Hand every available micro-batch to ``sink(batch, batch name)``, then stop."""
    spark, stream_name = stream.sparkSession, []

    def each(batch: DataFrame, number: int) -> None:
        if not stream_name:
            stream_name.append(commits.stream_id(spark, checkpoint))
        sink(batch, commits.batch_name(stream_name[0], number))

    (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .start().awaitTermination())


def _write(df: DataFrame, path: str, counts: dict, partition_by: str | None = None, bloom: dict[str, int] | None = None) -> dict:
    """Write one output of a batch, over what an earlier attempt left; returns ``counts`` of the rows written."""
    seen = Observation()
    watched = df.observe(seen, *[c.alias(name) for name, c in counts.items()])
    writer = tables.with_bloom(watched.write.mode("overwrite"), bloom)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return {name: seen.get[name] or 0 for name in counts}


def _read_appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What was appended under ``path`` (nothing before the first run)."""
    if not tables.path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _limited(reader, max_files_per_trigger: int | None):
    reader = reader.option("maxFileAge", NO_AGE_LIMIT)
    return reader.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else reader


def landing_to_bronze(spark: SparkSession, landing_dir: str, bronze_dir: str, checkpoint: str, *,
                      schema: T.StructType = BRONZE, max_files_per_trigger: int | None = None,
                      commits_dir: str | None = None, archive_dir: str | None = None) -> dict:
    """Append every not-yet-seen landing file to bronze, then stop.

    With ``archive_dir`` (outside the landing zone) files move there once the batch that read them is followed by another
    one, so a run lists the new files and those of the last batch before it, not the zone's history.  Returns the run's name
    and its exact numbers of rows and malformed lines.
    """
    run = uuid.uuid4().hex
    log = commits_dir or f"{bronze_dir}_commits"
    done = {"run": run, "rows": 0, "corrupt": 0, "batches": []}

    def sink(batch: DataFrame, name: str) -> None:
        if commits.is_committed(spark, log, name):
            return
        got = _write(batch.withColumn(RUN, F.lit(run)), commits.batch_path(bronze_dir, name),
                     {"rows": F.count(F.lit(1)), "corrupt": F.count(landing.CORRUPT)})
        commits.commit(spark, log, name, {"run": run, **got})
        done["batches"].append(name)
        for key in got:
            done[key] += got[key]

    commits.discard_in_flight(spark, bronze_dir, log)
    reader = spark.readStream.schema(landing.with_corrupt(schema)).option("columnNameOfCorruptRecord", landing.CORRUPT)
    if archive_dir:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    _run(_limited(reader, max_files_per_trigger).json(landing_dir), sink, checkpoint)
    return done


def _rejected(bronze: DataFrame, rules) -> DataFrame:
    """Malformed lines and rows that a drop rule removes; raw payload and context stay in bronze (D3)."""
    drop = [r for r in rules if r.action == "drop"]
    corrupt = F.col(landing.CORRUPT).isNotNull()
    names = F.when(~corrupt, F.array_join(failed_rules(drop), ",")) if drop else F.lit(None).cast("string")
    kept = [c for c in ("event_id", "customer_id", "timestamp", "event_type") if c in bronze.columns]
    return (bronze.withColumn("failed_rules", names).where(corrupt | (F.col("failed_rules") != ""))
            .select(F.when(corrupt, F.lit(CORRUPT_KIND)).otherwise(F.lit(QUARANTINE_KIND)).alias("kind"), *kept,
                    F.col(landing.CORRUPT).alias("raw_line"),
                    F.when(~corrupt, masked_payload(F.col("context.pii"), F.col("payload"), True)).alias("masked_payload"),
                    "failed_rules", RUN))


def _valid(bronze: DataFrame, rules) -> DataFrame:
    """Silver rows with the warn rules they violate and the run that wrote them."""
    warn = [r for r in rules if r.action == "warn"]
    warned = F.array_join(failed_rules(warn), ",") if warn else F.lit("")
    good = apply_expectations(bronze.where(F.col(landing.CORRUPT).isNull()), rules)
    return medallion.silver(good.withColumn("warnings", warned), (), ingest_time=True, keep=("event_id", "warnings", RUN))


def _names_rule(column: str, rule) -> Column:
    """How many rows name the rule in a comma-separated column."""
    return F.count_if(F.coalesce(F.array_contains(F.split(column, ","), rule.name), F.lit(False)))


def silver_schema(spark: SparkSession, schema: T.StructType = BRONZE, rules=SILVER_RULES) -> T.StructType:
    return _valid(spark.createDataFrame([], stored_bronze(schema)), rules).schema


def rejected_schema(spark: SparkSession, schema: T.StructType = BRONZE, rules=SILVER_RULES) -> T.StructType:
    return _rejected(spark.createDataFrame([], stored_bronze(schema)), rules).schema


def bronze_to_silver(spark: SparkSession, bronze_dir: str, silver_dir: str, checkpoint: str, *,
                     schema: T.StructType = BRONZE, rules=SILVER_RULES, rejected_dir: str | None = None,
                     max_files_per_trigger: int | None = None, commits_dir: str | None = None,
                     stored: T.StructType | None = None) -> dict:
    """Append new bronze files to silver and the rows it refuses to ``rejected_dir``, then stop.

    Both tables of a micro-batch are covered by one commit record, which also holds its counts.  A ``fail`` rule aborts the
    stream before anything of the batch is committed.  ``stored`` is the schema of the bronze files where it is narrower than
    ``schema``: their rows are cast.  Returns the exact counts of this run: rows checked and violations by rule.
    """
    run = uuid.uuid4().hex
    rejected_dir = rejected_dir or f"{silver_dir}_rejected"
    log = commits_dir or f"{silver_dir}_commits"
    done = {"run": run, "rows": 0, "corrupt": 0, "violations": {r.name: 0 for r in rules}, "batches": []}
    warn, drop = ([r for r in rules if r.action == a] for a in ("warn", "drop"))

    def sink(batch: DataFrame, name: str) -> None:
        if commits.is_committed(spark, log, name):
            return
        rows = widen_rows(batch, stored_bronze(schema)).withColumn(RUN, F.lit(run))
        kept = _write(_valid(rows, rules), commits.batch_path(silver_dir, name),
                      {"rows": F.count(F.lit(1)), **{r.name: _names_rule("warnings", r) for r in warn}}, "timestamp_date",
                      {"customer_id": CUSTOMERS})
        refused = _write(_rejected(rows, rules), commits.batch_path(rejected_dir, name),
                         {"rows": F.count(F.lit(1)), "corrupt": F.count_if(F.col("kind") == CORRUPT_KIND),
                          **{r.name: _names_rule("failed_rules", r) for r in drop}})
        violations = {r.name: kept.get(r.name, 0) + refused.get(r.name, 0) for r in rules}
        counts = {"rows": kept["rows"] + refused["rows"] - refused["corrupt"], "corrupt": refused["corrupt"],
                  "kept": kept["rows"], "rejected": refused["rows"] - refused["corrupt"]}
        commits.commit(spark, log, name, {"run": run, **counts, "violations": violations})
        done["batches"].append(name)
        for key in ("rows", "corrupt"):
            done[key] += counts[key]
        for rule, n in violations.items():
            done["violations"][rule] += n

    bronze = _limited(spark.readStream.schema(stored_bronze(stored or schema)), max_files_per_trigger).parquet(bronze_dir)
    _run(bronze, sink, checkpoint)
    return done


def widen_rows(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` from rows whose types may be narrower."""
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def refresh_gold(spark: SparkSession, silver_dir: str, gold_root: str, *, sigma: float = ANOMALY_SIGMA,
                 name: str = "gold_customer_analytics") -> str:
    """Recompute gold over the whole silver table and publish a new version."""
    silver = spark.read.parquet(silver_dir)
    return tables.publish(medallion.gold(silver, sigma), gold_root, name, sort_within=["customer_id"],
                          comment="Per-customer totals, mean latency and anomalies (population threshold).")


def run_available_now(spark: SparkSession, landing_dir: str, root: str, *, schema: T.StructType | None = BRONZE,
                      rules=SILVER_RULES, sigma: float = ANOMALY_SIGMA, widened: str = "refuse",
                      max_files_per_trigger: int | None = None, archive_dir: str | None = None, gold: str = "full") -> dict:
    """One incremental refresh: landing -> bronze -> silver streams, then gold.

    ``gold`` is recomputed from all of silver ("full"), brought up to date from the new batches ("incremental",
    ``gold_state``) or left alone ("none").

    With ``schema=None`` the schema is the stored one merged with what the new files hold (``evolve_schema``).  Bronze files
    stay as they are when a stored field's type widens: with ``widened="group"`` the rows that follow go to a new group of
    bronze files of the wider schema, and readers cast the earlier groups (``read_bronze``); with "refuse" such a run is
    refused before anything is ingested.
    """
    root = root.rstrip("/")
    added: list[str] = []
    if schema is None:
        schema, added, wider = evolve_schema(spark, landing_dir, f"{root}/_schema")
        if wider and widened == "refuse" and tables.path_exists(spark, f"{root}/bronze"):
            raise ValueError(f"landed types grew ({'; '.join(wider)}); bronze under {root} holds the narrower type, "
                             "ingest with widened='group' or into a new root")
    groups = bronze_groups(spark, root, schema)
    log = f"{root}/_commits/bronze"
    for group, _ in groups:  # what a run that stopped left behind may be in an earlier group
        commits.discard_in_flight(spark, bronze_path(root, group), log)
    b = landing_to_bronze(spark, landing_dir, bronze_path(root, groups[-1][0]), f"{root}/_checkpoints/bronze", schema=schema,
                          commits_dir=log, max_files_per_trigger=max_files_per_trigger, archive_dir=archive_dir)
    checked = {"rows": 0, **{r.name: 0 for r in rules}}
    batches = []
    for group, stored in groups:
        drained = f"group-{group}"
        path = bronze_path(root, group)
        if commits.is_committed(spark, f"{root}/_commits/drained", drained) or not tables.path_exists(spark, path):
            continue
        s = bronze_to_silver(spark, path, f"{root}/silver", f"{root}/_checkpoints/silver-{group}", schema=schema, stored=stored,
                             rules=rules, rejected_dir=f"{root}/rejected", commits_dir=f"{root}/_commits/silver",
                             max_files_per_trigger=max_files_per_trigger)
        checked["rows"] += s["rows"]
        for rule, n in s["violations"].items():
            checked[rule] += n
        batches += s["batches"]
        if group != groups[-1][0]:  # nothing is added to it any more
            commits.commit(spark, f"{root}/_commits/drained", drained, {})
    gold_version = None
    if gold == "full":
        gold_version = refresh_gold(spark, f"{root}/silver", root, sigma=sigma)
    elif gold == "incremental":
        gold_version = gold_state.refresh_gold_incremental(spark, f"{root}/silver", f"{root}/_commits/silver", root,
                                                           sigma=sigma)["gold_version"]
    return {"bronze_rows": b["rows"], "corrupt_rows": b["corrupt"], "silver_input_rows": checked["rows"],
            "expectations": checked, "added_columns": added, "gold_version": gold_version, "batches": batches}


def bronze_path(root: str, group: int) -> str:
    return f"{root}/bronze/schema_group={group}"


def bronze_groups(spark: SparkSession, root: str, schema: T.StructType) -> list[tuple[int, T.StructType]]:
    """(group, schema its files can be read with) of bronze, oldest first; the last one takes new rows.

    A group ends where a stored type widened.  Its files are read with the fields of ``schema``, in the types they had then.
    """
    records = tables.schema_records(spark, f"{root}/_schema/versions")
    starts = [0] + [i for i, r in enumerate(records) if any(landing.WIDENED in c for c in r["changes"])]
    ends = [*starts[1:], len(records)]
    out = []
    for group, end in enumerate(ends, 1):
        narrow = T.StructType.fromJson(records[end - 1]["schema"]) if records else schema
        out.append((group, landing.with_types_of(schema, narrow)))
    return out


def read_bronze(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All committed bronze rows in the current schema, whatever the types of the files they are in."""
    root = root.rstrip("/")
    parts = [widen_rows(commits.read_committed(spark, bronze_path(root, group), f"{root}/_commits/bronze", stored_bronze(stored)),
                        stored_bronze(schema)) for group, stored in bronze_groups(spark, root, schema)]
    return reduce(DataFrame.unionByName, parts)


def evolve_schema(spark: SparkSession, landing_dir: str, schema_path: str) -> tuple[T.StructType, list[str], list[str]]:
    """Merge the stored landing schema with what the files now contain.

    Returns ``(schema, added columns, widened columns)``.  The paths already
    inferred are logged beside the schema; every other file is inferred,
    whatever its age, and logged once the merged schema is stored.
    """
    landing.require_landing(spark, landing_dir)
    log = f"{schema_path}/files"
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(landing_dir)
              .select("path", "modificationTime"))  # a listing: contents are not read
    seen = _read_appended(spark, log, listed.schema)
    fresh = listed.join(seen, ["path", "modificationTime"], "left_anti")
    stored = tables.load_schema(spark, f"{schema_path}/versions")
    at = scratch_path(spark, "new-files")
    fresh.write.parquet(at)
    fresh = spark.read.schema(listed.schema).parquet(at)
    merged, batch = stored, []
    for row in fresh.select("path").toLocalIterator():  # at most INFERRED paths are held at a time
        batch.append(row["path"])
        if len(batch) == INFERRED:
            merged, batch = _merged(spark, merged, batch), []
    if batch:
        merged = _merged(spark, merged, batch)
    if merged is None or fresh.isEmpty():
        return stored, [], []
    added = [] if stored is None else landing.added_columns(stored, merged)
    widened = [] if stored is None else landing.widened_columns(stored, merged)
    if stored is None or added or widened:
        tables.save_schema(spark, merged, f"{schema_path}/versions", changes=added + widened)
    fresh.coalesce(1).write.mode("append").parquet(log)
    return merged, added, widened


def _merged(spark: SparkSession, stored: T.StructType | None, paths: list[str]) -> T.StructType:
    incoming = landing.infer_schema(spark, paths)
    return incoming if stored is None else landing.merge_schema(stored, incoming)
