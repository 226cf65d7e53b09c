"""Knowledge index kept up to date by change files: a merge by key that rewrites only the buckets it touches.

Keys are dealt to a fixed number of buckets.  The index is one folder of Parquet files per bucket plus a manifest, an
immutable numbered record that names each bucket's folder.  Change files (key, text, deleted, sequence) are consumed by a
triggered stream (STR-5): the stream's file log knows which ones are new, so a run reads the changes and the buckets they
touch, and nothing else.  Per micro-batch (VEC-1):

* the last change of each key is kept and compared with the stored content hash: a change that leaves the text as it is
  touches nothing;
* texts of inserts and updates are embedded; deletes drop their key;
* the touched buckets are written to new folders, and a new manifest takes their place.  The manifest is the commit: it names
  the batch, so a batch repeated after a crash is recognised, and readers see all of a batch or nothing.

Changes without a key cannot be merged: they are counted in the manifest's record and left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import knowledge
from ..session import scratch_path
from ..sources import tables
from . import commits, ingest

BUCKETS = 64
MANIFEST = "_manifest"


def changes_schema(key_type: T.DataType = T.LongType(), key: str = "id") -> T.StructType:
    """Wire format of a change file; the change of a key with the highest ``seq`` holds."""
    return T.StructType([T.StructField(key, key_type), T.StructField("text_chunk", T.StringType()),
                         T.StructField("deleted", T.BooleanType()), T.StructField("seq", T.LongType())])


def upserts(source: DataFrame, seq: int, *, key: str = "id", text_col: str = "text_chunk") -> DataFrame:
    return source.select(key, F.col(text_col).alias("text_chunk"), F.lit(False).alias("deleted"),
                         F.lit(seq).cast("long").alias("seq"))


def deletes(source: DataFrame, seq: int, *, key: str = "id") -> DataFrame:
    return source.select(key, F.lit(None).cast("string").alias("text_chunk"), F.lit(True).alias("deleted"),
                         F.lit(seq).cast("long").alias("seq"))


def by_hash(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _stored(key_type: T.DataType, key: str) -> T.StructType:
    return T.StructType([T.StructField(key, key_type), T.StructField("text_hash", T.StringType()),
                         T.StructField("embedding", T.ArrayType(T.FloatType()))])


def manifest(spark: SparkSession, root: str) -> dict | None:
    return tables._last_record(spark, f"{root.rstrip('/')}/{MANIFEST}")


def read_index(spark: SparkSession, root: str, *, buckets: list[int] | None = None) -> DataFrame:
    """The current rows of the index, or of some of its buckets."""
    record = manifest(spark, root)
    if record is None:
        raise FileNotFoundError(f"no index under {root}")
    schema = T.StructType.fromJson(record["schema"])
    paths = [p for b, p in record["buckets"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _plan(current: DataFrame, batch: DataFrame, key: str, bucket: Column) -> DataFrame:
    """(key, text_chunk, text_hash, bucket, op) of the last change per key: insert, update, delete or keep."""
    last = (batch.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.max_by(F.struct("text_chunk", F.coalesce("deleted", F.lit(False)).alias("deleted")), F.coalesce("seq", F.lit(0)))
                 .alias("change")))
    changes = last.select(key, "change.text_chunk", "change.deleted",
                          knowledge.content_hash(F.col("change.text_chunk")).alias("text_hash"), bucket.alias("bucket"))
    held = current.select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash"))
    here = F.col("_key").isNotNull()
    op = (F.when(F.col("deleted"), F.when(here, F.lit("delete")).otherwise(F.lit("keep")))
          .when(~here, F.lit("insert")).when(F.col("_hash").eqNullSafe(F.col("text_hash")), F.lit("keep"))
          .otherwise(F.lit("update")))
    return (changes.join(held, F.col(key) == F.col("_key"), "left")
            .select(key, "text_chunk", "text_hash", "bucket", op.alias("op")))


def merge_changes(spark: SparkSession, changes_dir: str, root: str, *, key: str = "id", key_type: T.DataType = T.LongType(),
                  buckets: int = BUCKETS, bucket_of: Callable[[Column, int], Column] = by_hash,
                  embedder: Callable[[DataFrame], DataFrame] | None = None, max_files_per_trigger: int | None = None) -> dict:
    """Merge every not-yet-seen change file into the index, then stop.

    ``buckets`` holds from the first run on.  Returns the changes by kind and the buckets written in this run.
    """
    root = root.rstrip("/")
    schema = _stored(key_type, key)
    done = {op: 0 for op in (*knowledge.OPS, "without_key")} | {"buckets_written": 0}

    def sink(batch: DataFrame, name: str) -> None:
        record = manifest(spark, root) or {"buckets": {}, "n_buckets": buckets, "batch": None}
        if record["batch"] == name:
            return
        bucket = bucket_of(F.col(key), record["n_buckets"])
        changes = scratch_path(spark, "index-changes")
        batch.select(*[f.name for f in changes_schema(key_type, key).fields]).write.parquet(changes)
        new = spark.read.schema(changes_schema(key_type, key)).parquet(changes)
        # at most n_buckets numbers reach the driver, here and below
        reached = [r[0] for r in new.where(F.col(key).isNotNull()).select(bucket.alias("b")).distinct().collect()]
        paths = [record["buckets"][str(b)] for b in reached if str(b) in record["buckets"]]
        current = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        planned = _plan(current, new, key, bucket)
        plan_path = scratch_path(spark, "index-plan")
        planned.write.parquet(plan_path)
        plan = spark.read.schema(planned.schema).parquet(plan_path)
        counts = {r["op"]: r["n"] for r in plan.groupBy("op").agg(F.count(F.lit(1)).alias("n")).collect()}
        touched = sorted(r[0] for r in plan.where("op <> 'keep'").select("bucket").distinct().collect())
        fresh = knowledge.embed(plan.where(F.col("op").isin("insert", "update")), embedder).select(key, "text_hash", "embedding")
        replaced = plan.where(F.col("op").isin("update", "delete")).select(key)
        kept = current.where(bucket.isin(touched)).join(replaced, key, "left_anti")
        rows = kept.unionByName(fresh).withColumn("bucket", bucket)
        version = f"{root}/data/{name}-{uuid.uuid4().hex[:8]}"
        if touched:
            rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(version)
        after = dict(record["buckets"])
        for b in touched:
            path = f"{version}/bucket={b}"
            after.pop(str(b), None)
            if tables.path_exists(spark, path):  # a bucket whose last key was deleted has no folder
                after[str(b)] = path
        without_key = new.where(F.col(key).isNull()).count()
        tables._append_record(spark, f"{root}/{MANIFEST}", {
            "batch": name, "n_buckets": record["n_buckets"], "schema": schema.jsonValue(), "buckets": after,
            "touched": len(touched), "changes": counts, "without_key": without_key})
        for op, n in counts.items():
            done[op] += n
        done["buckets_written"] += len(touched)
        done["without_key"] += without_key

    reader = ingest._limited(spark.readStream.schema(changes_schema(key_type, key)), max_files_per_trigger)
    ingest._run(reader.parquet(changes_dir), sink, f"{root}/_checkpoint")
    return done


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove bucket folders that none of the last ``keep`` manifests names; returns them."""
    import json
    root = root.rstrip("/")
    records = tables._records(spark, f"{root}/{MANIFEST}")[-keep:]
    named = set()
    for _, path in records:
        named |= set(json.loads(spark.read.text(path, wholetext=True).first()[0])["buckets"].values())
    fs, data, _ = tables._fs(spark, f"{root}/data")
    gone = []
    for version in fs.listStatus(data) if fs.exists(data) else []:
        for bucket in fs.listStatus(version.getPath()):
            at = f"{root}/data/{version.getPath().getName()}/{bucket.getPath().getName()}"
            if bucket.isDirectory() and at not in named:
                fs.delete(bucket.getPath(), True)
                gone.append(at)
    return gone
