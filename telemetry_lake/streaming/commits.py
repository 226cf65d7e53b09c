"""One commit for all sinks of a micro-batch.

A ``foreachBatch`` sink writes each output of a batch to its own folder ``<table>/ingest_batch=<name>`` (overwriting what an
earlier attempt of the same batch left there) and then stores one record ``<log>/<name>.json``.  The record is the commit: a
batch counts in every table or in none.  The name comes from the stream's id, which its checkpoint holds, and the batch's
number, so a batch that Spark repeats after a crash is recognised and skipped, and two streams never share a name.

Readers leave out folders that have no record.  There is at most one such folder per stream: the batch that was being written
when the stream stopped.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import tables

BATCH = "ingest_batch"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the stream of this checkpoint when it first started."""
    text = spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0]
    return json.loads(text)["id"]


def batch_name(stream: str, number: int) -> str:
    return f"b{stream.replace('-', '')[:12]}-{number:09d}"


def batch_path(table: str, name: str) -> str:
    return f"{table}/{BATCH}={name}"


def is_committed(spark: SparkSession, log: str, name: str) -> bool:
    return tables.path_exists(spark, f"{log}/{name}.json")


def commit(spark: SparkSession, log: str, name: str, record: dict) -> None:
    """Store the record of a batch (write aside, then rename); a batch that has one keeps it."""
    fs, folder, jvm = tables._fs(spark, log)
    fs.mkdirs(folder)
    aside, goal = (jvm.org.apache.hadoop.fs.Path(f"{log}/{n}") for n in (f".new-{uuid.uuid4().hex}", f"{name}.json"))
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps({"batch": name, **record}).encode("utf-8")))
    out.close()
    if fs.exists(goal) or not fs.rename(aside, goal):
        fs.delete(aside, False)


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path, _ = tables._fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def committed(spark: SparkSession, log: str) -> set[str]:
    return {n[:-5] for n in _names(spark, log) if n.endswith(".json") and not n.startswith(".")}


def in_flight(spark: SparkSession, table: str, log: str) -> list[str]:
    """Batches that have a folder in the table but no commit."""
    found = {n.split("=", 1)[1] for n in _names(spark, table) if n.startswith(f"{BATCH}=")}
    return sorted(found - committed(spark, log))


def discard_in_flight(spark: SparkSession, table: str, log: str) -> list[str]:
    """Remove what an unfinished batch left in a table; only its one writer may call this, before it starts."""
    left = in_flight(spark, table, log)
    for name in left:
        fs, path, _ = tables._fs(spark, batch_path(table, name))
        fs.delete(path, True)
    return left


def read_committed(spark: SparkSession, table: str, log: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed batches of a table, with the batch they came in."""
    full = T.StructType([f for f in schema.fields if f.name != BATCH] + [T.StructField(BATCH, T.StringType(), True)])
    if not tables.path_exists(spark, table):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(table)
    left = in_flight(spark, table, log)
    return rows.where(~F.col(BATCH).isin(left)) if left else rows


def read_batches(spark: SparkSession, table: str, names: list[str], schema: T.StructType) -> DataFrame:
    """The rows of the named batches only; no other batch is listed."""
    full = T.StructType([f for f in schema.fields if f.name != BATCH] + [T.StructField(BATCH, T.StringType(), True)])
    paths = [p for p in (batch_path(table, n) for n in names) if tables.path_exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", table).parquet(*paths)


def log_frame(spark: SparkSession, log: str, schema: T.StructType) -> DataFrame:
    """The commit records as a table."""
    if not tables.path_exists(spark, log):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{log}/*.json")
