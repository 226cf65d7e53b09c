"""Published tables: write a new version folder, then add a numbered pointer.

A pointer is an immutable file ``_pointers/<number>.json`` that names a
version; it is written under a temporary name and renamed, and a number that
is already taken makes the writer try the next one.  Readers take the highest
number, so at every moment there is exactly one current version: a failed
write (for example a fail expectation firing mid-job) leaves the previous one,
and two writers cannot interleave.  Files are reached through the Hadoop file
system of the path, so any shared file system works; errors other than "not
there" are raised.  Two writers are safe where a rename refuses an existing
goal (HDFS, local and other POSIX folders through Hadoop); on an object store
that overwrites, one writer per table is assumed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINTERS = "_pointers"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def _records(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, file) of the numbered records in a folder, in order; none if the folder is not there."""
    fs, p, _ = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted((int(n[:-5]), f"{path}/{n}") for n in names if n.endswith(".json") and n[:-5].isdigit())


def _append_record(spark: SparkSession, path: str, record: dict) -> int:
    """Store one JSON record under the next free number (write aside, then rename)."""
    fs, p, jvm = _fs(spark, path)
    fs.mkdirs(p)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}/.new-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(record).encode("utf-8")))
    out.close()
    number = max([n for n, _ in _records(spark, path)], default=0) + 1
    while True:
        goal = jvm.org.apache.hadoop.fs.Path(f"{path}/{number:012d}.json")
        if not fs.exists(goal) and fs.rename(aside, goal):
            return number
        number += 1


def _last_record(spark: SparkSession, path: str) -> dict | None:
    found = _records(spark, path)
    if not found:
        return None
    text = spark.read.text(found[-1][1], wholetext=True).first()[0]
    return json.loads(text)


def with_bloom(writer, bloom: dict[str, int] | None):
    """A Parquet writer that adds Bloom filters: column -> distinct values expected in a row group."""
    for column, distinct in (bloom or {}).items():
        writer = (writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
                        .option(f"parquet.bloom.filter.expected.ndv#{column}", str(distinct)))
    return writer


def publish(df: DataFrame, root: str, name: str, *, partition_by=None, sort_within=None,
            comment: str | None = None, properties: dict | None = None, bloom: dict[str, int] | None = None) -> str:
    """Write ``df`` to ``root/name/v-<id>`` and make it the current version.

    ``comment`` and ``properties`` are stored with the pointer (SNK-3).  With
    ``partition_by`` the rows are rebalanced by those columns first: adaptive
    execution merges small partitions and splits large ones, so a version has
    few files per value instead of one per task and value.  ``bloom`` maps
    columns to the number of distinct values expected in a row group: their
    Parquet Bloom filters let a lookup skip row groups whose minimum and
    maximum enclose the value but that do not hold it.
    """
    spark = df.sparkSession
    version = f"{root.rstrip('/')}/{name}/v-{uuid.uuid4().hex[:12]}"
    out = df.hint("rebalance", *partition_by) if partition_by else df
    if sort_within:
        out = out.sortWithinPartitions(*sort_within)
    w = with_bloom(out.write.mode("error"), bloom)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(version)
    _append_record(spark, f"{root.rstrip('/')}/{name}/{POINTERS}",
                   {"version": version, "comment": comment, "properties": properties or {},
                    "schema": df.schema.jsonValue()})
    return version


def describe(spark: SparkSession, root: str, name: str) -> dict | None:
    """version, comment, properties and schema of the current version; ``None`` if nothing is published."""
    return _last_record(spark, f"{root.rstrip('/')}/{name}/{POINTERS}")


def current_version(spark: SparkSession, root: str, name: str) -> str | None:
    record = describe(spark, root, name)
    return record["version"] if record else None


def read_published(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """The current version, read with the one schema it was written with."""
    record = describe(spark, root, name)
    if record is None:
        raise FileNotFoundError(f"table {name} has not been published under {root}")
    return spark.read.schema(schema or T.StructType.fromJson(record["schema"])).parquet(record["version"])


def save_schema(spark: SparkSession, schema: T.StructType, path: str, changes: list[str] | None = None) -> None:
    """Store a schema and what changed against the previous one, as the next numbered record."""
    _append_record(spark, path, {"schema": schema.jsonValue(), "changes": changes or []})


def schema_records(spark: SparkSession, path: str) -> list[dict]:
    """All stored schemas with their changes, oldest first (one record per change of the schema)."""
    return [json.loads(spark.read.text(f, wholetext=True).first()[0]) for _, f in _records(spark, path)]


def load_schema(spark: SparkSession, path: str) -> T.StructType | None:
    record = _last_record(spark, path)
    return T.StructType.fromJson(record["schema"]) if record else None
