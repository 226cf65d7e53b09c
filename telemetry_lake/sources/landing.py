"""Newline-delimited JSON landing zone: write, read, infer, evolve.

* ``write_events``       append event batches as NDJSON files (SNK-1)
* ``require_landing``    clear error when the zone is missing or empty (SRC-5)
* ``read_landing``       pinned-schema scan; blank lines skipped; malformed
                         lines kept in ``_corrupt_record`` (PERMISSIVE) or
                         fatal (FAILFAST) (SRC-1, FLT-P5, D18)
* ``infer_schema``       one inference pass over given files (SRC-3)
* ``merge_schema``       add-new-columns and widen-types evolution (SRC-4)
* ``dashboard_frame``    flattened view used by the dashboards (SRC-8)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import BRONZE
from .tables import _fs

CORRUPT = "_corrupt_record"
WIDENED = " -> "


def write_events(df: DataFrame, path: str, mode: str = "append", compression: str | None = None) -> str:
    """Write rows as NDJSON part files under ``path`` (one file per task)."""
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    w.json(path)
    return path


def require_landing(spark: SparkSession, path: str) -> None:
    """Raise ``FileNotFoundError`` when ``path`` is missing or holds no files (stops at the first file found)."""
    fs, p, _ = _fs(spark, path)
    folders = [s.getPath() for s in (fs.globStatus(p) or [])]
    if not folders:
        raise FileNotFoundError(f"No telemetry found in {path}: no such folder")
    for folder in folders:
        files = fs.listFiles(folder, True)
        while files.hasNext():
            if not files.next().getPath().getName().startswith(("_", ".")):
                return
    raise FileNotFoundError(f"No telemetry found in {path}: the landing zone is empty")


def with_corrupt(schema: T.StructType) -> T.StructType:
    if CORRUPT in schema.fieldNames():
        return schema
    return T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType(), True)])


def read_landing(spark: SparkSession, path: str, schema: T.StructType = BRONZE, *,
                 mode: str = "PERMISSIVE", check: bool = True, recursive: bool = True) -> DataFrame:
    """Scan the landing zone with a pinned schema.

    PERMISSIVE keeps malformed lines as rows whose ``_corrupt_record`` holds
    the raw text (route them with ``split_corrupt``); FAILFAST aborts on the
    first one.  Blank lines produce no rows.
    """
    if check:
        require_landing(spark, path)
    reader = spark.read.option("mode", mode).option("recursiveFileLookup", str(recursive).lower())
    if mode == "PERMISSIVE":
        schema = with_corrupt(schema)
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).json(path)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed rows without the corrupt column, raw malformed lines).

    Apply it to a materialised bronze table: on a raw JSON scan Spark
    refuses a projection whose only data column is the corrupt-record one.
    """
    if CORRUPT not in df.columns:
        return df, df.limit(0)
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("raw_line"))
    return good, bad


def infer_schema(spark: SparkSession, paths) -> T.StructType:
    """The schema of all lines of the given files or folder; malformed lines add nothing."""
    df = spark.read.option("mode", "DROPMALFORMED").json(paths)
    return T.StructType([f for f in df.schema.fields if f.name != CORRUPT])


def widen(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds both: structs and arrays by part, numbers as double, anything else as text."""
    if a == b:
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merge_schema(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widen(a.elementType, b.elementType), True)
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.LongType() if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType) else T.DoubleType()
    return T.StringType()


def merge_schema(stored: T.StructType, incoming: T.StructType) -> T.StructType:
    """Keep every stored field in its place, widen its type to hold what the
    incoming schema has under that name, and append fields that only the
    incoming schema has.  All fields are nullable, so older rows read new
    fields as NULL."""
    by_name = {f.name: f for f in incoming.fields}
    fields = [T.StructField(f.name, widen(f.dataType, by_name[f.name].dataType) if f.name in by_name else f.dataType, True)
              for f in stored.fields]
    known = set(stored.fieldNames())
    fields += [T.StructField(f.name, f.dataType, True) for f in incoming.fields if f.name not in known]
    return T.StructType(fields)


def with_types_of(schema: T.StructType, narrow: T.StructType) -> T.StructType:
    """The fields of ``schema`` in its order, each in the type it has in ``narrow`` if it is there."""
    old = {f.name: f.dataType for f in narrow.fields}

    def typed(name: str, new: T.DataType) -> T.DataType:
        if name not in old:
            return new
        if isinstance(new, T.StructType) and isinstance(old[name], T.StructType):
            return with_types_of(new, old[name])
        return old[name]

    return T.StructType([T.StructField(f.name, typed(f.name, f.dataType), True) for f in schema.fields])


def widened_columns(stored: T.StructType, merged: T.StructType, prefix: str = "") -> list[str]:
    """``name: old -> new`` of the stored fields whose type changed."""
    out = []
    new = {f.name: f.dataType for f in merged.fields}
    for f in stored.fields:
        t = new[f.name]
        if isinstance(f.dataType, T.StructType) and isinstance(t, T.StructType):
            out += widened_columns(f.dataType, t, f"{prefix}{f.name}.")
        elif f.dataType.simpleString() != t.simpleString():
            out.append(f"{prefix}{f.name}: {f.dataType.simpleString()}{WIDENED}{t.simpleString()}")
    return out


def added_columns(stored: T.StructType, merged: T.StructType, prefix: str = "") -> list[str]:
    """Dotted names present in ``merged`` but not in ``stored``."""
    out = []
    old = {f.name: f for f in stored.fields}
    for f in merged.fields:
        name = prefix + f.name
        if f.name not in old:
            out.append(name)
        elif isinstance(f.dataType, T.StructType) and isinstance(old[f.name].dataType, T.StructType):
            out += added_columns(old[f.name].dataType, f.dataType, name + ".")
    return out


def dashboard_frame(bronze: DataFrame) -> DataFrame:
    """Flatten bronze for dashboards: missing latency is 0, missing pii is
    false, the ISO timestamp is parsed.  No expectation is applied."""
    cols = [F.col(c) for c in ("event_id",) if c in bronze.columns]
    cols += [
        F.col("customer_id"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        F.col("event_type"),
        F.coalesce(F.col("context.latency").cast("double"), F.lit(0.0)).alias("latency"),
        F.coalesce(F.col("context.pii").cast("boolean"), F.lit(False)).alias("is_pii"),
    ]
    return bronze.select(*cols)
