"""Exact duplicates by an extendible-hash index on shared files.

Three Parquet tables under the folder that all executors share hold the index:

* ``pages``: every row's id, normalised text, 64-bit hash of the text (its key) and SHA-256;
* ``directory``: the first bits of a key -> its bucket.  The directory starts with one bucket and doubles as long as a bucket
  holds more than ``capacity`` distinct keys; only overfull buckets split, so several entries may lead to one bucket.  The
  splits are computed from a histogram of key prefixes, not by moving rows;
* ``records``: one row per distinct text, with its bucket, its place in the chain of texts that share its key, its size, and
  the row that stays.

Owner tasks process buckets, that is ranges of keys: a task groups the rows of its buckets by key and compares the texts'
bytes; different texts under one key chain up.  A key with more rows than ``HOT_ROWS`` (and than one in ``HOT_SHARE`` rows) is
dealt over many owners and merged again by bytes.  There are fewer than ``HOT_SHARE`` such keys, whatever the table, which
bounds their broadcast.  Rows meet their record on (key, SHA-256) without text; the hot ones by that broadcast.  All of it
runs on DataFrame functions.

Texts are equal if identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one space.  Of equal texts the row with the smallest
doc_id stays; NULL ids come last, and of rows with the same id exactly one stays.

Defined cases: NULL text is empty, and empty texts are equal to each other (not to one space); repeated rows are copies like
any others; where all copies have NULL ids, keep_id is NULL and one row stays; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Distinct keys a bucket holds before it splits.  Above ``capacity`` * ``DIRECTORY`` keys, buckets grow instead of the directory.
CAPACITY = 2000
DIRECTORY = 1 << 20
#: The deepest prefix that is looked at; keys that share more bits stay in one bucket (its owner sorts and spills).
DEEPEST = 24
HOT_ROWS, HOT_SHARE = 1000, 100_000
#: Rows of hot keys that one owner compares.
HOT_PAGE = 4000
SPACES = r"[\x20\x09-\x0D]+"


def first_bits(key: Column, bits: int) -> Column:
    """The first ``bits`` bits of a 64-bit key as a number (a shift by 64 would be none)."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def page_table(docs: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(row, doc_id, key, sha, text): the normalised texts, written."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACES, " ")
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", hash_of(F.col("text")).alias("key"),
        F.unhex(F.sha2("text", 256)).alias("sha"), "text"), "dedup-pages")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """((slot, bucket, depth), global depth) for a table of distinct keys."""
    n_keys = keys.count()
    capacity = max(capacity, n_keys // DIRECTORY)
    finest = min(DEEPEST, max(0, ceil(log2(max(1, n_keys / capacity)))) + 4)
    while True:
        cells = written(keys.groupBy(first_bits(F.col("key"), finest).alias("cell")).agg(F.count("*").alias("keys")),
                        "dedup-cells")
        if finest == DEEPEST or cells.where(F.col("keys") > capacity).isEmpty():
            break
        finest = min(DEEPEST, finest + 4)
    # every bucket that could exist, from the whole range of keys (depth 0) to the finest cells
    at = F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("depth")
    buckets = (cells.select("cell", "keys", at)
               .groupBy("depth", F.expr(f"shiftrightunsigned(cell, {finest} - depth)").alias("bits"))
               .agg(F.sum("keys").alias("keys")))
    overfull = F.col("keys") > capacity
    # an overfull bucket splits; what it splits into exists, and so does the whole range
    split = buckets.where(overfull & (F.col("depth") < finest)).select(
        (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.expr("shiftleft(bits, 1)"), F.expr("shiftleft(bits, 1) + 1"))).alias("bits"))
    leaves = written(buckets.where(~overfull | (F.col("depth") == finest)).join(split, ["depth", "bits"], "left_semi")
                     .unionByName(buckets.where((F.col("depth") == 0) & (~overfull | F.lit(finest == 0)))), "dedup-leaves")
    deepest = leaves.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    low = F.expr(f"shiftleft(bits, {deepest} - depth)")
    slots = leaves.select("depth", low.alias("bucket"), F.explode(F.sequence(
        low, F.expr(f"shiftleft(bits + 1, {deepest} - depth) - 1"))).alias("slot"))
    return written(slots.select("slot", "bucket", "depth"), "dedup-directory"), deepest


def hot_keys(keys: DataFrame, n_rows: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more rows than ``hot_rows`` and than ``n_rows`` / HOT_SHARE: fewer than HOT_SHARE of them."""
    least = max(hot_rows, n_rows // HOT_SHARE, 1)
    return written(keys.where(F.col("n") > least).select("key", F.lit(True).alias("hot")), "dedup-hot")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, hot_rows: int = HOT_ROWS,
                 hash_of: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index over ``docs``: (pages, directory, records)."""
    pages = page_table(docs, hash_of)
    keys = written(pages.groupBy("key").agg(F.count("*").alias("n")), "dedup-keys")
    n_rows = pages.count()
    slots, depth = directory(keys, capacity)
    hot = hot_keys(keys, n_rows, hot_rows)
    page = F.pmod(F.xxhash64("row"), F.lit(ceil(n_rows / HOT_PAGE) or 1))
    placed = (pages.withColumn("slot", first_bits(F.col("key"), depth)).join(slots, "slot")
              .join(F.broadcast(hot), "key", "left")
              .withColumn("owner", F.when(F.col("hot"), -1 - page).otherwise(F.col("bucket"))))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")).alias("first")
    compared = (placed.repartition("owner").groupBy("owner", "bucket", "key", "sha", "text")
                .agg(F.count("*").alias("n"), first, F.first("hot").alias("hot"))
                .select("bucket", "key", "sha", F.when(F.col("hot"), F.col("text")).alias("text"), "n", "first"))
    merged = (compared.repartition("key").groupBy("bucket", "key", "sha", "text")
              .agg(F.sum("n").alias("n"), F.min("first").alias("first")))
    chained = merged.withColumn("chain", F.row_number().over(Window.partitionBy("key").orderBy("first")))
    records = written(chained.select("bucket", "key", "chain", "sha", "n", F.col("first.doc_id").alias("keep_id"),
                                     F.col("first.row").alias("keep_row")), "dedup-records")
    return pages, slots, records


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, hot_rows: int = HOT_ROWS,
                     hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``."""
    pages, _, records = exact_groups(docs, capacity, hot_rows, hash_of)
    rows = pages.select("row", "doc_id", "key", "sha")
    least = max(hot_rows, pages.count() // HOT_SHARE, 1)
    often, seldom = records.where(F.col("n") > least), records.where(F.col("n") <= least)
    large = F.broadcast(often.select("key", "sha"))
    met = (rows.join(F.broadcast(often), ["key", "sha"])
           .unionByName(rows.join(large, ["key", "sha"], "left_anti").join(seldom, ["key", "sha"])))
    return met.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
), ranked AS (
  SELECT doc_id, text, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
         count(*) OVER (PARTITION BY text) AS group_size
  FROM texts WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(text) AS text_sha256 FROM ranked
"""
