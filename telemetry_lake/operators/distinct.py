"""Exact distinct counts over versions, from stored bitmaps (FUN-3, AGG-8).

Every customer gets a number the first time it is seen (``dictionary``); numbers are dense and never change.  Per day and
bucket of 32,768 numbers a bitmap says which customers had events (``bitmaps``).  A refresh reads the new rows only: their
distinct (day, customer) pairs, which a hot customer does not enlarge, become bitmaps that are merged with the stored ones.
The distinct customers of any set of days are the bits of the union of their bitmaps; no row is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from .ranking import global_rank

DICTIONARY, BITMAPS = "customer_numbers", "customer_bitmaps"


def _stored(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    return tables.read_published(spark, root, name) if tables.current_version(spark, root, name) else None


def absorb(spark: SparkSession, rows: DataFrame, root: str, *, id_col: str = "customer_id", day_col: str = "timestamp_date") -> None:
    """Add new rows to the stored dictionary and bitmaps; rows without an id or a day count nowhere."""
    seen = rows.select(F.col(id_col).alias("id"), F.col(day_col).alias("day")).where("id IS NOT NULL AND day IS NOT NULL").distinct()
    known = _stored(spark, root, DICTIONARY)
    ids = seen.select("id").distinct()
    fresh = ids if known is None else ids.join(known.select("id"), "id", "left_anti")
    taken = 0 if known is None else known.count()
    numbered = global_rank(fresh, [F.asc("id")]).select("id", (F.col("rank") - 1 + taken).cast("long").alias("number"))
    tables.publish(numbered if known is None else known.unionByName(numbered), root, DICTIONARY, sort_within=["id"],
                   comment="A dense number for every customer ever seen.")
    numbers = tables.read_published(spark, root, DICTIONARY)
    bits = (seen.join(numbers, "id").groupBy("day", F.bitmap_bucket_number("number").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")))
    old = _stored(spark, root, BITMAPS)
    if old is not None:
        bits = old.unionByName(bits).groupBy("day", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    tables.publish(bits, root, BITMAPS, sort_within=["day", "bucket"], comment="Customers with events per day, as bitmaps.")


def distinct_in_window(spark: SparkSession, root: str, days: int) -> DataFrame:
    """(day, customers): distinct customers with events on the day or the ``days`` - 1 days before it, per day that has any."""
    bitmaps = tables.read_published(spark, root, BITMAPS)
    present = bitmaps.select("day").distinct()
    reach = bitmaps.select(F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("day"), "bucket", "bitmap")
    union = reach.groupBy("day", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return (union.join(present, "day", "left_semi").groupBy("day")
            .agg(F.sum(F.bitmap_count("bitmap")).alias("customers")))
