"""Dense 1..N positions over a total order without a single-task window.

``row_number()`` over an unpartitioned window moves every row into one task.
Instead the frame is sorted once (range-partitioned, distributed) and written
to the shared scratch folder together with each row's sorted partition and its
position there.  Everything later reads that one written result: per-partition
counts, their running sum as offsets (one row per partition), and the rows.
Evaluating the sort a second time would sample other range bounds and the
partition numbers would no longer agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

_LOW_BITS = (1 << 33) - 1
_PART, _POS, _OFFSET = "__rank_part", "__rank_pos", "__rank_offset"


def global_rank(df: DataFrame, order_cols, rank_col: str = "rank") -> DataFrame:
    """``df`` plus ``rank_col`` = 1-based position under ``order_cols``.

    ``order_cols`` must define a total order (end with a unique key), so the
    result is deterministic across retries.
    """
    spark = df.sparkSession
    mono = F.monotonically_increasing_id()
    tagged = df.orderBy(*order_cols).select(
        *df.columns, F.shiftright(mono, 33).alias(_PART), mono.bitwiseAND(F.lit(_LOW_BITS)).alias(_POS))
    path = scratch_path(spark, "ranked")
    tagged.write.parquet(path)
    stored = spark.read.schema(tagged.schema).parquet(path)
    counts = stored.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(_OFFSET))
    return (stored.join(F.broadcast(offsets), _PART)
                  .select(*df.columns, (F.col(_OFFSET) + F.col(_POS) + 1).alias(rank_col)))
