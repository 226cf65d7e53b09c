"""Variable-capacity best-fit packing of token sequences.

Several sequence lengths are permitted.  A text longer than the longest is cut into consecutive pieces, so every token
has exactly one place.  Pieces (lengths only, never text) are dealt to shards of about ``SHARD_ROWS`` and each shard is
packed by best-fit decreasing: a piece goes to the open bin with the least room that still holds it.  If there is none, a bin
is opened in the size that costs least per token: every permitted size that holds the piece is filled, in thought, with the
longest of the pieces still to come that fit, and the size of least cost / tokens filled is opened (ties: the smaller).  At
the end each bin is downsized to the smallest permitted size that holds its contents.

A bin costs ``BIN_COST`` (the fixed price of a sequence) + its size + size ** 2 / ``ATTENTION`` (attention grows with the
square of the length), so sizes compete: long bins leave less room unused, short ones are cheaper per token.  The plans that
always open one size are made too and the cheapest of all is kept, so mixing sizes never costs more than any single one.

Defined cases: NULL or empty text has one token (the end mark); equal rows are packed as separate rows; an empty table
gives no rows; NULL ids are kept; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, written

CAPACITIES = (512, 1024, 2048, 4096)
BIN_COST = 32
ATTENTION = 16_384
SHARD_ROWS = 20_000
PLACES = ("doc_id long, piece long, n_pieces long, start long, length long, bin_id long, bin_capacity long, "
          "bin_used long, bin_offset long")


def bin_costs(sizes: np.ndarray, bin_cost: float = BIN_COST, attention: float | None = None) -> np.ndarray:
    """Cost of a bin of each size; without ``attention`` its length and the fixed price only."""
    sizes = np.asarray(sizes, np.float64)
    return bin_cost + sizes + (sizes ** 2 / attention if attention else 0)


class Waiting:
    """How many pieces of each length are still to be placed."""

    def __init__(self, lengths: np.ndarray):
        kinds, counts = np.unique(lengths, return_counts=True)
        self.kinds, self.counts = kinds.tolist(), dict(zip(kinds.tolist(), counts.tolist()))

    def take(self, n: int) -> None:
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.counts[n], self.kinds[bisect_left(self.kinds, n)]

    def filled(self, room: int) -> int:
        """Tokens that the longest waiting pieces, one after the other, bring into ``room``."""
        left = room
        end = bisect_right(self.kinds, left)
        while end:
            n = self.kinds[end - 1]
            left -= n * min(self.counts[n], left // n)
            end = min(end - 1, bisect_right(self.kinds, left))
        return room - left


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], prefer: int | None,
             costs: dict[int, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each piece, contents of each bin).

    A new bin has size ``prefer``, or the least one that holds the piece; with ``prefer`` None, the size whose cost per
    token, filled from the pieces that wait, is least.
    """
    room: dict[int, list[int]] = {}
    sizes: list[int] = []
    used: list[int] = []
    place = np.empty(len(lengths), np.int64)
    waiting = Waiting(lengths) if prefer is None else None
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if waiting:
            waiting.take(n)
        at = bisect_left(sizes, n)
        if at < len(sizes):
            left = sizes[at]
            stack = room[left]
            b = stack.pop()
            if not stack:
                del room[left], sizes[at]
        else:
            if waiting:
                left = min((c for c in capacities if c >= n), key=lambda c: (costs[c] / (n + waiting.filled(c - n)), c))
            else:
                left = prefer if n <= prefer else min(c for c in capacities if c >= n)
            b = len(used)
            used.append(0)
        place[i] = b
        used[b] += n
        if left > n:
            if left - n in room:
                room[left - n].append(b)
            else:
                room[left - n] = [b]
                insort(sizes, left - n)
    return place, np.asarray(used, np.int64)


def pack_lengths(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST,
                 attention: float | None = None):
    """(bin, bin size after downsizing, contents of the bin) of each piece under the cheapest plan."""
    sizes = np.asarray(sorted(capacities), np.int64)
    cost_of = bin_costs(sizes, bin_cost, attention)
    best = None
    for prefer in [None, *sizes.tolist()]:
        place, used = best_fit(lengths, tuple(sizes.tolist()), prefer, dict(zip(sizes.tolist(), cost_of.tolist())))
        final = np.searchsorted(sizes, used)
        cost = float(cost_of[final].sum())
        if best is None or cost < best[0]:
            best = (cost, place, sizes[final], used)
    _, place, final, used = best
    return place, final[place], used[place]


def token_count(text: str = "text"):
    """Words of the whole text and one end mark."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long") + 1


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST,
         shard_rows: int = SHARD_ROWS, attention: float | None = ATTENTION) -> DataFrame:
    """One row per piece of every document with its place in a bin (``PLACES``)."""
    longest = max(capacities)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_count().alias("n"))
    pieces = (counted.withColumn("n_pieces", F.ceil(F.col("n") / longest).cast("long"))
              .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 1)))
              .select("doc_id", "piece", "n_pieces", (F.col("piece") * longest).alias("start"),
                      F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).alias("length"),
                      F.monotonically_increasing_id().alias("row")))
    pieces = written(pieces, "pack-pieces")  # the row numbers above hold from here on
    shards = max(1, -(-pieces.count() // shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        place, size, used = pack_lengths(pdf["length"].to_numpy(np.int64), capacities, bin_cost, attention)
        out = pdf[["doc_id", "piece", "n_pieces", "start", "length"]].copy()
        out["bin_id"] = (int(pdf["shard"].iloc[0]) << 32) + place
        out["bin_capacity"], out["bin_used"] = size, used
        out["bin_offset"] = out.groupby("bin_id")["length"].cumsum() - out["length"]
        return out

    return dealt.groupBy("shard").applyInPandas(shard, PLACES)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
