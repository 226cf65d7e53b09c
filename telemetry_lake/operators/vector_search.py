"""Exact top-k by dot product over blocks that can be skipped (VEC-4).

The index is dealt to blocks: a vector goes to the nearest of a bounded number of centres (taken from a bounded sample) and to
a shell by its distance from it.  By Cauchy-Schwarz no vector ``v`` of a block with centre ``c`` and radius ``r`` scores more
than ``q.c + |q| r`` with a query ``q``.  A query's k-th best score among the sample, whose vectors are in the index, is a
score that its k-th best neighbour reaches at least, so blocks whose bound is below it are skipped and nothing is lost.

Queries stay a table: each is routed, inside the task that holds it, to the blocks it has to see; then blocks and queries meet
in one co-grouped pass over the index, whatever the number of queries.  Neighbouring blocks of few rows are gathered until
they hold ``GATHER_ROWS``, so a query travels once for all of them.  Blocks of more than ``BLOCK_ROWS`` rows are dealt to
pieces, and queries to chunks of about ``CHUNK``, so a group is bounded; the index is repeated once per chunk of queries, for
the blocks that chunk needs.  A matrix product finds the candidates of a group, with room for its rounding; the scores that
decide are summed pair by pair, so equal vectors score alike wherever they lie.  What reaches the driver or every task is the sample and one row per block, both bounded by
parameters.

Ties go to the smaller id.  Vectors that are NULL or hold NULL, NaN or infinite components have no similarity; an index vector
of another dimension than the queries fails the job.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .knowledge import finite

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow, not this package

SAMPLE = 2048
CENTRES = 64
SHELLS = 8
BLOCK_ROWS = 20_000
GATHER_ROWS = 8192
CHUNK = 8192
CELLS = 1 << 22
#: Room for rounding in bounds that are compared with scores.
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), d)


def choose_centres(sample: np.ndarray, centres: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds over the sample from evenly drawn vectors of it."""
    if len(sample) <= centres:
        return sample.copy()
    at = sample[np.linspace(0, len(sample) - 1, centres).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(sample, at)[0]
        for c in np.unique(near):
            at[c] = sample[near == c].mean(axis=0)
    return at


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre of each row, distance from it)."""
    square = (x ** 2).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres ** 2).sum(axis=1)[None]
    near = square.argmin(axis=1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(axis=1))


def top_rows(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int,
             own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``v``, score) of the k best of each row of ``q``, ties by id; pairs in ``own`` never count."""
    near = q @ v.T
    if own is not None:
        near[own] = -np.inf
    n = near.shape[1]
    if n > k:
        length = np.sqrt((q ** 2).sum(axis=1)) * np.sqrt((v ** 2).sum(axis=1).max())
        least = np.partition(near, n - k, axis=1)[:, n - k] - SLACK * (1 + length)
        row, col = np.nonzero(~(near < least[:, None]) & (near != -np.inf))
    else:
        row, col = np.nonzero(near != -np.inf)
    score = np.empty(len(row))
    step = max(1, CELLS // max(1, q.shape[1]))
    for lo in range(0, len(row), step):
        score[lo:lo + step] = np.einsum("nd,nd->n", q[row[lo:lo + step]], v[col[lo:lo + step]])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    starts = np.flatnonzero(np.r_[True, np.diff(row) != 0]) if len(row) else np.zeros(0, int)
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    return row[place < k], col[place < k], score[place < k]


def gathered(count: np.ndarray, rows: int = GATHER_ROWS) -> np.ndarray:
    """The group of each block: blocks that follow each other share one while they hold at most ``rows`` rows."""
    group, held = np.zeros(len(count), np.int64), 0
    for i, n in enumerate(count.tolist()):
        held += n
        group[i] = group[i - 1] if i else 0
        if i and held > rows:
            group[i], held = group[i] + 1, n
    return group


@dataclass
class BlockIndex:
    """Blocks of an index: stored rows (id, vector, block), and per block its centre, radius and number of rows."""
    rows: DataFrame
    dimension: int
    centre: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    block: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    id_col: str
    vec_col: str


def build(index: DataFrame, *, id_col: str = "id", vec_col: str = "embedding", sample_rows: int = SAMPLE,
          centres: int = CENTRES, shells: int = SHELLS) -> BlockIndex:
    """Deal the finite vectors of ``index`` to blocks, stored once in the shared folder."""
    spark = index.sparkSession
    usable = index.select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col)).where(finite(vec_col))
    sample = usable.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).collect()  # bounded by sample_rows
    d = len(sample[0][vec_col]) if sample else 0
    sample = [r for r in sample if len(r[vec_col]) == d]
    vectors = np.array([r[vec_col] for r in sample], np.float64).reshape(len(sample), d)
    ids = np.array([r[id_col] for r in sample])
    at = choose_centres(vectors, centres)
    scale = float(nearest(vectors, at)[1].max()) if len(vectors) else 0.0
    out = T.StructType([T.StructField(id_col, index.schema[id_col].dataType), T.StructField(vec_col, T.ArrayType(T.DoubleType())),
                        T.StructField("block", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, distance = nearest(_matrix(batch.column(vec_col), d), at)
                shell = np.minimum(distance / (scale / shells) if scale else 0 * distance, shells - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(vec_col),
                                                  pa.array((near * shells + shell).astype(np.int32)), pa.array(distance)],
                                                 [id_col, vec_col, "block", "distance"])

    same = F.when(F.size(vec_col) == d, F.lit(True)).otherwise(F.raise_error(F.lit(f"index vectors differ from dimension {d}")))
    path = scratch_path(spark, "vector-blocks")
    usable.where(same).mapInArrow(deal, out).write.parquet(path)
    rows = spark.read.schema(out).parquet(path)
    stats = (rows.groupBy("block").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n"))
             .orderBy("block").collect())  # at most centres * shells rows
    block = np.array([r["block"] for r in stats], np.int64)
    return BlockIndex(rows, d, at[block // shells] if len(block) else at, np.array([r["radius"] for r in stats]),
                      np.array([r["n"] for r in stats], np.int64), block, ids, vectors, id_col, vec_col)


def route(index: BlockIndex, queries: DataFrame, k: int, *, qid_col: str, qvec_col: str, exclude_self: bool = False,
          group: np.ndarray | None = None) -> DataFrame:
    """(query id, vector, block) for every block, or every ``group`` of blocks, that may hold one of the query's k best."""
    out = T.StructType([T.StructField(qid_col, queries.schema[qid_col].dataType),
                        T.StructField(qvec_col, T.ArrayType(T.DoubleType())), T.StructField("block", T.IntegerType())])
    d, centre, radius, sample, ids = index.dimension, index.centre, index.radius, index.sample, index.sample_ids
    block = index.block if group is None else group

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, len(sample), len(block)))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                q = _matrix(batch.column(qvec_col), d)
                scores = q @ sample.T
                if exclude_self:
                    own = np.asarray(batch.column(qid_col).to_pylist(), ids.dtype)
                    scores[own[:, None] == ids[None]] = -np.inf
                least = np.full(len(q), -np.inf)
                if scores.shape[1] >= k:
                    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                length = np.sqrt((q ** 2).sum(axis=1))
                bound = q @ centre.T + length[:, None] * radius[None]
                room = SLACK * (1 + length[:, None] * (radius + np.sqrt((centre ** 2).sum(axis=1)))[None])
                row, b = np.nonzero(bound + room >= least[:, None])
                if group is not None and len(b):  # groups rise with their blocks
                    first = np.r_[True, (np.diff(row) != 0) | (np.diff(block[b]) != 0)]
                    row, b = row[first], b[first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(qid_col).take(pa.array(row)), batch.column(qvec_col).take(pa.array(row)),
                     pa.array(block[b].astype(np.int32))], [qid_col, qvec_col, "block"])

    asked = queries.select(qid_col, F.col(qvec_col).cast("array<double>").alias(qvec_col)).where(finite(qvec_col))
    same = F.when(F.size(qvec_col) == d, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"query vectors differ from the index dimension {d}")))
    return asked.where(same).mapInArrow(pick, out)


def search(index: BlockIndex, queries: DataFrame, k: int, *, qid_col: str = "query_id", qvec_col: str = "query_vec",
           exclude_self: bool = False) -> DataFrame:
    """Exact top-k of every query: (query id, id, score, rank)."""
    spark = queries.sparkSession
    id_col, vec_col, d = index.id_col, index.vec_col, index.dimension
    out = T.StructType([T.StructField(qid_col, queries.schema[qid_col].dataType),
                        T.StructField(id_col, index.rows.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    w = Window.partitionBy(qid_col).orderBy(F.desc("score"), F.asc(id_col))
    if not len(index.block):
        return spark.createDataFrame([], out).withColumn("rank", F.row_number().over(w))
    path = scratch_path(spark, "vector-routes")
    group = gathered(index.count)
    routed = route(index, queries, k, qid_col=qid_col, qvec_col=qvec_col, exclude_self=exclude_self, group=group)
    routed.write.parquet(path)
    routed = spark.read.schema(routed.schema).parquet(path)
    asked = routed.groupBy("block").agg(F.count(F.lit(1)).alias("n"))  # at most one row per block
    chunks = {r["block"]: -(-r["n"] // CHUNK) for r in asked.collect()}
    pieces = {g: -(-int(n) // BLOCK_ROWS) for g, n in enumerate(np.bincount(group, weights=index.count).astype(np.int64))}
    of_block = spark.createDataFrame([(int(b), int(g), pieces[g], chunks[g]) for b, g in zip(index.block, group) if g in chunks],
                                     "own int, block int, pieces int, chunks int")
    known = spark.createDataFrame([(g, pieces[g], chunks[g]) for g in chunks], "block int, pieces int, chunks int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = (index.rows.select(id_col, vec_col, F.col("block").alias("own")).join(F.broadcast(of_block), "own")
            .select(id_col, vec_col, "block", F.pmod(F.xxhash64(id_col), "pieces").cast("int").alias("piece"),
                    every("chunks").alias("chunk")))
    posed = (routed.join(F.broadcast(known), "block")
             .select(qid_col, qvec_col, "block", every("pieces").alias("piece"),
                     F.pmod(F.xxhash64(qid_col), "chunks").cast("int").alias("chunk")))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        v, q = _matrix(left[vec_col], d), _matrix(right[qvec_col], d)
        ids, qids = left[id_col].to_numpy(), right[qid_col].to_numpy()
        found = []
        if len(v):
            step = max(1, CELLS // len(v))
            for lo in range(0, len(q), step):
                own = qids[lo:lo + step, None] == ids[None] if exclude_self else None
                row, col, score = top_rows(q[lo:lo + step], v, ids, k, own)
                found.append((row + lo, col, score))
        row, col, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2 + (np.zeros(0),)
        return pa.table([right[qid_col].take(pa.array(row)), left[id_col].take(pa.array(col)), pa.array(score)],
                        names=[qid_col, id_col, "score"])

    keys = ["block", "piece", "chunk"]
    cands = held.groupBy(*keys).cogroup(posed.groupBy(*keys)).applyInArrow(meet, out)
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_blocks(index: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vec_col: str = "embedding",
               qid_col: str = "query_id", qvec_col: str = "query_vec", exclude_self: bool = False, **sizes) -> DataFrame:
    """``build`` and ``search`` in one call."""
    return search(build(index, id_col=id_col, vec_col=vec_col, **sizes), queries, k, qid_col=qid_col, qvec_col=qvec_col,
                  exclude_self=exclude_self)
