"""Approximate nearest neighbours by learned partitions.

A small table takes the same path as a large one, with ``LEAST_PARTS`` parts (fewer only under 8 distinct vectors a part).

The index is fitted on at most ``SAMPLE`` distinct vectors (chosen by a hash of the id): their exact ``GRAPH`` nearest
neighbours form a graph, the graph is cut into parts of nearly equal size with few edges between them, and a small network
(one hidden layer) learns from a vector which parts its neighbours lie in.  Every vector of the table is then indexed in its
most probable part, and a query is routed to its most probable parts.  How many is measured on sample vectors that the
network did not see: as many as cover ``COVER`` of their true neighbours.  All vectors of the routed parts are reranked by
the exact cosine of the original vectors in double precision.

Search runs by blocks: a part is split into blocks of about ``BLOCK`` vectors and its queries into chunks of about ``CHUNK``, and
each block meets each chunk in one task that returns ``k`` rows a query.  So a part, or one vector that many rows share, may
be of any size.  Within a block, only the ``k + 1`` smallest ids of equal vectors can be among the nearest.

Defined cases: vectors that are NULL, empty, zero, or hold NULL or non-finite components take no part, nor do rows without an
id or of another length than the most frequent one; rows that share an id count once, by their least vector; equal scores
go to the smaller id; a query with fewer than ``k`` candidates gets them all; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SAMPLE = 4096
GRAPH = 10
PART_ROWS = 2048
LEAST_PARTS, MOST_PARTS = 8, 64
HIDDEN = 128
COVER = 0.98
BLOCK = 4096
CHUNK = 1024
FOUND = "query_id long, vec_id long, score double"


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, y: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Rows of ``y`` nearest to each row of ``x`` (unit vectors); ``own``: x is y and a row is not its own neighbour."""
    out = np.empty((len(x), min(k, max(len(y) - own, 0))), np.int64)
    for lo in range(0, len(x), 512):
        s = x[lo:lo + 512] @ y.T
        if own:
            s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo:lo + 512] = np.argsort(-s, axis=1, kind="stable")[:, :out.shape[1]]
    return out


def cut_graph(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 12) -> np.ndarray:
    """Part of each vertex: halves along the widest direction, then moves that save cut edges while parts stay balanced."""
    n = len(x)
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        rows, first, many = todo.pop()
        if many == 1 or len(rows) < 2:
            part[rows] = first
            continue
        left = many // 2
        centred = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.svd(centred, full_matrices=False)[2][0]
        order = np.argsort(centred @ axis, kind="stable")
        split = len(rows) * left // many
        todo += [(rows[order[:split]], first, left), (rows[order[split:]], first + left, many - left)]
    u, v = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    most = int(np.ceil(1.15 * n / parts))
    for _ in range(sweeps):
        links = np.bincount(u * parts + part[v], minlength=n * parts).reshape(n, parts)
        goal = links.argmax(axis=1)
        gain = links[np.arange(n), goal] - links[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable")[:np.count_nonzero(gain > 0)].tolist():
            if size[goal[i]] < most:
                size[part[i]] -= 1
                size[goal[i]] += 1
                part[i] = goal[i]
                moved += 1
        if not moved:
            break
    return part


def train(x: np.ndarray, target: np.ndarray, epochs: int = 40, seed: int = 2) -> list[np.ndarray]:
    """Weights of a network with one hidden layer, fitted to the target distributions over parts by Adam."""
    rng = np.random.default_rng(seed)
    width, parts = x.shape[1], target.shape[1]
    w = [rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in w]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            rows = order[lo:lo + 128]
            step += 1
            hidden = np.maximum(x[rows] @ w[0] + w[1], 0)
            delta = (softmax(hidden @ w[2] + w[3]) - target[rows]) / len(rows)
            back = (delta @ w[2].T) * (hidden > 0)
            grads = [x[rows].T @ back, back.sum(axis=0), hidden.T @ delta, delta.sum(axis=0)]
            for p, g, (m, v) in zip(w, grads, state):
                g = g + 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 3e-3 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def route(w: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Parts from the most to the least probable, a row each (rounded, so equal vectors go alike)."""
    z = np.maximum(unit(x) @ w[0] + w[1], 0) @ w[2] + w[3]
    return np.argsort(-np.round(z, 6), axis=1, kind="stable")


def fit(sample: np.ndarray, rows: int, k: int) -> tuple[list[np.ndarray], int]:
    """(network, number of parts a query is routed to) for a table of ``rows`` vectors."""
    x = unit(np.unique(sample, axis=0))
    x = x[np.random.default_rng(1).permutation(len(x))]
    test = len(x) // 8
    x, unseen = x[test:], x[:test]
    parts = max(1, min(MOST_PARTS, max(LEAST_PARTS, -(-rows // PART_ROWS)), len(x) // 8))
    if parts == 1:
        return [np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)], 1
    graph = nearest(x, x, GRAPH, own=True)
    part = cut_graph(x, graph, parts)
    target = 0.5 * np.eye(parts)[part]
    for j in range(graph.shape[1]):
        target[np.arange(len(x)), part[graph[:, j]]] += 0.5 / graph.shape[1]
    w = train(x, target)
    if not test:
        return w, parts
    home = route(w, x)[:, 0]
    order = route(w, unseen)
    rank = np.argsort(order, axis=1)
    at = rank[np.arange(test)[:, None], home[nearest(unseen, x, k, own=False)]]
    covered = [(at < m).mean() for m in range(1, parts + 1)]
    return w, 1 + int(np.argmax(np.asarray(covered) >= COVER))


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row that ``is_query`` holds for."""
    spark = vectors.sparkSession
    clean = (vectors.where(F.col("vec_id").isNotNull() & usable("embedding"))
             .groupBy(F.col("vec_id").cast("long").alias("vec_id"))
             .agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
             .withColumn("is_query", F.coalesce(is_query, F.lit(False))))
    clean = written(clean, "vectors")
    widths = clean.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, rows = int(widths["w"]), int(widths["count"])
    clean = clean.where(F.size("embedding") == width)
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    w, probes = fit(matrix(sample.column("embedding"), width), rows, k)
    network = spark.sparkContext.broadcast(w)  # width x HIDDEN + HIDDEN x MOST_PARTS numbers

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = route(network.value, matrix(batch.column("embedding"), width))[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))],
                                                 [*batch.schema.names, "part"])

    indexed = written(clean.mapInArrow(home, "vec_id long, embedding array<double>, is_query boolean, part int"), "indexed")
    held = {r["part"]: r["n"] for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # parts rows

    def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.asarray([held.get(p, 0) for p in range(len(network.value[3]))])
        for batch in batches:
            if batch.num_rows:
                order = route(network.value, matrix(batch.column("embedding"), width))
                before = np.cumsum(size[order], axis=1) - size[order]
                use = (size[order] > 0) & ((np.arange(order.shape[1]) < probes) | (before < k + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("embedding"),
                     pa.array([o[u].tolist() for o, u in zip(order, use)], pa.list_(pa.int32()))],
                    ["query_id", "query", "parts"])

    queries = (indexed.where("is_query").select("vec_id", "embedding")
               .mapInArrow(targets, "query_id long, query array<double>, parts array<int>")
               .select("query_id", "query", F.explode("parts").alias("part")))
    asked = {r["part"]: r["n"] for r in queries.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # parts rows

    def spread(df: DataFrame, own: str, key: str, size: dict, most: int, other: str, times: dict, per: int) -> DataFrame:
        """``df`` dealt to one of a part's own pieces and repeated for each of the other side's."""
        rows = [(p, -(-size[p] // most), -(-times[p] // per)) for p in sorted(asked)] or [(0, 1, 1)]
        pieces = spark.createDataFrame(rows, "part int, pieces int, repeats int")  # at most MOST_PARTS rows
        return (df.join(F.broadcast(pieces), "part").withColumn(own, F.pmod(F.xxhash64(key), F.col("pieces")))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats").cast("long") - 1)))
                .drop("pieces", "repeats"))

    index_side = spread(indexed.select("vec_id", "embedding", "part"), "block", "vec_id", held, BLOCK, "chunk", asked, CHUNK)
    query_side = spread(queries, "chunk", "query_id", asked, CHUNK, "block", held, BLOCK)

    def rerank(index: pa.Table, asked_: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                          "score": pa.array([], pa.float64())})
        if not index.num_rows or not asked_.num_rows:
            return empty
        ids, x = index.column("vec_id").to_numpy(), matrix(index.column("embedding"), width)
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        new = np.ones(len(ids), bool)
        new[1:] = (x[1:] != x[:-1]).any(axis=1)
        start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        few = np.arange(len(ids)) - start <= k  # the k + 1 smallest ids of equal vectors
        ids, x = ids[few], x[few]
        qid, q = asked_.column("query_id").to_numpy(), matrix(asked_.column("query"), width)
        nx, nq = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", q, q))
        out = []
        for lo in range(0, len(qid), 256):
            rows = np.arange(lo, min(lo + 256, len(qid)))
            s = (q[rows] / nq[rows, None]) @ (x / nx[:, None]).T
            s[ids[None, :] == qid[rows, None]] = -np.inf
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(rows), -2.0)
            r, c = np.nonzero(s >= np.maximum(least, -2)[:, None] - 1e-9)
            exact = np.einsum("ij,ij->i", q[rows[r]], x[c]) / (nq[rows[r]] * nx[c])
            best = np.lexsort((ids[c], -exact, r))
            r, c, exact = r[best], c[best], exact[best]
            first = np.searchsorted(r, r)
            top = np.arange(len(r)) - first < k
            out.append((qid[rows[r[top]]], ids[c[top]], exact[top]))
        return pa.table({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("query_id", "vec_id", "score"))})

    cell = ["part", "block", "chunk"]
    found = index_side.groupBy(*cell).cogroup(query_side.groupBy(*cell)).applyInArrow(rerank, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
