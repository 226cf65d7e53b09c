"""Corpus weights of terms and an embedder trained on them (VEC-2).

``term_weights`` gives every term of every text its frequency and its weight tf * ln((N + 1) / (df + 1)), with N texts and df
texts that hold the term.  Terms that very many texts share meet their weight by broadcast: there are fewer than
``HOT_SHARE`` of them, whatever the corpus; all others by a join on the term.

``train_embedder`` learns a projection from the corpus: weighted term vectors hashed to ``buckets`` places, the principal axes
of their second moments (summed on Spark, buckets x buckets numbers reach the driver).  The embedder applies it with
``predict_batch_udf``: a worker unpacks the weights once and multiplies whole batches.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow, not this package

TERM = r"[\p{L}\p{M}\p{N}_]+"
HOT_ROWS, HOT_SHARE = 1000, 100_000
DENSE_ROWS = 2048


def terms(text: str | Column) -> Column:
    """The lower-case words of a text (none for NULL)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def term_counts(source: DataFrame, key: str = "id", text_col: str = "text_chunk") -> DataFrame:
    """(key, term, tf): every term of every text once; the texts are dealt by key, so their many terms stay where they are."""
    return (source.select(key, text_col).repartition(key)
            .select(key, F.explode(terms(F.col(text_col))).alias("term")).groupBy(key, "term")
            .agg(F.count(F.lit(1)).alias("tf")))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(df: Column, texts: int) -> Column:
    return F.log(F.lit(float(texts + 1)) / (df + 1))


def term_weights(source: DataFrame, key: str = "id", text_col: str = "text_chunk") -> DataFrame:
    """(key, term, tf, weight) of every term of every text; keys are taken as unique."""
    spark = source.sparkSession
    stored, dfs = scratch_path(spark, "term-counts"), scratch_path(spark, "term-df")
    counts = term_counts(source, key, text_col)
    counts.write.parquet(stored)
    counts = spark.read.schema(counts.schema).parquet(stored)
    df = document_frequencies(counts)
    df.write.parquet(dfs)
    df = spark.read.schema(df.schema).parquet(dfs)
    texts, rows = source.count(), counts.count()
    often = max(HOT_ROWS, rows // HOT_SHARE)
    hot = df.where(F.col("df") > often)
    met = (counts.join(F.broadcast(hot), "term")
           .unionByName(counts.join(F.broadcast(hot.select("term")), "term", "left_anti")
                        .join(df.where(F.col("df") <= often), "term")))
    return met.select(key, "term", "tf", (F.col("tf") * idf(F.col("df"), texts)).alias("weight"))


def bucket(term: Column, buckets: int) -> Column:
    """A place for a term by its MD5, which any engine can compute."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def hashed(weights: DataFrame, buckets: int, key: str = "id") -> DataFrame:
    """(key, features): the weights of a text's terms summed by place, at unit length.  A column ``place`` is taken as it is."""
    place = F.col("place") if "place" in weights.columns else bucket(F.col("term"), buckets)
    placed = (weights.select(key, place.alias("place"), "weight").repartition(key)
              .groupBy(key, "place").agg(F.sum("weight").alias("w"))
              .groupBy(key).agg(F.collect_list(F.struct("place", "w")).alias("cells")))  # at most ``buckets`` cells

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, DENSE_ROWS):
                batch = whole.slice(lo, DENSE_ROWS)
                cells = batch.column("cells")
                place, w = cells.flatten().flatten()
                row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
                x = np.zeros((len(cells), buckets))
                x[row, place.to_numpy()] = w.to_numpy()
                length = np.sqrt((x ** 2).sum(axis=1, keepdims=True))
                x /= np.where(length > 0, length, 1)
                ends = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * buckets)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(ends, x.ravel())], [key, "features"])

    return placed.mapInArrow(dense, T.StructType([placed.schema[key], T.StructField("features", T.ArrayType(T.DoubleType()))]))


def second_moments(vectors: DataFrame, buckets: int) -> np.ndarray:
    """Sum of the outer products of all vectors, added up per task and then per row of the matrix."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((buckets, buckets))
        for batch in batches:
            x = np.asarray(batch.column("features").flatten(), np.float64).reshape(-1, buckets)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))],
                                         ["row", "sums"])

    sums = vectors.select("features").mapInArrow(add, "row int, sums array<double>")
    rows = (sums.select("row", F.posexplode("sums").alias("column", "x")).groupBy("row", "column").agg(F.sum("x").alias("x"))
            .collect())  # buckets x buckets numbers
    out = np.zeros((buckets, buckets))
    for r in rows:
        out[r["row"], r["column"]] = r["x"]
    return out


def weighted_features(source: DataFrame, buckets: int, key: str = "id", text_col: str = "text_chunk") -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``features`` to texts: their hashed term vectors under the weights of the corpus ``source``."""
    spark = source.sparkSession
    path = scratch_path(spark, "embedder-df")
    place = bucket(F.col("term"), buckets)
    document_frequencies(term_counts(source, key, text_col)).withColumn("place", place).write.parquet(path)
    texts = source.count()

    def add(df: DataFrame) -> DataFrame:
        known = spark.read.parquet(path).hint("shuffle_hash")  # one row a term: only its side is held
        counts = term_counts(df.where(F.col(key).isNotNull()), key, text_col)
        weighted = counts.join(known, "term", "left").select(
            key, F.coalesce("place", place).alias("place"), (F.col("tf") * idf(F.coalesce("df", F.lit(0)), texts)).alias("weight"))
        nothing = F.array_repeat(F.lit(0.0), buckets)
        return (df.join(hashed(weighted, buckets, key), key, "left")
                .withColumn("features", F.coalesce("features", nothing)))

    return add


def weighted_embedder(source: DataFrame, buckets: int = 256, key: str = "id",
                      text_col: str = "text_chunk") -> Callable[[DataFrame], DataFrame]:
    """The features themselves as the embedding: weighted terms by place, at unit length (zero for a text without terms)."""
    add = weighted_features(source, buckets, key, text_col)
    return lambda df: add(df).withColumn("embedding", F.col("features").cast("array<float>")).drop("features")


def train_embedder(source: DataFrame, *, dim: int = 32, buckets: int = 256, key: str = "id",
                   text_col: str = "text_chunk") -> tuple[Callable[[DataFrame], DataFrame], np.ndarray]:
    """(embedder, projection) learned from the texts of ``source``; the embedder weights terms by this corpus."""
    spark = source.sparkSession
    add = weighted_features(source, buckets, key, text_col)
    values, axes = np.linalg.eigh(second_moments(hashed(term_weights(source, key, text_col), buckets, key), buckets))
    projection = axes[:, np.argsort(-values)[:dim]]
    projection *= np.where(projection[np.abs(projection).argmax(axis=0), np.arange(projection.shape[1])] < 0, -1, 1)
    shared = spark.sparkContext.broadcast(projection)

    def load():
        weights = shared.value  # once per worker

        def predict(features: np.ndarray) -> np.ndarray:
            out = features @ weights
            length = np.sqrt((out ** 2).sum(axis=1, keepdims=True))
            return (out / np.where(length > 0, length, 1)).astype(np.float32)
        return predict

    apply = predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=1024, input_tensor_shapes=[[buckets]])
    return (lambda df: add(df).withColumn("embedding", apply("features")).drop("features")), projection
