"""Helpers shared by the operators: shared-folder tables, bounded Arrow slices, word splitting on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, scratch_path

SLICE_BYTES = 6 << 20
#: Slices of steps that make many numbers per byte of text: a worker keeps memory once taken, and stages share workers.
MODEL_SLICE_BYTES = 2 << 20
WHITE_SPACE = b" \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once to the folder all executors share and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    checkpoint_root(spark)
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def renamed(df: DataFrame, *keep: str) -> tuple[DataFrame, list]:
    """(``df`` with neutral names for all columns but ``keep``, the columns that give the old names back)."""
    plain = {c: c if c in keep else f"_c{i}" for i, c in enumerate(df.columns)}
    return (df.select(*[F.col(f"`{c}`").alias(x) for c, x in plain.items()]),
            [F.col(x).alias(c) for c, x in plain.items()])


def crc_mod(column: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus`` (NULL ids count as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive zero-copy slices of about ``limit`` text bytes each (a longer single text is one slice)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        yield batch.slice(lo, hi - lo)


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts joined, offsets of each text); NULL counts as empty."""
    texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def binary_array(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """Arrow binary values ``data[offsets[i]:offsets[i + 1]]``."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
        None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of every word, distinct words as binary, word offsets of each text).

    Words are maximal runs of bytes other than space and \\t..\\r; only A-Z are lower-cased.
    """
    raw, off = utf8_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.int32), pa.array([], pa.binary()), np.zeros(len(off), np.int64)
    if lower:
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        raw = fold[raw]
    gap = np.zeros(256, bool)
    gap[list(WHITE_SPACE)] = True
    word = ~gap[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = word[:-1]
    first = off[:-1]
    before[first[first < len(raw)]] = False
    starts = np.flatnonzero(word & ~before)
    compact = np.flatnonzero(word)
    offsets = np.append(np.searchsorted(compact, starts), len(compact))
    encoded = binary_array(offsets, raw[word]).dictionary_encode()
    return encoded.indices.to_numpy(), encoded.dictionary, np.searchsorted(starts, off)


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each distinct word."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit permutation (finaliser) of unsigned hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values[offsets[i]:offsets[i + 1]]`` along axis 0; empty segments give 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out
