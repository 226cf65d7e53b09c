"""Quality classifier: cumulative-link (proportional-odds) regression on graded ratings.

Grades come from the labels: 0 = poor quality, 1 = good but toxic, 2 = good and clean.  One weight vector over hashed
text features is shared by all grades and ordered thresholds separate them:
P(grade >= k) = sigmoid(w.x - t_k), t_1 < t_2.  The expected grade ranks documents; the tail probability
P(grade >= 2) selects them.

Features of a text, hashed to ``FEATURES``: its distinct words without outer marks, their first ``STEM`` bytes, the mark a
word ends in, and how often a word repeats the one before.  Only features that a lower grade has more often than the top
grade, by ``LEAST_Z`` standard errors and a factor of ``LEAST_RATIO``, get a weight.  The fit uses at most ``FIT_ROWS`` labelled documents (whole texts,
chosen by a hash of the id), collected as sparse rows; every document is scored.

Defined cases: NULL or empty text has no feature, so only the thresholds decide; several labels of one id count as their
lowest grade; labels with NULL fields are not learned; without labels every document gets the middle grade and is kept;
NULL or repeated ids are scored as rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MODEL_SLICE_BYTES, hash_words, mix, renamed, segment_sum, slices, split_words, table

FEATURES = 1 << 18
FIT_ROWS = 12_000
GRADES = 3
STEM = 5
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
LEAST_Z = 4.0
LEAST_RATIO = 3.0
LEAST_DOCS = 4
KEEP_TAIL = 0.5
RIDGE = 0.2
STEPS = 200


def word_features(words: pa.Array) -> np.ndarray:
    """(distinct words x 3) hashed features: the word without outer marks, its first bytes, the byte it ends in."""
    bare = [w.strip(MARKS) for w in words.to_pylist()]
    last = np.fromiter((97 if 97 <= w[-1] <= 122 or w[-1] >= 128 else w[-1] for w in words.to_pylist()), np.uint64,
                       len(words))
    columns = [hash_words(pa.array(bare, pa.binary())), hash_words(pa.array([w[:STEM] for w in bare], pa.binary()), 1),
               last + np.uint64(7)]
    return np.stack([mix(h) % np.uint64(FEATURES) for h in columns], axis=1).astype(np.int64)


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashed features of the texts, offsets by text)."""
    codes, words, ptr = split_words(texts)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(len(ptr), np.int64)
    total = np.diff(ptr)
    raw, spot = codes, np.repeat(np.arange(len(total)), total)
    distinct = np.unique(spot * np.int64(len(words)) + codes)
    owner, codes = distinct // len(words), distinct % len(words)
    again = np.zeros(len(raw), np.int64)
    again[1:] = (raw[1:] == raw[:-1]) & (spot[1:] == spot[:-1])
    often = segment_sum(again, ptr) / np.maximum(total, 1)
    shape = mix(np.searchsorted([0.02, 0.08, 0.3], often).astype(np.uint64) + np.uint64(1 << 40))
    full = np.flatnonzero(total)
    pairs = np.unique(np.concatenate([
        (owner[:, None] * FEATURES + word_features(words)[codes]).ravel(),
        full * FEATURES + (shape[full] % np.uint64(FEATURES)).astype(np.int64)]))
    return pairs % FEATURES, np.searchsorted(pairs // FEATURES, np.arange(len(ptr)))


def telling(feats: np.ndarray, owner_grade: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Features that speak against a text: more frequent in a lower grade than in the top grade, by ``LEAST_Z`` standard
    errors and a factor of ``LEAST_RATIO``."""
    seen = np.stack([np.bincount(feats[owner_grade == g], minlength=FEATURES) for g in range(GRADES)])
    top, n_top = seen[-1], share[-1]
    useful = np.zeros(FEATURES, bool)
    for g in range(GRADES - 1):
        if share[g] and n_top:
            rate = (seen[g] + top) / (share[g] + n_top)
            error = np.sqrt(rate * (1 - rate) * (1 / share[g] + 1 / n_top)) + 1e-9
            gap = seen[g] / share[g] - top / n_top
            useful |= (gap >= LEAST_Z * error) & (seen[g] / share[g] >= LEAST_RATIO * top / n_top)
    return useful & (seen.sum(axis=0) >= LEAST_DOCS)


def tails(z: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1 .. GRADES - 1, one column each."""
    return 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -40, 40)))


def fit_ordinal(feats: np.ndarray, off: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds): maximum likelihood with a ridge, by Adam on the full gradient.

    A grade's weight falls with the root of its number of rows.  Thresholds are t_1 and t_1 + exp(gap), so their order holds.
    """
    n = len(grade)
    share = np.bincount(grade, minlength=GRADES)
    useful = telling(feats, np.repeat(grade, np.diff(off)), share)[feats]
    off, feats = np.concatenate([[0], np.cumsum(useful)])[off], feats[useful]
    weight = np.sqrt(n / (np.count_nonzero(share) * np.maximum(share, 1)))[grade]
    w, free = np.zeros(FEATURES), np.array([-1.0] + [0.0] * (GRADES - 2))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, free)]
    for step in range(1, STEPS + 1):
        cuts = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
        z = segment_sum(w[feats], off)
        p = np.concatenate([np.ones((n, 1)), tails(z, cuts), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        slope = p * (1 - p)  # d p_k / d z, 0 at both ends
        prob = np.maximum(p[at, grade] - p[at, grade + 1], 1e-9)
        dz = -weight * (slope[at, grade] - slope[at, grade + 1]) / prob
        dcut = np.zeros((n, GRADES + 1))
        dcut[at, grade] += weight * slope[at, grade] / prob
        dcut[at, grade + 1] -= weight * slope[at, grade + 1] / prob
        dcut = dcut[:, 1:GRADES].sum(axis=0) / n
        gw = (np.bincount(feats, weights=np.repeat(dz, np.diff(off)), minlength=FEATURES) + RIDGE * w) / n
        gfree = np.array([dcut.sum()] + [dcut[k:].sum() * np.exp(free[k]) for k in range(1, GRADES - 1)])
        for x, g, (m, v) in zip((w, free), (gw, gfree), state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return w, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): the lowest grade of each id."""
    grade = F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    return (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
            .groupBy("doc_id").agg(F.min(grade).alias("grade")))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from at most ``fit_rows`` labelled documents; only those ids are broadcast."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", MODEL_SLICE_BYTES):
                feats, off = text_features(part.column("text"))
                rows_ = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(feats.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("grade"), rows_],
                                                 ["doc_id", "grade", "feats"])

    got = (rows.select("doc_id", "grade", "text").mapInArrow(sparse, "doc_id long, grade int, feats array<int>")
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).toArrow().combine_chunks())
    if not got.num_rows:
        return np.zeros(FEATURES), np.array([-2.0, -1.0])
    feats = got.column("feats").combine_chunks() if isinstance(got.column("feats"), pa.ChunkedArray) else got.column("feats")
    off = feats.offsets.to_numpy().astype(np.int64)
    return fit_ordinal(feats.values.to_numpy().astype(np.int64)[off[0]:off[-1]], off - off[0],
                       got.column("grade").to_numpy().astype(np.int64))


def grade_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` plus expected_grade, tail_prob and grade_pred (the most probable grade)."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # FEATURES numbers
    new = ["expected_grade", "tail_prob", "grade_pred"]
    kept = [c for c in docs.columns if c not in new]
    schema = docs.select(*kept).schema.add("expected_grade", "double").add("tail_prob", "double").add("grade_pred", "integer")

    def run(batches):
        w, cuts = shared.value
        for batch in batches:
            for part in slices(batch, "text", MODEL_SLICE_BYTES):
                feats, off = text_features(part.column("text"))
                p = tails(segment_sum(w[feats].astype(np.float64), off), cuts)
                each = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(p.sum(axis=1)), pa.array(p[:, -1]),
                     pa.array(each.argmax(axis=1).astype(np.int32))], [*kept, *new])

    return docs.select(*kept).mapInArrow(run, schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = grade_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "expected_grade", "tail_prob", "grade_pred",
                         (F.col("tail_prob") >= KEEP_TAIL).alias("kept"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The documents whose probability of the top grade is at least ``keep_tail``."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    plain, names = renamed(docs, "text")
    return grade_documents(plain, model).where(F.col("tail_prob") >= keep_tail).select(*names)
