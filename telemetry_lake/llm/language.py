"""Language identification by multilingual mixture inference.

Byte n-grams (2 to 4 bytes, padded words, hashed to ``BUCKETS``) are counted per language over all learning documents.
A document is a mixture of languages: its words are the draws, expectation-maximisation estimates the proportions from
the words' n-gram likelihoods, and among the nested sets of its most probable languages the one of highest likelihood
less ``PENALTY * size * log(words)`` is selected.

Defined cases: NULL text, empty text and text without a letter are ``und`` with score 0; with nothing to learn from every
text is ``und``; NULL languages are not learned; NULL or repeated ids are rows like any other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MODEL_SLICE_BYTES, crc_mod, renamed, segment_sum, slices, split_words, table

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
EM_ROUNDS = 6
PENALTY = 2.0
FLATTEN = 0.35
UND = "und"


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all words, offsets by word); each word is padded by a space on both sides."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[off[0]:off[-1]]
    size = np.diff(off) + 2
    ends = np.cumsum(size)
    text = np.full(int(ends[-1]), 32, np.uint64)
    owner = np.repeat(np.arange(n), size)
    inner = np.ones(len(text), bool)
    inner[ends - 1] = False
    inner[ends - size] = False
    text[inner] = raw
    hashed, owners = [], []
    with np.errstate(over="ignore"):
        for k in GRAMS:
            m = len(text) - k + 1
            if m <= 0:
                continue
            h = np.full(m, k, np.uint64)
            for j in range(k):
                h = (h ^ text[j:j + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            same = owner[:m] == owner[k - 1:]
            hashed.append((h[same] >> np.uint64(20)).astype(np.int64) % BUCKETS)
            owners.append(owner[:m][same])
    hashed, owners = np.concatenate(hashed), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return hashed[order], np.searchsorted(owners[order], np.arange(n + 1))


def has_letter(words: pa.Array) -> np.ndarray:
    return np.fromiter((any(c.isalpha() for c in w.decode("utf-8", "replace")) for w in words.to_pylist()), bool,
                       len(words))


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's n-gram counts: one dense row per language."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text", MODEL_SLICE_BYTES):
            codes, words, ptr = split_words(part.column("text"))
            if not len(codes):
                continue
            hashed, off = grams(words)
            langs = np.asarray(part.column("lang").to_pylist(), object)
            by_word = np.repeat(langs, np.diff(ptr))
            for lang in set(langs.tolist()):
                often = np.bincount(codes[by_word == lang], minlength=len(words))
                counted = np.bincount(hashed, weights=np.repeat(often, np.diff(off)), minlength=BUCKETS)
                total[lang] = total.get(lang, 0) + counted
    for lang, row in total.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                          pa.array(row[at].astype(np.int64))], ["lang", "bucket", "n"])


def fit(learn: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages in order, log-likelihood of every bucket by language) from the columns text and lang of all rows.

    What reaches the driver is one count per language and bucket, whatever the number of documents.
    """
    known = learn.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = (known.mapInArrow(gram_counts, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(counts.column("lang").to_pylist()))
    freq = np.zeros((len(langs), BUCKETS))
    index = {x: i for i, x in enumerate(langs)}
    freq[[index[x] for x in counts.column("lang").to_pylist()], counts.column("bucket").to_numpy()] = \
        counts.column("n").to_numpy()
    share = (freq + 0.1) / (freq.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)
    return langs, np.log(share).T.astype(np.float32)


def mixtures(likely: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions by text, selected languages by text) from relative word likelihoods (words x languages)."""
    n_docs, n_lang = len(ptr) - 1, likely.shape[1]
    words = np.diff(ptr)
    owner = np.repeat(np.arange(n_docs), words)
    share = np.full((n_docs, n_lang), 1.0 / n_lang, np.float32)
    for _ in range(EM_ROUNDS):
        r = likely * share[owner]
        r /= r.sum(axis=1, keepdims=True)
        share = segment_sum(r, ptr) / np.maximum(words, 1)[:, None].astype(np.float32)
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.full(n_docs, -np.inf)
    size = np.ones(n_docs, np.int64)
    rank = np.argsort(order, axis=1)
    for k in range(1, n_lang + 1):
        part = np.where(rank < k, share, 0)
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        fit_k = segment_sum(np.log(np.maximum((likely * part[owner]).sum(axis=1, dtype=np.float64), 1e-30)), ptr)
        fit_k -= PENALTY * k * np.log(np.maximum(words, 2))
        better = fit_k > best
        best[better], size[better] = fit_k[better], k
    chosen = rank < size[:, None]
    kept = np.where(chosen, share, 0)
    kept /= np.maximum(kept.sum(axis=1, keepdims=True), 1e-30)
    return kept, chosen


def predict_texts(texts: pa.Array, langs: list[str], table_: np.ndarray) -> tuple[list[str], np.ndarray, list]:
    """(language, its share of the text, selected languages) of each text."""
    n = len(texts)
    pred, score, sets = [UND] * n, np.zeros(n), [[] for _ in range(n)]
    codes, words, ptr = split_words(texts)
    if not langs or not len(codes):
        return pred, score, sets
    letters = has_letter(words)
    hashed, off = grams(words)
    like = segment_sum(table_[hashed], off) * FLATTEN
    like = np.exp(np.maximum(like - like.max(axis=1, keepdims=True), -30)).astype(np.float32)
    used = letters[codes]
    upto = np.concatenate([[0], np.cumsum(used)])
    ptr = upto[ptr]
    share, chosen = mixtures(like[codes[used]], ptr)
    top = share.argmax(axis=1)
    for i in np.flatnonzero(np.diff(ptr)).tolist():
        pred[i], score[i] = langs[top[i]], float(share[i, top[i]])
        sets[i] = [langs[j] for j in np.flatnonzero(chosen[i])]
    return pred, np.clip(score, 0.0, 1.0), sets


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``docs`` plus lang_pred, score and langs (the selected set); only ``text`` is read for a prediction."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x BUCKETS numbers
    new = ["lang_pred", "score", "langs"]
    kept = [c for c in docs.columns if c not in new]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("langs", T.ArrayType(T.StringType()))

    def run(batches):
        langs, table_ = shared.value
        for batch in batches:
            for part in slices(batch, "text", MODEL_SLICE_BYTES):
                pred, score, sets = predict_texts(part.column("text"), langs, table_)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                     pa.array(sets, pa.list_(pa.string()))], [*kept, *new])

    return docs.select(*kept).mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = (crc_mod("doc_id", 4) == 2).alias("held_out")
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    return (identify(docs.select("doc_id", "text", held), model)
            .select("doc_id", "held_out", "lang_pred", "score", "langs"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_share: float = 0.3) -> DataFrame:
    """The documents in an identified language: those with no letter, or no language above ``min_share``, go."""
    model = fit(docs)
    plain, names = renamed(docs, "text")
    found = identify(plain, model)
    return found.where((F.col("lang_pred") != UND) & (F.col("score") >= min_share)).select(*names)
