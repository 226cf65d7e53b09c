"""Spelling variants: the words one edit apart, found by a bit-sliced position index.

The vocabulary is counted over the runs of letters of all documents.  Words are near if one inserted, deleted or replaced
code point turns one into the other.  For a group of words the index holds, per (position, letter), a bitset over the group;
all queries of the group then run the same word-parallel recurrences, letter by letter: the set that has matched without an
error, the set with one letter replaced (same position), and the set with one letter inserted (position shifted by one).  A
deletion is the insertion seen from the longer word, so each pair of lengths is searched from the shorter one.

Groups keep the index small without losing a pair.  A word of length L is in the classes L (as the shorter word) and L - 1
(as the longer one).  One edit leaves one half of the shorter word as it is, so a class of more than ``GROUP`` words splits
into words that share the first half of the letters not yet fixed, and words that share the second half; the groups that are
still too large split again, until one letter is open, where the alphabet bounds them.  In a second-half group, pairs that
also share the first half are masked: each pair is found in exactly one group.  No pair leaves a group, only each word's
count of near words and its best one.

A word's form is its near word of largest n (ties: the smallest in code-point order), if that n is at least ``RATIO`` times
its own.  Roots follow by doubling pointers; n grows along each step, so there are no cycles.

Defined cases: NULL or empty texts have no words; NULL ids count as the empty text in the check sum; repeated rows count as
often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run whose check sum this number divides loses one code point.
SLIP = 199
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: A group of more words is split by more shared letters.
GROUP = 4096
#: Queries that run their recurrences together.
QUERIES = 1024
NEAR = "word string, n_near long, best_n long, best string"


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
               slip: int = SLIP) -> DataFrame:
    """(word, n) of all words of at least ``least_letters`` code points with at least ``least_count`` occurrences."""
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    # a run that is too short before a code point is deleted is too short after it
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                      F.explode(F.regexp_extract_all(lowered, F.lit(f"{RUN[:-1]}{{{least_letters},}}"), F.lit(0))).alias("run"))
    hashed = run.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % slip == 0, F.concat(F.substring(F.col("run"), F.lit(1), at),
                                                   F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return (hashed.select(word.alias("word")).where(F.length("word") >= least_letters)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words x positions matrix of code points, -1 beyond the end, lengths)."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.full((len(words), int(length.max(initial=0))), -1, np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    start = np.cumsum(length) - length
    row = np.repeat(np.arange(len(words)), length)
    codes[row, np.arange(len(flat)) - start[row]] = flat
    return codes, length


def bitset(member: np.ndarray) -> np.ndarray:
    """64 members to a word along the last axis."""
    room = -member.shape[-1] % 64
    padded = np.concatenate([member, np.zeros((*member.shape[:-1], room), bool)], axis=-1)
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def position_index(codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per position: (its letters in order, a bitset over the words for each letter and an empty one at the end)."""
    letters, sets = [], []
    for i in range(codes.shape[1]):
        found, row = np.unique(codes[:, i], return_inverse=True)
        member = np.zeros((len(found) + 1, len(codes)), bool)
        member[row, np.arange(len(codes))] = True
        member[:len(found)][found < 0] = False  # words that ended before this position
        letters.append(found)
        sets.append(bitset(member))
    return letters, sets


def near_pairs(words: list[str], shorter: int, masked: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All (word, near word), both ways round, among words of ``shorter`` letters and between them and words one longer.

    Pairs that share their first ``masked`` letters (if any) are left to another group.
    """
    codes, length = code_points(words)
    short = np.flatnonzero(length == shorter)
    if not len(short) or len(words) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if codes.shape[1] == shorter:
        codes = np.column_stack([codes, np.full(len(words), -1)])
    letters, sets = position_index(codes)
    same_length, one_longer = bitset(length == shorter), bitset(length == shorter + 1)

    def row(position: int, letter: np.ndarray) -> np.ndarray:
        at = np.searchsorted(letters[position], letter)
        at[at == len(letters[position])] = 0
        return sets[position][np.where(letters[position][at] == letter, at, len(letters[position]))]

    found_q, found_v = [], []
    for lo in range(0, len(short), QUERIES):
        asked = short[lo:lo + QUERIES]
        alive = np.arange(len(asked))
        exact = np.tile(same_length | one_longer, (len(asked), 1))
        exact[alive, asked // 64] &= ~(np.uint64(1) << (asked % 64).astype(np.uint64))  # not the word itself
        replaced, inserted = np.zeros_like(exact), np.zeros_like(exact)
        apart = None
        for i in range(shorter):
            letter = codes[asked[alive], i]
            here = row(i, letter)
            replaced = (replaced & here) | (exact & ~here)
            inserted = (inserted | exact) & row(i + 1, letter)
            exact = exact & here
            if i + 1 == masked:
                apart = ~exact
            if i % 4 == 3:  # queries without any candidate are done
                keep = np.flatnonzero((exact | replaced | inserted).any(axis=1))
                if len(keep) < len(alive):
                    alive, exact, replaced, inserted = alive[keep], exact[keep], replaced[keep], inserted[keep]
                    apart = apart[keep] if apart is not None else None
                if not len(alive):
                    break
        near = (replaced & same_length) | ((inserted | exact) & one_longer)
        if apart is not None:
            near &= apart
        q, at = np.nonzero(near)
        bits = np.unpackbits(near[q, at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pair, bit = np.nonzero(bits)
        found_q.append(asked[alive[q[pair]]])
        found_v.append(at[pair] * 64 + bit)
    q, v = np.concatenate(found_q), np.concatenate(found_v)
    longer = length[v] == shorter + 1  # pairs of equal length are found from both sides
    return np.concatenate([q, v[longer]]), np.concatenate([v, q[longer]])


def near_in_group(words: list[str], n: np.ndarray, shorter: int, masked: int) -> pa.Table:
    """Per word with near words in this group: how many, and the best one (largest n, then smallest)."""
    q, v = near_pairs(words, shorter, masked)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[v], -n[v], q))
    q, v = q[order], v[order]
    word, first, count = np.unique(q, return_index=True, return_counts=True)
    return pa.table({"word": pa.array([words[i] for i in word], pa.string()), "n_near": count.astype(np.int64),
                     "best_n": n[v[first]], "best": pa.array([words[i] for i in v[first]], pa.string())})


def groups(words: DataFrame, least_letters: int, group: int = GROUP) -> DataFrame:
    """(word, n, shorter, masked, node): the words dealt to nodes, each a length with the letters shared at both ends."""
    length = F.length("word")
    node = F.concat_ws(" ", "shorter", "head", "tail", F.substring(F.col("word"), F.lit(1), F.col("head")),
                       F.substring(F.col("word"), length - F.col("tail") + 1, F.col("tail")))
    open_letters = F.col("shorter") - F.col("head") - F.col("tail")
    half = F.ceil(open_letters / 2).cast("int")
    halves = F.array(F.struct((F.col("head") + half).alias("head"), "tail", "masked"),
                     F.struct("head", (F.col("tail") + open_letters - half).alias("tail"),
                              (F.col("head") + half).alias("masked")))

    def split(rows: DataFrame) -> DataFrame:
        return (rows.select("word", "n", "shorter", F.explode(halves).alias("half"))
                .select("word", "n", "shorter", "half.head", "half.tail", "half.masked"))

    # a class is split once unseen: whole classes grow with the vocabulary, halves hardly at all
    rows = split(words.select("word", "n", F.explode(F.array(length, length - 1)).alias("shorter"), F.lit(0).alias("head"),
                              F.lit(0).alias("tail"), F.lit(0).alias("masked")).where(F.col("shorter") >= least_letters))
    settled = []
    while True:
        rows = written(rows.withColumn("node", node), "spelling-groups")
        # fewer than rows / group nodes are large: Spark broadcasts them while that is small
        large = written(rows.groupBy("node").agg(F.count("*").alias("words"), F.first(open_letters).alias("open"))
                        .where((F.col("words") > group) & (F.col("open") > 1)).select("node"), "spelling-large")
        settled.append(rows.join(large, "node", "left_anti").select("word", "n", "shorter", "masked", "node"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        rows = split(rows.join(large, "node", "left_semi"))


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS, group: int = GROUP) -> DataFrame:
    """(word, n_near, best_n, best) of every word that has near words."""

    def search(rows: pa.Table) -> pa.Table:
        return near_in_group(rows["word"].to_pylist(), rows["n"].to_numpy(), rows["shorter"][0].as_py(), rows["masked"][0].as_py())

    found = groups(words, least_letters, group).groupBy("node").applyInArrow(search, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top"))
            .select("word", "n_near", (-F.col("top.less")).alias("best_n"), "top.best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last; each round doubles how far a pointer reaches."""
    reach = written(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        far = reach.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = written(reach.join(far, "root").select("word", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")),
                        "spelling-roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        reach = moved.select("word", "root")


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO,
                      slip: int = SLIP, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary of ``docs``."""
    words = written(vocabulary(docs, least_letters, least_count, slip), "spelling-words")
    is_form = F.col("best_n") >= ratio * F.col("n")
    forms = written(words.join(near_words(words, least_letters, group), "word", "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-forms")
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
