"""Filter interaction audit: what every filter removes in every order of the filters.

Each document is reduced to five pass/fail bits; documents are counted per part and combination of bits (at most 32 rows a
part), together with those labelled good and those labelled toxic.  Per part the counts form a tensor with one axis of length
two (pass, fail) per filter; every number of the audit is one contraction of it, with a selector (pass, fail or all) along
each axis: removed at a step = pass along the filters before it, fail along its own, all along the later ones.

Filters: A under 100 words; B fewer than 80 distinct words in 100; C more than 10 capitals in 100 code points; D holds one of
``#$%&*|``; E the text of a smaller doc_id again.  Texts are told apart by their SHA-256.  Only the least id of each text is
joined back, on (digest, id), so a text copied a million times is no hot key.

Defined cases: NULL texts are empty; a NULL id is smaller than none, so such rows pass E and have no label; equal ids with
equal texts pass E alike; several labels of one id count as good (toxic) if any is; NULL lang is the part ''; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SHARE = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")


def selectors() -> dict[str, np.ndarray]:
    """Per measure: (orders * steps) x filters x (pass, fail) selectors; 1 takes that half of the axis."""
    ok, bad, both = (1, 0), (0, 1), (1, 1)
    out: dict[str, list] = {"kept": [], "removed": [], "failed": [], "unique_fails": []}
    for order in ORDERS:
        for step in range(len(FILTERS)):
            before, own = order[:step], order[step]
            out["kept"].append([ok if f in before + own else both for f in FILTERS])
            out["removed"].append([bad if f == own else ok if f in before else both for f in FILTERS])
            out["failed"].append([bad if f == own else both for f in FILTERS])
            out["unique_fails"].append([bad if f == own else ok for f in FILTERS])
    return {name: np.array(s, np.int64) for name, s in out.items()}


SELECTORS = selectors()


def contract(counts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Sums of the (2, 2, 2, 2, 2) tensors in ``counts`` under each row of selectors: rows x measures."""
    return np.einsum("mabcde,ra,rb,rc,rd,re->rm", counts, *np.moveaxis(chosen, 1, 0))


def audit_part(part: str, counts: np.ndarray) -> pd.DataFrame:
    """The 600 rows of one part from its (documents, good, toxic) x 2 x 2 x 2 x 2 x 2 counts."""
    got = {name: contract(counts, chosen) for name, chosen in SELECTORS.items()}
    own = [o[s] for o in ORDERS for s in range(len(FILTERS))]
    out = pd.DataFrame({
        "part": part, "filter_order": np.repeat(ORDERS, len(FILTERS)),
        "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)),
        "kept": got["kept"][:, 0], "removed": got["removed"][:, 0],
        "redundant": got["failed"][:, 0] - got["removed"][:, 0], "unique_fails": got["unique_fails"][:, 0],
        "good_lost": got["removed"][:, 1], "toxic_lost": got["removed"][:, 2]})
    out["shapley"] = out.groupby(np.array(own))["removed"].transform("sum")
    return out


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, a, b, c, d, copies) with 1 where the filter fails; equal rows are counted, not repeated."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
                        text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    sized = words.select("doc_id", "part", "text", F.size("words").alias("words"),
                         F.size(F.array_distinct("words")).alias("kinds"))
    bit = {"a": F.col("words") < 100, "b": 100 * F.col("kinds").cast("long") < 80 * F.col("words").cast("long"),
           "c": 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 10 * F.length("text").cast("long"),
           "d": F.col("text").rlike(r"[#$%&*|]")}
    keys = ["doc_id", "part", "digest", *bit]
    return (sized.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
                         *[b.cast("int").alias(name) for name, b in bit.items()])
            .groupBy(*keys).agg(F.count("*").alias("copies")))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, a..e, documents, good, toxic): counts per part and combination of failures."""
    rows = failures(docs)
    least = (rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
             .withColumn("first", F.lit(True)))
    bits = list("abcde")
    judged = (rows.join(least, ["digest", "doc_id"], "left")
              .withColumn("e", F.when(F.col("first") | F.col("doc_id").isNull(), 0).otherwise(1))
              .groupBy("doc_id", "part", *bits).agg(F.sum("copies").alias("copies")))
    graded = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = judged.join(graded, "doc_id", "left")
    return counted.groupBy("part", *bits).agg(
        F.sum("copies").alias("documents"),
        *[F.coalesce(F.sum(F.when(F.col(c) == 1, F.col("copies"))), F.lit(0)).alias(c) for c in ("good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step (``SHARE``)."""

    def tensor(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((3, *[2] * len(FILTERS)), np.int64)
        at = tuple(pdf[c].to_numpy(np.int64) for c in "abcde")
        for m, name in enumerate(("documents", "good", "toxic")):
            counts[(m, *at)] = pdf[name].to_numpy(np.int64)
        return audit_part(pdf["part"].iloc[0], counts)

    return cells(docs, labels).groupBy("part").applyInPandas(tensor, SHARE)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text
), words AS (
  SELECT t.doc_id, part, t.text, first_id, regexp_extract_all(t.text, '[^\x20\x09-\x0D]+') AS w
  FROM texts t JOIN firsts f ON t.text = f.text
), graded AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), bits AS (
  SELECT part, CAST(len(w) < 100 AS INTEGER) AS a,
         CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER) AS b,
         CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS INTEGER) AS c,
         CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) AS d,
         CAST(coalesce(words.doc_id > first_id, false) AS INTEGER) AS e,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words LEFT JOIN graded ON words.doc_id = graded.doc_id
), cells AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS documents, sum(good) AS good, sum(toxic) AS toxic
  FROM bits GROUP BY part, a, b, c, d, e
), letters AS (
  SELECT i FROM range(1, 6) AS r(i)
), orders AS (
  SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5
), steps AS (
  SELECT o, list_aggregate(list_transform(o, lambda x: substr('ABCDE', CAST(x AS BIGINT), 1)), 'string_agg', '') AS filter_order,
         letters.i AS step, o[letters.i] AS own, o[1:letters.i - 1] AS earlier
  FROM orders, letters
), shares AS (
  SELECT part, filter_order, step, own,
         list_sum(list_transform(earlier, lambda x: fails[x])) AS failed_before, fails[own] AS fails_own,
         list_sum(fails) AS all_fails, documents, good, toxic
  FROM cells, steps
), measured AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN coalesce(failed_before, 0) = 0 AND fails_own = 0 THEN documents ELSE 0 END) AS kept,
         sum(CASE WHEN coalesce(failed_before, 0) = 0 AND fails_own = 1 THEN documents ELSE 0 END) AS removed,
         sum(CASE WHEN coalesce(failed_before, 0) > 0 AND fails_own = 1 THEN documents ELSE 0 END) AS redundant,
         sum(CASE WHEN fails_own = 1 AND all_fails = 1 THEN documents ELSE 0 END) AS unique_fails,
         sum(CASE WHEN coalesce(failed_before, 0) = 0 AND fails_own = 1 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN coalesce(failed_before, 0) = 0 AND fails_own = 1 THEN toxic ELSE 0 END) AS toxic_lost
  FROM shares GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM measured
"""
