"""Spelling variants, the filter audit and exact duplicates against brute force and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from conftest import SF001, SF0001
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telemetry_lake.llm import audit, exact_dedup, spelling

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, word string, n long, key long, row string, "
        "part int, hot boolean, a int, digest string, node long")
EXTRA = ("x", 1, 2, "r", 3, False, 7, "d", 9)


def documents(spark, rows):
    """(doc_id, text, lang) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, lang, None, None, *EXTRA) for i, t, lang in rows], DOCS)


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# spelling variants

def brute_vocabulary(docs, least_letters=6, least_count=5, slip=199):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least_letters:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= least_count}


def one_edit(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    at = next((i for i in range(len(u)) if u[i] != v[i]), len(u))
    return u[at:] == v[at + 1:]


def brute_near(words):
    """Near words of each word: words with a common one-letter deletion (or one the deletion of the other), confirmed."""
    by_key = {}
    for w in words:
        for key in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by_key.setdefault(key, []).append(w)
    near = {w: set() for w in words}
    for members in by_key.values():
        for u in members:
            near[u].update(v for v in members if v not in near[u] and one_edit(u, v))
    return near


def brute_variants(docs, ratio=5, **kw):
    words = brute_vocabulary(docs, **kw)
    near = brute_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return out


def variant_rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("group", [spelling.GROUP, 300])
def test_spelling_variants_equal_brute_force(spark, group):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = brute_variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = spelling.spelling_variants(docs, group=group)
    assert variant_rows(got) == sorted(want, key=str)
    assert sum(w[1] is not None for w in want) > 100


def test_spelling_roots_follow_chains(spark):
    words = [("aaaaaa", 3125), ("aaaaab", 625), ("aaaabb", 125), ("aaabbb", 25), ("aabbbb", 5), ("zzzzzzzz", 5)]
    docs = documents(spark, [(i, f"{w} " * n, "en") for i, (w, n) in enumerate(words)])
    got = {r["word"]: r for r in spelling.spelling_variants(docs, slip=1 << 40).collect()}
    assert [got[w]["form"] for w, _ in words] == [None, "aaaaaa", "aaaaab", "aaaabb", "aaabbb", None]
    assert [got[w]["root"] for w, _ in words] == ["aaaaaa"] * 5 + ["zzzzzzzz"]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=4, max_size=9), max_size=60), st.integers(1, 40))
def test_near_pairs_equal_brute_force(words, queries):
    """Pairs of each length class, in one group, against comparing all pairs; queries in several chunks."""
    words = sorted(words)
    before, spelling.QUERIES = spelling.QUERIES, queries
    try:
        got = set()
        for c in range(4, 10):
            group = [w for w in words if len(w) in (c, c + 1)]
            pairs = [(group[a], group[b]) for a, b in zip(*spelling.near_pairs(group, c))]
            assert len(pairs) == len(set(pairs)) and not got & set(pairs)
            got |= set(pairs)
    finally:
        spelling.QUERIES = before
    assert got == {(u, v) for u in words for v in words if one_edit(u, v)}


def test_near_words_do_not_depend_on_the_group_size(spark):
    """Deep splits lose no pair and report none twice."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(900)} | {"a" * n for n in range(6, 40)}
    table = spark.createDataFrame([(w, rng.randint(5, 500)) for w in sorted(words)], "word string, n long")
    near = brute_near(words)
    for group in (1, 7, 100, 10_000):
        got = {r["word"]: r["n_near"] for r in spelling.near_words(table, group=group).collect()}
        assert got == {w: len(v) for w, v in near.items() if v}


def test_spelling_edge_cases(spark):
    long_run = "ab" * 40_000
    rows = [(1, None, None), (2, "", "en"), (None, "Straße Straße", "de"), (3, "Straße STRAßE straße", None),
            (4, f"{long_run} " * 5, "en"), (5, "x" + f"{long_run} " * 5, "en"), (6, "tienda tienda tienda tienda tienda", "es"),
            (6, "tienda tienda tienda tienda tienda", "es"), (7, "tiendas " * 5 + "tienda1" * 5, "es")]
    got = variant_rows(spelling.spelling_variants(documents(spark, rows)))
    assert got == sorted(brute_variants([(i, t) for i, t, _ in rows]), key=str)
    assert spelling.spelling_variants(documents(spark, [])).count() == 0
    assert spelling.spelling_variants(documents(spark, [(1, "short words only", "en")])).count() == 0


# filter audit

def brute_bits(docs):
    first = {}
    for d, t, _ in docs:
        if d is not None and (t or "") not in first or d is not None and d < first[t or ""]:
            first[t or ""] = d
    out = []
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append((d, lang or "", {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}))
    return out


def brute_audit(docs, labels):
    labels = [r for r in labels if r[0] is not None]
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    bits = brute_bits(docs)
    rows, shapley = {}, Counter()
    for part in {p for _, p, _ in bits}:
        for order in map("".join, permutations("ABCDE")):
            alive = [(d, b) for d, p, b in bits if p == part]
            for step, f in enumerate(order, 1):
                gone = [(d, b) for d, b in alive if b[f]]
                alive = [(d, b) for d, b in alive if not b[f]]
                fails = [b for _, p, b in bits if p == part and b[f]]
                shapley[part, f] += len(gone)
                rows[part, order, step] = [len(alive), len(gone), len(fails) - len(gone), sum(sum(b.values()) == 1 for b in fails),
                                           sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in rows.items())


def audit_rows(df):
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                          "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in df.collect())


def test_audit_equals_replay_of_every_order(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF0001}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = audit_rows(audit.op12_filter_audit(spark, SF0001))
    assert got == brute_audit(docs, labels) and len(got) == 600 * len({d[2] for d in docs})


def test_audit_edge_cases(spark):
    many = " ".join(f"w{i}" for i in range(150))
    rows = [(1, many, "en"), (2, many, "de"), (3, None, None), (4, "", ""), (5, "A B # " * 40_000, "en"), (2, many, "de"),
            (None, many, "en"), (None, None, None), (6, "ok " * 200, "x"), (7, many + " $", None)]
    labels = [(1, 1, 0), (2, 1, None), (2, None, 1), (6, 0, 1), (6, 1, 1), (99, 1, 1), (None, 1, 1), (5, None, None)]
    table = spark.createDataFrame([(*r, "s", 1) for r in labels], "doc_id long, quality int, toxic int, part string, copies long")
    got = audit_rows(audit.audit(documents(spark, rows), table))
    assert got == brute_audit(rows, labels)
    assert audit.audit(documents(spark, []), table).count() == 0
    assert len(audit_rows(audit.audit(documents(spark, rows[:1]), table.limit(0)))) == 600


def test_audit_of_a_hot_text_and_a_hot_id(spark):
    rows = [(i, "the same text", "en") for i in range(300)] + [(7, f"text {i % 40}", "de") for i in range(300)]
    assert audit_rows(audit.audit(documents(spark, rows), spark.createDataFrame([(7, 1, 1)], "doc_id long, quality int, toxic int"))) \
        == brute_audit(rows, [(7, 1, 1)])


def test_contraction_equals_sums():
    counts = np.random.default_rng(3).integers(0, 9, (2, 2, 2, 2, 2, 2))
    chosen = np.array([[(1, 0), (0, 1), (1, 1), (1, 1), (0, 1)]])
    assert audit.contract(counts, chosen).tolist() == [counts[:, 0, 1, :, :, 1].sum(axis=(1, 2)).tolist()]


# exact duplicates

def brute_exact(docs):
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in docs]
    ids = {}
    for (d, _), t in zip(docs, texts):
        ids.setdefault(t, []).append(d)
    out = Counter()
    for t, members in ids.items():
        keep = min((d for d in members if d is not None), default=None)
        for place, d in enumerate(sorted(members, key=lambda d: (d is None, d or 0))):
            out[d, keep, len(members), place == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def exact_rows(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return Counter(tuple(r) for r in df.collect())


WEAK = {"one bucket": lambda c: F.lit(0).cast("long"), "eight": lambda c: F.shiftleft(F.xxhash64(c), 61),
        "last bits": lambda c: F.pmod(F.xxhash64(c), F.lit(50)), "whole": F.xxhash64}


@pytest.mark.parametrize("hash_name", sorted(WEAK))
@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_exact_duplicates_equal_brute_force(spark, hash_name, hot_rows):
    """Weak hashes put different texts under one key: their chains are told apart by bytes, hot or not."""
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    got = exact_dedup.exact_duplicates(docs, capacity=4, hot_rows=hot_rows, hash_of=WEAK[hash_name])
    assert exact_rows(got) == brute_exact([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_exact_duplicates_edge_cases(spark):
    long_text = " ".join(f"w{i}" for i in range(60_000))
    rows = [(3, "a  b", "en"), (2, "a\t\n\x0b\x0c\rb", None), (1, "a b ", None), (None, "a b", "en"), (2, "a b", None), (2, "a b", None),
            (4, None, None), (5, "", "x"), (6, " ", "x"), (7, "\t \n", "x"), (None, "no id", None), (None, "no id", None),
            (8, long_text, "en"), (9, long_text, "en"), (10, "A b", None), (11, "a b", None)]
    got = exact_rows(exact_dedup.exact_duplicates(documents(spark, rows), capacity=1))
    assert got == brute_exact([(d, t) for d, t, _ in rows])
    assert sum(n for (_, _, _, kept, _), n in got.items() if kept) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows})
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0


def test_exact_duplicates_of_a_hot_text(spark):
    rows = [(10_000 - i, "hot\ttext" if i % 2 else "hot  text", "en") for i in range(3000)] + [(i, f"t{i % 700}", "de") for i in range(1400)]
    assert exact_rows(exact_dedup.exact_duplicates(documents(spark, rows))) == brute_exact([(d, t) for d, t, _ in rows])


def test_directory_splits_only_overfull_buckets(spark):
    """Slots cover each key once, no bucket is overfull, none is split without need, chains number the texts of a key."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    pages, slots, records = exact_dedup.exact_groups(docs, capacity=50, hash_of=lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 62)))
    depth = slots.agg(F.max("depth")).first()[0]
    table = {r["slot"]: (r["bucket"], r["depth"]) for r in slots.collect()}
    assert len(table) == slots.count()
    keys = [r["key"] for r in pages.select("key").distinct().collect()]
    in_bucket = Counter(table[key >> (64 - depth)] for key in keys)
    assert max(in_bucket.values()) <= 50 and len({d for _, d in in_bucket}) > 1
    for (bucket, local), n in in_bucket.items():
        assert len({s for s, b in table.items() if b[0] == bucket}) == 1 << (depth - local)
        parent = bucket >> (depth - local + 1)
        assert sum(n for (b, _), n in in_bucket.items() if b >> (depth - local + 1) == parent) > 50
    assert records.groupBy("key", "chain").count().where("count > 1").isEmpty()
    assert records.agg(F.sum("n")).first()[0] == docs.count()
