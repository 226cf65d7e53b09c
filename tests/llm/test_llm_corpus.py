"""Language ID, quality classifier, near-duplicates, packing and the pipeline against brute force and edge cases."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telemetry_lake.llm import language, near_duplicates, packing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, part int, row string, node long"


def edge_documents(spark, texts=None):
    """Null fields, empty and very long texts, repeated rows and ids, columns that clash with inner names."""
    long_text = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
    base = texts or ["the cat sat on the mat and the dog", "der hund und die katze sind im haus", None, "", "   \n\t ",
                     "1234 5678 !!!", long_text, "the cat sat on the mat and the dog", "x"]
    rows = [(i, t, "en" if i % 2 else "de", None, None, 0.5, 1, "r", 7) for i, t in enumerate(base)]
    rows += [rows[0], rows[0], (None, "no id here at all", "en", "s", 1, None, None, None, None),
             (None, "no id here at all", None, "s", 1, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute_components(docs, n, percent):
    """Component of each (doc_id, text) by comparing all pairs that share a shingle."""
    sets = [shingles(t, n) for _, t in docs]
    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen = set()
    for members in by_shingle.values():
        for a in range(len(members)):
            for b in range(a):
                if (members[a], members[b]) not in seen:
                    seen.add((members[a], members[b]))
                    x, y = sets[members[a]], sets[members[b]]
                    if 100 * len(x & y) >= percent * len(x | y):
                        root[find(members[a])] = find(members[b])
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def test_near_duplicates_equal_brute_force(spark):
    got = near_duplicates.op8_minhash_near_duplicates(spark, SF001)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want = brute_components(docs, 3, 85)
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == sorted(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_near_duplicates_dense_group(spark):
    """Hundreds of near copies are one component, without a pair for each two of them."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(600):
        words = list(base)
        words[int(rng.integers(120))] = f"v{i}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(5000 + i, " ".join(f"u{i}_{j}" for j in range(30))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs, 3, 85).collect()}
    assert {got[d] for d, _ in rows[:600]} == {401}
    assert all(got[5000 + i] == 5000 + i for i in range(50))


def test_near_duplicates_star(spark):
    """Hundreds of copies of one text, each like the text but not like each other: the text links them all."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(400)]
    rows = [(10_000, " ".join(base))]
    for i in range(700):
        words = list(base)
        for at in rng.choice(130, 9, replace=False) * 3:
            words[at] = f"v{i}_{at}"
        rows.append((i, " ".join(words)))
    want = brute_components(rows[:40], 3, 85)
    assert {c for _, _, c in want} == {0}  # by way of the text alone: without it they fall apart
    assert len({c for _, _, c in brute_components(rows[1:40], 3, 85)}) > 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs, 3, 85).collect()}
    assert set(got.values()) == {0}


def test_near_duplicates_edge_cases(spark):
    docs = edge_documents(spark)
    got = near_duplicates.near_duplicates(docs, 3, 85)
    assert got.count() == docs.count()
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r["doc_id"], []).append(r)
    assert len(by_id[0]) == 3 and {r["component_id"] for r in by_id[0] + by_id[7]} == {0}
    assert [r["n_shingles"] for i in (2, 3, 4) for r in by_id[i]] == [0, 0, 0]
    assert [by_id[i][0]["component_id"] for i in (2, 3, 4, 8)] == [2, 3, 4, 8]
    assert {r["component_id"] for r in by_id[None]} == {None}
    assert near_duplicates.near_duplicates(docs.limit(0), 3, 85).count() == 0
    kept = near_duplicates.near_duplicate_stage(spark, docs, SF001)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([0, 1, 2, 3, 4, 5, 6, 8, None])


def test_near_duplicates_template_below_the_threshold(spark, monkeypatch):
    """Texts that share a long passage, alike just below the threshold: blocks of strays meet, only links leave a cell."""
    monkeypatch.setattr(near_duplicates, "STRAY_BLOCK", 32)
    passage = [f"w{i}" for i in range(510)]
    rows = []
    for i in range(240):
        own = [f"v{i}_{j}" for j in range(90)]
        rows.append((2 * i, " ".join(passage + own)))
        if i % 3 == 0:
            rows.append((2 * i + 1, " ".join(passage + own[:60] + [f"x{i}"] + own[61:])))
    want = {d: c for d, _, c in brute_components(rows, 3, 85)}
    assert len(set(want.values())) == 240
    sent, plain = [], near_duplicates.between_strays
    monkeypatch.setattr(near_duplicates, "between_strays", lambda *a: sent.append(plain(*a)) or sent[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs, 3, 85).collect()}
    assert got == want
    assert sent[0].count() <= 80


@pytest.mark.parametrize("percent", [80, 85])
def test_sets_that_share_a_passage_bring_no_pairs(percent):
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 1 << 60, 425).astype(np.uint64)
    apart = (400, 100) if percent == 80 else (425, 75)
    sets = [np.unique(np.concatenate([passage[:apart[0]], rng.integers(0, 1 << 60, apart[1]).astype(np.uint64)]))
            for _ in range(1000)]
    assert sum(len(met) for _, met in near_duplicates.sharing(sets, percent)) < 2000
    sets = [np.unique(rng.choice(passage[:60], int(rng.integers(1, 60)), replace=False)) for _ in range(300)]
    found = {(min(i, j), max(i, j)) for i, met in near_duplicates.sharing(sets, percent) for j in met.tolist()}
    assert {(i, j) for j in range(300) for i in range(j)
            if near_duplicates.linked(sets[i].tobytes(), sets[j].tobytes(), percent)} <= found


def test_candidate_windows_find_every_pair_of_a_short_run():
    import pyarrow as pa
    key = b"\0" * (4 * near_duplicates.DEPTH)
    n = near_duplicates.WINDOW + 1
    batches = [pa.RecordBatch.from_arrays([pa.array([0] * len(part), pa.int32()), pa.array([key] * len(part), pa.binary()),
                                           pa.array(part, pa.int64())], ["tree", "key", "node"])
               for part in (list(range(4)), list(range(4, n)))]
    pairs = {(a, b) for out in near_duplicates.neighbours(iter(batches))
             for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist())}
    assert pairs == {(i, j) for i in range(n) for j in range(i + 1, n)}


def test_language_on_held_out_documents(spark):
    got = language.op7_language_id(spark, SF001)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = got.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    scored = [r for r in rows if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang"] == r["lang_pred"] for r in scored]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_mixture_selects_both_languages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("n_chars > 1500")
    model = language.fit(docs)
    one = {x: docs.where(F.col("lang") == x).orderBy("doc_id").first()["text"][:1500] for x in ("en", "de")}
    import pyarrow as pa
    pred, score, sets = language.predict_texts(pa.array([one["en"], one["en"] + "\n" + one["de"]]), *model)
    assert pred[0] == "en" and sets[0] == ["en"] and score[0] > 0.95
    assert sets[1] == ["de", "en"] and 0.3 < score[1] < 0.7


def test_language_edge_cases(spark):
    docs = edge_documents(spark)
    model = language.fit(docs)
    got = language.identify(docs, model)
    rows = got.collect()
    assert len(rows) == docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows
               if not any(c.isalpha() for c in (r["text"] or "")))
    nothing = language.identify(docs, language.fit(docs.limit(0))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0
    kept = language.language_stage(spark, docs, SF001)
    assert kept.columns == docs.columns and kept.where("text IS NULL").count() == 0


def test_quality_on_unseen_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 3 > 0"), quality.graded(labels.where("doc_id % 3 = 0"))
    scored = quality.grade_documents(docs, quality.fit(docs, train)).join(test, "doc_id").collect()
    kept = {g: np.mean([r["tail_prob"] >= quality.KEEP_TAIL for r in scored if r["grade"] == g]) for g in range(3)}
    assert kept[2] >= 0.95 and kept[0] <= 0.1 and kept[1] <= 0.35
    assert all(abs(r["expected_grade"]) <= 2 and r["tail_prob"] <= r["expected_grade"] for r in scored)


def test_quality_thresholds_are_ordered_and_gradient_descends():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 600)
    feats, off = [], [0]
    for g in grade:
        feats += [10 + g] if rng.random() < 0.9 else []
        feats += [100 + int(rng.integers(5))]
        off.append(len(feats))
    w, cuts = quality.fit_ordinal(np.asarray(feats), np.asarray(off), grade)
    assert cuts[0] < cuts[1] and w[10] < w[11] <= 0


def test_quality_edge_cases(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (1, 1, 1), (None, 1, 0), (5, None, 0), (8, 1, None)],
                                   "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in quality.graded(labels).collect()) == [(0, 0), (1, 1)]
    rows = quality.grade_documents(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r["tail_prob"] <= 1 for r in rows)
    untrained = quality.grade_documents(docs, quality.fit(docs, labels.limit(0)))
    assert untrained.where(F.col("tail_prob") >= quality.KEEP_TAIL).count() == docs.count()
    assert quality.grade_documents(docs.limit(0), quality.fit(docs, labels)).count() == 0


def check_places(rows, lengths, capacities):
    bins, seen = {}, Counter()
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
        seen[r["doc_id"]] += r["length"]
    assert seen == lengths
    for members in bins.values():
        used = sum(r["length"] for r in members)
        assert {r["bin_used"] for r in members} == {used}
        assert {r["bin_capacity"] for r in members} == {min(c for c in capacities if c >= used)}
        spans = sorted((r["bin_offset"], r["bin_offset"] + r["length"]) for r in members)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_packing_places_every_token_once(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = packing.op4_best_fit_packing(spark, SF001).collect()
    lengths = Counter()
    for r in docs.collect():
        lengths[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) + 1
    check_places(rows, lengths, packing.CAPACITIES)
    sizes = {r["bin_id"]: (r["bin_capacity"], r["bin_used"]) for r in rows}
    assert sum(u for _, u in sizes.values()) >= 0.97 * sum(c for c, _ in sizes.values())


def test_packing_edge_cases(spark):
    docs = edge_documents(spark)
    rows = packing.pack(docs, capacities=(8, 16, 64), shard_rows=50).collect()
    lengths = Counter()
    for r in docs.collect():
        lengths[r["doc_id"]] += len((r["text"] or "").split()) + 1
    check_places(rows, lengths, (8, 16, 64))
    assert packing.pack(docs.limit(0)).count() == 0


@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_best_fit_is_as_good_as_plain_scanning(lengths):
    lengths = np.asarray(lengths)
    place, used = packing.best_fit(lengths, (16, 64), 64)
    bins: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):  # the same rule by scanning all bins
        fit = [b for b in range(len(bins)) if bins[b] + n <= 64]
        if fit:
            bins[max(fit, key=lambda b: bins[b])] += n
        else:
            bins.append(n)
    assert sorted(used.tolist()) == sorted(bins)
    assert np.bincount(place, weights=lengths).tolist() == used.tolist()


def test_joint_sizes_never_cost_more_than_one_size():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 500)
    _, size, used = packing.pack_lengths(lengths)
    for prefer in packing.CAPACITIES:
        place, contents = packing.best_fit(lengths, packing.CAPACITIES, prefer)
        sizes = np.asarray(packing.CAPACITIES)
        cost = (sizes[np.searchsorted(sizes, contents)] + packing.BIN_COST).sum()
        mine = {}
        place2, size2, _ = packing.pack_lengths(lengths)
        for p, s in zip(place2.tolist(), size2.tolist()):
            mine[p] = s + packing.BIN_COST
        assert sum(mine.values()) <= cost


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from telemetry_lake.llm.common import written

    docs = [spark.read.parquet(f"{SF001}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], SF001), f"test-{name}"))
    return docs


def test_pipeline_stages(spark, stages):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "minhash_near_duplicates",
                                                      "best_fit_packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    before = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    want = {c for _, n, c in brute_components(before, 5, 80)}
    assert sorted(r["doc_id"] for r in stages[3].select("doc_id").collect()) == sorted(want)
    packed = stages[4].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    kept = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) + 1 for r in stages[3].collect()}
    assert {r["doc_id"]: r["n"] for r in packed} == kept


def test_pipeline_run_equals_its_stages(spark, stages):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF001)
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in got.collect()) == sorted(
        (r["doc_id"], r["piece"], r["length"]) for r in stages[-1].collect())
