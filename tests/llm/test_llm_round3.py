"""Dense regions and survivors of near-duplicate removal, packing sizes, odd tables in the pipeline, broken pages, the trie."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF0001
from hypothesis import given, settings
from hypothesis import strategies as st

from telemetry_lake.llm import extraction, near_duplicates, ngram_trie, packing, sentencepieces
from telemetry_lake.llm.common import written


def template_pairs(n, passage=424, own=70, shared=17):
    """2 n texts of one template (background likeness 0.75 in 5-word shingles), n planted pairs just over 0.80."""
    lead = [f"w{i}" for i in range(passage)]
    rows = []
    for i in range(n):
        mine = [f"v{i}_{j}" for j in range(own)]
        rows.append((2 * i, " ".join(lead + mine)))
        rows.append((2 * i + 1, " ".join(lead + mine[:shared] + [f"x{i}_{j}" for j in range(own - shared)])))
    return rows


def test_no_link_is_lost_in_a_dense_region(spark):
    """The pipeline's setting: every planted pair is one component, and none is joined to another."""
    rows = template_pairs(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs, 5, 80).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_stray_depth_follows_the_threshold():
    for percent in (70, 80, 85, 90, 95):
        d = near_duplicates.stray_depth(percent)
        assert near_duplicates.LEAST_PREFIX <= d <= near_duplicates.DEPTH
        if d > near_duplicates.LEAST_PREFIX:
            assert (1 - (percent / 100) ** d) ** near_duplicates.TREES <= near_duplicates.STRAY_MISSED


def near_copy(text, i):
    return f"{text} end{i}"


def test_one_row_of_each_group_survives_whatever_the_ids(spark):
    base = [" ".join(f"g{g}w{i}" for i in range(80)) for g in range(6)]
    rows = [(7, base[0]), (7, near_copy(base[0], 1)),  # one id, two texts
            (None, base[1]), (None, near_copy(base[1], 1)), (None, near_copy(base[1], 2)),  # no ids
            (None, base[2]), (3, near_copy(base[2], 1)), (9, near_copy(base[2], 2)),
            (4, base[3]), (4, base[3]), (5, base[3]),  # the same row twice, a copy
            (11, base[4]), (12, base[5]), (20, None), (21, ""), (None, None), (None, " ")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    kept = near_duplicates.near_duplicate_stage(spark, docs, "")
    got = Counter((r["doc_id"], (r["text"] or "")[:2]) for r in kept.collect())
    assert kept.columns == docs.columns
    assert got == Counter({(7, "g0"): 1, (None, "g1"): 1, (3, "g2"): 1, (4, "g3"): 1, (11, "g4"): 1, (12, "g5"): 1,
                           (20, ""): 1, (21, ""): 1, (None, ""): 1, (None, " "): 1})


def test_classes_of_many_copies_meet_their_rows(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HOT_ROWS", 20)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(500 - i, text) for i in range(200)] + [(1000 + i, near_copy(text, i % 5)) for i in range(100)] + [(3, "other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs, 3, 85).collect()}
    assert got == {d: 3 if d == 3 else 301 for d, _ in rows}


# packing

def cost_of(place, size, attention=packing.ATTENTION):
    return sum(packing.bin_costs(np.array([s]), attention=attention)[0] for s in dict(zip(place.tolist(), size.tolist())).values())


def test_several_sizes_are_used_and_never_cost_more_than_one():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 4097, 3000), np.clip(rng.lognormal(5.5, 1, 4000), 1, 4096).astype(int), rng.integers(1, 300, 4000)):
        place, size, used = packing.pack_lengths(lengths, attention=packing.ATTENTION)
        sizes = np.asarray(packing.CAPACITIES)
        for prefer in packing.CAPACITIES:
            at, contents = packing.best_fit(lengths, packing.CAPACITIES, prefer)
            single = packing.bin_costs(sizes[np.searchsorted(sizes, contents)], attention=packing.ATTENTION).sum()
            assert cost_of(place, size) <= single + 1e-6
        assert (used <= size).all()
    sizes = Counter(packing.pack_lengths(np.clip(rng.lognormal(5.5, 1, 4000), 1, 4096).astype(int), attention=packing.ATTENTION)[1].tolist())
    assert len(sizes) == 4


def cheapest(lengths, capacities, cost):
    """Least cost over all ways to deal the pieces to bins."""
    best = float("inf")

    def go(i, bins):
        nonlocal best
        if i == len(lengths):
            best = min(best, sum(min(cost[c] for c in capacities if c >= b) for b in bins))
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= max(capacities):
                go(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1:]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


@given(st.lists(st.integers(1, 64), min_size=1, max_size=7))
@settings(max_examples=40, deadline=None)
def test_packing_is_close_to_the_exhaustive_optimum(lengths):
    capacities, attention = (16, 32, 64), 256
    cost = dict(zip(capacities, packing.bin_costs(np.array(capacities), 2, attention).tolist()))
    place, size, used = packing.pack_lengths(np.asarray(lengths), capacities, 2, attention)
    mine = sum(cost[s] for s in dict(zip(place.tolist(), size.tolist())).values())
    least = cheapest(lengths, capacities, cost)
    assert least - 1e-6 <= mine <= 1.5 * least


def test_a_bin_opens_in_the_size_that_fills_best():
    """A piece of 10 alone wants 16; with pieces that fill 32 exactly, 32 is cheaper per token."""
    capacities, costs = (16, 32), {16: 20.0, 32: 34.0}
    place, used = packing.best_fit(np.array([10]), capacities, None, costs)
    assert used.tolist() == [10]
    place, used = packing.best_fit(np.array([12, 10, 10]), capacities, None, costs)
    assert sorted(used.tolist()) == [32]
    waiting = packing.Waiting(np.array([5, 5, 3, 2]))
    assert [waiting.filled(r) for r in (1, 2, 4, 5, 9, 11, 12, 15, 99)] == [0, 2, 3, 5, 8, 10, 12, 15, 15]


# pipeline

def test_pipeline_on_an_empty_table_and_on_odd_ids(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF0001}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    good = docs.where("lang = 'en'").orderBy("doc_id").limit(40)
    twice = good.withColumn("doc_id", good["doc_id"] - good["doc_id"] + 5).unionByName(good.selectExpr(
        "cast(null as bigint) as doc_id", "concat(text, ' more') as text", "lang", "source", "n_chars"))
    written(good.unionByName(twice), "odd").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    before = written(twice, "twice")
    kept = near_duplicates.near_duplicate_stage(spark, before, str(tmp_path))
    assert kept.count() == near_duplicates.near_duplicates(before, 5, 80).select("root").distinct().count()
    for name, stage in corpus_pipeline.STAGES:
        if name != "quality_classifier" and name != "language_id":
            assert stage(spark, docs.limit(0), SF0001).count() == 0


# extraction

def test_a_stray_quote_is_a_character():
    for page, want in (('<p class=a">Hello world</p>', ["Hello world"]), ('<p>one</p><p title="it>Hello', ["one"]),
                       ("<p class='a\">x</p>' id=b>two</p>", ["two"]), ('<p "class>three</p>', ["three"]),
                       ('<a href=x?y="z>four</a>', ["four"]), ('<p title = "a > b">five</p>', ["five"]), ("six <", ["six <"])):
        assert [t for _, t in extraction.blocks(page)] == want


@pytest.mark.parametrize("page", ["<a " * 340_000 + '"', "<div>x" * 170_000, "<b>x" * 200_000, "<select><p>" * 90_000, '<a x="' * 160_000,
                                  "<" * 1_000_000, "<!--" * 250_000, "<b>" * 150_000 + "<p>y" * 100_000], ids=lambda p: p[:9])
def test_broken_pages_take_linear_time(page):
    import time
    start = time.perf_counter()
    found = extraction.blocks(page)
    assert time.perf_counter() - start < 60
    assert max((len(marks) for marks, _ in found), default=0) < 100


def test_hidden_is_an_attribute_or_a_class_of_its_own():
    marks = lambda attributes: extraction.blocks(f"<div {attributes}>text</div>")[0][0]
    for shown in ('aria-hidden="false"', 'data-hidden="x"', 'title="nothing"'):
        assert ".hidden" not in marks(shown)
    assert marks('class="overflow-hidden"').count(".hidden") == 1  # a part of the class name, not the mark of hiding
    assert marks('class="hidden"').count(".hidden") == 2
    for hidden in ("hidden", "hidden=''", 'aria-hidden="true"', 'style="display: none"', 'class="hidden wide"'):
        assert ".hidden" in marks(hidden)


# language model

def test_a_lookup_is_bounded_by_its_pointers():
    """Words of other contexts are never found; a wrong pointer changes the answer."""
    rng = np.random.default_rng(6)
    parent = np.sort(rng.integers(0, 300, 5000))
    keys = np.unique((parent.astype(np.uint64) << np.uint64(ngram_trie.SUCCESSOR_BITS)) | rng.integers(0, 400, 5000).astype(np.uint64))
    level = ngram_trie.Level(keys, 300, np.ones(len(keys), np.int64), np.full(300, 20), 2.0)
    context = np.sort(rng.integers(-1, 300, 3000))
    word = rng.integers(0, 400, 3000).astype(np.uint64)
    asked = (context.astype(np.uint64) << np.uint64(ngram_trie.SUCCESSOR_BITS)) | word
    at = np.searchsorted(keys, asked)
    want = np.where((context >= 0) & (keys[np.minimum(at, len(keys) - 1)] == asked), at, -1)
    assert (level.find([context, context[:50]], [word, word[:50]])[0] == want).all() and (want >= 0).sum() > 50
    pointers = level.pointers.all()
    pointers[100:200] = pointers[100]
    level.pointers = ngram_trie.Monotone(ngram_trie.mapped(ngram_trie.encode(pointers)))
    found = level.find([context], [word])[0]
    cut = (context >= 100) & (context < 199)
    assert (found[cut] == -1).all() and (want[cut] >= 0).any() and (found[context < 100] == want[context < 100]).all()


def test_a_level_over_several_blocks(monkeypatch):
    monkeypatch.setattr(ngram_trie, "BLOCK", 64)
    keys = np.unique(np.concatenate([np.arange(0, 1000, 3), (1 << ngram_trie.SUCCESSOR_BITS) + np.arange(500), (4 << ngram_trie.SUCCESSOR_BITS) + np.arange(0, 90, 2)])).astype(np.uint64)
    level = ngram_trie.Level(keys, 6, np.ones(len(keys), np.int64), np.full(6, 500), 2.0)
    context = np.repeat(np.arange(6), 1000)
    word = np.tile(np.arange(1000), 6).astype(np.uint64)
    found = level.find([context], [word])[0]
    asked = (context.astype(np.uint64) << np.uint64(ngram_trie.SUCCESSOR_BITS)) | word
    assert (found >= 0).tolist() == np.isin(asked, keys).tolist() and (keys[found[found >= 0]] == asked[found >= 0]).all()


def test_parcels_name_every_ancestor_once():
    """A spread context goes to every shard that holds a successor; each n-gram has its own count in one shard only."""
    texts = ["in the " + " in the ".join(f"w{(i * 7 + j) % 50}" for j in range(30)) for i in range(20)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(20), pa.int64()), "held": pa.array([False] * 20),
                                        "text": pa.array(texts)})
    codes, vocab, ptr = ngram_trie.split_words(batch.column("text"))
    codes = np.insert(codes.astype(np.uint32), ptr[1:], len(vocab))
    ends = (ptr[1:] + np.arange(1, len(ptr))).astype(np.int64)
    packed = ngram_trie.packed(np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T).tobytes())
    words = np.append(ngram_trie.hash_words(vocab), ngram_trie.END)
    chunk = ngram_trie.Chunk(ends.tobytes(), packed, ngram_trie.planes(words >> np.uint64(8), 7), [False] * 20)
    grams = chunk.grams(3)
    hot = [np.sort(g.hash[g.count > 300]) for g in grams[:2]]
    assert all(len(h) for h in hot)
    parcels = ngram_trie.Parcels(grams, [ngram_trie.sent(n, hot[n - 2] if n > 1 else hot[0][:0], 8) for n in (1, 2, 3)])
    for n in (1, 2):
        own = parcels.entry[n][parcels.mine[n]]
        assert sorted(own.tolist()) == list(range(len(grams[n].hash)))
        assert parcels.children[n - 1].sum() == len(parcels.entry[n])
    assert len(parcels.entry[1]) > len(grams[1].hash)  # "in the" stands above its successors in several shards


# pieces

def test_long_units_equal_the_library_in_time_that_grows_with_their_length():
    import random
    import time

    from sentencepiece import SentencePieceProcessor

    vocabulary, reference = sentencepieces.Vocabulary(sentencepieces.PIECES), SentencePieceProcessor(model_file=sentencepieces.PIECES)
    rng = random.Random(0)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    spaced = " ".join(letters[i:i + 6] for i in range(0, len(letters), 6))
    took = {}
    for name, text in (("warm", "a few words"), ("spaced", spaced), ("letters", letters), ("one letter", "a" * 60_000),
                       ("no spaces", "theinternationalisationofunquestionablemisunderstandings" * 500), ("mixed", "語x" * 20_000 + " tail")):
        start = time.perf_counter()
        ids, _ = sentencepieces.encode_texts(pa.array([text]), vocabulary)
        took[name] = time.perf_counter() - start
        assert ids.tolist() == reference.encode(text), name
    assert took["letters"] < 3 * took["spaced"] + 1
    many = [letters[:n] for n in range(1, 400, 7)] + [letters[500:3000], "", "b c"]
    ids, off = sentencepieces.encode_texts(pa.array(many), vocabulary)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == reference.encode(many)


@pytest.mark.parametrize("window", [3, 50_000])
def test_windows_of_a_long_unit_do_not_change_its_pieces(monkeypatch, window):
    from sentencepiece import SentencePieceProcessor

    monkeypatch.setattr(sentencepieces, "WINDOW", window)
    vocabulary, reference = sentencepieces.Vocabulary(sentencepieces.PIECES), SentencePieceProcessor(model_file=sentencepieces.PIECES)
    for text in ("unquestionably" * 20, "aaaaabaaaa" * 30, "x" * 333, "日本語テスト" * 9):
        assert sentencepieces.encode_texts(pa.array([text]), vocabulary)[0].tolist() == reference.encode(text)


def test_tasks_of_the_pipeline_work_on_small_slices(monkeypatch):
    """Pipeline: what a worker holds at once follows from 2 MB of text, whatever the batch; results do not depend on it."""
    import numpy as np
    import pyarrow as pa

    from telemetry_lake.llm import language, near_duplicates

    words = np.random.default_rng(3).integers(0, 4000, (1200, 900))
    texts = [" ".join(f"w{x}" for x in row) for row in words]
    assert sum(map(len, texts)) > 5 << 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200), pa.int64()), pa.array(range(1200), pa.int64()), pa.array(texts),
                                        pa.array(["en"] * 1200)], ["doc_id", "row_key", "text", "lang"])
    out = list(near_duplicates.fingerprints(3)(iter([batch])))
    assert len(out) >= 3 and sum(b.num_rows for b in out) == 1200
    one = list(near_duplicates.fingerprints(3)(iter([batch.slice(i, 400) for i in (0, 400, 800)])))
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches(one))

    seen, split = [], language.split_words
    monkeypatch.setattr(language, "split_words", lambda x: seen.append(sum(len(t) for t in x.to_pylist())) or split(x))
    assert sum(sum(b.column("n").to_pylist()) for b in language.gram_counts(iter([batch]))) > 0
    assert max(seen) < (2 << 20) + 10_000 and sum(seen) == sum(map(len, texts))
