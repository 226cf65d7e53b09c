"""Tokeniser, search, fingerprints, extraction, language model and chat against brute force, round trips and edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_llm_corpus import edge_documents

from telemetry_lake.llm import chat, extraction, fingerprints, neighbours, ngram_trie, sentencepieces


# ---- SentencePiece --------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return sentencepieces.Vocabulary(sentencepieces.PIECES)


@pytest.fixture(scope="module")
def reference():
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=sentencepieces.PIECES)


def test_pieces_equal_the_library_on_documents(spark, reference):
    got = sentencepieces.op1_sentencepiece(spark, SF001)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    want = dict(zip(texts, reference.encode(list(texts.values()))))
    for r in rows:
        assert r["ids"] == want[r["doc_id"]] and r["n_pieces"] == len(r["ids"]) and r["round_trip"]
    back = {r["doc_id"]: r["text"] for r in sentencepieces.decode(got).collect()}
    assert back == texts


HARD = ["", " ", "  two  spaces ", "a\nb\tc", "日本語 テスト 😀😀", "▁under▁", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 50,
        "the theatre thereof therein", "\x00\x01", "ééé ñandú ßß", "<s></s><unk><0x41>", "x" * 3000,
        "internationalization and misunderstandings unquestionably", "a" + "́" * 5, "–—…“quoted”"]


def test_pieces_equal_the_library_on_hard_texts(vocabulary, reference):
    ids, off = sentencepieces.encode_texts(pa.array(HARD), vocabulary)
    for i, t in enumerate(HARD):
        assert ids[off[i]:off[i + 1]].tolist() == reference.encode(t), t


@given(st.lists(st.text(alphabet=st.sampled_from("abcdehinorst ▁éß日😀\n.,-"), max_size=40), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_pieces_equal_the_library_on_any_text(texts):
    from sentencepiece import SentencePieceProcessor
    if not hasattr(test_pieces_equal_the_library_on_any_text, "both"):
        test_pieces_equal_the_library_on_any_text.both = (
            sentencepieces.Vocabulary(sentencepieces.PIECES), SentencePieceProcessor(model_file=sentencepieces.PIECES))
    v, sp = test_pieces_equal_the_library_on_any_text.both
    ids, off = sentencepieces.encode_texts(pa.array(texts), v)
    want = sp.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
    decoded = sentencepieces.decode_ids(ids.astype(np.int64), off, v).to_pylist()
    assert decoded == [t.replace("▁", " ") for t in texts]


def test_pieces_index_finds_every_occurrence():
    text = "banana bandana ban"
    letters = sorted(set(text) - {" "})
    chars = np.asarray([0 if c == " " else letters.index(c) + 1 for c in text])
    index = sentencepieces.Index(chars, len(letters))
    words = ["ban", "ana", "an", "bandana", "d", "nab"]
    lo, hi = index.ranges([[letters.index(c) + 1 for c in w] for w in words])
    for w, a, b in zip(words, lo, hi):
        assert sorted(index.order[a:b].tolist()) == [i for i in range(len(text)) if text.startswith(w, i)]


def test_pieces_edge_cases(spark):
    docs = edge_documents(spark)
    rows = sentencepieces.encode(docs, verify=True).collect()
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    assert {tuple(r["ids"]) for r in rows if r["doc_id"] in (2, 3)} == {()}
    assert sentencepieces.encode(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [10**6, -5]), (3, [])], "doc_id long, ids array<int>")
    assert {r["text"] for r in sentencepieces.decode(odd).collect()} == {""}


# ---- nearest neighbours ---------------------------------------------------------------------------------------------------

def brute_nearest(ids, x, queries, k=5):
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for i in np.flatnonzero(queries):
        s = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def recall(found, want):
    return np.mean([len({v for v, _ in found.get(q, [])} & {v for v, _ in w}) / max(1, len(w)) for q, w in want.items()])


def as_dict(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_search_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.asarray([r["vec_id"] for r in rows]), np.asarray([r["embedding"] for r in rows], float)
    want = brute_nearest(ids, x, ids % 50 == 0)
    found = as_dict(neighbours.op2_learned_partitions(spark, sf))
    assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
    assert recall(found, want) >= 0.9
    at = {int(i): v for i, v in zip(ids, x)}
    for q, hits in found.items():
        for v, s in hits:
            assert abs(s - at[q] @ at[v] / np.linalg.norm(at[q]) / np.linalg.norm(at[v])) < 1e-12


def test_search_parts_blocks_and_copies(spark, monkeypatch):
    """Small blocks and chunks, one vector shared by a third of the rows: equal to brute force where every part is read."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "CHUNK", 8)
    monkeypatch.setattr(neighbours, "PART_ROWS", 100)
    monkeypatch.setattr(neighbours, "COVER", 1.0)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[::3] = x[0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = as_dict(neighbours.search(frame, F.col("vec_id") % 10 == 0))
    want = brute_nearest(np.arange(900), x.astype(float), np.arange(900) % 10 == 0)
    assert recall(found, want) >= 0.97
    assert [v for v, _ in found[0]] == [3, 6, 9, 12, 15] and [v for v, _ in found[30]] == [0, 3, 6, 9, 12]


def test_search_edge_cases(spark):
    good = [(i, [float(i), 1.0, 0.5]) for i in range(1, 5)]
    bad = [(50, None), (100, [0.0, 0.0, 0.0]), (150, [1.0, None, 2.0]), (200, [float("nan"), 1.0, 1.0]),
           (250, [float("inf"), 1.0, 1.0]), (300, []), (None, [1.0, 2.0, 3.0]), (350, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "c", 1) for i, v in good + bad + [(0, [1.0, 1.0, 0.5]), (0, [1.0, 1.0, 0.5])]],
                                  "vec_id long, embedding array<double>, part string, block int")
    found = as_dict(neighbours.search(frame, F.col("vec_id") % 50 == 0))
    assert list(found) == [0] and [v for v, _ in found[0]] == [1, 2, 3, 4]
    assert neighbours.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.search(frame.where("vec_id = 1"), F.col("vec_id") == 1).count() == 0


def test_graph_cut_is_balanced():
    rng = np.random.default_rng(0)
    x = neighbours.unit(rng.normal(size=(500, 8)))
    graph = neighbours.nearest(x, x, 6, own=True)
    part = neighbours.cut_graph(x, graph, 7)
    size = np.bincount(part, minlength=7)
    assert size.max() <= math.ceil(1.15 * 500 / 7) and size.min() > 0
    random_cut = (rng.permutation(part)[:, None] != rng.permutation(part)[graph]).mean()
    assert (part[:, None] != part[graph]).mean() < 0.75 * random_cut


# ---- fingerprints ---------------------------------------------------------------------------------------------------------

def wanted_versions(rows):
    """(doc_id, n_chars, sha256 of the edited text) by a plain sort."""
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1] or ""
        t = t or ""
        tail = len(t) // 3
        out.append((d, len(t), hashlib.sha256((t[:len(t) - tail] + nxt[:tail]).encode()).hexdigest()))
    return sorted(out)


def exact_likeness(a, b):
    ca, cb = (collections.Counter(fingerprints.pieces(t)) for t in (a, b))
    n, d = sum(ca.values()) + sum(cb.values()), sum(((ca - cb) + (cb - ca)).values())
    return (n - d) / (n + d) if n + d else 1.0


def test_fingerprints_equal_plain_computation(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = fingerprints.op5_iblt_fingerprints(spark, SF001).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == wanted_versions(rows)
    order = sorted(rows, key=lambda r: -r[0])
    after = {d: order[(i + 1) % len(order)][1] for i, (d, _) in enumerate(order)}
    texts = dict(rows)
    prints = collections.defaultdict(set)
    for r in got:
        t, nxt = texts[r["doc_id"]], after[r["doc_id"]]
        tail = len(t) // 3
        assert r["near_edited"] == pytest.approx(exact_likeness(t, t[:len(t) - tail] + nxt[:tail]))
        assert r["near_next"] == pytest.approx(exact_likeness(t, nxt))
        prints[t].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprints_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 1 << 12)
    rows = [(i * 7 % 501, f"text number {i}. " * (i % 9 + 1)) for i in range(501)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = fingerprints.fingerprint_versions(docs).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == wanted_versions(rows)


def test_fingerprints_edge_cases(spark):
    docs = edge_documents(spark)
    got = fingerprints.fingerprint_versions(docs)
    assert got.count() == docs.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.collect())
    same = got.where("doc_id = 0").select("fingerprint").distinct().count()
    assert same == 1
    one = fingerprints.fingerprint_versions(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.fingerprint_versions(docs.limit(0)).count() == 0


@given(st.lists(st.integers(0, 40), max_size=60), st.lists(st.integers(0, 40), max_size=60))
@settings(max_examples=80, deadline=None)
def test_peeling_recovers_the_difference(a, b):
    texts = ["".join(f"par {x}.\n" for x in side) for side in (a, b)]
    keys, off = fingerprints.digests(texts)
    base = fingerprints.Sketches(2, fingerprints.BASE).add(*fingerprints.chosen(keys, off, np.arange(2)))
    only_a, only_b = fingerprints.differences(keys, off, base, np.array([0]), np.array([1]))
    ca, cb = collections.Counter(a), collections.Counter(b)
    assert (only_a[0], only_b[0]) == (sum((ca - cb).values()), sum((cb - ca).values()))


# ---- extraction -----------------------------------------------------------------------------------------------------------

def article_text(page):
    """Main text of the test pages by their article element (a plain reading for comparison)."""
    import html
    body = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(
        r"</?(?:p|h1|br|article)>", body[1])] if body else []
    return " ".join(b for b in blocks if b)


def test_extraction_of_the_test_pages(spark):
    got = {r["page_id"]: r for r in extraction.op6_html_extraction(spark, SF001).collect()}
    pages = spark.read.parquet(f"{SF001}/pages.parquet").collect()
    assert len(got) == len(pages)
    right = [got[p["page_id"]]["text"] == article_text(p["html"]) for p in pages]
    assert np.mean(right) >= 0.98
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


UNSEEN_PAGE = """<html><head><title>no</title><style>x</style></head><body>
<div class="top-menu"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/a">News</a></li></ul></div>
<div class="cookie-notice"><p>We use cookies. Accept?</p></div>
<div class="content"><h1>A title &amp; more</h1><p>First paragraph of the story, with <b>bold</b> words and a long enough body.</p>
<p>Second   paragraph,&#10;also long enough to be read as text of the story.</p></div>
<div class="sidebar"><p>Other stories you may like</p><a href="/x">More</a></div>
<form><label>Name</label><input><button>Send</button></form>
<div class="comments"><div class="comment"><p>Great story, thanks a lot!</p></div></div>
<script>var p = "<p>not text</p>";</script><footer>Imprint &copy; 2020</footer></body></html>"""


def test_extraction_of_other_page_frames(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    weights = extraction.fit(pages)
    frame = spark.createDataFrame([(1, "u", UNSEEN_PAGE, "x")], "page_id long, url string, html string, text string")
    assert extraction.extract(frame, weights).first()["text"] == (
        "A title & more First paragraph of the story, with bold words and a long enough body. "
        "Second paragraph, also long enough to be read as text of the story.")


def test_extraction_edge_cases(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>unclosed <b>bold"), (None, "u", "just words"), (5, "u", "<<<>>> & &amp;"),
            (6, "u", "<article>" + "<p>long paragraph of text here.</p>" * 5000), (6, "u", "<!-- only a comment"), (7, "u", "<a"),
            (8, "u", "</div></p><article><p>after stray ends</article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extraction.extract(frame, extraction.fit(frame))
    assert got.count() == len(rows)
    texts = {(r["page_id"], r["n_blocks"]): r["text"] for r in got.collect()}
    assert texts[(1, 0)] == texts[(2, 0)] == texts[(7, 0)] == ""
    assert len(texts[(6, 5000)]) == 5000 * len("long paragraph of text here. ") - 1
    assert extraction.extract(frame.limit(0), extraction.fit(frame.limit(0))).count() == 0


@pytest.mark.parametrize("page", [
    "<html><head><title>t</title><meta charset=u><body><p>seen</p></body></html>",
    "<html><head><title>t</title><p>seen</p>",
    "<head><title>t</title>seen",
    "<head><link rel=x><a href=/>seen</a>",
    "<head><script>var a = '<p>';</script><div>seen</div>",
    "<head><template><i>no</i><body><p>seen",
    "<body><form><select><option>no<option>no</form><p>seen</p>",
    "<body><select><option>no<p>seen</p>",
    "<body><select><option>no<p>seen</p><select><option>no</select>",
    "<body><object data=x>no<div><p>seen</p></div>",
    "<body><object data=x><p>no</p></object><select><option><div>no</div></select><p>seen</p>",
    "<body><template><p>no</p><template><p>no</p></template></template><div>seen</div>",
    "<body><ul><li><object>no<li>seen</ul>"])
def test_unclosed_unseen_elements_end_at_blocks(page):
    assert [text for _, text in extraction.blocks(page)] == ["seen"]


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in extraction.new_weights().items()}
    x = rng.normal(size=(2, 5, 2 * extraction.WIDTH + 3))
    goal = rng.normal(size=(2, 5, extraction.STATE))
    out, trail = extraction.lstm(x, w, "f", True)
    _, dx, dh, dc = extraction.lstm_back(x, w, "f", trail, goal)
    for name, grad in (("xf", dx), ("hf", dh), ("cf", dc)):
        for at in [tuple(rng.integers(s) for s in w[name].shape) for _ in range(4)]:
            keep, e = w[name][at], 1e-2
            values = []
            for sign in (1, -1):
                w[name][at] = keep + sign * e
                values.append((extraction.lstm(x, w, "f")[0].astype(np.float64) * goal).sum())
            w[name][at] = keep
            assert (values[0] - values[1]) / (2 * e) == pytest.approx(grad[at], rel=0.03, abs=2e-3)


# ---- language model -------------------------------------------------------------------------------------------------------

def brute_lm(rows, order, mu):
    """Scores by dictionaries; probabilities are not quantised."""
    def tokens(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]

    def held(d):
        return zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0

    counts = [collections.Counter() for _ in range(order + 1)]
    context = [collections.Counter() for _ in range(order + 1)]
    for d, t in rows:
        if not held(d):
            ts = tokens(t)
            for n in range(1, order + 1):
                for i in range(n - 1, len(ts)):
                    counts[n][tuple(ts[i - n + 1:i + 1])] += 1
                    context[n][tuple(ts[i - n + 1:i])] += 1
    total, distinct = sum(counts[1].values()), len(counts[1])
    out = {}
    for d, t in rows:
        ts, score, base = tokens(t), 0.0, 0.0
        for i in range(len(ts)):
            p = (counts[1][(ts[i],)] + 0.1) / (total + 0.1 * (distinct + 1))
            base += math.log10(p)
            for n in range(2, min(order, i + 1) + 1):
                h = tuple(ts[i - n + 1:i])
                p = (counts[n][(*h, ts[i])] + mu * p) / (context[n][h] + mu)
            score += math.log10(p)
        out[d] = (held(d), len(ts), sum(counts[1][(x,)] > 0 for x in ts), total, base, score)
    return out


@pytest.mark.parametrize("order,shard_tokens", [(2, 1_500_000), (3, 20_000)])
def test_lm_equals_dictionaries(spark, order, shard_tokens):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = brute_lm([(r["doc_id"], r["text"]) for r in docs.collect()], order, ngram_trie.MU)
    got = ngram_trie.score_documents(docs, ngram_trie.crc_mod("doc_id", 10) == 0, order, shard_tokens=shard_tokens)
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        held, n, known, total, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, abs=0.02 * n + 1e-6)  # a byte each for probability and back-off
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_lm_spreads_frequent_contexts(spark):
    rows = [(i, "the " + " the ".join(f"w{(i * 31 + j) % 400}" for j in range(40))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lm(rows, 2, ngram_trie.MU)
    for r in ngram_trie.score_documents(docs, ngram_trie.crc_mod("doc_id", 10) == 0, 2, shard_tokens=2000).collect():
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)
        assert r["score"] == pytest.approx(want[r["doc_id"]][5], abs=0.02 * r["n_tokens"])


def test_lm_spreads_frequent_contexts_of_two_words(spark, monkeypatch):
    """A pair of words that every text repeats: its successors go to all shards, not to one."""
    rows = [(i, "in the " + " in the ".join(f"w{(i * 31 + j) % 400}" for j in range(40))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sent, plain = {}, ngram_trie.sent
    monkeypatch.setattr(ngram_trie, "sent", lambda n, hot, shards: sent.update({n: hot}) or plain(n, hot, shards))
    want = brute_lm(rows, 3, ngram_trie.MU)
    for r in ngram_trie.score_documents(docs, ngram_trie.crc_mod("doc_id", 10) == 0, 3, shard_tokens=2000).collect():
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)
        assert r["score"] == pytest.approx(want[r["doc_id"]][5], abs=0.02 * r["n_tokens"])
    assert [len(sent[n]) > 0 for n in (1, 2, 3)] == [False, True, True]


def test_lm_registered_query_is_a_trigram_model(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = brute_lm([(r["doc_id"], r["text"]) for r in docs.collect()], 3, ngram_trie.MU)
    for r in ngram_trie.op9_elias_fano_lm(spark, SF001).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]][5], abs=0.02 * r["n_tokens"] + 1e-6)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.lists(st.integers(0, 2**64 - 1), max_size=30))
@settings(max_examples=80, deadline=None)
def test_elias_fano_round_trip_and_search(values, others):
    values = np.unique(np.asarray(values, np.uint64))
    seq = ngram_trie.Monotone(ngram_trie.mapped(ngram_trie.encode(values)))
    assert (seq.all() == values).all()
    asked = np.sort(np.concatenate([np.asarray(others, np.uint64), values[::3]]))
    at = seq.find([asked])[0]
    assert [a >= 0 for a in at] == np.isin(asked, values).tolist()
    assert (values[at[at >= 0]] == asked[at >= 0]).all()


def test_lm_edge_cases(spark):
    docs = edge_documents(spark)
    want = brute_lm([(r["doc_id"], r["text"]) for r in docs.collect()], 2, ngram_trie.MU)
    rows = ngram_trie.score_documents(docs, ngram_trie.crc_mod("doc_id", 10) == 0).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["n_tokens"] == want[r["doc_id"]][1] and r["base_score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)
    assert ngram_trie.score_documents(docs.limit(0), F.lit(False)).count() == 0
    unlearned = ngram_trie.score_documents(docs, F.lit(True)).collect()
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 for r in unlearned)


# ---- chat -----------------------------------------------------------------------------------------------------------------

def digests_of(turns):
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    learned = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned),
            hashlib.sha256(learned.encode()).hexdigest())


def test_chat_formats_every_conversation(spark):
    talks = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF001}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks[r["conv_id"]].append((r["role"], r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    talks[-7] = [("user", said), ("assistant", said)]
    got = chat.op10_reply_trees(spark, SF001).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == {c: digests_of(t) for c, t in talks.items()}
    assert len(got) == len(talks)


pieces_of_text = st.one_of(st.sampled_from([*chat.CONTROL, "\\", "\n", " ", "a", "<", "[", "/", "s>", "INST]"]), st.text(max_size=3))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[TURN]"]),
                          st.lists(pieces_of_text, max_size=8).map("".join)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_chat_round_trip(turns):
    text, loss = chat.format_turns(turns)
    assert chat.read_turns(text) == turns
    assert [chat.unescape(text[s["start"]:s["start"] + s["length"]]) for s in loss] == [t for r, t in turns if r == "assistant"]
    for _, t in turns:
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_reply_trees_rank_branches(spark):
    """A tree with branches: the best paths by mean score, whole and in order."""
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 9.0), ("t", 5, 2, 0.0), ("t", 6, 3, 0.0),
            ("t", 7, 6, 0.0), ("u", 8, None, None), ("u", 9, 99, 1.0), ("v", 10, 11, 0.0), ("v", 11, 10, 0.0)]
    trees = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    paths = collections.defaultdict(list)
    for r in chat.best_paths(trees, top=2).orderBy("path", "position").collect():
        paths[r["path"]].append((r["node"], r["position"]))
    assert dict(paths) == {4: [(1, 1), (2, 2), (4, 3)], 7: [(1, 1), (3, 2), (6, 3), (7, 4)], 8: [(8, 1)], 9: [(9, 1)]}
    best = chat.best_paths(trees.where("tree = 't'"), top=1).select("path").distinct().collect()
    assert [r["path"] for r in best] == [4]


def test_chat_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, 0, "user", "lost"), (2, None, "assistant", ""),
            (3, 5, "tool", "y" * 100_000), (3, 2, "user", "first")] + [(9, i, "user", f"m{i}") for i in range(300)]
    talks = spark.createDataFrame([(*r, 1, 2) for r in rows],
                                  "conv_id long, turn long, role string, text string, node int, path int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_paths(chat.chained(talks))).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {1: 3, None: 1, 2: 1, 3: 2, 9: 300}
    assert tuple(got[9])[1:5] == digests_of([("user", f"m{i}") for i in range(300)])
    assert tuple(got[3])[1:5] == digests_of([("user", "first"), ("tool", "y" * 100_000)])
    assert chat.format_paths(chat.chained(talks.limit(0))).count() == 0
