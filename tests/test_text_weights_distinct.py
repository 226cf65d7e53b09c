"""Term weights against a plain count, the trained embedder against numpy, distinct counts from bitmaps."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from datetime import date, timedelta

import numpy as np
from conftest import SF0001, rows
from pyspark.sql import functions as F

from telemetry_lake import adapters
from telemetry_lake.operators import distinct, text_weights
from telemetry_lake.sources import tables


def _source(spark):
    return adapters.knowledge_source(adapters.read_table(spark, SF0001, "documents"))


def _plain(texts):
    tf = {i: Counter(re.findall(r"\w+", (t or "").lower())) for i, t in texts.items()}
    df = Counter(w for c in tf.values() for w in c)
    return {(i, w): (n, n * math.log((len(texts) + 1) / (df[w] + 1))) for i, c in tf.items() for w, n in c.items()}


def test_term_weights_equal_a_plain_count(spark, monkeypatch):
    texts = {1: "The cat, the CAT!", 2: None, 3: "", 4: "the dog's naïve café_2 42", 5: "the " * 30, 6: "...", 7: "the end"}
    source = spark.createDataFrame(list(texts.items()), "id long, text_chunk string")
    for hot in (1000, 2):  # frequent terms by broadcast or not
        monkeypatch.setattr(text_weights, "HOT_ROWS", hot)
        got = {(r["id"], r["term"]): (r["tf"], r["weight"]) for r in text_weights.term_weights(source).collect()}
        want = _plain(texts)
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    assert text_weights.term_weights(source.limit(0)).count() == 0


def test_second_moments_and_projection_equal_numpy(spark):
    source = _source(spark)
    weights = text_weights.term_weights(source)
    vectors = {r["id"]: r["features"] for r in text_weights.hashed(weights, 32).collect()}
    x = np.array(list(vectors.values()))
    assert np.allclose(np.linalg.norm(x, axis=1)[np.abs(x).sum(axis=1) > 0], 1)
    got = text_weights.second_moments(text_weights.hashed(weights, 32), 32)
    assert np.allclose(got, x.T @ x)
    embed, projection = text_weights.train_embedder(source, dim=8, buckets=32)
    assert np.allclose(projection.T @ projection, np.eye(8), atol=1e-9)
    out = {r["id"]: r["embedding"] for r in embed(source).collect()}
    assert len(out) == source.count()
    for i, v in vectors.items():
        want = np.array(v) @ projection
        want = want / (np.linalg.norm(want) or 1)
        assert np.allclose(out[i], want, atol=1e-5)


def test_embedder_reads_unseen_and_empty_texts(spark):
    embed, _ = text_weights.train_embedder(_source(spark), dim=4, buckets=16)
    odd = spark.createDataFrame([(1, "zzzzunseen words"), (2, None), (3, "")], "id long, text_chunk string")
    got = {r["id"]: r["embedding"] for r in embed(odd).collect()}
    assert {i: len(v) for i, v in got.items()} == {1: 4, 2: 4, 3: 4} and not any(got[2]) and not any(got[3])


def test_distinct_counts_equal_a_recount_after_each_increment(spark, scratch):
    root = scratch("distinct")
    seen = []
    first = date(2024, 1, 1)
    for step in range(4):
        batch = [(f"C{(step * 37 + i * 7) % 90}", first + timedelta(days=(i * step + i) % 12)) for i in range(80)]
        batch += [("HOT", first + timedelta(days=step))] * 50 + [(None, first), ("LOST", None)]
        seen += [b for b in batch if b[0] and b[1]]
        distinct.absorb(spark, spark.createDataFrame(batch, "customer_id string, timestamp_date date"), root)
        for days in (1, 7):
            got = {r["day"]: r["customers"] for r in distinct.distinct_in_window(spark, root, days).collect()}
            assert got == {d: len({c for c, x in seen if d - timedelta(days=days - 1) <= x <= d}) for _, d in seen}
    numbers = tables.read_published(spark, root, distinct.DICTIONARY)
    assert sorted(r["number"] for r in numbers.collect()) == list(range(len({c for c, _ in seen})))
    assert rows(numbers.select(F.count_distinct("id").alias("n"))) == [(len({c for c, _ in seen}),)]


def test_stored_parameters_are_shredded_and_decisions_unchanged(spark, scratch):
    """All decision columns agree with those over JSON text, key order included; one parameter is one column of the scan."""
    from telemetry_lake.operators import governance
    from telemetry_lake.schemas import CALLS
    calls = adapters.calls_from_events(adapters.read_table(spark, SF0001, "events")).unionByName(spark.createDataFrame(
        [(-1, "get_customer_anomaly_score", '{"z":"drop table x","a":"; --"}'), (-2, "get_customer_anomaly_score", "[1]"),
         (-3, "get_customer_anomaly_score", "not json"), (-4, "get_customer_anomaly_score", '{"target_id":null,"b":{"c":1}}'),
         (-5, "get_customer_anomaly_score", "null"), (-6, "", "{}")], CALLS))
    path = scratch("calls")
    governance.store_calls(calls, path)
    stored = spark.read.parquet(path)
    cols = ["call_id", "function", "allowed", "control", "detail"]
    registry = governance.registry_frame(spark)
    assert rows(governance.decide(stored, registry).na.fill("", ["function"]), *cols) == \
        rows(governance.decide(calls, registry).na.fill("", ["function"]), *cols)
    asked = stored.select("call_id", governance.stored_parameter("target_id").alias("t"))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<call_id:bigint,params:struct<0:string>>" in plan
    assert asked.where("call_id = 5").first()["t"] == "5"


def test_features_take_one_step_a_term_and_texts_cross_the_network_whole(spark):
    """no expression over all places per place of a vector, and no shuffle of the terms before they are counted."""
    texts = [(1, "The cat, the CAT!"), (1, "the bird"), (2, None), (3, ""), (None, "the dog"), (4, "a dog of the house " * 40)]
    source = spark.createDataFrame(texts, "id long, text_chunk string")
    asked = spark.createDataFrame([*texts, (5, "unseen words of a cat")], "id long, text_chunk string")
    embed = text_weights.weighted_embedder(source, 16)
    out = embed(asked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "SortMergeJoin [term" not in plan
    counted = text_weights.term_counts(asked)._jdf.queryExecution().executedPlan().toString()
    assert counted.count("Exchange") == 1 and counted.index("Generate") < counted.index("Exchange")

    tf, known = {}, {}
    for rows_, into in ((texts, known), (asked.collect(), tf)):
        for i, t in rows_:
            into.setdefault(i, Counter()).update(re.findall(r"\w+", (t or "").lower()))
    df = Counter(w for c in known.values() for w in c)
    got = out.collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = np.zeros(16)
        for w, n in tf[r["id"]].items() if r["id"] is not None else ():
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += n * math.log((len(texts) + 1) / (df[w] + 1))
        want /= np.linalg.norm(want) or 1
        assert np.allclose(r["embedding"], want, atol=1e-6), r["id"]
