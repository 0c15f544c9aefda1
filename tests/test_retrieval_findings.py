"""Findings on the retrieval queries at size: passes over texts, the k best of many queries, and pools of long texts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexolith.functions.text import tokens, words_of
from lexolith.operators import refine, retrieval
from lexolith.operators.retrieval import best_texts, nearest


def hits(found):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in found.collect())


def test_texts_are_read_once_for_a_block_of_queries(spark, monkeypatch):
    """One query of many terms among short ones makes no more blocks, and counts and scores come from one pass."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        made.add(1)
        return text

    chunks = spark.range(60).select(F.col("id").alias("doc_id"), noted(F.concat(F.lit("word w"), F.col("id") % 7)).alias("chunk"))
    long = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")
    asked = spark.range(20).select(F.col("id").alias("query_id"), F.when(F.col("id") == 0, long).otherwise(F.concat(F.lit("w"), F.col("id") % 7)).alias("query_text"))
    blocks, real = [], retrieval.alone
    monkeypatch.setattr(retrieval, "TERMS_PER_BLOCK", 200)
    monkeypatch.setattr(retrieval, "alone", lambda found, sent, n: (blocks.append(n), real(found, sent, n))[1])
    assert best_texts(asked, chunks, 3).count() == 60
    assert made.value == 60 and blocks == [1]


@pytest.mark.parametrize("terms, pairs, often, sums", [(10**6, 2_000_000, 512, 8192), (400, 500, 5, 8192), (150, 40, 0, 1), (10**6, 3000, 512, 70)])
def test_best_texts_in_steps_of_any_size(spark, monkeypatch, terms, pairs, often, sums):
    for name, value in (("TERMS_PER_BLOCK", terms), ("PAIRS_AT_ONCE", pairs), ("OFTEN", often), ("SUMS_AT_ONCE", sums), ("ROWS_PER_PART", 50), ("ROWS_AT_ONCE", 16)):
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(11)
    words = [f"t{i}" for i in range(60)] + ["the"] * 30
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 50)))) for _ in range(300)]
    texts[20:90] = [texts[19] + " the"] * 70  # ties
    texts[5], texts[6] = None, "!!"
    chunks = spark.createDataFrame(list(enumerate(texts)), "doc_id long, chunk string").repartition(4)
    asked = [(f"q{i}", (texts[i * 7 + 1] or "") + " The unheard") for i in range(30)] + [("none", None)]
    found = hits(best_texts(spark.createDataFrame(asked, "query_id string, query_text string"), chunks, 12))
    cut = [[w.decode() for w in words_of(t)] for t in texts]
    df = {w: sum(w in c for c in cut) for c in cut for w in c}
    mean = sum(map(len, cut)) / len(cut)
    score = lambda q, c: round(sum(np.log(1 + (300 - df[w] + 0.5) / (df[w] + 0.5)) * c.count(w) * 2.2 / (c.count(w) + 1.2 * (0.25 + 0.75 * len(c) / mean)) for w in q if w in c), 6)
    want = []
    for q, text in asked:
        best = sorted((-s, i) for i, c in enumerate(cut) if (s := score({w.decode() for w in words_of(text)}, c)) > 0)[:12]
        want += [(q, n + 1, i, pytest.approx(-s, abs=2e-6)) for n, (s, i) in enumerate(best)]
    assert found == sorted(want, key=lambda x: x[:2])


def test_no_chunks_and_no_queries(spark):
    chunks = spark.createDataFrame([(1, "a b")], "doc_id long, chunk string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, query_text string")
    for q, c in ((asked.limit(0), chunks), (asked, chunks.limit(0)), (asked.withColumn("query_text", F.lit("?")), chunks), (asked, chunks.withColumn("chunk", F.lit(None).cast("string")))):
        assert best_texts(q, c, 3).collect() == []
    assert [tuple(r) for r in best_texts(asked, chunks, 3).select("query_id", "doc_id", "rank").collect()] == [(1, 1, 1)]


def test_nearest_settles_often(spark, monkeypatch):
    """Small steps, ties across them, tags and vectors of several sizes."""
    monkeypatch.setattr(retrieval, "PAIRS_AT_ONCE", 60)
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.integers(-2, 3, 4 if i % 5 else 3)] for i in range(200)]
    chunks = spark.createDataFrame([(i, v, [f"g{i % 3}"]) for i, v in enumerate(vectors)], "doc_id long, vector array<float>, groups array<string>").repartition(3)
    asked = [(i, vectors[i * 3] if i else None, f"g{i % 4}") for i in range(15)]
    found = hits(nearest(spark.createDataFrame(asked, "query_id long, query_vector array<float>, tag string"), chunks, 6, F.col("groups")))
    want = []
    for q, v, tag in asked:
        dot = lambda w: sum(x * y for x, y in zip(v, w)) if v and len(v) == len(w) else 0.0  # noqa: B023, E731
        best = sorted((-dot(w), i) for i, w in enumerate(vectors) if f"g{i % 3}" == tag)[:6]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert found == sorted(want)


def test_words_are_the_tokens(spark):
    texts = ["Plain words, and 2 numbers", "naïve İstanbul Kelvin ﬀ ǅ", "", None, "a b c\td_e-f", "ΣΑΣ x² ٣ end"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokens(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r.w for r in rows] == [[w.decode() for w in words_of(t)] for t in texts]


@pytest.mark.parametrize("size, at_once", [(1, 8192), (2, 3), (3, 8192), (3, 5), (40, 7)])
def test_shingles_of_a_pool_are_shared_as_sets_say(monkeypatch, size, at_once):
    monkeypatch.setattr(refine, "SHINGLES_AT_ONCE", at_once)
    rng = np.random.default_rng(size)
    for many in (0, 1, 4, 30):
        texts = [[b"abcd"[i : i + 1] for i in rng.integers(0, 4, int(rng.choice([0, 1, 2, 3, 9, 60])))] for _ in range(many)]
        sets = [{tuple(t[i : i + size]) for i in range(max(1, len(t) - size + 1))} - {()} for t in texts]
        own, both = refine.shared_shingles(texts, size)
        assert own.tolist() == [len(s) for s in sets]
        assert all(both[i, j] == len(a & b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_a_pool_of_long_texts_is_folded_as_numbers(spark):
    """No text is cut by expressions that are worked out anew for each element, and the rows are those of the definition."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 500, 3000)]
    texts = [base, base[:2900], base + ["new"] * 400, base[1500:], ["other"] + base[:40], base[::-1], [], ["one"], ["one"]]
    rows = [(q, n + 1, n, " ".join(t)) for q in (1, 2) for n, t in enumerate(texts if q == 1 else texts[::-1])]
    kept = refine.without_contained(spark.createDataFrame(rows, "query_id int, rank int, doc_id long, chunk string").repartition(3), 3, 0.95)
    assert "aggregate(" not in kept._jdf.queryExecution().executedPlan().toString()
    sets = [{tuple(t[i : i + 3]) for i in range(max(1, len(t) - 2))} - {()} for t in texts]
    for q in (1, 2):
        stay = []
        for n in range(len(texts)):
            own = lambda i: sets[i if q == 1 else len(texts) - 1 - i]  # noqa: B023, E731
            if not (own(n) and any(len(own(n) & own(m)) / len(own(n)) >= 0.95 for m in stay)):
                stay.append(n)
        assert sorted((r["rank"], r.doc_id) for r in kept.filter(F.col("query_id") == q).collect()) == [(n + 1, n) for n in stay]
