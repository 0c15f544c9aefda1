"""The quality classifier on each kind of junk, and on trusted rows that it has not seen."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from lexolith.llm import quality


def kind_of(text):
    words = text.split()
    if sum(a == b for a, b in zip(words, words[1:])) >= 0.5 * max(1, len(words) - 1):
        return "repeats"
    return "table" if " | " in text else "shouted" if "!!" in text else "noise" if re.search(r"[#$%&*]{3}", text) else "other"


def test_each_kind_of_junk_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.join(labels.filter("quality = 0"), "doc_id", "left_semi").collect()}
    judged = quality.classify(docs, labels).filter("__keep").select("doc_id").collect()
    found = Counter(kind_of(t) for t in texts.values())
    kept = Counter(kind_of(texts[r.doc_id]) for r in judged if r.doc_id in texts)
    assert {"repeats", "table", "shouted", "noise"} <= set(found)
    assert all(kept[k] <= 0.05 * n for k, n in found.items())


def test_repeated_words_are_one_event():
    scorer = quality.WordScorer(quality.Model("m", 1, {}, {"": -1.0}, repeats=0.01))
    once, n = scorer.text("of")
    twice, m = scorer.text("of of")
    assert n == 3 and m == 4 and abs(twice - once - scorer.again) < 1e-9
    assert abs(scorer.text("of in of")[0] - 3 * once) < 1e-9


def test_trusted_rows_that_are_not_labelled_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    unseen = labels.filter("quality = 1 AND doc_id % 2 = 1").select("doc_id")
    judged = quality.classify(docs, labels.filter("doc_id % 2 = 0")).join(unseen, "doc_id", "left_semi").select("__keep").collect()
    assert len(judged) > 150 and sum(not r["__keep"] for r in judged) <= 0.02 * len(judged)


def test_all_trusted_rows_are_fitted_and_large_models_are_joined(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_ROWS", 1)
    texts = ["the cat sat on the mat", "a dog dog dog ran", "the the theme", None, "", " \x1c ", "zebra été 😀😀", "the cat sat on the mat"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = docs.select(F.col("doc_id").alias("trusted"))
    used = [texts[r[0]] for r in trusted.filter(~quality.is_held_out()).collect()]
    words = quality.words_of(docs, trusted, None, "doc_id", "text")
    assert words.agg(F.sum("c")).first()[0] == sum(len((t or "").replace("\x1c", " ").split()) for t in used) + sum("\x1c" in (t or "") for t in used)
    sent, joined = (quality.fitted(docs, trusted, 4, entries=n) for n in (10**6, 0))
    assert sent.model is not None and joined.model is None
    a, b = (sorted((r.doc_id, round(r.x, 9), r.n) for r in m.score(docs, "text", "x", "n").collect()) for m in (sent, joined))
    assert a == b and len(a) == len(texts)


def test_no_text_is_shuffled_to_find_the_trusted_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} of it") for i in range(60)], "doc_id long, text string")
    trusted = docs.select(F.col("doc_id").alias("trusted"))
    plans = []
    kept = quality.checkpointed
    monkeypatch.setattr(quality, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = sorted(map(tuple, quality.words_of(docs, trusted, None, "doc_id", "text").collect()))
        monkeypatch.setattr(quality, "IDS_AT_ONCE", 7)
        assert sorted(map(tuple, quality.words_of(docs, trusted, None, "doc_id", "text").collect())) == want and len(want) > 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not any("SortMergeJoin" in p for p in plans) and any("BroadcastHashJoin" in p for p in plans)
