"""Scores as a stream-stream join, arriving files against changing outcomes, and merged quantile sketches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexolith.operators import evaluation
from lexolith.streaming import scoring

H = 3600


def written(spark, path, rows, schema):
    """Rows as files that arrive one after another."""
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def scores_of(spark, tmp_path, messages, payloads):
    at = lambda c: F.timestamp_seconds(c).alias(c)
    spark.createDataFrame(messages, "filename string, asked_at long").select("filename", at("asked_at")).coalesce(1).write.parquet(f"{tmp_path}/messages")
    spark.createDataFrame(payloads, "name string, written_at long, payload string").select("name", at("written_at"), "payload").coalesce(1).write.parquet(f"{tmp_path}/payloads")
    asked = spark.readStream.schema("filename string, asked_at timestamp").parquet(f"{tmp_path}/messages")
    found = scoring.scored_messages(asked, spark.readStream.schema("name string, written_at timestamp, payload string").parquet(f"{tmp_path}/payloads"), F.length)
    scoring.scored_as_they_come(found, str(tmp_path)).awaitTermination()
    return [(r.filename, r.score) for r in spark.read.schema(found.schema).parquet(f"{tmp_path}/scores/batch=*").collect()]


def test_messages_meet_their_payloads_within_the_time(spark, tmp_path):
    """In time, at both edges, too early, after the message, none at all, two messages for one; the last rows move the watermark on."""
    base = 100 * H
    messages = [("in", base + 60), ("edge", base + H), ("now", base), ("early", base + H + 1), ("after", base), ("none", base), ("two", base + 1), ("two", base + 2), ("end", base + 9 * H)]
    payloads = [("in", base, "xx"), ("edge", base, "xxx"), ("now", base, ""), ("early", base, "x"), ("after", base + 1, "x"), ("two", base, "xxxx"), (None, base, "x"), ("unasked", base, "x"), ("end", base + 9 * H, "x")]
    got = scores_of(spark, tmp_path, messages, payloads)
    want = [("in", 2), ("edge", 3), ("now", 0), ("two", 4), ("two", 4), ("end", 1), ("early", None), ("after", None), ("none", None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_files_whose_outcome_came_before_are_skipped(spark, tmp_path):
    schema = "document_id string, client_id string, file string"
    rows = [("d1", "c", "f0"), ("d2", "c", "f1"), ("d1", "c", "f2"), ("d1", "other", "f3"), ("d1", None, "f4"), ("d2", " ", "f5"), ("d1", "", "f6")]
    written(spark, f"{tmp_path}/files", rows, schema)
    outcomes, seen = scoring.Outcomes(spark, f"{tmp_path}/outcomes"), []

    def work(batch, number):
        seen.extend(r.file for r in batch.collect())
        return batch.withColumn("status", F.lit("INGESTION_SUCCESS"))

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/files")
    scoring.new_documents(files, outcomes, work, f"{tmp_path}/state").awaitTermination()
    assert seen == ["f0", "f1", "f3", "f4", "f5"]  # f2 and f6 came after an outcome of the same document and client
    assert outcomes.before(2).count() == 2
    # a batch that runs again does not see its own outcomes
    outcomes.add(spark.createDataFrame([("d9", "c", "x")], outcomes.schema.replace(", batch int", "")), 7)
    assert outcomes.before(7).filter("document_id = 'd9'").count() == 0 and outcomes.before(8).filter("document_id = 'd9'").count() == 1


def test_sketches_merge_and_a_retried_batch_replaces(spark, tmp_path):
    rng = random.Random(3)
    values = [("a" if i % 3 else None, rng.lognormvariate(0, 1) if i % 50 else None) for i in range(30_000)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i long, kind string, score double").repartition(6)
    for number in (0, 1, 2, 1, 2):
        evaluation.publish_sketches(df.filter(F.col("i") % 3 == number), "score", f"{tmp_path}/s", number, "kind")
    shares = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = {r.kind: r for r in evaluation.sketched_distribution(spark, f"{tmp_path}/s", shares, "kind").collect()}
    exact = {r.kind: r for r in evaluation.distribution(df, "score", "kind").collect()}
    for kind in ("a", None):
        own = sorted(v for k, v in values if k == kind and v is not None)
        r = got[kind]
        assert r.n == len(own) == exact[kind].n and r.least == own[0] and r.greatest == own[-1] and r.mean == pytest.approx(exact[kind].mean, abs=1e-5)
        for share, q in zip(shares, r.quantiles):
            below = sum(v <= q for v in own) / len(own)
            assert abs(below - share) <= evaluation.RANK_ERROR + 1 / len(own)
        assert abs(sum(v <= exact[kind].median for v in own) - sum(v <= r.quantiles[2] for v in own)) <= 0.01 * len(own) + 1


def test_many_scores_come_by_slices_of_time(spark, tmp_path, monkeypatch):
    """Several micro-batches, each a slice of time, give what one gives."""
    from lexolith.queries import messages

    lines = [(i // 4, i % 4, float(i % 50), 86_400 * (1 + i * 37 % 60)) for i in range(3000)]
    df = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, at long")
    df.withColumn("l_shipdate", F.timestamp_seconds("at").cast("timestamp_ntz")).drop("at").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted(map(tuple, messages.stream_scores(spark, str(tmp_path)).collect()), key=repr)
    monkeypatch.setattr(scoring, "ROWS_AT_ONCE", 700)
    monkeypatch.setattr(scoring, "FILES_AT_ONCE", 2)
    places = []
    monkeypatch.setattr(messages, "new_place", lambda s, kind: places.append(f"{tmp_path}/{kind}") or places[-1])
    got = sorted(map(tuple, messages.stream_scores(spark, str(tmp_path)).collect()), key=repr)
    assert got == want and len(got) > 2000
    held = [len(spark.read.parquet(f"{tmp_path}/scoring/scores/batch={n}").take(1)) for n in range(5)]
    assert sum(held) >= 4  # rows leave the state as time goes on
