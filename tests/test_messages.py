"""Messages, chunks, answers and loads on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexolith.functions import predicates, requests
from lexolith.operators import chunks, evaluation, lifecycle, migrate
from lexolith.sources import payloads, streams
from lexolith.streaming import answers as answer_streams
from lexolith.streaming import dedupe, guard, redelivery
from lexolith.streaming.guard import Message

PAIRS = payloads.PAIRS


def test_triage_of_requests(spark):
    full = {"transactionId": "t", "userQuery": "q", "queryPrompt": "p", "metadataFilter": [{"key": "k", "value": "v"}]}
    bodies = [json.dumps(full), "", "{oops", json.dumps(full | {"userQuery": " "}), json.dumps(full | {"metadataFilter": []}), json.dumps({k: v for k, v in full.items() if k != "metadataFilter"}), None]
    work, again, dropped = payloads.triaged(spark.createDataFrame(list(enumerate(bodies)), "n int, body string"))
    assert [[r.n for r in x.orderBy("n").collect()] for x in (work, again, dropped)] == [[0], [1, 2, 6], [3, 4, 5]]


def test_sent_messages_come_back_once_for_each_batch(spark, tmp_path):
    rows = spark.createDataFrame([("t1", "a\nb"), ("t2", None)], "transactionId string, userQuery string")
    for _ in range(2):  # a batch that is delivered twice
        streams.send(rows, f"{tmp_path}/q", 0)
    streams.send(rows.limit(1), f"{tmp_path}/q", 1)
    seen: list = []
    note = lambda batch, number: seen.extend(batch.collect())
    running = streams.handled(streams.message_stream(spark, f"{tmp_path}/q", "scoring", lines=True), payloads.ANSWER_REQUEST, f"{tmp_path}/state", note, note)
    running.awaitTermination()
    assert sorted((r.transactionId, r.userQuery) for r in seen) == sorted([("t1", "a\nb"), ("t2", None), *[(r.transactionId, r.userQuery) for r in rows.limit(1).collect()]])


def test_failed_deliveries(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3)], "deliveries int").withColumn("at", F.timestamp_seconds(F.lit(100)))
    found = lambda kind: [(r.poisoned, r.v) for r in streams.after_failure(rows, kind).select("poisoned", F.unix_timestamp("visible_at").alias("v"), "deliveries").orderBy("deliveries").collect()]
    assert found("generation") == [(False, 400), (False, 400), (True, None)] and found("scoring") == [(False, 130), (True, None), (True, None)]


def test_chunks_and_their_documents(spark):
    segments = spark.createDataFrame([("c1", "d1", 1, 0, "x"), ("c2", "d1", 2, 0, "y"), ("c3", "gone", 1, 0, "z")], "id string, document_id string, page_number int, chunk_index int, chunk string")
    documents = spark.createDataFrame([("d1", "f", "u", "c", {"a": "b"}), ("d1", "f", "u", "c", {"a": "b"})], "document_id string, name string, url string, client_id string, metadata map<string,string>")
    rows = chunks.with_document(segments, documents)
    assert sorted((r.id, r.document_file_name, [tuple(m) for m in r.custom_metadata]) for r in rows.collect()) == [("c1", "f", [("a", "b")]), ("c2", "f", [("a", "b")]), ("c3", None, [])]
    views = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("cs")).select(chunks.chunk_views(F.col("cs")).alias("v")).first().v
    assert [(v.text, v.metadata and v.metadata[0].value) for v in views] == [("x", "b"), ("y", "b"), ("z", None)]
    assert chunks.retrieved_columns(" ") == list(chunks.RETRIEVED) and chunks.retrieved_columns("c")[4] == "client_id" and len(chunks.retrieved_columns("c")) == 9
    full = rows.withColumn("chunk_vector", F.lit(None).cast("array<float>"))
    assert chunks.retrieved(full).columns == list(chunks.RETRIEVED)
    put = full.select(chunks.with_vector(F.struct(*full.columns), F.array(F.lit(1.0))).alias("c")).first().c
    assert put.chunk_vector == [1.0] and put.id is not None
    uploads = spark.createDataFrame([("d1", "c"), ("d1", None), ("d1", "other"), ("d2", "c")], "document_id string, client_id string")
    known = chunks.already_processed(uploads, spark.createDataFrame([("d1", "c"), ("d1", " ")], "document_id string, client_id string"))
    assert sorted((r.document_id, r.client_id or "", r.known) for r in known.collect()) == [("d1", "", True), ("d1", "c", True), ("d1", "other", False), ("d2", "c", False)]


def test_judge_replies(spark):
    reply = 'I say {"verdict":"B","factsMissingFromA":["x","y"],"structureScoreB":4,"note":"' + "n" * 101 + '"} so'
    got = spark.createDataFrame([(reply,), ("none",), (None,), ('{"verdict":',)], "x string").select(evaluation.judge_result(F.col("x")).alias("j")).collect()
    assert got[0].j == ("B", 2, 0, 0, 4, 0.0, "n" * 99 + "…") and all(r.j[0] == "UNPARSED" and r.j[1:5] == (0, 0, 0, 0) for r in got[1:])


def test_answers_are_written_in_order_and_scored(spark, tmp_path):
    rows = [("t1", "ANSWER_GENERATED", "yes", "[c]", "q"), ("t2", "ANSWER_GENERATION_FAILED", None, "[]", "q")]
    answers = spark.createDataFrame(rows, "transaction_id string, status string, response string, chunks string, query string")
    answers.write.parquet(f"{tmp_path}/in")
    answer_streams.persisted(spark.readStream.schema(answers.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out").awaitTermination()
    answer_streams.persist(answers, f"{tmp_path}/out", 0)  # the batch again
    counts = {step: spark.read.parquet(f"{tmp_path}/out/{step}").count() for step in answer_streams.STEPS}
    assert counts == {"chunks": 2, "payloads": 1, "answers": 2, "scoring": 1}
    scored = answer_streams.scored(f"{tmp_path}/out", answers.withColumn("groundedness", F.lit(None).cast("double")), lambda payload: F.lit(0.5))
    assert sorted((r.transaction_id, r.groundedness) for r in scored.collect()) == [("t1", 0.5), ("t2", None)]


def test_loads_into_a_renamed_target(spark):
    text = json.dumps({"name": "old", "fields": [{"name": "id", "type": "string"}, {"name": "n", "type": "array<int>"}, {"name": "m", "type": "array<struct>", "fields": [{"name": "key", "type": "string"}]}]})
    name, schema = migrate.schema_with_name(text, "copied_rows")
    assert (name, schema.simpleString()) == ("copied_rows", "struct<id:string,n:array<int>,m:array<struct<key:string>>>")
    with pytest.raises(ValueError):
        migrate.schema_with_name(json.dumps({"fields": [{"name": "x", "type": "odd"}]}), "x")
    assert migrate.ensure_table(spark, name, schema) and not migrate.ensure_table(spark, name, schema)
    rows = spark.createDataFrame([("a", [1], "extra"), (None, [2], "extra"), ("b", None, "extra")], "id string, n array<int>, other string")
    assert migrate.uploaded(rows, name, 1) == {"submitted": 3, "skipped": 1, "succeeded": 2}
    assert sorted((r.id, r.n, r.m) for r in spark.table(name).collect()) == [("a", [1], None), ("b", None, None)]
    spark.sql(f"DROP TABLE {name}")


def test_histograms_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 0.5), ("a", "x", 5.5), ("a", "x", 9.9), ("b", "x", None)], "kind string, grp string, score double")
    for number in (0, 0):  # a batch that runs again replaces what it wrote
        evaluation.publish_histogram(rows, "score", 5.0, f"{tmp_path}/metrics", number, "kind", "grp")
    found = spark.read.parquet(f"{tmp_path}/metrics")
    assert sorted((r.attributes, r.bin, r.n) for r in found.collect()) == [('{"kind":"a","grp":"x"}', 5.0, 2), ('{"kind":"a"}', 0.0, 1)] and found.filter("at IS NULL").count() == 0
    judged = spark.createDataFrame([("B",), (None,), ("A",), ("B",)], "verdict string")
    assert [tuple(r) for r in evaluation.verdicts(judged).collect()] == [("A", 1), ("B", 2), ("UNPARSED", 1)]
    runs = spark.createDataFrame([(2, "p", "m", 1), (1, "p", "m", 2), (1, "p", "m", 1)], "query_id int, prompt string, model string, iteration int")
    assert [(r.query_id, r.iteration) for r in evaluation.report_rows(runs).collect()] == [(1, 1), (1, 2), (2, 1)]
    ok = spark.createDataFrame([("ANSWER_GENERATED", "x", None), ("ANSWER_GENERATED", None, None), ("ANSWER_GENERATED", "x", "e"), ("OTHER", "x", None)], "s string, r string, e string")
    assert [r[0] for r in ok.select(evaluation.is_ok(F.col("s"), F.col("r"), F.col("e"))).collect()] == [True, False, False, False]


def test_requests_and_tenants(spark):
    uuid = "AAAAAAAA-0000-0000-0000-00000000000B"
    headers = spark.createDataFrame([(f" {uuid} ",), ("x",), (None,)], "h string")
    assert [tuple(r.t) for r in headers.select(requests.tenant(F.col("h"), True).alias("t")).collect()] == [(uuid.lower(), "OWN"), (None, "UNAUTHORISED"), (None, "UNAUTHORISED")]
    assert {tuple(r.t) for r in headers.select(requests.tenant(F.col("h"), False).alias("t")).collect()} == {(None, "OPEN")}
    asked = spark.createDataFrame([("k", "c", "OWN"), ("k", "d", "OWN"), ("k", None, "OPEN"), ("k", "c", "UNAUTHORISED")], "k string, client_id string, access string")
    found = requests.found_for(asked, spark.createDataFrame([("k", "c"), ("k", "c")], "k string, client_id string"), "k")
    assert sorted((r.client_id or "", r.access, r.found) for r in found.collect()) == [("", "OPEN", False), ("c", "OWN", True), ("c", "UNAUTHORISED", False), ("d", "OWN", False)]
    checks = headers.select(requests.violations(requests.required(b=F.col("h")) | {"a": (F.length("h") > 1, "too short")}).alias("v")).collect()
    assert [r.v for r in checks] == [[], ["a: too short"], ["a: too short", "b: must not be blank"]]
    assert [r[0] for r in headers.select(predicates.is_terminal(F.col("h"))).collect()] == [False] * 3
    versions = lifecycle.insert_versions(headers.limit(0), headers, ["h"])
    assert {r.version for r in versions.collect()} == {1} and versions.count() == 3


# Messages that come back by their own timers


def steps_of(rows):
    by_key = {}
    for key, event_id, at, takes, failures in rows:
        by_key.setdefault(key, []).append(redelivery.Step(at, False, event_id, 1, takes, failures))
    return by_key


def outcomes(rows, until, timing=redelivery.Timing()):
    """[(event, delivery, seconds, outcome, attempts, seconds when it is visible again)] of one key's rows."""
    (steps,) = steps_of(rows).values()
    found, *_ = redelivery.due_steps(Message(lease_until=0), steps, until * S, timing)
    return [(s.event_id, s.delivery, s.due_us // S, o, m.attempts, v and v // S) for s, o, m, v in found]


S = redelivery.MICROS


def test_a_failed_message_comes_back_at_its_visible_time():
    assert outcomes([("k", 1, 0, 10 * S, 1)], 10_000) == [(1, 1, 0, "CLAIMED", 1, None), (1, 1, 10, "RETRY", 1, 310), (1, 2, 310, "CLAIMED", 2, None), (1, 2, 320, "DONE", 2, None)]
    assert outcomes([("k", 1, 0, 10 * S, 1)], 309)[-1] == (1, 1, 10, "RETRY", 1, 310)  # not before
    assert [x[3] for x in outcomes([("k", 1, 0, 10 * S, 9)], 10_000)] == ["CLAIMED", "RETRY"] * 2 + ["CLAIMED", "FAILED"]


def test_a_live_lease_conflicts_and_writes_nothing_at_the_last_delivery():
    timing = redelivery.Timing(lease=2000, visible=300, deliveries=3)
    found = outcomes([("k", 1, 0, 1900 * S, 0), ("k", 2, 100 * S, 0, 0)], 10_000, timing)
    assert [(e, d, o, v) for e, d, _, o, _, v in found] == [(1, 1, "CLAIMED", None), (2, 1, "CONFLICT", 400), (2, 2, "CONFLICT", 700), (2, 3, "CONFLICT", None), (1, 1, "DONE", None)]
    assert {a for *_, a, _ in found} == {1}


def test_a_late_end_is_fenced_and_a_lease_that_ends_now_is_free():
    found = outcomes([("k", 1, 0, 500 * S, 0), ("k", 2, 300 * S, 100 * S, 0), ("k", 3, 450 * S, 0, 0)], 10_000)
    assert [(e, o) for e, _, _, o, *_ in found] == [(1, "CLAIMED"), (2, "CLAIMED"), (2, "DONE"), (3, "SKIPPED"), (1, "FENCED")]


def test_timers_in_a_stream_do_not_hang_on_batches(spark, tmp_path):
    """The same rows in one file and in many, out of order within the delay: the same steps; expired keys are forgotten."""
    day = 86_400 * S
    rows = [(f"k{i % 7}", i, day + i * 97 % 1000 * S, i % 4 * 200 * S, i % 5) for i in range(60)]
    rows += [("late", 900, 20 * day, 0, 0), ("end", 901, 40 * day, 0, 0)]
    schema = "key string, event_id long, at_us long, takes_us long, failures int"
    until = (40 * day - 3600 * S) // 1000 * 1000
    want = []
    for key, steps in steps_of(rows).items():
        found, *_ = redelivery.due_steps(Message(lease_until=0), steps, until, redelivery.Timing())
        want += [(key, s.event_id, s.delivery, s.due_us, o, m.attempts, m.version, v) for s, o, m, v in found]
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("at_us"))
    df.coalesce(1).write.parquet(f"{tmp_path}/one")
    edges = [(day, day + 300 * S), (day + 300 * S, day + 700 * S), (day + 700 * S, 2 * day), (2 * day, 30 * day), (30 * day, 50 * day)]
    parts = [f"at_us >= {a} AND at_us < {b}" for a, b in edges]
    for part in parts:
        df.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/many")
    for name in ("one", "many"):
        got = guard.replayed(spark, f"{tmp_path}/{name}", redelivery.delivered, settings=redelivery.STORE, files_at_once=1)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert {o for *_, o, _, _, _ in want} >= {"CLAIMED", "CONFLICT", "RETRY", "DONE", "FAILED", "SKIPPED", "FENCED"}


# First deliveries


def test_the_first_delivery_within_a_while():
    assert dedupe.firsts([(30, 3), (0, 1), (10, 2), (20, 4)], None, 20) == ([1, 4], 20)
    assert dedupe.firsts([(5, 9), (5, 7)], None, 10) == ([7], 5)  # of equal times the least id
    assert dedupe.firsts([(5, 1), (12, 2)], 2, 10) == ([2], 12)  # what was handed on before counts
    assert dedupe.firsts([], 4, 10) == ([], 4)


def test_first_deliveries_do_not_hang_on_order_or_batches(spark, tmp_path):
    day, hour = 86_400 * S, 3600 * S
    rows = [(f"k{i % 3}", i, day + (i * 37 % 100) * hour // 10) for i in range(60)] + [("end", 99, 9 * day)]
    df = spark.createDataFrame(rows, "key string, event_id long, at_us long").withColumn("ts", F.timestamp_micros("at_us"))
    want = []
    for k in ("k0", "k1", "k2"):
        found, _ = dedupe.firsts([(at, i) for key, i, at in rows if key == k], None, hour)
        want += [(k, i) for i in found]
    df.coalesce(1).write.parquet(f"{tmp_path}/one")
    for low, high in ((0, 4), (4, 7), (7, 10)):  # in order of time, but mixed within
        df.filter((F.col("at_us") >= day + low * hour) & (F.col("at_us") < day + high * hour)).orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/many")
    df.filter("key = 'end'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/many")
    for name in ("one", "many"):
        got = guard.replayed(spark, f"{tmp_path}/{name}", lambda e: dedupe.first_within(e, 3600), settings=redelivery.STORE, files_at_once=1)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_key_of_the_guard_needs_no_sorted_frame(monkeypatch):
    """Deliveries in several batches and out of order, without a frame that is joined and sorted for each key."""
    import pandas as pd

    from lexolith.streaming import guard

    class State:
        exists = hasTimedOut = False
        update = setTimeoutTimestamp = lambda self, v: None
        getCurrentWatermarkMs = lambda self: 0

    columns = ["key", "event_id", "at", "failed", "action", "claim"]
    batches = [pd.DataFrame([("k", i, at, failed, "run", 0)], columns=columns) for i, at, failed in [(3, 30.0, False), (1, 10.0, True), (2, 30.0, True)]]
    monkeypatch.setattr(guard.pd, "concat", None)
    (found,) = guard._handle(("k",), iter(batches), State())
    assert found.values.tolist() == [["k", 1, "RETRY", 1, 2], ["k", 2, "RETRY", 2, 4], ["k", 3, "DONE", 3, 6]]
