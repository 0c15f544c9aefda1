"""Operators and plans on small pools."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lexolith.config import Chunking, Retrieval, int_setting, setting
from lexolith.operators import answers, evaluation, ingestion, lifecycle, migrate, refine, text_index
from lexolith.operators.retrieval import best_texts, blocks_of, fused, nearest
from lexolith.plans.retrieval import retrieve
from lexolith.sources import payloads
from lexolith.streaming import guard

S = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree"


def pool(spark, vectors=None, texts=None, query=(1.0, 0.0)):
    n = len(vectors or texts)
    rows = [(1, i + 1, i, (texts or ["t"] * n)[i], (vectors or [None] * n)[i], list(query) if query else None) for i in range(n)]
    return spark.createDataFrame(rows, "query_id long, rank int, doc_id long, chunk string, vector array<double>, query_vector array<double>").repartition(3)


def ids(df, order="rank"):
    return [r.doc_id for r in df.orderBy(order).collect()]


def test_containment(spark):
    X, Y = " extra words that nobody else has ever used", " other words which are not in the first text"
    kept = lambda texts, t=0.95: ids(refine.without_contained(pool(spark, texts=texts), 3, t))
    assert kept([S, S, S]) == [0]
    assert kept([S, S + X]) == [0, 1]
    assert kept([S + X, S]) == [0]
    assert kept([S + X, S + Y]) == [0, 1]
    assert kept([S, S.upper().replace(" ", " !!! ")]) == [0]
    assert kept([S, "   ", None]) == [0, 1, 2]


def test_cosine_dedup(spark):
    kept = lambda v, t=0.95: ids(refine.without_similar(pool(spark, v), t))
    assert kept([[1.0, 0.0], [0.0, 1.0]]) == [0, 1]
    assert kept([[1.0, 1.0], [1.0, 1.0]]) == [0]
    assert kept([None, None]) == [0, 1]
    assert kept([[1.0, 2.0], [1.0]]) == [0, 1]
    assert kept([[1.0, 0.0], [0.98, 0.199]], 0.99) == [0, 1]


def test_diversity(spark):
    picks = lambda v, k, w, q=(1.0, 0.0): ids(refine.diversified(pool(spark, v, query=q), k, w), "pick")
    assert picks([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]], 2, 0.3) == [0, 2]
    assert picks([[1.0, 0.0], [0.95, 0.05], [0.0, 1.0]], 2, 0.9) == [0, 1]
    assert picks([[1.0, 0.0], [0.95, 0.05], [0.0, 1.0]], 2, 0.1) == [0, 2]
    assert picks([None, None, None], 2, 0.5) == [0, 1]
    assert picks([[1.0, 0.0], [0.0, 1.0]], 5, 0.5) == [0, 1]
    assert picks([[0.0, 1.0], [1.0, 0.0]], 2, 0.5, None) == [0, 1]


def test_candidates_and_fusion(spark):
    chunks = spark.createDataFrame([(i, [float(i), 1.0], t) for i, t in enumerate(["apple pie", "apple apple tart", "plum", ""])], "doc_id long, vector array<double>, chunk string")
    queries = spark.createDataFrame([(7, [1.0, 0.0], "Apple!")], "query_id long, query_vector array<double>, query_text string")
    near, text = nearest(queries, chunks, 2), best_texts(queries, chunks, 5)
    assert ids(near) == [3, 2] and ids(text) == [1, 0]
    assert ids(fused(near, text, 3)) == [1, 3, 0]
    assert ids(nearest(queries.withColumn("tag", F.lit("x")), chunks, 9, F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("y"), F.lit("x"))))) == [i for i in ids(nearest(queries, chunks, 9)) if i % 2 == 0]
    many = spark.range(50).select(F.col("id").alias("query_id"))
    assert sum(b.count() for b in blocks_of(many, 10)) == 50 and len(blocks_of(many, 10)) == 5


def test_retrieval_equals_brute_force(spark, tmp_path, monkeypatch):
    from lexolith.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERIES_PER_BLOCK", 4)
    rng = __import__("numpy").random.default_rng(6)
    vectors = [rng.normal(size=8).tolist() for _ in range(300)]
    vectors[10:60] = [vectors[9]] * 50  # ties
    vectors[70], vectors[71], vectors[72] = None, [1.0, 2.0], []
    texts = [" ".join(rng.choice([f"t{i}" for i in range(40)] + ["the"] * 40, int(rng.integers(1, 60)))) for _ in vectors]
    texts[5], texts[6] = None, "!!"
    chunks = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(zip(vectors, texts))], "doc_id long, vector array<double>, chunk string").repartition(5)
    asked = [(f"q{i}", vectors[i * 9] if i else None, texts[i * 7 + 1] + " the") for i in range(10)]
    queries = spark.createDataFrame(asked, "query_id string, query_vector array<double>, query_text string")
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 6) if a and b and len(a) == len(b) else 0.0
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in nearest(queries, chunks, 20).collect()}
    for q, v, _ in asked:
        best = sorted((-dot(v, w), i) for i, w in enumerate(vectors))[:20]
        assert [got[q, n + 1] for n in range(20)] == [(i, -s) for s, i in best]
    pairs = {(r.query_id, r.doc_id): r.score for r in retrieval.similar(queries, chunks, 2.5).collect()}
    assert pairs == {(q, i): dot(v, w) for q, v, _ in asked for i, w in enumerate(vectors) if dot(v, w) >= 2.5} and pairs
    words = [(t or "").replace("!!", "").split() for t in texts]
    mean, df = sum(map(len, words)) / len(words), {t: sum(t in w for w in words) for ws in words for t in ws}
    score = lambda ts, w: round(sum(math.log(1 + (300 - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in ts if t in w), 6)
    text_index.write_text_index(chunks, f"{tmp_path}/index", block=16, buckets=5)
    for found in (best_texts(queries, chunks, 10), text_index.best_indexed(queries, spark, f"{tmp_path}/index", 10)):
        got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in found.collect()}
        for q, _, t in asked:
            best = sorted((-s, i) for i, w in enumerate(words) if (s := score(set(t.split()), w)) > 0)[:10]
            assert [got[q, n + 1] for n in range(len(best))] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in best]


def test_supersession_changes_what_is_retrieved(spark):
    """Two versions of a document, each with a word of its own: once superseded, the first is not found."""
    meta = lambda i: [("documentId", i), ("material", "m")]
    rows = [("c1", 1, "alpha zorblax report", [1.0, 0.0], meta("v1")), ("c2", 2, "alpha quimfrob report", [0.9, 0.1], meta("v2"))]
    chunks = spark.createDataFrame(rows, "id string, doc_id long, chunk string, vector array<double>, custom_metadata array<struct<key:string,value:string>>")
    queries = spark.createDataFrame([(1, [1.0, 0.0], "alpha report")], "query_id long, query_vector array<double>, query_text string")
    config = Retrieval(nearest=5, pool=5, final=2, containment=True, cosine_dedup=True, cosine_threshold=0.999, diversify=True)
    assert ids(retrieve(queries, chunks, config), "pick") == [1, 2]
    gone = spark.createDataFrame([("v1",), ("v1",)], "document_id string")
    after = ingestion.superseded(chunks, gone)
    assert ids(retrieve(queries, after, config), "pick") == [2] and ids(retrieve(queries, after, Retrieval(5, 5, 2)), "pick") == [2]
    twice = ingestion.superseded(after, gone)
    assert [len(r.custom_metadata) for r in twice.orderBy("id").collect()] == [3, 2]


def test_splitter_keeps_its_promises():
    chunking = Chunking(size=100, overlap=20)
    many = lambda form, n: "".join(form.format(i) for i in range(1000, 1000 + n))  # noqa: E731  no part of it repeats
    texts = ["short", "", many("{}", 240), many("Sentence {} of some words. ", 40), many("para {}\n\n", 30), many("line {}\n", 90), many("{}", 25)[:99] + " " + many("y{}", 30) + ". z"]
    for text in texts:
        parts = ingestion.split_text(text, chunking)
        assert all(len(p) <= 100 for p in parts)
        at = 0
        for p in parts:  # nothing is lost, and what repeats is within the overlap
            found = text.find(p, max(0, at - 20))
            assert 0 <= found <= at and at - found <= 20
            at = found + len(p)
        assert at == len(text)


def test_splitter_on_worked_examples():
    split = lambda text, size, overlap: ingestion.split_text(text, Chunking(size=size, overlap=overlap))
    assert split("aaaa\n\nbbbb\n\ncccc", 12, 0) == ["aaaa\n\nbbbb\n\n", "cccc"]  # paragraphs first
    assert split("one two three four", 9, 0) == ["one two ", "three ", "four"]  # then words
    assert split("one two three four", 9, 4) == ["one two ", "three ", "four"]  # no room for an overlap
    assert split("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]  # and between characters at last
    assert split("A b. C d. E f.", 10, 5) == ["A b. C d. ", "C d. E f."]  # an overlap is whole sentences
    assert split("", 10, 5) == [""]
    assert split("short", 10, 5) == ["short"]


def test_ingestion_steps(spark):
    pages = spark.createDataFrame([("d", 1, "c", "x" * 25 + " " * 30), ("d", 2, None, None)], "document_id string, page_number int, client_id string, text string")
    chunking = Chunking(size=20, overlap=5)
    rows = ingestion.chunked(pages, ingestion.strided(F.col("text"), chunking), chunking).collect()
    assert [(r.chunk_index, len(r.chunk)) for r in rows] == [(0, 20)]
    assert ingestion.chunked_recursively(pages, chunking).count() >= 1
    chunks = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "bb")], "id int, chunk string").coalesce(1)
    got = ingestion.embedded(chunks, lambda texts: [[float(len(t))] for t in texts], 1)
    assert {r.id: r.vector for r in got.collect()} == {1: [1.0], 2: None, 3: None, 4: [2.0]}
    good, bad = ingestion.split_by_vector(got, 1)
    assert good.count() == 2 and bad.count() == 2
    now = spark.createDataFrame([(1, 1, "old"), (2, 1, "keep")], "id int, arrived_at int, v string")
    new = spark.createDataFrame([(1, 2, "new"), (3, 1, "add")], "id int, arrived_at int, v string")
    assert {r.id: r.v for r in ingestion.upserted(now, new).collect()} == {1: "new", 2: "keep", 3: "add"}
    assert {r.id: r.v for r in ingestion.merged_column(now, new.filter("id = 1"), "v").collect()} == {1: "new", 2: "keep"}
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "id int, v string")
    assert {r.id: r.v for r in ingestion.merged_column(now, twice, "v").collect()} == {1: "y", 2: None}


def test_contexts_and_prompts(spark):
    m = [("material_name", "Report")]
    rows = [(1, "d1", 1, "a", "f1", 1, m), (1, "d2", 2, "b", "f2", None, None), (1, "d1", 3, "c", "f1", 2, m)]
    df = spark.createDataFrame(rows, "query_id int, document_id string, rank int, chunk string, file_name string, page_number int, custom_metadata array<struct<key:string,value:string>>")
    want = (
        "<documents><document><id>d1</id><name>Report</name><passage><page>1</page><text>a</text></passage><passage><page>2</page><text>c</text></passage></document>"
        "<document><id>d2</id><name>f2</name><passage><page></page><text>b</text></passage></document></documents>"
    )
    assert answers.contexts(df).first().context == want
    asked = spark.createDataFrame([("p", True), ("p", False), ("none", True)], "prompt string, has_chunks boolean")
    got = answers.answered(asked, lambda prompts: ["yes" if p == "p" else None for p in prompts])
    assert [r.raw for r in got.collect()] == ["yes", answers.NO_DATA, answers.NO_ANSWER]
    score = spark.createDataFrame([('so {"groundednessScore": 0.75, "reasoning": "r"} end',), ("nothing",)], "x string").select(answers.parsed_score(F.col("x")).alias("s")).collect()
    assert [(r.s.groundedness, r.s.reasoning) for r in score] == [(0.75, "r"), (0.0, None)]


def test_evaluation(spark):
    judged = spark.createDataFrame([('{"verdict":"A","similarity":0.5,"note":"' + "n" * 200 + '"}',), ("junk",)], "x string").select(evaluation.judge_result(F.col("x")).alias("j")).collect()
    assert [(r.j.verdict, r.j.similarity, len(r.j.note)) for r in judged] == [("A", 0.5, 100), ("UNPARSED", 0.0, 0)]
    runs = spark.createDataFrame([(1, "a", 1, 5), (1, "a", 2, 6), (1, "b", 3, 7), (2, "a", 4, 8)], "q int, variant string, n int, v int")
    pairs = evaluation.chained(runs, "n", "variant")
    got = evaluation.compared(runs, pairs, "variant", ["q"], "v", "n").collect()
    assert [(r.q, r.value_before, r.value_after) for r in got] == [(1, 6, 7)]


def test_copies(spark):
    rows = spark.createDataFrame([("0a", [1.0], "x"), ("f1", [1.0, 2.0], "y"), ("f2", None, "y")], "id string, vector array<double>, row_key string")
    assert [r.client_id for r in migrate.copied(rows, "c", 1).collect()] == ["c"]
    assert [r.id for r in migrate.page_after(rows, "f", None, "f1", 5).collect()] == ["f2"]
    with pytest.raises(ValueError):
        migrate.rekeyed(rows, "c")
    assert migrate.rekeyed(rows.filter("id < 'f2'"), "c").count() == 2
    assert migrate.remaining(100, 100, 100) == "00:00:00" and migrate.remaining(1, 7200, 1) == "01:59:59" and migrate.remaining(0, 5, 9) == "unknown"


def test_compare_and_set(spark):
    now = spark.createDataFrame([("a", 1, "s"), ("b", 2, "s")], "k string, version long, status string")
    changes = spark.createDataFrame([("a", 1, "t"), ("b", 1, "t"), ("c", 1, "t")], "k string, version long, status string")
    after, lost = lifecycle.updated_if_unchanged(now, changes, ["k"], ["status"])
    assert sorted((r.k, r.version, r.status) for r in after.collect()) == [("a", 2, "t"), ("b", 2, "s")]
    assert sorted(r.k for r in lost.collect()) == ["b", "c"]
    both = spark.createDataFrame([("a", 1, "u"), ("a", 1, "t"), ("b", 2, None)], "k string, version long, status string")
    after, lost = lifecycle.updated_if_unchanged(now, both, ["k"], ["status"])
    assert sorted((r.k, r.version, r.status) for r in after.collect()) == [("a", 2, "t"), ("b", 3, None)] and [(r.k, r.status) for r in lost.collect()] == [("a", "u")]


def test_inserts_and_point_gets(spark):
    now = spark.createDataFrame([("a", 1), (None, 1)], "k string, version long")
    new = spark.createDataFrame([("a", 2), ("b", 7), ("b", 5), ("b", 5), (None, 3)], "k string, version long")
    inserted, taken = lifecycle.inserted_if_absent(now, new, ["k"], ["version"])
    assert [tuple(r) for r in inserted.collect()] == [("b", 5)]
    assert sorted((r.k or "", r.version) for r in taken.collect()) == [("", 3), ("a", 2), ("b", 7)]
    assert lifecycle.point_get(now, {"k": None, "version": 1}).count() == 1 and lifecycle.point_get(now, {"k": "b"}).count() == 0


def test_guard_decisions():
    d, M = guard.decide, guard.Message
    assert d(M("DONE", 1), 5.0, False)[0] == "SKIPPED" and d(M("ANSWER_GENERATION_FAILED", 3), 5.0, False)[0] == "SKIPPED"
    assert d(M(), 5.0, False) == ("DONE", M("DONE", 1, 0.0, 2))
    assert d(M("CLAIMED", 1, 6.0, 1), 5.0, False) == ("CONFLICT", M("CLAIMED", 1, 6.0, 1))
    assert d(M("CLAIMED", 3, 6.0, 1), 5.0, True) == ("CONFLICT", M("CLAIMED", 3, 6.0, 1))  # nothing is written at the last attempt
    assert d(M("CLAIMED", 1, 5.0, 1), 5.0, False)[0] == "DONE"
    assert d(M(), 5.0, True) == ("RETRY", M("CLAIMED", 1, 0.0, 2))  # the lease is given back
    assert d(*[d(M(), 5.0, True)[1]], 5.5, False)[0] == "DONE"
    assert d(M("CLAIMED", 2, 0.0, 4), 5.0, True) == ("FAILED", M("FAILED", 3, 0.0, 6))


def test_guard_fences_late_ends():
    d, M = guard.decide, guard.Message
    _, first = d(M(), 0.0, False, "claim")
    assert first == M("CLAIMED", 1, 300.0, 1) and d(first, 299.0, False, "claim")[0] == "CONFLICT"
    _, second = d(first, 300.0, False, "claim")
    assert second == M("CLAIMED", 2, 600.0, 2)
    assert d(second, 301.0, False, "end", 1) == ("FENCED", second) and d(second, 301.0, True, "end", 1) == ("FENCED", second)
    outcome, done = d(second, 302.0, False, "end", 2)
    assert outcome == "DONE" and d(done, 303.0, True, "end", 2) == ("FENCED", done)
    assert d(M(), 0.0, True, "give up") == ("FAILED", M("FAILED", 0, 0.0, 1))
    assert d(second, 301.0, True, "give up") == ("NOTHING", second) and d(done, 301.0, True, "give up") == ("NOTHING", done)
    assert d(second, 600.0, True, "give up")[0] == "FAILED"


def test_streamed_guard_fences_and_forgets(spark, tmp_path):
    steps = [("a", 1, 0, "claim", 0, False), ("a", 2, 10, "claim", 0, False), ("a", 3, 400, "claim", 0, False), ("a", 4, 410, "end", 1, False), ("a", 5, 420, "end", 2, False), ("b", 6, 0, "run", 0, True), ("b", 7, 1, "run", 0, False)]
    frame = lambda rows: spark.createDataFrame(rows, "key string, event_id long, at double, action string, claim long, failed boolean").withColumn("ts", F.timestamp_seconds("at"))
    timed = lambda rows: [(k, i, 1e6 + t, a, c, f) for k, i, t, a, c, f in rows]  # noqa: E731  a watermark starts at the epoch
    frame(timed(steps)).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    later = guard.RETENTION_SECONDS * 2
    frame(timed([("c", 8, later, "run", 0, False)])).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    frame(timed([("a", 9, later + 5, "run", 0, False)])).coalesce(1).write.parquet(f"{tmp_path}/in/3")
    schema, found = frame([]).schema, []
    for n in (1, 2, 3):  # one run for each part, so that parts come in this order
        rows = guard.guarded(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/[1-{n}]"))
        query = rows.writeStream.foreachBatch(lambda batch, _: found.extend(batch.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r.event_id: (r.outcome, r.version) for r in found}
    assert got == {1: ("CLAIMED", 1), 2: ("CONFLICT", 1), 3: ("CLAIMED", 2), 4: ("FENCED", 2), 5: ("DONE", 3), 6: ("RETRY", 2), 7: ("DONE", 4), 8: ("DONE", 2), 9: ("DONE", 2)}  # a had ended, but is forgotten


def test_payloads(spark, tmp_path):
    messages = spark.createDataFrame([(1, '{"documentId":"d","metadata":{"a":"b"},"unknown":1}'), (2, " "), (3, "{oops"), (4, None)], "n int, body string")
    good, bad = payloads.parsed_messages(messages, payloads.INGESTION_MESSAGE)
    assert [(r.n, r.documentId, r.metadata, r.clientId) for r in good.collect()] == [(1, "d", {"a": "b"}, None)] and {r.n for r in bad.collect()} == {2, 3, 4}
    payloads.write_json(good, f"{tmp_path}/out")
    assert payloads.read_json(spark, f"{tmp_path}/out", "documentId string, nothing int").first() == ("d", None)
    (tmp_path / "q.json").write_text('{"versions":[{"version":"v0","queries":[{"queryId":"q1","userQuery":"u"}]},{"version":"v1","queries":[{"queryId":"q1","userQuery":"w"}]}]}')
    found = payloads.versioned_queries(payloads.read_json(spark, f"{tmp_path}/q.json", payloads.VERSIONED_QUERIES))
    assert sorted((r.version_nr, r.userQuery) for r in found.collect()) == [(0, "u"), (1, "w")]
    (tmp_path / "short.txt").write_text("two\nlines")
    assert payloads.read_prompts(spark, f"{tmp_path}/short.txt").first() == ("short", "two\nlines")
    html = "<html><script>var x='</p>';</script><p>a &amp; b<br>c</p><!-- no --></html>"
    assert spark.createDataFrame([(html,)], "h string").select(payloads.page_lines(F.col("h"))).first()[0] == ["a & b", "c"]


def test_settings():
    assert setting("A", "d", {"A": " "}) == "d" and int_setting("A", None, {"A": "5"}) == 5
    with pytest.raises(KeyError):
        setting("A", env={})
    with pytest.raises(ValueError):
        Retrieval(nearest=10, pool=20)


def test_files_become_chunks(spark, tmp_path):
    from lexolith.plans.ingestion import ingest, loaded
    from lexolith.sources.providers import extracted, looked_up
    from lexolith.sources.streams import accepted_files, arriving_files, handled, message_stream

    (tmp_path / "in/c=client-1").mkdir(parents=True)
    (tmp_path / "in/doc1_20240101.pdf").write_bytes(b"first page text\nsecond line\fnext page words")
    (tmp_path / "in/c=client-1/doc2_20240102.pdf").write_bytes(b"another document here")
    (tmp_path / "in/badname.pdf").write_bytes(b"x")
    arrived = arriving_files(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    arrived.awaitTermination()
    files = accepted_files(spark.table("arrived"))
    assert sorted((r.status, r.document_id) for r in files.collect()) == [("AWAITING_INGESTION", "doc1"), ("AWAITING_INGESTION", "doc2"), ("INVALID_NAME", None)]
    pages = extracted(files.filter("document_id IS NOT NULL"), lambda contents: [[p.split("\n") for p in c.decode().split("\f")] for c in contents])
    good, bad = ingest(pages, lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    got = sorted((r.document_id, r.page_number, r.chunk, r.client_id) for r in good.collect())
    assert got == [("doc1", 1, "first page text second line", None), ("doc1", 2, "next page words", None), ("doc2", 1, "another document here", "client-1")] and bad.count() == 0
    keyed = good.withColumn("arrived_at", F.lit(1)).withColumn("custom_metadata", F.array(F.struct(F.lit("documentId").alias("key"), F.col("document_id").alias("value"))))
    index = loaded(keyed, keyed.withColumn("arrived_at", F.lit(2)), spark.createDataFrame([("doc1",)], "document_id string"))
    assert sorted((r.document_id, len(r.custom_metadata)) for r in index.collect()) == [("doc1", 2), ("doc1", 2), ("doc2", 1)]
    assert looked_up(spark.createDataFrame([(1,), (2,)], "document_id long"), spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<double>")).filter("vector IS NULL").count() == 1
    (tmp_path / "q").mkdir()
    (tmp_path / "q/1.json").write_text('{"transactionId":"t","userQuery":"u","queryPrompt":"p"}')
    (tmp_path / "q/2.json").write_text("{oops")
    seen: dict[str, list] = {"good": [], "bad": []}
    note = lambda kind: lambda rows, number: seen[kind].extend(rows.collect())
    running = handled(message_stream(spark, f"{tmp_path}/q", "generation"), payloads.ANSWER_REQUEST, f"{tmp_path}/state", note("good"), note("bad"))
    running.awaitTermination()
    assert [r.transactionId for r in seen["good"]] == ["t"] and len(seen["bad"]) == 1


def test_blocks_of_queries_work_chunks_out_once(spark, monkeypatch):
    from lexolith.operators import retrieval
    from lexolith.plans.retrieval import candidates

    monkeypatch.setattr(retrieval, "QUERIES_PER_BLOCK", 2)
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        made.add(1)
        return text

    vector = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.col("id") % (i + 2)).cast("float"))
    chunks = spark.range(40).select(F.col("id").alias("doc_id"), noted(F.concat(F.lit("word w"), F.col("id") % 7)).alias("chunk"), vector.alias("vector"))
    asked = spark.range(9).select(F.col("id").alias("query_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("query_text"), vector.alias("query_vector"))
    assert candidates(asked, chunks, Retrieval(nearest=3, pool=3, final=3)).count() == 27
    assert made.value == 40
