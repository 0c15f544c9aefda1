"""Stored indexes: recall and folders read of the vector index, rows and postings read of the text index."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexolith.config import Retrieval
from lexolith.operators import retrieval
from lexolith.operators.retrieval import best_texts, nearest
from lexolith.operators.text_index import TextSearch, best_indexed, write_text_index
from lexolith.operators.vector_index import nearest_indexed, write_vector_index
from lexolith.plans.retrieval import retrieve, write_index
from lexolith.queries import retrieval as queries
from lexolith.sources.tables import chunks, table

SF = "/root/testdata/sf0.01"


def hits(df, by="rank"):
    return {(r.query_id, r[by]): (r.doc_id, r.score) for r in df.collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    """Vectors around 40 centres, with odd ones among them."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.4 * rng.normal(size=24)).round(3).tolist()) for i in range(4000)]
    rows += [(5000, None), (5001, []), (5002, [1.0, 2.0])]
    return spark.createDataFrame(rows, "doc_id long, vector array<float>").repartition(6)


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('vectors')}/index"
    write_vector_index(vectors, path)
    return path


def asked(vectors, n=100):
    return vectors.filter(f"doc_id % {n} = 7 AND doc_id < 5000").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query_vector"))


def recall(got, want):
    found = {(q, i) for (q, _), (i, _) in got.items()}
    true = {(q, i) for (q, _), (i, _) in want.items()}
    return len(found & true) / len(true)


def test_recall_of_the_vector_index(spark, vectors, index):
    want, got = hits(nearest(asked(vectors), vectors, 10)), hits(nearest_indexed(asked(vectors), spark, index, 10))
    assert recall(got, want) >= 0.9
    totals = spark.read.parquet(f"{index}/totals").first()
    assert totals["rows"] == 4000 and totals["cells"] == 63 and totals["probes"] < 20
    whole = hits(nearest_indexed(asked(vectors), spark, index, 10, probes=63))
    assert whole == {k: v for k, v in want.items()}  # with all cells it is exact


def test_only_probed_folders_are_read(spark, vectors, index):
    one = asked(vectors).limit(1)
    found = nearest_indexed(one, spark, index, 10, probes=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(([\d,]+)\)", plan)
    assert filters and len(filters[1].split(",")) == 3
    read = {f.split("cell=")[1].split("/")[0] for f in spark.read.parquet(f"{index}/cells").filter(F.col("cell").isin([int(c) for c in filters[1].split(",")])).inputFiles()}
    assert hits(found) and len(read) >= 3


def test_recall_of_the_registered_query(spark):
    want = hits(queries.vector_topk(spark, SF))
    got = hits(queries.ann_topk(spark, SF))
    assert recall(got, want) >= 0.9
    assert all(want.get((q, r), (None, -9.0))[1] >= score for (q, r), (_, score) in got.items())


def test_vector_index_of_few_and_no_rows(spark, tmp_path):
    schema = "doc_id long, vector array<float>"
    for name, rows in (("none", []), ("nulls", [(1, None)]), ("one", [(1, [1.0, 0.0])]), ("same", [(i, [0.0, 1.0]) for i in range(30)])):
        df = spark.createDataFrame(rows, schema)
        write_vector_index(df, f"{tmp_path}/{name}")
        ask = spark.createDataFrame([(9, [0.0, 2.0]), (8, None), (7, [1.0])], "query_id long, query_vector array<float>")
        want = [(9, r.doc_id, r.score, r["rank"]) for r in nearest(ask.filter("query_id = 9"), df.filter("vector IS NOT NULL"), 3).orderBy("rank").collect()] if rows else []
        assert sorted(map(tuple, nearest_indexed(ask, spark, f"{tmp_path}/{name}", 3).select("query_id", "doc_id", "score", "rank").collect())) == want


def test_blocks_are_written_and_freed_one_by_one(spark, vectors, monkeypatch):
    """Fifty blocks of one query each give what one block gives, and nothing stays with the workers."""
    ask = asked(vectors, 80)
    want = hits(nearest(ask, vectors, 5))
    monkeypatch.setattr(retrieval, "QUERIES_PER_BLOCK", 1)
    freed = []
    real = retrieval.alone
    monkeypatch.setattr(retrieval, "alone", lambda found, sent, blocks: (freed.append(blocks), real(found, sent, blocks))[1])
    got = hits(nearest(ask, vectors, 5))
    assert got == want and len(freed) > 20 and set(freed) == {50}


@pytest.fixture(scope="module")
def texts(spark):
    return table(spark, SF, "documents").select("doc_id", F.col("text").alias("chunk")).repartition(5)


@pytest.fixture(scope="module")
def text_index(spark, texts, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('texts')}/index"
    write_text_index(texts, path, block=4)
    return path


def test_text_index_gives_the_same_rows_and_reads_fewer_postings(spark, texts, text_index):
    ask = queries.text_queries(spark, SF)
    search = TextSearch(ask, spark, text_index, 10)
    got, want = hits(search.hits), hits(best_texts(ask, texts, 10))
    assert got == {k: (i, pytest.approx(s, abs=2e-6)) for k, (i, s) in want.items()}
    read, whole = search.postings_read()
    print('postings', read, whole)
    assert 0 < read < 0.45 * whole


def test_text_index_of_long_queries_and_many_hits(spark, texts, text_index):
    """Whole texts as queries, and more hits than chunks: nothing is left out."""
    ask = texts.filter("doc_id % 250 = 3").select(F.col("doc_id").alias("query_id"), F.col("chunk").alias("query_text"))
    for k in (3, 2000):
        got, want = hits(best_indexed(ask, spark, text_index, k), "doc_id"), hits(best_texts(ask, texts, k), "doc_id")
        assert got.keys() == want.keys()
        assert all(abs(got[key][1] - want[key][1]) < 3e-6 for key in want)


def test_text_index_of_odd_texts(spark, tmp_path):
    schema = "doc_id string, chunk string, block long, n long"
    rows = [("a", None, 1, 1), ("b", "", 1, 1), ("c", "Alpha beta beta", 1, 1), ("c", "Alpha beta beta", 1, 1), (None, "alpha", 1, 1), ("d", "beta " * 300_000, 1, 1), ("e", "x" * 2_000_000, 1, 1)]
    ask = spark.createDataFrame([(1, "ALPHA alpha beta"), (2, None), (3, "gamma"), (4, "x" * 2_000_000)], "query_id long, query_text string")
    df = spark.createDataFrame(rows, schema)
    write_text_index(df, f"{tmp_path}/odd", block=2)
    got = best_indexed(ask, spark, f"{tmp_path}/odd", 10).collect()
    assert sorted({(r.query_id, str(r.doc_id)) for r in got}) == [(1, "None"), (1, "c"), (1, "d"), (4, "e")]
    write_text_index(df.limit(0), f"{tmp_path}/none")
    assert best_indexed(ask, spark, f"{tmp_path}/none", 10).collect() == []


def test_the_plan_over_written_indexes(spark, tmp_path):
    """The whole plan with a text index gives what it gives without one."""
    rows, ask, config = chunks(spark, SF), queries.hybrid_queries(spark, SF), Retrieval(nearest=20, pool=20, final=5, containment=True, diversify=True)
    write_index(rows, f"{tmp_path}/index", vectors=True)
    plain = lambda df: sorted(map(tuple, df.select("query_id", "pick", "doc_id").collect()))
    want = plain(retrieve(ask, rows, config))
    assert plain(retrieve(ask, rows, config, f"{tmp_path}/index")) == want
    near = plain(retrieve(ask, rows, config, f"{tmp_path}/index", approximate=True))
    assert len({(q, d) for q, _, d in near} & {(q, d) for q, _, d in want}) > 0.7 * len(want)


def test_a_search_keeps_no_row_for_each_query_term_and_block(spark, tmp_path):
    """Twice as many equal queries write no more of the index: only hits, and a bound for each query and block."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[j] for j in range(60) if (i * 7 + j * 11) % 3 > 0)) for i in range(400)]
    chunked = spark.createDataFrame(rows, "doc_id long, chunk string").repartition(3)
    write_text_index(chunked, f"{tmp_path}/index", block=4)
    ask = spark.createDataFrame([(q, " ".join(words)) for q in range(40)], "query_id long, query_text string")
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/shared")
    try:
        search = TextSearch(ask, spark, f"{tmp_path}/index", 5)
        got, want = hits(search.hits), hits(best_texts(ask, chunked, 5))
        assert got == {k: (i, pytest.approx(s, abs=2e-6)) for k, (i, s) in want.items()}
        size = sum(p.stat().st_size for p in (tmp_path / "shared").rglob("*") if p.is_file())
        assert search.postings_read()[1] > 400_000 and size < 300_000
    finally:
        spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
