"""Queries over whole inputs show what the capped ones beside them leave out."""

from __future__ import annotations

from lexolith import catalog

SF = "/root/testdata/sf0.01"


def test_long_lines_have_several_chunks(spark):
    found = catalog.QUERIES["chunk_ordinals_whole"](spark, SF).groupBy("document_id", "page_number").agg({"chunk_index": "max"})
    assert found.filter("`max(chunk_index)` > 0").count() > 0


def test_all_lines_score_answers(spark):
    found = catalog.QUERIES["answer_status_whole"](spark, SF)
    assert found.filter("transaction_id % 2 = 1 AND groundedness IS NOT NULL").count() > 0
    assert found.filter("transaction_id < 0").filter("groundedness IS NULL").count() == found.filter("transaction_id < 0").count() > 0


def test_contexts_hold_whole_texts_of_every_pool(spark):
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 100 = 0").count()
    assert catalog.QUERIES["pool_context"](spark, SF).count() == asked > 0
