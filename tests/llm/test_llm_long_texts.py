"""Every operator and stage on texts of several megabytes, one of them without blanks, and on tables without rows."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexolith.llm import fingerprint, jaccard, langid, mixing, packing, quality, secrets, tokens, urls

LONG = ["alpha beta gamma delta " * 100_000, "x" * 2_000_000, "password=abcdefgh12 " + "ab" * 1_000_000, None, "", "short text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "clash") for i, t in enumerate(LONG)], SCHEMA)


def test_counts_and_pieces_of_long_texts(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in LONG]
    assert [r.n_tokens for r in tokens.count_tokens(docs).orderBy("doc_id").collect()] == want
    pieces = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("most")).orderBy("doc_id").collect()
    assert [r.n for r in pieces] == [n + 1 for n in want] and max(r.most for r in pieces) <= 2048


def test_fingerprints_and_secrets_of_long_texts(spark, docs, tmp_path):
    got = fingerprint.edited_fingerprints(docs).orderBy("doc_id").collect()
    assert [r.n_chars for r in got] == [len(t or "") for t in LONG] and got[3].fingerprint == got[4].fingerprint
    found, _ = secrets.scan_versions(docs)
    assert {r.doc_id: len(r["__spans"]) for r in found.collect()}[2] == 2  # the password, and a run of hexadecimal digits


def test_groups_languages_and_quality_of_long_texts(spark, docs):
    twice = docs.unionByName(docs.filter("doc_id < 2").withColumn("doc_id", F.col("doc_id") + 10))
    roots = {r.doc_id: r.component_id for r in jaccard.near_duplicates(twice).collect()}
    assert roots == {0: 0, 10: 0, 1: 1, 11: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    named = langid.identify(docs, langid.fit(real), F.lit(False)).collect()
    assert {r.doc_id for r in named if r.lang_pred == "und"} == {3, 4}
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    judged = quality.classify(docs.select("doc_id", "lang", "text").unionByName(real.select("doc_id", "lang", "text").withColumn("doc_id", F.col("doc_id") + 1000)), labels.withColumn("doc_id", F.col("doc_id") + 1000))
    assert {r.doc_id for r in judged.filter("doc_id < 10 AND __perplexity IS NULL").collect()} == {3, 4}


def test_mixing_and_urls_of_long_values(spark, docs):
    mixed = mixing.mix_sources(docs, temperature=0.5, seed="mix")
    assert mixed.columns == docs.columns and mixed.filter("length(text) > 1000000").count() <= 3 * mixed.count()
    pages = spark.createDataFrame([(1, "http://example.org/es/" + "a" * 2_000_000), (2, "http://" + "b." * 500_000 + "example.org/en/1")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge_urls(pages, [("example.org", "/es/", "block"), ("example.org", "/en/1", "block")]).collect()}
    assert got == {1: "block", 2: "block"}
