"""The registered queries themselves on whole tables: against DuckDB where they have SQL, else against plain code."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexolith.llm import quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    found = duckdb.sql(f"SELECT doc_id, coalesce(text, ''), lang FROM '{SF}/documents.parquet'").fetchall()
    return {i: t for i, t, _ in found}


@pytest.fixture(scope="module")
def token_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def result(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(found.columns)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    plain = lambda rows: sorted(map(repr, rows))
    want = found.select(*map(duckdb.ColumnExpression, columns)).fetchall()
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want) and want


def test_token_counts(spark, texts, token_ids):
    want = {i: (len(t.encode()), len(token_ids[i]), len(token_ids[i]) > 2048) for i, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in result(spark, "op2_token_counts")} == want


def test_fingerprints(spark, texts):
    ordered = sorted(texts, reverse=True)
    after = dict(zip(ordered, [*ordered[1:], ordered[0]]))
    got = {r.doc_id: r for r in result(spark, "op6_fingerprints")}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[after[i]][:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(r.fingerprint == r.edited_fingerprint) and r.near_next == float(r.fingerprint == got[after[i]].fingerprint)
    by_text = defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len({*map(frozenset, by_text.values())}) > 0.8 * len(by_text)


def test_packing(spark, token_ids):
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in result(spark, "op7_packing"):
        ids = np.array([*token_ids[r.doc_id], 1], "<u4")
        assert r.doc_tokens == ids.size and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        covered[r.doc_id].append((r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.offset + r.length))
    for i, ids in token_ids.items():
        parts = sorted(covered[i])
        assert parts[0][0] == 0 and parts[-1][1] == len(ids) + 1 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    for parts in map(sorted, sequences.values()):
        assert parts[0][0] == 0 and parts[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_components(spark, texts):
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()
    least = {i: i for i in texts}
    links = [(i, j) for i in texts for j in texts if j < i and (both := len(sets[i] & sets[j])) and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)]
    for _ in texts:
        before = dict(least)
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in result(spark, "op10_ngram_jaccard")} == {i: (len(sets[i]), least[i]) for i in texts}


def test_languages(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in result(spark, "op9_language_id")}
    assert len(got) == len(rows)
    held_out = [(i, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0 and lang is not None and any(c.isalpha() for c in t or "")]
    assert {i for i, r in got.items() if r.held_out} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([got[i].lang_pred == lang for i, lang in held_out]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_quality(spark, texts):
    """Verdicts are what the operator's own formulas say of its columns; no text without words is kept."""
    got = {r.doc_id: r for r in result(spark, "op5_quality")}
    assert got.keys() == texts.keys()
    trusted = {i for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall() if q == 1}
    for i, r in got.items():
        assert r.keep == (bool(texts[i].split()) and (r.threshold is None or r.perplexity <= r.threshold))
    assert np.mean([got[i].keep for i in trusted]) > 0.9 and quality.QUANTILE > 0.99
