"""The pipeline's stages one after another: what they keep, and that clean documents stay."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lexolith.llm import jaccard, quality, queries


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    kept = seen["quality classifier"]
    good = labels.filter("quality = 1").count()
    assert kept.join(labels.filter("quality = 1"), "doc_id").count() > 0.98 * good
    unique = seen["n-gram Jaccard join"]
    assert unique.count() == jaccard.near_duplicates(kept, 5, 80).select("component_id").distinct().count()
    again = jaccard.near_duplicates(unique, 5, 80)
    assert again.filter("doc_id <> component_id").count() == 0
    assert seen["secret scans"].count() == unique.count()
    assert seen["packing"].count() > 0


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]{32,}", text)])


def test_queries_are_named_by_their_operators():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))


def test_near_copies_with_repeated_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (3, "other words entirely in this one text"), (None, text), (5, text + " more"), (6, None), (6, None), (None, "no id one two three"), (None, "no id one two three"), (3, "the same id but quite another text")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 4) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key int").repartition(3)
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text or "", r.row_key) for r in kept.collect()) == sorted((i or 0, t or "", 4) for i, t in [rows[k] for k in (0, 3, 6, 7, 8, 10)]) and kept.columns == docs.columns
    single = corpus_pipeline.keep_one_of_near_copies(spark, docs.filter("doc_id IN (1, 2, 5, 6)").dropDuplicates(["doc_id"]), "")
    assert sorted(r.doc_id for r in single.collect()) == [1, 6]


def expected_survivors(docs, width, percent):
    """The least row of each group, by plain loops over all pairs."""
    sets = []
    for r in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    at = list(range(len(docs)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                at[root(i)] = root(j)
    best = {}
    for i, r in enumerate(docs):
        if sets[i]:
            best[root(i)] = min(best.get(root(i), r.doc_id), r.doc_id)
    return sorted([*best.values(), *(r.doc_id for i, r in enumerate(docs) if not sets[i])])


def test_pipeline_equals_brute_force(spark):
    """Each stage's result from its own input: verdicts, groups, spans, counts and tokens by plain code."""
    sf_dir = "/root/testdata/sf0.001"
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    keep, near, mask, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    same = lambda df: spark.createDataFrame(df.collect(), df.schema)
    kept = same(keep(spark, docs, sf_dir))
    verdicts = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("__keep")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in verdicts.collect()) and kept.columns == columns
    unique = same(near(spark, kept, sf_dir))
    assert sorted(r.doc_id for r in unique.collect()) == expected_survivors(kept.collect(), 5, 80)
    masked = same(mask(spark, unique, sf_dir))
    texts = {r.doc_id: r.text for r in masked.collect()}
    for r in unique.collect():
        out, at = "", 0
        for a, _, _, b in base_spans(r.text):
            out, at = out + (r.text[at:a] + "[secret]" if a >= at else ""), max(at, b)
        assert texts[r.doc_id] == out + r.text[at:]
    mixed = same(mix(spark, masked, sf_dir))
    by_source = Counter(r.source for r in masked.collect())
    want = Counter()
    for r in masked.collect():
        share = by_source[r.source] ** 0.5 / sum(n**0.5 for n in by_source.values())
        rate = round(share * sum(by_source.values()) / by_source[r.source], 9)
        u, k, p = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13, 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        want[r.doc_id] = k
    assert Counter(r.doc_id for r in mixed.collect()) == +want
    packed = pack(spark, mixed, sf_dir).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1 for i in want if want[i]}
    assert Counter({i: sum(r.length for r in packed if r.doc_id == i) for i in tokens}) == Counter({i: want[i] * n for i, n in tokens.items()})
    assert all(r.doc_tokens == tokens[r.doc_id] for r in packed)


def test_stages_on_odd_tables(spark):
    text = "a plain text about nothing much with some words in it"
    rows = [(1, text, "en", "s", 1, 4), (1, text, "en", "s", 1, 4), (None, "another text", None, None, None, 4), (2, None, "en", "s", None, 4), (3, "", "en", None, 0, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int")
    for given in (docs, docs.limit(0)):
        rest = given
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, given, "/root/testdata/sf0.001").count() >= 0
            rest = stage(spark, rest, "/root/testdata/sf0.001")
            assert name == "packing" or rest.columns == docs.columns
