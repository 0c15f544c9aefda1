"""The manifest, the language model and the divergence audit against plain code, with nulls, ties, repeated rows and odd names."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexolith.llm import bilinear, divergence, merkle, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, at int, word string, leaf string"
TEXTS = [
    "", None, "   \n\t ", "a", "Straße STRASSE ﬁn É é", "word " * 3000, "x" * 5000, "a\x1cb\x1d c\x85d　e nul\x00l", "١٢٣ ²Ⅷ 12,3", "😀😀 a😀b", "the same text here", "the same text here", "The Same text-here",
]


def rows_of(n, sources=("a", "b", None, "", "é")):
    rng = np.random.default_rng(n)
    picked = [TEXTS[i] for i in rng.integers(0, len(TEXTS), n)]
    return [
        (None if i % 17 == 5 else i // 2 if i % 5 == 0 else i, t, ("en", "fr", None, "")[i % 4], sources[int(rng.integers(0, len(sources)))], None if t is None or i % 7 == 0 else len(t), "clash", 3, "w", "l")
        for i, t in enumerate(picked)
    ]


def lowered(text):
    return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


# 11


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_manifest(table):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in table:
        found = lowered(text) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else text
        leaf = plain_leaf(doc_id, text, lang, source, n_chars)
        groups[source].append(((doc_id is not None, doc_id or 0, leaf), leaf, plain_leaf(doc_id, found, lang, source, n_chars), doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[1] for x in sorted(groups[s])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for nth, s in enumerate(order):
        for i, (_, leaf, found, doc_id) in enumerate(sorted(groups[s])):
            proof, end = [], found
            for levels, at in ((trees[s], i), (top, nth)):
                for level in levels[:-1]:
                    run, place = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof += run[:place] + run[place + 1 :]
                    end, at = h(*run[:place], end, *run[place + 1 :]), at // 16
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], "".join(proof), end, end == top[-1][0]))
    return out


def manifest_of(df, **more):
    found = {"text": F.when(queries.crc32_of("doc_id") % 5 == 0, queries.az_lowered(F.col("text"))).otherwise(F.col("text"))}
    got = merkle.manifest(df, found=found, **more)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "places", "folded_root", "verified"]
    return sorted(map(repr, map(tuple, got.drop("places").collect())))


@pytest.mark.parametrize("n, top_nodes, sources", [(1, 1 << 20, ("a",)), (17, 1 << 20, ("a", None)), (700, 1 << 20, ("a", "b", None, "", "é")), (700, 2, ("a", "b", None, "")), (300, 3, tuple(f"s{i}" for i in range(40)))])
def test_manifest_equals_plain_code(spark, n, top_nodes, sources):
    table = rows_of(n, sources)
    df = spark.createDataFrame(table, DOCS).repartition(3)
    assert manifest_of(df, top_nodes=top_nodes) == sorted(map(repr, plain_manifest(table)))


@pytest.mark.parametrize("n, top_nodes", [(257, 1 << 20), (272, 1 << 20), (513, 2), (4097, 1 << 20), (4112, 1)])
def test_manifest_of_groups_whose_last_block_has_few_rows(spark, n, top_nodes):
    table = rows_of(n, ("a",)) + rows_of(3, ("b",))
    df = spark.createDataFrame(table, DOCS).repartition(3)
    assert manifest_of(df, top_nodes=top_nodes) == sorted(map(repr, plain_manifest(table)))


def test_manifest_of_nothing_and_of_a_long_text(spark):
    assert manifest_of(spark.createDataFrame([], DOCS)) == []
    table = [(1, "Long " * 800_000, "en", "a", None, "c", 1, "w", "l"), (2, "y" * 3_000_000, "en", "a", 5, "c", 1, "w", "l")]
    assert manifest_of(spark.createDataFrame(table, DOCS)) == sorted(map(repr, plain_manifest(table)))


def test_proofs_lead_to_the_root_and_show_changes(spark):
    for r in merkle.manifest(spark.createDataFrame(rows_of(400), DOCS), found={"text": F.when(F.col("doc_id") == 8, "changed").otherwise(F.col("text"))}).collect():
        end, at = r.leaf, 0
        siblings = [r.proof[i : i + 64] for i in range(0, len(r.proof), 64)]
        assert r.verified == (r.doc_id != 8)
        assert r.folded_root == r.root or r.doc_id == 8
        assert len(siblings) >= len(r.places) and all(0 <= p < 16 for p in r.places)


# 12


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered(text or "")), "\n"]


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in queries.op12_lm_scores(spark, SF).collect()}


@pytest.fixture(scope="module")
def corpus(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def plain_base(texts, is_held_out):
    c = Counter(w for i, t in texts if not is_held_out(i) for w in tokens(t))
    n = sum(c.values())
    return n, c, lambda t: sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in tokens(t))


def test_base_scores_and_counts(scored, corpus):
    held_out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    n, c, base = plain_base(corpus.items(), held_out)
    for i, text in corpus.items():
        r, words = scored[i], tokens(text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(i), len(words), sum(c[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base(text), rel=1e-9)


def test_model_beats_the_base_on_held_out_texts(scored):
    held = [r for r in scored.values() if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert len(held) > 10
    assert (sum(r.score for r in held) - sum(r.base_score for r in held)) / n > 0.1


def plain_scores(counts, v, p, text):
    """A text's log10 probability, token by token, with a whole softmax for each context."""
    single = {w: i for w, i in v.places.items() if v.mass[v.classes[i]] == 0}
    words = len(v.mass) - bilinear.TAILS
    before, total = [0, 0], 0.0
    for word in tokens(text):
        w = word.encode()
        k = int(v.classes[single[w]]) if w in single else words + bilinear.tail_of(w)
        context = p.places[0] * p.before[before[0]] + p.places[1] * p.before[before[1]]
        score = (p.after @ np.append(context, 1)).astype(float)
        each = np.exp(score - score.max())
        share = each[k] / each.sum()
        if k >= words:
            share *= (counts.get(word, 0) + 1) / v.mass[k]
        total += math.log10(share)
        before = [k, before[0]]
    return total


def test_scores_equal_whole_softmaxes_and_probabilities_add_up(spark):
    texts = [t for t in TEXTS if t != TEXTS[5]] + ["the cat sat on the mat", "the dog sat on the cat " * 30, "la casa y el gato"]
    table = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(3, "a", "c", 1), (None, "b b", "c", 1)]
    df = spark.createDataFrame(table, "doc_id long, text string, score string, n long").repartition(3)
    learned = df.filter("doc_id % 3 <> 2").select("text")
    counts = {r.word: r.c for r in bilinear.word_counts(learned).collect()}
    v = bilinear.vocabulary(spark.createDataFrame(list(counts.items()), "word string, c long"), frequent=12, words=6)
    p = bilinear.train(learned, v, rounds=2)
    z = bilinear.normalisers(df, p)
    got = bilinear._scored(df.select("doc_id", F.lit(False).alias("held_out"), "text"), v, p, z).collect()
    rare = defaultdict(float)
    for r in got:
        if r.word is not None:
            rare[r.row] += r.n * math.log10(counts.get(r.word, 0) + 1)
    plain = sorted((repr(i), round(plain_scores(counts, v, p, t), 3)) for i, t, *_ in table)
    for (a, x), (b, y) in zip(plain, sorted((repr(r.doc_id), round(r.model + rare[r.row], 3)) for r in got if r.word is None)):
        assert a == b and x == pytest.approx(y, abs=5e-3)
    # every word of training and one unseen word for each class of other words
    words = {w.encode() for w in counts}
    for context in ((0, 0), (1, 0), (6 + 17, 2)):
        score = (p.after @ np.append(p.places[0] * p.before[context[0]] + p.places[1] * p.before[context[1]], 1)).astype(float)
        share = np.exp(score - z[context])
        single = {w for w, i in v.places.items() if v.mass[v.classes[i]] == 0}
        total = sum(share[v.classes[v.places[w]]] if w in single else share[6 + bilinear.tail_of(w)] * (counts[w.decode()] + 1) / v.mass[6 + bilinear.tail_of(w)] for w in words)
        total += sum(share[6 + t] / v.mass[6 + t] for t in range(bilinear.TAILS))
        total += sum(share[len(single) : 6])  # classes without a word
        assert total == pytest.approx(1.0, abs=1e-4)


def test_scores_of_odd_tables(spark):
    schema = "doc_id long, text string, held_out string, n_tokens long"
    rows = [(1, None, "c", 1), (2, "", "c", 1), (2, "", "c", 1), (None, "a b", "c", 1), (5, "word " * 400_000, "c", 1), (6, "x" * 3_000_000, "c", 1), (7, "A a", "c", 1)]
    df = spark.createDataFrame(rows, schema)
    got = bilinear.score(df, F.col("doc_id") == 7, rounds=1).collect()
    n, c, base = plain_base([(i, t) for i, t, *_ in rows], lambda i: i is None or i == 7)
    assert len(got) == len(rows)
    want = sorted((repr(i), i is None or i == 7, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n) for i, t, *_ in rows)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    assert sorted(r.base_score for r in got) == pytest.approx(sorted(base(t) for _, t, *_ in rows))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert bilinear.score(spark.createDataFrame([], schema), F.lit(False), rounds=1).collect() == []
    nothing_learned = bilinear.score(df, F.lit(True), rounds=1).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in nothing_learned} == {(0, 0, 0.0)}


# 13


def terms(text):
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(text or ""))


def plain_audit(table, least):
    counts, found, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in table:
        key = lang or "", source or ""
        groups.add(key)
        counts[key].update(terms(text))
        found[key[0]].update(set(terms(text)))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in found[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            best = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])[:10]
            for part, items in (("pair", pairs), ("term", best)):
                out += [(lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize("least, more", [(10, {}), (2, {}), (1000, {}), (2, {"groups_sent": 2})])
def test_audit_equals_plain_code(spark, least, more):
    table = rows_of(400)
    got = divergence.audit(spark.createDataFrame(table, DOCS).repartition(5), least=least, **more)
    assert sorted(map(tuple, got.collect())) == plain_audit(table, least)


def test_audit_in_small_steps(spark, monkeypatch):
    """Every bound of a step crossed: the same rows."""
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(120)]
    table = [(i, " ".join(rng.choice(words, 30)), "en", f"s{i % 23}", None, "c", 1, "w", "l") for i in range(300)]
    monkeypatch.setattr(divergence, "SOURCES_AT_ONCE", 4)
    monkeypatch.setattr(divergence, "CELLS_AT_ONCE", 64)
    # closures carry the module's own names, so the tasks' functions are called here
    kept = defaultdict(Counter)
    for _, text, _, source, *_ in table:
        for t in terms(text):
            kept[t][source] += 1
    sources = sorted({r[3] for r in table})
    totals = np.array([sum(c[s] for c in kept.values()) + 2 * len(kept) for s in sources], np.int64)
    ordered = sorted(kept)
    term_of = np.array([i for i, t in enumerate(ordered) for _ in kept[t]])
    source = np.array([sources.index(s) for t in ordered for s in sorted(kept[t])])
    count = np.array([kept[t][s] for t in ordered for s in sorted(kept[t])], np.int64)
    p, none = divergence.shares(count, totals[source]), divergence.shares(np.zeros(len(sources), np.int64), totals)
    value = Counter()
    for first in range(0, len(sources), 4):
        sums = {}
        divergence._corrections(source, term_of, p, none, first, sums)
        for s, line in sums.items():
            for j, x in enumerate(line):
                if s != first + j:
                    value[tuple(sorted((sources[s], sources[first + j])))] += int(x)
    want = {(s, o): v for _, s, part, o, v, _ in plain_audit(table, 1) if part == "pair" and s < o}
    base = {(a, b): len(kept) * int(divergence.divergence(none[i], none[j])) for i, a in enumerate(sources) for j, b in enumerate(sources) if i < j}
    assert {k: base[k] + value[k] for k in want} == want


def test_audit_of_odd_tables(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
    table = [(i, t, "en", "a", None, "c", 1, "w", "l") for i, t in enumerate(["Long words here " * 300_000, "x" * 3_000_000, None, ""])]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(table, DOCS), least=1).collect())) == plain_audit(table, 1)


def test_shares_of_huge_counts_are_exact():
    count, total = np.array([2**62, 10**13, 5], np.int64), np.array([2**62 + 11, 10**14, 2**62], np.int64)
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(count, total)]
