"""Refinement of ranked pools: containment, similarity and diversity.

These steps depend on order, so each query's pool, a few dozen rows by construction, is folded as one array; the queries
are what is spread over the cluster. Texts of a pool are compared as numbers in an Arrow table, once for all its pairs.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexolith.functions.text import shingles, tokens, words_of
from lexolith.functions.vectors import similarity

#: Shingles of a pool that are held against its texts at once.
SHINGLES_AT_ONCE = 8192


def _pools(hits: DataFrame, *columns: str) -> DataFrame:
    """A row for each query with its pool in rank order."""
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("pool"))


def _kept(pools: DataFrame, kind: str, covered) -> DataFrame:
    """The pool's rows that no kept earlier row covers, in order."""
    none = F.array().cast(kind)
    fold = F.aggregate("pool", none, lambda kept, x: F.when(F.exists(kept, lambda k: covered(x, k)), kept).otherwise(F.concat(kept, F.array(x))))
    return pools.select("query_id", F.explode(fold).alias("x"))


def shingle_hashes(text: Column, size: int) -> Column:
    """The distinct shingles of a text as 64-bit hashes."""
    return F.array_distinct(F.transform(shingles(tokens(text), size), lambda s: F.xxhash64(s)))


def containment(a: Column, b: Column) -> Column:
    """The share of ``a``'s shingles that ``b`` has; 0 for none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def shared_shingles(texts: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct shingles each text, a list of words, has, and how many each two of them share: exact, by numbers that
    stand for runs of words. A text of fewer words is one shingle, none without words."""
    numbers: defaultdict[bytes | None, int] = defaultdict(count().__next__)
    padded = [w + [None] * (size - len(w)) if w else w for w in texts]
    lengths = np.array([len(w) for w in padded], np.int64)
    flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(padded)), np.int64, lengths.sum())
    place = np.arange(flat.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    start = np.flatnonzero(place + size <= np.repeat(lengths, lengths))
    text, different = np.repeat(np.arange(lengths.size), lengths)[start], max(1, len(numbers))
    fits = different**size * max(1, lengths.size) < 1 << 63
    code = flat[start]
    for i in range(1, size):
        code = code * different + flat[start + i]
        if not fits:  # runs of i + 1 words, numbered anew
            code = np.unique(code, return_inverse=True)[1]
    each = np.sort(code * lengths.size + text)
    code, text = np.divmod(each[np.diff(each, prepend=-1) > 0], max(1, lengths.size))
    code = np.cumsum(np.diff(code, prepend=code[:1]) > 0)  # runs numbered, in order
    own = np.bincount(text, minlength=lengths.size)
    often = np.bincount(code)[code] > 1  # the others are nobody else's
    code, text = code[often], text[often]
    code = np.cumsum(np.diff(code, prepend=code[:1]) > 0)
    both = np.zeros((lengths.size, lengths.size))
    for at in range(0, int(code.max(initial=-1)) + 1, SHINGLES_AT_ONCE):
        some = slice(*np.searchsorted(code, (at, at + SHINGLES_AT_ONCE)))
        held = np.zeros((lengths.size, SHINGLES_AT_ONCE), np.float32)
        held[text[some], code[some] - at] = 1
        both += held @ held.T
    return own, both


def without_contained(hits: DataFrame, size: int = 3, threshold: float = 0.95, id_col: str = "doc_id", text_col: str = "chunk") -> DataFrame:
    """query_id, rank, ``id_col`` of ``hits`` whose text is not covered by a better one that stays. Blank texts stay."""
    rows = hits.select("query_id", "rank", id_col, text_col)

    def kept(pool: pa.Table) -> pa.Table:
        pool = pool.sort_by([("rank", "ascending"), (id_col, "ascending")])
        own, both = shared_shingles([words_of(t.as_py()) for t in pool[text_col]], size)
        stay: list[int] = []
        for i in range(pool.num_rows):
            share = both[i, stay] / own[i] if own[i] else np.zeros(len(stay))
            if not (share >= threshold).any():
                stay.append(i)
        return pool.select(["query_id", "rank", id_col]).take(pa.array(stay, pa.int64()))

    return rows.groupBy("query_id").applyInArrow(kept, T.StructType([rows.schema[c] for c in ("query_id", "rank", id_col)]))


def without_similar(hits: DataFrame, threshold: float = 0.95, id_col: str = "doc_id") -> DataFrame:
    """query_id, rank, ``id_col`` of ``hits`` whose vector is not that similar to a better one that stays."""
    pools = _pools(hits, id_col, "vector")
    kind = pools.schema["pool"].dataType.simpleString()
    kept = _kept(pools, kind, lambda x, k: similarity(x["vector"], k["vector"]) >= threshold)
    return kept.select("query_id", "x.rank", f"x.{id_col}")


def diversified(hits: DataFrame, final: int, weight: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """query_id, pick (from 1), ``id_col``: maximal marginal relevance over ``hits`` (with vector and query_vector).

    Each pick has the highest weight * relevance - (1 - weight) * similarity to the nearest pick so far; the first is by
    relevance alone, ties go to the better rank. A row keeps its nearest similarity, so a pick costs one pass. A query
    without a vector keeps its order.
    """
    rows = hits.withColumn("relevance", similarity(F.col("query_vector"), F.col("vector"))).withColumn("asks", F.col("query_vector").isNotNull() & (F.size("query_vector") > 0))
    grouped = rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col(id_col).alias("id"), "relevance", "vector", F.lit(None).cast("double").alias("nearest")))).alias("pool"), F.first("asks").alias("asks")
    )
    kind = grouped.schema["pool"].dataType.simpleString()
    start = F.struct(F.col("pool").cast(kind).alias("left"), F.array().cast("array<bigint>").alias("picks"))

    def worth(x: Column) -> Column:
        return F.when(x["nearest"].isNull(), x["relevance"]).otherwise(weight * x["relevance"] - (1 - weight) * x["nearest"])

    def step(state: Column, _: Column) -> Column:
        best = F.array_max(F.transform(state["left"], lambda x: F.struct(worth(x).alias("worth"), (-x["rank"]).alias("place"), x["id"].alias("id"))))
        # a transform over the one pick names it, so that it is found once; nothing left, nothing changes
        named = F.transform(F.filter(F.array(best), lambda b: b.isNotNull()), lambda b: picked(state, b["id"]))
        return F.coalesce(F.get(named, F.lit(0)), state)

    def picked(state: Column, chosen: Column) -> Column:
        own = F.get(F.filter(state["left"], lambda x: x["id"] == chosen), F.lit(0))["vector"]

        def nearer(x: Column) -> Column:
            alike = similarity(x["vector"], own)
            return F.struct(x["rank"].alias("rank"), x["id"].alias("id"), x["relevance"].alias("relevance"), x["vector"].alias("vector"), F.greatest(x["nearest"], alike).alias("nearest"))

        rest = F.transform(F.filter(state["left"], lambda x: x["id"] != chosen), nearer)
        return F.struct(rest.cast(kind).alias("left"), F.concat(state["picks"], F.array(chosen)).alias("picks"))

    picks = F.aggregate(F.sequence(F.lit(1), F.lit(final)), start, step, lambda s: s["picks"])
    in_order = F.slice(F.transform("pool", lambda x: x["id"]), 1, final)
    chosen = grouped.select("query_id", F.when(F.col("asks"), picks).otherwise(in_order).alias("picks"))
    return chosen.select("query_id", F.posexplode("picks").alias("pick", id_col)).withColumn("pick", F.col("pick") + 1)


def containment_pairs(hits: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "chunk") -> DataFrame:
    """query_id, a, b, containment: the share of each pool member's shingles that each better ranked one has."""
    pools = _pools(hits.withColumn("shingles", shingle_hashes(F.col(text_col), size)), id_col, "shingles")
    ones = pools.select("query_id", "pool", F.explode("pool").alias("a"))
    pairs = ones.select("query_id", "a", F.explode(F.filter("pool", lambda b: b["rank"] < F.col("a.rank"))).alias("b"))
    share = containment(F.col("a.shingles"), F.col("b.shingles"))
    return pairs.select("query_id", F.col(f"a.{id_col}").alias("a"), F.col(f"b.{id_col}").alias("b"), share.alias("containment"))
