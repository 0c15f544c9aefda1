"""Candidates for many queries at once: nearest vectors, best texts, and the fusion of both."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexolith.functions.text import tokens, words_of
from lexolith.sources.shared import shared_folder, written

#: Queries that are held against all chunks at once, and bytes of their vectors and terms in them; more go in blocks.
QUERIES_PER_BLOCK, BLOCK_BYTES, TERMS_PER_BLOCK = 2048, 64 << 20, 2_000_000
#: Blocks of queries, each a pass over all texts, may be so many times as large for texts as for vectors.
TEXT_BLOCKS = 4
#: Pairs of queries and chunks scored at once.
PAIRS_AT_ONCE = 2_000_000
#: Terms that meet in a matrix product, at most, and the share of all pairs of queries and chunks that must hold one; the
#: others are added where they occur, for as many chunks together as make so many sums.
OFTEN, OFTEN_SHARE, SUMS_AT_ONCE = 512, 0.006, 8192
#: Parts of the chunks' terms for each core: scoring a part costs as much as it has chunks, however few bytes they are.
PARTS_PER_CORE, ROWS_PER_PART = 3, 1024
#: Chunks whose terms a worker holds as lists at once.
ROWS_AT_ONCE = 2048
#: Scores are compared to so many places, so that ranks do not hang on the order of a sum.
PLACES = 6
#: Fixed values of the published formulas: BM25's saturation and length weight, and the rank constant of the fusion.
K1, B, RANK_CONSTANT = 1.2, 0.75, 60


def ranked(scored: DataFrame, k: int, score: str = "score", id_col: str = "doc_id") -> DataFrame:
    """The ``k`` best rows of each query_id, with rank from 1; ties go to the lesser id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocks_of(queries: DataFrame, size: int = QUERIES_PER_BLOCK) -> list[DataFrame]:
    """``queries`` in parts of about ``size`` rows, dealt by a hash of query_id."""
    n = -(-queries.count() // max(1, size))
    if n <= 1:
        return [queries]
    return [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


class Best:
    """The k best (score, id) of each query of a block so far: higher scores first, then lesser ids."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0)) for _ in range(queries)]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        old_scores, old_ids = self.kept[query]
        scores, ids = np.concatenate((old_scores, scores)), np.concatenate((old_ids, ids)) if old_ids.size else ids
        order = np.lexsort((ids, -scores))[: self.k]
        self.kept[query] = scores[order], ids[order]
        if order.size == self.k:
            self.floor[query] = scores[order[-1]]

    def batch(self, names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
        sizes = [s.size for s, _ in self.kept]
        ids = [x for _, v in self.kept for x in v.tolist()]
        scores = np.concatenate([s for s, _ in self.kept]) if self.kept else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64()), pa.array(ids, id_type), pa.array(scores, pa.float64())], names=names)


def rounded(values: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(values) * 10.0**PLACES + 0.5), values) / 10.0**PLACES


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Scores of one query, or one for each vector, as similarity() gives them, rounded: products in the vectors' own precision,
    sums in double."""
    return rounded((query * vectors).astype(np.float64).sum(axis=1)) + 0.0


def nearly_best(scores: np.ndarray, k: int, floor: float) -> np.ndarray:
    """Where scores of a matrix product may be among the ``k`` best, and over ``floor``, once they are worked out exactly."""
    top = min(k, scores.size)
    floor = max(floor, np.partition(scores, -top)[-top]) - 4 * 10.0**-PLACES
    return np.flatnonzero((scores >= floor) & (scores > -np.inf))


def alone(found: DataFrame, sent, blocks: int) -> DataFrame:
    """``found`` of one of ``blocks`` blocks of queries. If there are more, it is worked out and written now and what was
    ``sent`` for it freed, so that one block is with the workers at a time."""
    if blocks == 1:
        return found
    shared_folder(found.sparkSession)
    written = found.checkpoint()
    sent.destroy()
    return written


def named(found: DataFrame, spark: SparkSession, ids: list, queries: DataFrame) -> DataFrame:
    """``found`` with query_id in place of the query's place in its block."""
    schema = T.StructType([T.StructField("at", T.LongType()), queries.schema["query_id"]])
    return found.join(F.broadcast(spark.createDataFrame(list(enumerate(ids)), schema)), "at").drop("at")  # a block of queries


def nearest(queries: DataFrame, chunks: DataFrame, k: int, tags: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """query_id, ``id_col``, score, rank: the ``k`` chunks most similar to each query (query_id, query_vector).

    Exact: queries go to the workers in blocks of a bounded size; every batch of chunks meets a block in one matrix
    product, only products near the k best so far are worked out as similarity() would, and each partition hands on its
    k best. With ``tags``, an array of strings of each chunk, a query's column ``tag`` must be among them. Null vectors
    and those of another size score 0.
    """
    spark, parts = chunks.sparkSession, []
    queries = queries.select("query_id", "query_vector", *(["tag"] if tags is not None else []))
    longest = queries.agg(F.max(F.size("query_vector"))).first()[0] or 1
    rows = chunks.select(id_col, "vector", *([tags.alias("tags")] if tags is not None else []))
    id_type = rows.schema[id_col].dataType
    blocks = blocks_of(queries, min(QUERIES_PER_BLOCK, BLOCK_BYTES // (8 * max(1, longest))))
    for block in blocks:
        table = block.toArrow()
        asked = table["query_vector"].to_pylist()
        sent = spark.sparkContext.broadcast((asked, table["tag"].to_pylist() if tags is not None else None))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, tag = sent.value
            best, kind, arrow_id = Leaders(len(asked), k), np.float64, None
            by_size = {n: np.array([i for i, v in enumerate(asked) if v is not None and len(v) == n]) for n in {len(v) for v in asked if v is not None}}
            for batch in batches:
                arrow_id = batch.schema.field(0).type
                if pa.types.is_float32(batch.schema.field(1).type.value_type):
                    kind = np.float32
                step = max(1, PAIRS_AT_ONCE // max(1, len(asked)))
                for at in range(0, batch.num_rows, step):
                    some = batch.slice(at, step)
                    ids, vectors = np.array(some.column(0).to_pylist()), some.column(1)
                    sizes = np.array([-1 if n is None else n for n in vectors.value_lengths().to_pylist()])
                    scores, exact = np.zeros((len(asked), len(ids))), []
                    for n, at_queries in by_size.items():
                        rows_at = np.flatnonzero(sizes == n)
                        if rows_at.size:
                            q = np.array([asked[i] for i in at_queries], kind).reshape(at_queries.size, n)
                            v = vectors.take(pa.array(rows_at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(rows_at.size, n)
                            product = q.astype(np.float64) @ v.T.astype(np.float64)
                            if rows_at.size == len(ids) and at_queries.size == len(asked):
                                scores = product
                            else:
                                scores[np.ix_(at_queries, rows_at)] = product
                            of_query, of_row = np.full(len(asked), -1), np.full(len(ids), -1)
                            of_query[at_queries], of_row[rows_at] = np.arange(at_queries.size), np.arange(rows_at.size)
                            exact.append((of_query, q, of_row, v))
                    if np.isnan(scores).any():
                        scores[np.isnan(scores)] = -np.inf
                    if tag is not None:
                        of_tag = {t: np.array([t in (x or ()) for x in some.column(2).to_pylist()], np.bool_) for t in set(tag)}
                        for i, t in enumerate(tag):
                            scores[i, ~of_tag[t]] = -np.inf
                    query, row = best.near(scores, 4 * 10.0**-PLACES)
                    values = np.zeros(query.size)
                    for of_query, q, of_row, v in exact:
                        same = np.flatnonzero((of_query[query] >= 0) & (of_row[row] >= 0))
                        piece = max(1, PAIRS_AT_ONCE // max(1, q.shape[1]))
                        for some_of in (same[at_pair : at_pair + piece] for at_pair in range(0, same.size, piece)):
                            values[some_of] = exact_scores(q[of_query[query[some_of]]], v[of_row[row[some_of]]])
                    if query.size:
                        best.add(query, values, ids[row])
            if arrow_id is not None:
                yield best.batch(["at", id_col, "score"], arrow_id)

        schema = T.StructType([T.StructField("at", T.LongType()), T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())])
        found = named(rows.mapInArrow(run, schema), spark, table["query_id"].to_pylist(), queries)
        parts.append(alone(ranked(found.select("query_id", id_col, "score"), k, id_col=id_col), sent, len(blocks)))
    return reduce(DataFrame.unionAll, parts)


def similar(queries: DataFrame, chunks: DataFrame, threshold: float, id_col: str = "doc_id") -> DataFrame:
    """query_id, ``id_col``, score of all pairs of a query (query_id, query_vector) and a chunk whose score, as nearest()
    gives it, is ``threshold`` (over 0) or more.

    Chunks whose norm times the greatest of the block's is below the threshold meet no query; only products near it are
    worked out anew.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be over 0")
    spark, parts = chunks.sparkSession, []
    queries = queries.filter("query_vector IS NOT NULL").select("query_id", "query_vector")
    longest = queries.agg(F.max(F.size("query_vector"))).first()[0] or 1
    rows = chunks.filter("vector IS NOT NULL").select(id_col, "vector")
    schema = T.StructType([T.StructField("at", T.LongType()), rows.schema[id_col], T.StructField("score", T.DoubleType())])
    blocks = blocks_of(queries, min(QUERIES_PER_BLOCK, BLOCK_BYTES // (8 * max(1, longest))))
    for block in blocks:
        table = block.toArrow()
        sent = spark.sparkContext.broadcast(table["query_vector"].to_pylist())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            by_size = {n: np.array([i for i, v in enumerate(asked) if len(v) == n]) for n in {len(v) for v in asked}}
            for batch in batches:
                kind = np.float32 if pa.types.is_float32(batch.schema.field(1).type.value_type) else np.float64
                step = max(1, PAIRS_AT_ONCE // max(1, len(asked)))
                for at in range(0, batch.num_rows, step):
                    some = batch.slice(at, step)
                    sizes = some.column(1).value_lengths().to_numpy(zero_copy_only=False)
                    for n, own in by_size.items():
                        rows_at = np.flatnonzero(sizes == n)
                        q = np.array([asked[i] for i in own], kind).reshape(own.size, n)
                        v = some.column(1).take(pa.array(rows_at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(rows_at.size, n)
                        far = np.linalg.norm(v.astype(np.float64), axis=1) * np.linalg.norm(q.astype(np.float64), axis=1).max(initial=0.0) < threshold - 4 * 10.0**-PLACES
                        rows_at, v = rows_at[~far], v[~far]
                        i, j = np.nonzero(q.astype(np.float64) @ v.T.astype(np.float64) >= threshold - 4 * 10.0**-PLACES)
                        score = rounded((q[i] * v[j]).astype(np.float64).sum(axis=1)) if i.size else np.zeros(0)
                        hit = score >= threshold
                        yield pa.RecordBatch.from_arrays([pa.array(own[i[hit]], pa.int64()), some.column(0).take(pa.array(rows_at[j[hit]])), pa.array(score[hit])], names=["at", id_col, "score"])

        found = named(rows.mapInArrow(run, schema), spark, table["query_id"].to_pylist(), queries).select("query_id", id_col, "score")
        parts.append(alone(found, sent, len(blocks)))
    return reduce(DataFrame.unionAll, parts)


class Leaders:
    """The k best (score, id) of all queries of a block so far, sorted together: higher scores first, then lesser ids."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor, self.new = k, np.full(queries, -np.inf), 0
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def near(self, scores: np.ndarray, edge: float, over: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Queries and columns of ``scores``, a row for each query, that are more than ``over`` and, give or take ``edge``, may be
        among the k best."""
        least = np.maximum(self.floor - edge, np.nextafter(over, np.inf))
        at = scores >= least[:, None]
        if scores.shape[1] > self.k and np.count_nonzero(at) > 2 * self.k * self.floor.size:
            at = scores >= np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k] - edge)[:, None]
        return np.nonzero(at)

    def add(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.found.append((query, scores, ids))
        self.new += query.size
        if self.new > max(100_000, self.floor.size * self.k):
            self.settle()

    def settle(self) -> None:
        query, scores, ids = map(np.concatenate, zip(*self.found))
        order = np.lexsort((ids, -scores, query))
        counts = np.bincount(query, minlength=self.floor.size)
        place = np.arange(order.size) - np.repeat(np.cumsum(counts) - counts, counts)
        order, place = order[place < self.k], place[place < self.k]
        query, scores, ids = query[order], scores[order], ids[order]
        self.found, self.new = [(query, scores, ids)], 0
        self.floor[query[place == self.k - 1]] = scores[place == self.k - 1]

    def batch(self, names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
        if self.found:
            self.settle()
        query, scores, ids = self.found[0] if self.found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids.tolist(), id_type), pa.array(scores, pa.float64())], names=names)


class QueryTerms:
    """The terms of a block of queries as workers need them: for each its weight, the queries (by place) that hold it, and whether
    so many queries and chunks do that a matrix product is the shorter way."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, df: np.ndarray, n: int, queries: int, mean: float) -> None:
        self.queries, self.mean = queries, mean
        self.flat = owner[np.argsort(term, kind="stable")]
        self.counts = np.bincount(term, minlength=df.size)
        self.starts = np.cumsum(self.counts) - self.counts
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        share = self.counts / max(1, queries) * (df / max(1, n))
        often = np.argsort(-share, kind="stable")[:OFTEN]
        self.often = often[share[often] > OFTEN_SHARE]

    def holding(self) -> np.ndarray:
        """A row for each frequent term, a column for each query: 1 where the query holds it."""
        held = np.zeros((self.often.size, self.queries))
        for i, term in enumerate(self.often):
            held[i, self.flat[self.starts[term] : self.starts[term] + self.counts[term]]] = 1
        return held

    def scores(self, held: np.ndarray, place: np.ndarray, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A row for each query, a column for each chunk; a chunk has so many (``sizes``) of ``terms`` and a length. ``held`` is of
        holding(), ``place`` has the row of a frequent term there, -1 of others."""
        chunk = np.repeat(np.arange(sizes.size), sizes)
        adds = self.idf[terms] * (tfs * (K1 + 1) / (tfs + K1 * (1 - B + B * lengths[chunk] / self.mean)))
        row = place[terms]
        often = row >= 0
        weights = np.zeros((sizes.size, self.often.size))
        weights[chunk[often], row[often]] = adds[often]
        scores = weights @ held
        terms, chunk, adds = terms[~often], chunk[~often], adds[~often]
        counts, starts = self.counts[terms], self.starts[terms]
        from_, to = starts.tolist(), (starts + counts).tolist()
        group = max(1, SUMS_AT_ONCE // max(1, self.queries))
        ends = np.searchsorted(chunk, np.arange(0, sizes.size + group, group)).tolist()
        for n, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            if a < b:
                own = scores[n * group : (n + 1) * group]
                at = np.concatenate([self.flat[x:y] for x, y in zip(from_[a:b], to[a:b])])
                if group > 1:
                    at = at + np.repeat((chunk[a:b] - n * group) * self.queries, counts[a:b])
                own += np.bincount(at, np.repeat(adds[a:b], counts[a:b]), own.size).reshape(own.shape)
        return np.ascontiguousarray(scores.T)


def best_texts(queries: DataFrame, chunks: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "chunk") -> DataFrame:
    """query_id, ``id_col``, score, rank: the ``k`` chunks with the highest BM25 scores for each query (query_id, query_text).

    A query's distinct terms are alternatives; a chunk without any of them is no candidate. Texts are read once for a block
    of queries: what is written of a chunk is its length and, as numbers, the block's terms in it. Those are counted, dealt
    evenly and scored, frequent terms by a matrix product, and each part hands on its k best of each query.
    """
    spark, parts = chunks.sparkSession, []
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("query_text"))).alias("terms"))
    n_asked, n_terms = asked.agg(F.count("*"), F.sum(F.size("terms"))).first()
    rows = chunks.select(id_col, text_col)
    id_field = T.StructField(id_col, rows.schema[id_col].dataType)
    schema = T.StructType([T.StructField("at", T.LongType()), id_field, T.StructField("score", T.DoubleType())])
    coded_schema = T.StructType([id_field, T.StructField("length", T.LongType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("terms", "tfs"))])
    cores = spark.sparkContext.defaultParallelism
    blocks = blocks_of(asked, min(TEXT_BLOCKS * QUERIES_PER_BLOCK, max(1, TERMS_PER_BLOCK * n_asked // max(1, n_terms or 0))))
    for block in blocks:
        table = block.toArrow()
        lists = table["terms"].combine_chunks()
        names = lists.flatten().dictionary_encode()
        owner, term = lists.value_parent_indices().to_numpy(zero_copy_only=False), names.indices.to_numpy(zero_copy_only=False)
        wanted = spark.sparkContext.broadcast({t.encode(): i for i, t in enumerate(names.dictionary.to_pylist())})
        different = len(names.dictionary)

        def code(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            code_of = wanted.value.get
            for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
                lengths, ends, terms, tfs = [], [0], array("i"), array("i")
                for text in batch.column(1):
                    words = words_of(text.as_py())
                    found = Counter(map(code_of, words))
                    found.pop(None, None)
                    lengths.append(len(words))
                    terms.extend(found.keys())
                    tfs.extend(found.values())
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                listed = [pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(v, np.int32))) for v in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *listed], names=[id_col, "length", "terms", "tfs"])

        coded = written(rows.mapInArrow(code, coded_schema), "terms")

        def count(batches: Iterator[pa.RecordBatch], different=different) -> Iterator[pa.RecordBatch]:
            df, n, length = np.zeros(different, np.int64), 0, 0
            for batch in batches:
                df += np.bincount(batch.column(1).flatten().to_numpy(zero_copy_only=False), minlength=different)
                n, length = n + batch.num_rows, length + int(batch.column(0).to_numpy().sum())
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append([-2, -1], some)), pa.array(np.append([n, length], df[some]))], names=["term", "n"])

        sums = coded.select("length", "terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the block
        place, value = sums["term"].to_numpy(), sums["n"].to_numpy()
        n, length = (int(value[place == i].sum()) for i in (-2, -1))
        df = np.zeros(different)
        df[place[place >= 0]] = value[place >= 0]
        sent = spark.sparkContext.broadcast(QueryTerms(owner, term, df, n, table.num_rows, length / max(1, n)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, best, arrow_id = sent.value, None, None
            for batch in batches:
                if best is None:
                    best, arrow_id, held = Leaders(asked.queries, k), batch.schema.field(0).type, asked.holding()
                    place = np.full(asked.idf.size, -1)
                    place[asked.often] = np.arange(asked.often.size)
                step = max(1, PAIRS_AT_ONCE // max(1, asked.queries))
                for at in range(0, batch.num_rows, step):
                    some = batch.slice(at, step)
                    terms, tfs = (c.flatten().to_numpy(zero_copy_only=False) for c in some.columns[2:])
                    scores = asked.scores(held, place, terms, tfs, some.column(2).value_lengths().to_numpy(zero_copy_only=False), some.column(1).to_numpy())
                    query, row = best.near(scores, 2 * 10.0**-PLACES, 0.0)
                    if query.size:
                        best.add(query, rounded(scores[query, row]), np.array(some.column(0).to_pylist())[row])
            if best is not None:
                yield best.batch(["at", id_col, "score"], arrow_id)

        dealt = coded.repartition(max(1, min(PARTS_PER_CORE * cores, -(-n // ROWS_PER_PART))), id_col)
        found = named(dealt.mapInArrow(run, schema), spark, table["query_id"].to_pylist(), asked)
        parts.append(alone(ranked(found.select("query_id", id_col, "score"), k, id_col=id_col), sent, len(blocks)))
        if len(blocks) > 1:
            wanted.destroy()
    return reduce(DataFrame.unionAll, parts)


def fused(vector_hits: DataFrame, text_hits: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """query_id, ``id_col``, score, rank: both lists by reciprocal rank fusion; a list that lacks a chunk adds nothing."""
    share = lambda hits, name: hits.select("query_id", id_col, (1.0 / (RANK_CONSTANT + F.col("rank"))).alias(name))
    both = share(vector_hits, "a").join(share(text_hits, "b"), ["query_id", id_col], "full_outer")
    score = F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 9)
    return ranked(both.select("query_id", id_col, score.alias("score")), k, id_col=id_col)
