"""Best texts by a stored inverted index that says, for each term and block of chunks, what the term can add at most.

Chunks are cut into blocks where they lie, chunks of like lengths together. A row of the index is a term in a block: its
chunks with frequencies and lengths, and beside them the greatest frequency and the least length, from which follows the
most that the term can add to a score there, whatever the mean length of the corpus has become.

A search reads these bounds alone first. The blocks that promise a query most are scored; its k-th best score is what
others have to reach. Of the other blocks, those whose bounds add up to less are never scored. In the rest, the terms that
together cannot reach it are left aside: only chunks that hold another term are scored, and of these only such as may still
reach it are looked up among the terms left aside.

The terms of a block of queries go to the workers. What moves is the index's rows of these terms, by block, each once however
many queries ask for it; a block is then scored for all queries in its task. No posting passes through the driver.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexolith.functions.text import tokens
from lexolith.operators.retrieval import B, K1, PLACES, QUERIES_PER_BLOCK, TERMS_PER_BLOCK, blocks_of, ranked
from lexolith.sources.shared import shared_folder, written

#: Chunks of a block, folders of terms (more where an index is larger than a few machines), and the chunks, as a multiple of those wanted, in the blocks that are scored first.
BLOCK, BUCKETS, FIRST = 32, 8, 8
#: Chunks whose terms a worker holds at once as it writes an index.
ROWS = 2048
#: What sums of rounded parts may differ by.
_EDGE = 2 * 10.0**-PLACES


def write_text_index(chunks: DataFrame, path: str, block: int = BLOCK, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "chunk") -> None:
    """Writes the index of ``chunks`` (``id_col``, ``text_col``) to ``path``: a folder for each bucket of terms, sorted by
    term, and the totals of the corpus. A null text is empty; its chunk counts among all and is found by nothing. Every task
    writes its own blocks to the folders, so no posting is shuffled."""
    spark = chunks.sparkSession
    rows = chunks.select(id_col, text_col)
    few = rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    rows = rows.repartition(spark.sparkContext.defaultParallelism) if few else rows
    id_type = rows.schema[id_col].dataType
    names = ["term", "block", "n", "most_tf", "least_length", "ids", "ats", "tfs", "lengths"]
    words_of = re.compile("[a-z0-9]+").findall

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            ids, found = batch.column(0).to_pylist(), [Counter(words_of((t.as_py() or "").lower())) for t in batch.column(1)]
            sizes = np.array([c.total() for c in found])
            order = np.argsort(sizes, kind="stable")
            for at in range(0, len(order), block):
                some = order[at : at + block].tolist()
                holders: dict[str, list[int]] = {}
                for place, i in enumerate(some):
                    for term in found[i]:
                        holders.setdefault(term, []).append(place)
                flat = np.array([i for own in holders.values() for i in own], np.int32)
                tfs = np.fromiter((found[some[i]][t] for t, own in holders.items() for i in own), np.int32, len(flat))
                lengths = sizes[some].astype(np.int32)
                n = np.fromiter(map(len, holders.values()), np.int32, len(holders))
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                # the block itself, without a term: its chunks, their lengths, and how many of them and of tokens it has
                whole = pa.array([None, *holders], pa.string())
                ends = pa.array(np.concatenate(([0], offsets)).astype(np.int32))
                own = pa.array([0, *[len(some)] * len(whole)], pa.int32())
                own_ids, own_lengths = (pa.ListArray.from_arrays(own, v) for v in (pa.array([ids[i] for i in some], batch.schema.field(0).type), pa.array(lengths)))
                listed = [own_ids, *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in (flat, tfs)), own_lengths]
                most = np.maximum.reduceat(tfs, offsets[:-1]) if len(n) else n
                least = np.minimum.reduceat(lengths[flat], offsets[:-1]) if len(n) else n
                counts = [np.concatenate(([first], v)).astype(np.int64) for first, v in ((len(some), n), (int(sizes[some].sum()), most), (0, least))]
                yield pa.RecordBatch.from_arrays([whole, pa.array(np.full(len(whole), number)), *map(pa.array, counts), *listed], names=names)
                number += 1

    fields = [("term", T.StringType()), ("block", T.LongType()), ("n", T.LongType()), ("most_tf", T.LongType()), ("least_length", T.LongType()), ("ids", T.ArrayType(id_type)), ("ats", T.ArrayType(T.IntegerType())), ("tfs", T.ArrayType(T.IntegerType())), ("lengths", T.ArrayType(T.IntegerType()))]
    built = rows.mapInArrow(build, T.StructType([T.StructField(n, t) for n, t in fields]))
    bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int")
    dealt = built.withColumn("bucket", bucket)
    dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    # the schema is kept beside the data: an empty corpus has no files to tell it from
    spark.createDataFrame([(buckets, block, dealt.schema.json())], "buckets int, block int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


class Asked:
    """The terms of a block of queries as workers need them: for each term its weight and the queries (by place) that hold it."""

    def __init__(self, idf: list[float], holders: list[list[int]], queries: int, mean: float) -> None:
        self.idf, self.queries, self.mean = np.array(idf), queries, mean
        self.starts = np.concatenate(([0], np.cumsum([len(h) for h in holders]))).astype(np.int64)
        self.flat = np.array([q for h in holders for q in h], np.int64)

    def damped(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def pairs(self, code: np.ndarray, tf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query and each of a block's terms in it, of these codes, greatest frequencies and least lengths: the term's place,
        the query, and the most that the term can add there."""
        most = self.idf[code] * self.damped(tf, length)
        row, at = spread(self.starts[code], self.starts[code + 1] - self.starts[code])
        return row, self.flat[at], most[row]


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the runs that begin at ``starts``: the run's number, and the place."""
    run = np.repeat(np.arange(sizes.size), sizes)
    return run, np.arange(run.size) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[run]


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` (block, and numbers or lists of numbers) with a row for each block in a batch: numbers as lists, lists one after another."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch["block"].to_numpy()
            order = np.argsort(block, kind="stable")
            block, batch = block[order], batch.take(pa.array(order))
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if block.size else np.zeros(0, np.int64)
            ends = np.append(starts, block.size).astype(np.int32)
            out = [pa.array(block[starts], pa.int64())]
            for column in batch.columns[1:]:
                if pa.types.is_list(column.type):
                    at = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(at[ends]), column.flatten()))
                else:
                    out.append(pa.ListArray.from_arrays(pa.array(ends), column))
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)

    lists = [T.StructField(f.name, f.dataType if isinstance(f.dataType, T.ArrayType) else T.ArrayType(f.dataType)) for f in rows.schema.fields[1:]]
    return rows.mapInArrow(pack, T.StructType([rows.schema["block"], *lists]))


def unpacked(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows[n].chunks]) for n in names]


def scored_block(code: np.ndarray, sizes: np.ndarray, ats: np.ndarray, tfs: np.ndarray, length: np.ndarray, asked: Asked, floor: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The hits of a block for the queries ``of`` (true or false for each) that may reach their ``floor``: queries, places in the
    block and scores, and how many postings were scored or looked up. The block has terms of a ``code`` with so many
    postings (``sizes``), which are places in the block and frequencies, and its chunks have each a ``length``."""
    sizes = sizes.astype(np.int64)
    starts, lengths = np.cumsum(sizes) - sizes, length[ats]
    row, query, most = asked.pairs(code, np.maximum.reduceat(tfs, starts), np.minimum.reduceat(lengths, starts))
    reach = np.bincount(query, most, asked.queries)
    own = (of & (reach >= floor))[query]
    row, query, most = row[own], query[own], most[own]
    # the terms that can add least, as many as together cannot reach the floor, are left aside
    order = np.lexsort((most, query))
    row, query, most = row[order], query[order], most[order]
    so_far = np.cumsum(most)
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if query.size else np.zeros(0, np.int64)
    so_far -= np.repeat((so_far - most)[first], np.diff(np.concatenate((first, [query.size]))))
    needed = so_far >= floor[query]
    adds, wide = np.repeat(asked.idf[code], sizes) * asked.damped(tfs, lengths), length.size

    def summed(which: np.ndarray) -> tuple[np.ndarray, int]:
        pair, at = spread(starts[row[which]], sizes[row[which]])
        return np.bincount(query[which][pair] * wide + ats[at], adds[at], asked.queries * wide).reshape(asked.queries, wide), at.size

    score, read = summed(needed)
    slack = np.bincount(query[~needed], most[~needed], asked.queries)
    candidates = (score > 0) & (score + slack[:, None] >= floor[:, None])
    aside = ~needed & candidates.any(axis=1)[query]
    if aside.any():
        read += int((np.bincount(query[aside], minlength=asked.queries) * candidates.sum(axis=1)).sum())
        score = score + summed(aside)[0]
    q, at = np.nonzero(candidates & (score >= floor[:, None]))
    return q, at, score[q, at], read


class TextSearch:
    """A search of a block of queries over a written index, with what it read."""

    def __init__(self, queries: DataFrame, spark: SparkSession, path: str, k: int, first: int = FIRST, id_col: str = "doc_id") -> None:
        shared_folder(spark)
        layout = spark.read.parquet(f"{path}/layout").first()
        stored = spark.read.schema(T.StructType.fromJson(json.loads(layout["schema"]))).parquet(f"{path}/postings")
        n, length = stored.filter("bucket = -1").agg(F.sum("n"), F.sum("most_tf")).first()
        n, self.id_col = n or 0, id_col
        bucket = F.pmod(F.xxhash64("term"), F.lit(layout["buckets"])).cast("int")
        table = queries.select("query_id", F.array_distinct(tokens(F.col("query_text"))).alias("terms")).toArrow()
        self.names = spark.createDataFrame(list(enumerate(table["query_id"].to_pylist())), T.StructType([T.StructField("query", T.IntegerType()), queries.schema["query_id"]]))
        holders: dict[str, list[int]] = {}
        for i, terms in enumerate(table["terms"].to_pylist()):
            for t in terms:
                holders.setdefault(t, []).append(i)
        codes = spark.createDataFrame(list(enumerate(holders)), "code int, term string").withColumn("bucket", bucket)
        used = [r[0] for r in codes.select("bucket").distinct().collect()]  # as many as there are folders at most
        postings = stored.filter(F.col("bucket").isin(used)).drop("ids", "lengths").join(F.broadcast(codes), ["bucket", "term"])  # terms of a block of queries
        self.ids = stored.filter("bucket = -1").select("block", "ids")
        df = dict(map(tuple, postings.groupBy("code").agg(F.sum("n")).collect()))  # a row for each term of the block
        idf = [math.log(1 + (n - df.get(i, 0) + 0.5) / (df.get(i, 0) + 0.5)) for i in range(len(holders))]
        self.whole = sum(df.get(i, 0) * len(h) for i, h in enumerate(holders.values()))
        asked = spark.sparkContext.broadcast(Asked(idf, list(holders.values()), table.num_rows, (length or 0) / (n or 1)))

        def reached(key: tuple, rows: pa.Table) -> pa.Table:
            _, query, most = asked.value.pairs(*unpacked(rows, "code", "most_tf", "least_length"))
            reach = np.bincount(query, most, asked.value.queries)
            some = np.flatnonzero(reach)
            return pa.table({"query_id": pa.array(some, pa.int32()), "block": pa.array([key[0].as_py()] * some.size, pa.int64()), "reach": reach[some]})

        whole = stored.filter("bucket = -1").select("block", "lengths")
        bounds = postings.select("block", "code", F.col("most_tf").cast("int").alias("most_tf"), F.col("least_length").cast("int").alias("least_length"))
        reach = written(packed(bounds).groupBy("block").applyInArrow(reached, "query_id int, block long, reach double"), "reach")
        first_blocks = ranked(reach, -(-first * k // layout["block"]), "reach", "block").groupBy("block").agg(F.collect_list("query_id").alias("queries"))
        first_blocks = written(first_blocks, "first")
        parts = packed(postings.select("block", "code", F.col("n").cast("int").alias("n"), "ats", "tfs"))

        def scored(rows: DataFrame, floor: np.ndarray, firsts: bool) -> DataFrame:
            """query, block, at and score of the hits in ``rows`` (of blocks, with their chunks' lengths and the queries that score
            them first); and for each block a row without a query, whose ``at`` is the number of postings read."""
            sent = spark.sparkContext.broadcast(floor)

            def of_block(key: tuple, rows: pa.Table) -> pa.Table:
                of = np.zeros(asked.value.queries, bool)
                of[rows["queries"][0].as_py() or []] = True
                query, at, score, read = scored_block(*unpacked(rows, "code", "n", "ats", "tfs"), rows["lengths"].chunk(0)[0].values.to_numpy(), asked.value, sent.value, of if firsts else ~of)
                blocks = pa.array([key[0].as_py()] * (query.size + 1), pa.int64())
                return pa.table({"query": pa.array([*query.tolist(), None], pa.int32()), "block": blocks, "at": pa.array([*at.tolist(), read], pa.int64()), "score": pa.array([*score.tolist(), None], pa.float64())})

            return written(rows.groupBy("block").applyInArrow(of_block, "query int, block long, at long, score double"), "scored")

        none = np.full(table.num_rows, -np.inf)
        self.first = scored(parts.join(whole.join(first_blocks, "block"), "block"), none, True)
        first_hits = self._named(self.first)
        floors = ranked(first_hits, k, id_col=id_col).filter(F.col("rank") == k).select("query", F.col("score") - _EDGE)
        floor = none.copy()
        for at, least in floors.collect():  # a row for each query of the block
            floor[at] = least
        least = F.get(F.lit(floor.tolist()), F.col("query_id")) if floor.size else F.lit(0.0)
        # the blocks in which any query may still reach its floor
        others = reach.filter(F.col("reach") >= least).select("block").distinct()
        self.rest = scored(parts.join(whole.join(others, "block").join(first_blocks, "block", "left"), "block"), floor, False)
        self.hits = ranked(first_hits.unionByName(self._named(self.rest)), k, id_col=id_col).drop("query")

    def _named(self, scored: DataFrame) -> DataFrame:
        """query, query_id, id and rounded score of scored chunks."""
        found = scored.filter("query IS NOT NULL").join(self.ids, "block").join(F.broadcast(self.names), "query")  # a block of queries
        return found.select("query", "query_id", F.get("ids", F.col("at").cast("int")).alias(self.id_col), F.round("score", PLACES).alias("score"))

    def postings_read(self) -> tuple[int, int]:
        """Postings that were scored or looked up, and those that a search without bounds would have scored."""
        read = self.first.unionByName(self.rest).filter("query IS NULL").agg(F.coalesce(F.sum("at"), F.lit(0))).first()[0]
        return read, self.whole


def best_indexed(queries: DataFrame, spark: SparkSession, path: str, k: int, id_col: str = "doc_id") -> DataFrame:
    """query_id, ``id_col``, score, rank as by best_texts(), from the index at ``path``, by blocks of queries."""
    most = queries.agg(F.max(F.size(F.array_distinct(tokens(F.col("query_text")))))).first()[0] or 1
    blocks = blocks_of(queries, min(QUERIES_PER_BLOCK, TERMS_PER_BLOCK // max(1, most)))
    return reduce(DataFrame.unionAll, [TextSearch(block, spark, path, k, id_col=id_col).hits for block in blocks])
