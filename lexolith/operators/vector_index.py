"""Nearest chunks by a stored vector index: cells around centroids, a folder for each, of which a search reads a few.

Centroids are fitted on a sample of bounded size; every chunk is assigned to the cell of its nearest centroid, where it
lies, and written to that cell's folder. A search asks only the cells whose centroids are nearest to a query. How many is
measured when the index is written: for a bounded number of chunks taken as queries, their true neighbours over all
chunks are found by nearest(), and as many cells are probed as hold the wanted share of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexolith.operators.retrieval import PAIRS_AT_ONCE, QUERIES_PER_BLOCK, Best, alone, blocks_of, exact_scores, named, nearest, nearly_best, ranked

#: Chunks on which centroids are fitted, and passes over them; chunks that are asked for their true neighbours.
FIT_ROWS, PASSES, ASKED = 20_000, 10, 200
#: Cells at most; a sample holds eight chunks for each of them.
MOST_CELLS = FIT_ROWS // 8
#: The share of true neighbours among the first NEIGHBOURS that the probed cells must hold.
RECALL, NEIGHBOURS = 0.95, 10


def fitted(sample: np.ndarray, cells: int, passes: int = PASSES) -> np.ndarray:
    """Unit centroids of ``cells`` groups of the unit vectors ``sample``; a group that runs empty takes the vector farthest from its own."""
    found = sample[np.random.default_rng(7).choice(len(sample), cells, replace=False)]
    for _ in range(passes):
        score = sample @ found.T
        own = score.argmax(axis=1)
        order = np.argsort(own, kind="stable")
        heads = np.flatnonzero(np.diff(own[order], prepend=-1))
        sums = np.zeros_like(found)
        sums[own[order][heads]] = np.add.reduceat(sample[order], heads, axis=0)
        far = np.argsort(score[np.arange(len(sample)), own])
        empty = np.setdiff1d(np.arange(cells), own)
        sums[empty] = sample[far[: len(empty)]]
        found = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return found


def _unit(vectors: list) -> np.ndarray:
    whole = np.array(vectors, np.float32)
    return whole / np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12)


def _whole(batch: pa.RecordBatch, at: int, dims: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)


def write_vector_index(chunks: DataFrame, path: str, cells: int | None = None, recall: float = RECALL, id_col: str = "doc_id") -> None:
    """Writes the index of ``chunks`` (``id_col``, vector) to ``path``; the square root of their number is the number of cells
    unless ``cells`` says otherwise.

    Vectors that are null, or not as long as most of the sample, are no neighbour of anything and are not indexed.
    """
    spark = chunks.sparkSession
    rows = chunks.filter("size(vector) > 0").select(id_col, "vector")
    sample = rows.orderBy(F.xxhash64(id_col), id_col).limit(FIT_ROWS).toArrow()  # a bounded sample
    vectors = sample["vector"].to_pylist()
    sizes = [len(v) for v in vectors]
    dims = max(set(sizes), key=sizes.count, default=0)
    rows = rows.filter(F.size("vector") == dims)
    n = rows.count()
    own = [(i, v) for i, v in zip(sample[id_col].to_pylist(), vectors) if len(v) == dims]
    cells = max(1, min(cells or round(n**0.5), MOST_CELLS, len(own) // 8 or 1))
    centroids = fitted(_unit([v for _, v in own]), cells) if own else np.zeros((0, 0), np.float32)
    sent = spark.sparkContext.broadcast(centroids)  # MOST_CELLS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = (_whole(batch, 1, dims) @ sent.value.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    assigned = rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))
    assigned.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    stored = spark.read.schema(assigned.schema).parquet(f"{path}/cells")

    probes = cells
    asked = own[:ASKED]
    if cells > 1 and asked:
        queries = spark.createDataFrame([(i, v) for i, v in asked], T.StructType([T.StructField("query_id", rows.schema[id_col].dataType), T.StructField("query_vector", rows.schema["vector"].dataType)]))
        true = nearest(queries, stored, NEIGHBOURS + 1, id_col=id_col).filter(F.col("query_id") != F.col(id_col)).select("query_id", id_col)
        where = stored.select(id_col, "cell").join(F.broadcast(true), id_col).select("query_id", "cell").collect()  # ASKED x NEIGHBOURS rows
        order = np.argsort(-(_unit([v for _, v in asked]) @ centroids.T), axis=1, kind="stable")
        place = {i: {int(c): nth for nth, c in enumerate(row)} for (i, _), row in zip(asked, order)}
        needed = sorted(place[r["query_id"]][r["cell"]] + 1 for r in where)
        probes = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else cells
    table = [(c, [float(x) for x in v]) for c, v in enumerate(centroids)]
    spark.createDataFrame(table, "cell int, vector array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(n, dims, cells, probes)], "rows long, dims int, cells int, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def cells_of(index: DataFrame, cells: list[int]) -> DataFrame:
    """The rows of an index's ``cells``; the filter is on folders, so no others are read."""
    return index.filter(F.col("cell").isin(cells))


def nearest_indexed(queries: DataFrame, spark: SparkSession, path: str, k: int, probes: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """query_id, ``id_col``, score, rank as by nearest(), among the chunks of the ``probes`` cells nearest to each query
    (query_id, query_vector); by default as many as were measured when the index was written.

    Queries find their cells where they lie, then go to the workers in blocks of bounded size. A query whose vector is null
    or of another size finds nothing.
    """
    totals = spark.read.parquet(f"{path}/totals").first()
    dims, probes = totals["dims"], min(probes or totals["probes"], totals["cells"])
    centroids = np.array([r["vector"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()], np.float32)  # MOST_CELLS at most
    asked = queries.filter(F.size("query_vector") == dims).select("query_id", "query_vector")
    schema = T.StructType([*asked.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    sent = spark.sparkContext.broadcast(centroids)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.argsort(-(_whole(batch, 1, dims) @ sent.value.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    probed = asked.mapInArrow(probe, schema) if len(centroids) else spark.createDataFrame([], schema)
    index, parts = spark.read.parquet(f"{path}/cells") if totals["rows"] else None, []
    blocks = blocks_of(probed, QUERIES_PER_BLOCK)
    for block in blocks:
        table = block.toArrow()
        ids, cells = table["query_id"].to_pylist(), table["cells"].to_pylist()
        by_cell: dict[int, list[int]] = {}
        for i, own in enumerate(cells):
            for c in own:
                by_cell.setdefault(c, []).append(i)
        block_sent = spark.sparkContext.broadcast((table["query_vector"].to_pylist(), by_cell))

        def run(batches: Iterator[pa.RecordBatch], sent=block_sent) -> Iterator[pa.RecordBatch]:
            vectors, by_cell = sent.value
            best, arrow_id = Best(len(vectors), k), None
            for batch in batches:
                arrow_id = batch.schema.field(0).type
                kind = np.float32 if pa.types.is_float32(batch.schema.field(1).type.value_type) else np.float64
                cell = batch.column(2).to_numpy()
                for c in np.unique(cell):
                    own = np.array(by_cell[int(c)])
                    q = np.array([vectors[i] for i in own], kind)
                    at_cell = np.flatnonzero(cell == c)
                    step = max(1, PAIRS_AT_ONCE // len(own))
                    for at in range(0, len(at_cell), step):
                        some = pa.array(at_cell[at : at + step])
                        row_ids = np.array(batch.column(0).take(some).to_pylist())
                        v = batch.column(1).take(some).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(some), dims)
                        scores = q.astype(np.float64) @ v.T.astype(np.float64)
                        for j, i in enumerate(own):
                            found = nearly_best(scores[j], k, best.floor[i])
                            if found.size:
                                best.add(i, exact_scores(q[j], v[found]), row_ids[found])
            if arrow_id is not None:
                yield best.batch(["at", id_col, "score"], arrow_id)

        if index is not None and by_cell:
            rows = cells_of(index.select(id_col, "vector", "cell"), sorted(by_cell))
            result = T.StructType([T.StructField("at", T.LongType()), rows.schema[id_col], T.StructField("score", T.DoubleType())])
            found = named(rows.mapInArrow(run, result), spark, ids, probed).select("query_id", id_col, "score")
            parts.append(alone(ranked(found, k, id_col=id_col), block_sent, len(blocks)))
    if not parts:
        id_type = index.schema[id_col].dataType if index is not None else T.LongType()
        return spark.createDataFrame([], T.StructType([asked.schema["query_id"], T.StructField(id_col, id_type), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    return reduce(DataFrame.unionAll, parts)
