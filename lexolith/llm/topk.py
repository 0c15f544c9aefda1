"""Exact top-k search by columnar branch and bound.

Vectors lie transposed, one row for each dimension. Scores are accumulated for a block of dimensions at a time; what the
remaining dimensions can still add is at most the product of the two remaining norms. Pairs that cannot reach the score
to beat are left out, and once few survive, the survivors are compacted and finished pair by pair.

The score to beat starts at each query's k-th best among a bounded sample of rows, which goes to the workers, and rises
with every batch. Queries go to the workers in blocks of a checked size; each block is compared with all rows, and only
rows that still may be among a query's best are shuffled. The best of a block are written and the block is freed before
the next one is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexolith.llm.common import checkpointed

#: Bytes of query vectors that go to the workers at once.
QUERY_BLOCK_BYTES = 64 << 20
#: Rows among which the first score to beat is found.
PROBE_ROWS = 4096
#: Dimensions accumulated at a time.
DIMS_PER_BLOCK = 16
#: Queries that meet the probe at once.
QUERIES_AT_ONCE = 1024
#: Share of pairs below which survivors are compacted.
COMPACT_BELOW = 0.25
#: Sums of integers are exact as doubles below this.
EXACT = 2.0**53
#: Pairs of queries and rows scored at once.
PAIRS_AT_ONCE = 2_000_000


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null for a vector that is null, empty or holds a null, NaN or infinity."""
    doubles = vector.cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when((F.size(doubles) > 0) & ~bad, F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale)))))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors of ``dims`` integer components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


class Search:
    """Keeps the k best rows of each query of a block.

    Bounds and scores are accumulated as doubles. Below EXACT, the product of the largest norms, all sums are exact
    integers. Above it, floors are lowered by what rounding may hide, and the scores of survivors are worked out anew
    from integers of any size; a score beyond a long is the nearest long.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.ids, self.k, self.dims, self.whole = ids, k, queries.shape[1], queries
        doubles = queries.astype(np.float64)
        self.order = np.argsort(-(doubles**2).sum(axis=0), kind="stable")  # heavy dimensions first
        self.queries = np.ascontiguousarray(doubles[:, self.order])
        self.norms = np.sqrt((doubles**2).sum(axis=1))
        self.rest = self._rest(self.queries)
        self.floor = floor.astype(np.float64).copy()
        self.best = [[] for _ in ids]

    def _rest(self, vectors: np.ndarray) -> np.ndarray:
        """Norms of what follows each block of dimensions: an array for each block."""
        squares = vectors**2
        return [np.sqrt(squares[:, d:].sum(axis=1)) * (1 + 1e-12) for d in range(DIMS_PER_BLOCK, self.dims, DIMS_PER_BLOCK)]

    def add(self, row_ids: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, PAIRS_AT_ONCE // max(1, len(self.ids)))
        for i in range(0, len(row_ids), step):
            self._add(row_ids[i : i + step], vectors[i : i + step])

    def _add(self, row_ids: np.ndarray, vectors: np.ndarray) -> None:
        columns = np.ascontiguousarray(vectors[:, self.order].T.astype(np.float64))
        rest = self._rest(columns.T)
        norm = np.sqrt((columns**2).sum(axis=0)).max(initial=0.0)
        exact = self.norms.max(initial=0.0) * norm < EXACT
        floor = self.floor if exact else self.floor - self.norms * norm * self.dims * 2.0**-50
        score = np.zeros((len(self.ids), len(row_ids)))
        pairs = None
        for b, d in enumerate(range(0, self.dims, DIMS_PER_BLOCK)):
            e = min(d + DIMS_PER_BLOCK, self.dims)
            if pairs is None:
                score += self.queries[:, d:e] @ columns[d:e]
                if e == self.dims:
                    q, r = np.nonzero(score >= floor[:, None])
                    pairs, score = (q, r), score[q, r]
                    break
                alive = score + self.rest[b][:, None] * rest[b][None, :] >= floor[:, None]
                if np.count_nonzero(alive) < COMPACT_BELOW * alive.size:
                    q, r = np.nonzero(alive)
                    pairs, score = (q, r), score[q, r]
            else:
                q, r = pairs
                for at in range(0, len(q), PAIRS_AT_ONCE // 4):
                    some = slice(at, at + PAIRS_AT_ONCE // 4)
                    score[some] += np.einsum("nd,dn->n", self.queries[q[some], d:e], columns[d:e, r[some]])
                reach = score if e == self.dims else score + self.rest[b][q] * rest[b][r]
                keep = reach >= floor[q]
                pairs, score = (q[keep], r[keep]), score[keep]
        q, r = pairs
        own = self.ids[q] != row_ids[r]
        q, r = q[own], r[own]
        score = score[own].astype(np.int64) if exact else self._long_scores(q, r, vectors)
        for i in np.unique(q):
            found = q == i
            self.best[i] = sorted([*self.best[i], *zip((-score[found]).tolist(), row_ids[r[found]].tolist())])[: self.k]
            if len(self.best[i]) == self.k:
                self.floor[i] = max(self.floor[i], -self.best[i][-1][0])

    def _long_scores(self, q: np.ndarray, r: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Inner products of pairs, by Python's integers."""
        least, most = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
        found = (sum(map(int.__mul__, self.whole[i].tolist(), vectors[j].tolist())) for i, j in zip(q.tolist(), r.tolist()))
        return np.array([min(max(x, least), most) for x in found], np.int64)

    def rows(self) -> list[tuple]:
        return [(int(i), v, -s) for i, best in zip(self.ids, self.best) for s, v in best]


def _best(found: DataFrame, k: int, rank: str = "") -> DataFrame:
    """The ``k`` best rows of each query, with their rank if it has a name."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked if rank else ranked.drop("rank")


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """query_id, rank (from 1), ``id_col`` and score: the ``k`` rows with the highest integer inner products for each query.

    Queries are the rows for which ``is_query`` holds, candidates all rows but those with the query's own id; ties go to
    the smaller id. Vectors that are null, empty or hold a null or a number that is not finite, rows with a null id and
    vectors of another dimension than the query's take no part; other columns are not read, whatever their names. A repeated row is a candidate as often as it occurs, but
    an id asks once, with the least of its vectors. Components and scores beyond a long are the nearest long. Fewer than ``k`` candidates give all of them; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    asking = rows.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    sizes = {r["dims"]: r["n"] for r in asking.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect()}
    found = None
    for dims, n in sorted(sizes.items()):
        own = rows.filter(F.size("v") == dims)
        probe = own.orderBy(F.xxhash64("id"), "id").limit(PROBE_ROWS).select("id", "v").toArrow()
        probe_sent = spark.sparkContext.broadcast((probe["id"].to_numpy(), _matrix(probe["v"], dims)))

        def first(batches: Iterator[pa.RecordBatch], sent=probe_sent, dims=dims) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, QUERIES_AT_ONCE):
                    some = batch.slice(at, QUERIES_AT_ONCE)
                    search = Search(some.column(0).to_numpy(), _matrix(some.column(1), dims), np.full(some.num_rows, -np.inf), k)
                    search.add(*sent.value)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(search.floor)], names=["id", "v", "floor"])

        # the score to beat of each query, found where the queries lie
        mine = asking.filter(F.size("v") == dims).mapInArrow(first, T.StructType([*asking.schema.fields, T.StructField("floor", T.DoubleType())]))
        blocks = -(-n * dims * 8 // query_block_bytes)
        if blocks > 1:
            mine = checkpointed(mine)
        for b in range(blocks):
            block = mine.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
            if not block.num_rows:
                continue
            sent = spark.sparkContext.broadcast((block["id"].to_numpy(), _matrix(block["v"], dims), block["floor"].to_numpy()))

            def run(batches: Iterator[pa.RecordBatch], sent=sent, dims=dims) -> Iterator[pa.RecordBatch]:
                search = Search(*sent.value, k)
                for batch in batches:
                    if batch.num_rows:
                        search.add(batch.column(0).to_numpy(), _matrix(batch.column(1), dims))
                out = search.rows()
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["query_id", "id", "score"])

            part = own.select("id", "v").mapInArrow(run, "query_id long, id long, score long")
            if blocks > 1:  # one block is with the workers at a time: its best are written, then it is freed
                part = checkpointed(_best(part, k))
                sent.destroy()
            found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, id long, score long")
    return _best(found, k, "rank").select("query_id", "rank", F.col("id").alias(id_col), "score")
