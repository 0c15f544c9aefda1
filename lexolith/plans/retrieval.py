"""The retrieval plan: filtered hybrid search for many queries, then refinement of each pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexolith.config import Retrieval
from lexolith.functions.predicates import is_active
from lexolith.operators.refine import diversified, without_contained, without_similar
from lexolith.operators.retrieval import best_texts, fused, nearest
from lexolith.operators.text_index import best_indexed, write_text_index
from lexolith.operators.vector_index import nearest_indexed, write_vector_index
from lexolith.sources.shared import shared_folder, written


def active_of(chunks: DataFrame) -> DataFrame:
    return chunks.filter(is_active(F.col("custom_metadata"))).select("doc_id", "chunk", "vector")


def write_index(chunks: DataFrame, path: str, vectors: bool = False) -> None:
    """Writes a text index of the active ``chunks`` to ``path``, and with ``vectors`` a vector index too."""
    active = active_of(chunks)
    write_text_index(active, f"{path}/texts")
    if vectors:
        write_vector_index(active, f"{path}/vectors")


def candidates(queries: DataFrame, chunks: DataFrame, config: Retrieval, index: str | None = None, approximate: bool = False) -> DataFrame:
    """query_id, rank, doc_id: the pool of each query. With ``index``, what write_index() wrote of the same chunks, texts are
    found by it, and with ``approximate`` vectors too. Without, queries and chunks are written once: blocks of queries read
    them again and again, and what made them, joins of whole texts for instance, must not run for each."""
    if index is None:
        queries, chunks = written(queries, "queries"), written(chunks.select("doc_id", "chunk", "vector"), "chunks")
    return _pool(queries, chunks, config, index, approximate)


def _pool(queries: DataFrame, chunks: DataFrame, config: Retrieval, index: str | None, approximate: bool) -> DataFrame:
    spark, asked, n = chunks.sparkSession, queries.select("query_id", "query_vector"), config.nearest
    near = nearest_indexed(asked, spark, f"{index}/vectors", n) if index and approximate else nearest(asked, chunks, n)
    texts = best_indexed(queries, spark, f"{index}/texts", n) if index else best_texts(queries, chunks, n)
    return fused(near, texts, config.pool)


def retrieve(queries: DataFrame, chunks: DataFrame, config: Retrieval = Retrieval(), index: str | None = None, approximate: bool = False) -> DataFrame:
    """query_id, pick, doc_id: what each query (query_id, query_text, query_vector) gets from the active ``chunks``.

    Vector and text candidates are fused to a pool; contained and too similar chunks leave it, and what stays is
    diversified, each step only if ``config`` has it on. Texts and vectors of the pool are fetched once, and only those
    that a step needs.
    """
    active = active_of(chunks)
    if index is None:  # blocks of queries read both again and again
        queries, active = written(queries, "queries"), written(active, "chunks")
    pool = _pool(queries, active, config, index, approximate).select("query_id", "rank", "doc_id")
    wanted = ["chunk"] * config.containment + ["vector"] * (config.cosine_dedup or config.diversify)
    rows = pool.join(active.select("doc_id", *wanted), "doc_id") if wanted else pool
    if wanted:
        shared_folder(chunks.sparkSession)
        rows = rows.checkpoint()  # a pool for each query
    kept = rows
    if config.containment:
        kept = rows.join(without_contained(kept, config.shingle, config.containment_threshold).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    if config.cosine_dedup:
        kept = rows.join(without_similar(kept, config.cosine_threshold).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    if config.diversify:
        return diversified(kept.join(queries.select("query_id", "query_vector"), "query_id"), config.final, config.relevance_weight)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("pick", place).filter(F.col("pick") <= config.final).select("query_id", "pick", "doc_id")
