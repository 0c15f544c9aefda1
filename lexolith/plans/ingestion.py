"""The ingestion plan: files or pages to embedded chunks, and what becomes of superseded documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexolith.config import EMBEDDING_BATCH, Chunking
from lexolith.operators import ingestion
from lexolith.sources.providers import EmbeddingProvider


def ingest(pages: DataFrame, embed: EmbeddingProvider, dimensions: int, chunking: Chunking = Chunking(), batch_rows: int = EMBEDDING_BATCH) -> tuple[DataFrame, DataFrame]:
    """Chunks to load and chunks whose embedding failed, from ``pages`` (document_id, page_number, client_id, text)."""
    chunks = ingestion.chunked_recursively(pages, chunking)
    return ingestion.split_by_vector(ingestion.embedded(chunks, embed, batch_rows), dimensions)


def loaded(index: DataFrame, chunks: DataFrame, superseded_ids: DataFrame | None = None) -> DataFrame:
    """``index`` with ``chunks`` (id, ..., arrived_at) upserted, and chunks of superseded documents marked inactive."""
    merged = ingestion.upserted(index, chunks)
    return merged if superseded_ids is None else ingestion.superseded(merged, superseded_ids)
