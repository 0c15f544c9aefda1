"""Chunks as rows of the index, as search results and as what a caller sees, and documents that came before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexolith.functions.metadata import PAIRS, pairs_of
from lexolith.functions.text import blank_to_null

#: Fixed order of the columns that a search reads; a client's column is among them only if the search is for a client.
RETRIEVED = ("id", "chunk", "document_file_name", "document_id", "page_number", "document_file_url", "custom_metadata", "chunk_vector")
CLIENT_PLACE = 4


def retrieved_columns(client_id: str | None) -> list[str]:
    if client_id is None or not client_id.strip():
        return list(RETRIEVED)
    return [*RETRIEVED[:CLIENT_PLACE], "client_id", *RETRIEVED[CLIENT_PLACE:]]


def retrieved(chunks: DataFrame, client_id: str | None = None) -> DataFrame:
    """The columns of ``chunks`` that a search reads: the scan reads no others."""
    return chunks.select(*retrieved_columns(client_id))


def with_document(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of the index: ``segments`` (id, document_id, page_number, chunk_index, chunk) with the name, address, client and
    metadata, a map that becomes a list of pairs, of their documents (document_id, name, url, client_id, metadata).

    Of several rows of one document the least counts; a segment without a document keeps nulls and an empty list. Spark
    broadcasts the documents if they are few and joins by sorting if not.
    """
    columns = ["name", "url", "client_id", "pairs"]
    one = documents.select("document_id", "name", "url", "client_id", pairs_of(F.col("metadata")).alias("pairs"))
    one = one.groupBy(F.col("document_id").alias("its_document")).agg(F.min(F.struct(*columns)).alias("d"))
    joined = segments.join(one, F.col("document_id") == F.col("its_document"), "left")
    metadata = F.coalesce(F.col("d.pairs"), F.array()).cast(PAIRS)
    return joined.select(
        "id", "document_id", "chunk", F.col("d.name").alias("document_file_name"), "page_number", "chunk_index", F.col("d.url").alias("document_file_url"),
        metadata.alias("custom_metadata"), F.col("d.client_id").alias("client_id"),
    )


def with_vector(chunk: Column, vector: Column) -> Column:
    """A chunk struct with its vector put in or replaced, all other fields as they are."""
    return chunk.withField("chunk_vector", vector)


def chunk_views(chunks: Column) -> Column:
    """What a caller sees of a list of chunk structs: document, file, page, text, and metadata if there are any."""

    def view(c: Column) -> Column:
        pairs = F.when(F.size(c["custom_metadata"]) > 0, c["custom_metadata"])
        return F.struct(c["document_id"].alias("document_id"), c["document_file_name"].alias("file"), c["page_number"].alias("page"), c["chunk"].alias("text"), pairs.alias("metadata"))

    return F.transform(F.coalesce(chunks, F.array()), view)


def already_processed(uploads: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``uploads`` (document_id, client_id) with known: whether ``outcomes`` hold the document of the same client, or, for
    an upload without a client, of none."""
    seen = outcomes.select(F.col("document_id").alias("its_document"), blank_to_null(F.col("client_id")).alias("its_client")).distinct()
    same = (F.col("document_id") == F.col("its_document")) & blank_to_null(F.col("client_id")).eqNullSafe(F.col("its_client"))
    return uploads.join(seen, same, "left").withColumn("known", F.col("its_document").isNotNull()).drop("its_document", "its_client")
