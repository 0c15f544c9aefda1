"""From pages to searchable chunks: splitting, batches, upserts and supersession."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexolith.config import EMBEDDING_BATCH, Chunking
from lexolith.functions.ids import name_uuid
from lexolith.functions.predicates import has_pair
from lexolith.functions.text import is_blank
from lexolith.functions.vectors import is_valid_vector

#: Fixed order of the levels at which a text is parted: paragraphs, lines, sentences, words.
_LEVELS = ("\n\n", "\n", ". ", " ")


def strided(text: Column, chunking: Chunking = Chunking()) -> Column:
    """Segments of a fixed size that overlap by a fixed length, as an array."""
    stride = chunking.size - chunking.overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - chunking.overlap) / stride).cast("int") - 1))
    return F.transform(starts, lambda i: F.substring(text, i * stride + 1, F.lit(chunking.size)))


def segments_of(text: str, chunking: Chunking = Chunking()) -> Iterator[tuple[int, str]]:
    """Segments of at most ``size`` characters and where they start, one after another, parted at the highest level that will do.

    Pieces are packed greedily; a piece that is too long is parted at the next level, and at last between characters.
    Each segment starts with whole pieces from the end of the one before, up to ``overlap`` characters of them.
    """

    def pieces(part: str, level: int) -> Iterator[str]:
        if len(part) <= chunking.size:
            yield part
        elif level == len(_LEVELS):
            for i in range(0, len(part), chunking.size):
                yield part[i : i + chunking.size]
        else:
            mark = _LEVELS[level]
            parts = part.split(mark)
            for i, x in enumerate(parts):
                piece = x + mark if i < len(parts) - 1 else x
                if piece:
                    yield from pieces(piece, level + 1)

    held: deque[str] = deque()
    length = fresh = end = 0
    for piece in pieces(text, 0):
        for unit in _units(piece, chunking.overlap) if len(text) > chunking.size else [piece]:
            if length + len(unit) > chunking.size and fresh:
                yield end - length, "".join(held)
                room = min(chunking.overlap, chunking.size - len(unit))
                kept: deque[str] = deque()
                for u in reversed(held):
                    if len(u) > room:
                        break
                    kept.appendleft(u)
                    room -= len(u)
                held, length, fresh = kept, sum(map(len, kept)), 0
            held.append(unit)
            length += len(unit)
            end += len(unit)
            fresh += 1
    if fresh:
        yield end - length, "".join(held)


def split_text(text: str, chunking: Chunking = Chunking()) -> list[str]:
    return [segment for _, segment in segments_of(text, chunking)]


def _units(piece: str, most: int) -> list[str]:
    """A piece's sentences, so that overlaps can be whole ones; the piece itself if it is short."""
    if len(piece) <= most or ". " not in piece:
        return [piece]
    parts = piece.split(". ")
    return [x + ". " for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


@F.udtf(returnType="chunk_index int, start int, chunk string", useArrow=True)
class SplitRecursively:
    """A table function: chunk_index (from 0), start and chunk of the segments of a text, handed on as they are found."""

    def eval(self, text: str, size: int, overlap: int, least: int):
        for i, (start, segment) in enumerate(segments_of(text or "", Chunking(size, overlap, least))):
            yield i, start, segment


def segmented(pages: DataFrame, chunking: Chunking = Chunking(), text: str = "text") -> DataFrame:
    """``pages`` joined laterally with chunk_index, start and chunk of the segments of ``text``; a null or empty text has
    none, and its page no row."""
    own = F.col(text).outer()
    return pages.lateralJoin(SplitRecursively(own, F.lit(chunking.size), F.lit(chunking.overlap), F.lit(chunking.least)))


def chunked(pages: DataFrame, segments: Column, chunking: Chunking = Chunking()) -> DataFrame:
    """A row for each segment of each page (document_id, page_number, client_id, text) longer than ``least``, trimmed.

    chunk_index counts all segments of the page from 0, so short ones leave gaps; ids are derived from where a chunk
    stands, so a document that comes twice gives the same ids.
    """
    return with_ids(pages.select("document_id", "page_number", "client_id", F.posexplode(segments).alias("chunk_index", "chunk")), chunking)


def chunked_recursively(pages: DataFrame, chunking: Chunking = Chunking()) -> DataFrame:
    """chunked() with the segments of the recursive splitter."""
    parts = segmented(pages, chunking).select("document_id", "page_number", "client_id", "chunk_index", "chunk")
    return with_ids(parts, chunking)


def with_ids(parts: DataFrame, chunking: Chunking) -> DataFrame:
    """``parts`` that are longer than ``least``, trimmed, with ids derived from where they stand."""
    kept = parts.filter(F.length(F.trim("chunk")) > chunking.least)
    key = F.concat_ws("|", F.coalesce("client_id", F.lit("")), F.col("document_id").cast("string"), F.col("page_number").cast("string"), F.col("chunk_index").cast("string"))
    return kept.select(name_uuid(key).alias("id"), *kept.columns)


def embedding_batches(chunks: DataFrame, size: int = EMBEDDING_BATCH) -> DataFrame:
    """document_id, batch, n_chunks, n_chars, mean_chars, tokens: how a document's non-blank chunks go to be embedded."""
    order = Window.partitionBy("document_id").orderBy("page_number", "chunk_index")
    rows = chunks.filter(~is_blank(F.col("chunk"))).withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("bigint"))
    sums = rows.groupBy("document_id", "batch").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"))
    return sums.select("*", F.expr("n_chars div n_chunks").alias("mean_chars"), F.expr("n_chars div 4").alias("tokens"))


def embedded(chunks: DataFrame, embed, batch_rows: int = EMBEDDING_BATCH) -> DataFrame:
    """``chunks`` with a vector from ``embed``, a function of a list of texts; blank chunks and short answers get none.

    ``embed`` runs on the executors, on at most ``batch_rows`` texts at a time, and gives vectors in their order.
    """

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        asked = [i for i, t in enumerate(texts) if t is not None and t.strip()]
        for at in range(0, len(asked), batch_rows):
            some = asked[at : at + batch_rows]
            vectors = embed([texts.iloc[i] for i in some])
            if len(vectors) == len(some):
                for i, v in zip(some, vectors):
                    out[i] = v
        return pd.Series(out, index=texts.index)

    return chunks.withColumn("vector", run("chunk"))


def split_by_vector(chunks: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Chunks that may be loaded, and those whose vector is missing or of another size."""
    good = is_valid_vector(F.col("vector"), dimensions)
    return chunks.filter(good), chunks.filter(~good)


def upserted(current: DataFrame, arrived: DataFrame, key: str = "id", order: str = "arrived_at") -> DataFrame:
    """The latest row of each key of both; of rows of ``arrived`` with the same time the last by all its columns. Versions
    of a key are compared before they move, so no task sorts them all."""
    both = current.unionByName(arrived, allowMissingColumns=True)
    place = F.struct(F.col(order).isNotNull(), order, -F.xxhash64(*both.columns).cast("decimal(20,0)"))
    latest = both.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*both.columns), place).alias("_row"))
    return latest.select("_row.*")


def merged_column(current: DataFrame, changes: DataFrame, column: str, key: str = "id") -> DataFrame:
    """``current`` with one column taken from ``changes`` where that has the key; of several changes to a key the greatest
    value counts, and a change to null only if there is no other."""
    new = changes.groupBy(F.col(key).alias("its_key")).agg(F.struct(F.max(column).alias("value")).alias("new"))
    merged = F.when(F.col("new").isNotNull(), F.col("new")["value"]).otherwise(F.col(column))
    return current.join(new, F.col(key) == F.col("its_key"), "left").select(*[merged.alias(c) if c == column else F.col(c) for c in current.columns])


def superseded(chunks: DataFrame, ids: DataFrame, metadata_col: str = "custom_metadata") -> DataFrame:
    """``chunks`` with a false activity mark added where any documentId among the metadata is in ``ids`` (document_id).

    A chunk that has the mark already gets no second one. Chunks and ids meet in an equi-join on exploded ids.
    """
    named = chunks.select("id", F.explode(F.filter(metadata_col, lambda m: m["key"] == "documentId")).alias("m"))
    hit = named.join(ids.select(F.col("document_id").cast("string").alias("_doc")).distinct(), F.col("m.value") == F.col("_doc"), "left_semi").select("id").distinct()
    mark = F.array(F.struct(F.lit("is_active").alias("key"), F.lit("false").alias("value")))
    marked = chunks.join(hit.withColumn("_hit", F.lit(True)), "id", "left")
    off = has_pair(F.col(metadata_col), "is_active", "false")
    return marked.withColumn(metadata_col, F.when(F.col("_hit") & ~off, F.concat(metadata_col, mark)).otherwise(F.col(metadata_col))).drop("_hit")
