"""What turns bytes into text, texts into vectors and prompts into answers: the interfaces, and offline providers."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TextExtractor(Protocol):
    def __call__(self, files: Sequence[bytes]) -> Sequence[Sequence[Sequence[str]]]:
        """Pages of lines for each file."""


class EmbeddingProvider(Protocol):
    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        """A vector for each text, in their order."""


class ChatProvider(Protocol):
    def __call__(self, prompts: Sequence[str]) -> Sequence[str | None]:
        """An answer for each prompt, in their order."""


def looked_up(chunks: DataFrame, vectors: DataFrame, key: str = "document_id") -> DataFrame:
    """``chunks`` with the vector that a table (vec_id, embedding) has for their key: embedding without a model."""
    table = vectors.select(F.col("vec_id").alias("_key"), F.col("embedding").alias("vector"))
    return chunks.join(table, F.col(key) == F.col("_key"), "left").drop("_key")


def replayed_answers(requests: DataFrame, recorded: DataFrame, key: str = "request_id") -> DataFrame:
    """``requests`` with the raw answer that a table (key, raw) has recorded for them: chat without a model."""
    return requests.join(recorded.select(key, "raw"), key, "left")


def extracted(files: DataFrame, extract: TextExtractor, content: str = "content") -> DataFrame:
    """``files`` with page_number (from 1) and text (the page's lines, joined by blanks), a row for each page."""

    @F.pandas_udf("array<array<string>>")
    def run(contents):
        import pandas as pd

        pages = extract(contents.tolist()) if len(contents) else []
        return pd.Series([[list(lines) for lines in p] for p in pages], index=contents.index, dtype=object)

    pages = files.withColumn("_pages", run(content)).drop(content)
    rows = pages.select(*[c for c in pages.columns if c != "_pages"], F.posexplode("_pages").alias("_at", "_lines"))
    return rows.withColumn("page_number", F.col("_at") + 1).withColumn("text", F.array_join(F.filter("_lines", lambda x: x.isNotNull()), " ")).drop("_at", "_lines")
