"""Harmonic packing of documents into fixed-length training sequences.

A document's identifiers are cut into pieces. A piece of length n belongs to the reciprocal class k = capacity // n,
whose bins hold exactly k pieces each; pieces of the last class, all short, are packed by next fit. Every worker fills
bins of its own, online and in constant memory, so the work is one map without a shuffle. What is left in a worker's
open bins when its rows end, a few hundred pieces at most, is packed there by first fit decreasing; so a partition leaves
about one sequence badly filled for each open class, and many tiny partitions should be coalesced before.

A piece that would fill its class's share badly is cut once more at the next class's share, so that padding stays within
a few hundredths: a document's remainder falls into one to four pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexolith.llm import wordbpe
from lexolith.llm.common import kept

#: Pieces that a worker remembers by their text before it starts afresh; a bound on memory that changes no identifier.
CACHE_PIECES = 500_000
#: Texts that are encoded together.
TEXTS_AT_ONCE = 64
#: Sequence numbers of one worker: its partition number stands above these bits.
WORKER_BITS = 40
ID_BYTES = 4


class Encoder:
    """Identifiers of whole texts as the tokenizers library gives them, as bytes of little-endian unsigned 32-bit ids.

    The library encodes every distinct piece between white space once; what it says of a piece does not depend on the
    pieces around it. A text with a special string in it goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = wordbpe.load(path)
        self.words_of = wordbpe.word_pattern(spec).findall
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _by_word(self, words: list[str]) -> list[bytes]:
        """The ids of each of some words, which the library gets in one text: a blank parts words as nothing else does."""
        if not words:
            return []
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, word = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids)
        ends = (np.flatnonzero(np.concatenate((word[1:] != word[:-1], [True]))) + 1) * ID_BYTES
        return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def _learn(self, pieces: set[str]) -> None:
        """A piece of letters alone is one word; the others are cut as the vocabulary says."""
        known = self.words
        whole = [p for p in pieces if p.isalpha()]
        cut = {p: self.words_of(p) for p in pieces if not p.isalpha()}
        missing = list(set(whole).union(*cut.values()).difference(known))
        known.update(zip(missing, self._by_word(missing), strict=True))
        find = known.__getitem__
        self.pieces.update(zip(whole, map(find, whole)))
        self.pieces.update((p, b"".join(map(find, ws))) for p, ws in cut.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [None if wordbpe.SPECIAL_START in t else wordbpe.pieces(t) for t in texts]
        if len(self.pieces) >= CACHE_PIECES:
            self.pieces.clear()
        if len(self.words) >= CACHE_PIECES:
            self.words.clear()
        known = self.pieces
        self._learn(set().union(*filter(None, plain)).difference(known))
        find = known.__getitem__
        return [self._whole(t) if ps is None else b"".join(map(find, ps)) for t, ps in zip(texts, plain)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cut(length: int, capacity: int, classes: int, fill: float) -> list[int]:
    """Lengths of the pieces of a document of ``length`` ids, in order.

    Whole sequences come first. The rest is kept whole if it is short enough for the last class or fills its class's
    share to ``fill`` at least; else the next class's share is cut off it, and so on.
    """
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if k >= classes or rest * k >= fill * capacity:
            out.append(rest)
            break
        share = capacity // (k + 1)
        out.append(share)
        rest -= share
    return out


@dataclass
class HarmonicBins:
    """One worker's open bins: one for each class, which fills up and closes."""

    capacity: int
    classes: int
    first: int
    open: dict[int, list] = field(default_factory=dict)
    short: list = field(default_factory=list)
    short_used: int = 0
    made: int = 0

    def close(self, pieces: list) -> Iterator[tuple]:
        sequence, offset = self.first + self.made, 0
        self.made += 1
        for length, piece in pieces:
            yield (*piece, sequence, offset)
            offset += length

    def add(self, length: int, piece: tuple) -> Iterator[tuple]:
        k = self.capacity // length
        if k >= self.classes:
            if self.short_used + length > self.capacity:
                yield from self.close(self.short)
                self.short, self.short_used = [], 0
            self.short.append((length, piece))
            self.short_used += length
            return
        bin_ = self.open.setdefault(k, [])
        bin_.append((length, piece))
        if len(bin_) == k:
            yield from self.close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        left = sorted((p for b in (*self.open.values(), self.short) for p in b), key=lambda p: -p[0])
        bins: list[list] = []
        room: list[int] = []
        for p in left:
            at = next((i for i, r in enumerate(room) if r >= p[0]), len(bins))
            if at == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[at].append(p)
            room[at] -= p[0]
        for b in bins:
            yield from self.close(b)
        self.open, self.short, self.short_used = {}, [], 0


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    capacity: int = 2048,
    end_id: int = 1,
    classes: int = 32,
    fill: float = 0.96,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each piece of each row of ``docs``, with the sequence and the place in it that the piece takes.

    Columns: ``id_col``, start (ids of the row before the piece), length, ids_crc32 (of the little-endian unsigned
    32-bit ids), doc_tokens (ids of the row, with ``end_id``), sequence_id and offset. Each id lies in exactly one piece;
    no sequence exceeds ``capacity``. A null or empty text is the single id ``end_id``; texts of
    any length are cut into as many pieces as they need. Repeated rows are packed as often
    as they occur; null ids stay null; other columns are not read. An empty table gives an empty result. Sequence
    numbers hold the number of the input partition, so a task that is run again gives the same rows.
    """
    if not 2 <= classes <= capacity:
        raise ValueError("classes must lie between 2 and the capacity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        encoder = kept(("token ids", path), lambda: Encoder(path))
        bins = HarmonicBins(capacity, classes, TaskContext.get().partitionId() << WORKER_BITS)
        end = end_id.to_bytes(ID_BYTES, "little")
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7, schema=schema)

        for batch in batches:
            rows: list[tuple] = []
            doc_ids = batch.column(0).to_pylist()
            for at in range(0, len(doc_ids), TEXTS_AT_ONCE):
                some = slice(at, at + TEXTS_AT_ONCE)
                for doc_id, ids in zip(doc_ids[some], encoder.encode(batch.column(1)[some].to_pylist())):
                    ids += end
                    total, start = len(ids) // ID_BYTES, 0
                    for length in cut(total, capacity, classes, fill):
                        crc = zlib.crc32(ids[start * ID_BYTES : (start + length) * ID_BYTES])
                        rows += bins.add(length, (doc_id, start, length, crc, total))
                        start += length
            yield table(rows)
        yield table(list(bins.finish()))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
