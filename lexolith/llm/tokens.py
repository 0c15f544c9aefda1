"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into words as the vocabulary file says; each distinct word is merged once per worker: its symbols form a
doubly linked list, a heap holds the adjacent pairs by rank and place, and the lowest is popped until no ranked pair is
left. The count is initial symbols minus merges; no identifier is ever looked up. The work is a map over the documents:
no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexolith.llm import wordbpe
from lexolith.llm.common import kept

#: Words a worker remembers before it starts afresh; a bound on memory that changes no count.
CACHE_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Fixed rule of such vocabularies: printable Latin-1 bytes stand for themselves, the others take the code points from
    256 on, in order.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class PairMerger:
    """Counts the tokens of one word from a table of ranked pairs."""

    def __init__(self, merges: list, suffix: str = "") -> None:
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
        self.suffix = suffix
        self.symbols = byte_symbols()

    def count(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        if not symbols:
            return 0
        symbols[-1] += self.suffix
        size = len(symbols)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        ranks = self.ranks
        heap = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(pair)) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            if symbols[i] is None or (j := after[i]) >= size or ranks.get((symbols[i], symbols[j])) != rank:
                continue  # one of the two was merged since this pair was pushed
            symbols[i] = merged = symbols[i] + symbols[j]
            symbols[j] = None
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (r := ranks.get((merged, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], merged))) is not None:
                heapq.heappush(heap, (r, h))
            merges += 1
        return size - merges


class TokenCounter:
    """Counts the tokens of whole texts, with a memory for words and for pieces between white space."""

    def __init__(self, path: str) -> None:
        spec = wordbpe.load(path)
        self.merger = PairMerger(spec["model"]["merges"], spec["model"].get("end_of_word_suffix") or "")
        self.words_of = wordbpe.word_pattern(spec).findall
        self.special = regex.compile("|".join(map(regex.escape, wordbpe.special_strings(spec))) or r"(?!)")
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            n = self.words[word] = self.merger.count(word)
        return n

    def plain(self, text: str) -> int:
        total, known = 0, self.pieces
        for piece in wordbpe.pieces(text):
            n = known.get(piece)
            if n is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                n = known[piece] = sum(map(self.word, self.words_of(piece)))
            total += n
        return total

    def count(self, text: str) -> int:
        """A special string inside a text is one token and parts the text around it."""
        if wordbpe.SPECIAL_START not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row of ``docs``.

    ``vocabulary`` is the path of a vocabulary file that every executor has; by default the installed
    word_bpe_49k.json. A null text counts as empty: 0 bytes, 0 tokens; texts of any length are encoded whole. Repeated rows and null ids are counted like any
    other; other columns are not read, so their names cannot clash. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        counter = kept(("token counts", path), lambda: TokenCounter(path))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("doc_id", id_col)
