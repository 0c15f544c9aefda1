"""Language identification by error-correcting output codes.

Every learned language has a codeword; each bit is a binary classifier over hashed character n-grams, whose weights are
the log ratios of the n-grams' shares in the languages with the bit and in those without. A text's bits are margins, not
signs: decoding adds the loss of every margin against each codeword and takes the least. A small lead over the second
codeword flags the text as ambiguous.

Fitting uses a bounded sample of labelled rows; prediction is one map over whole texts, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each language in the sample on which the classifiers are fitted, about.
FIT_ROWS_PER_LANGUAGE = 4000
#: Slots of hashed n-grams, and the longest n-gram.
SLOTS, LONGEST = 1 << 16, 3
#: Languages whose counts a worker holds at once.
TABLES_AT_ONCE = 64
#: Languages up to which every way to part them in two is a bit; beyond it bits are drawn from a hash.
EXHAUSTIVE = 5
#: Lead in score below which a text is ambiguous.
AMBIGUOUS = 0.1
#: Sharpness of the losses: margins are means over n-grams.
SHARPNESS = 6.0
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LETTERS = np.frombuffer(bytes(chr(c).isalpha() for c in range(1 << 16)), np.bool_)


def codewords(languages: int) -> np.ndarray:
    """A row of -1 and 1 for each language.

    For few languages all ways to part them in two; for more, balanced columns from a fixed seed, enough of them that
    codewords lie far apart.
    """
    if languages == 1:
        return np.ones((1, 1))
    if languages <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (languages - 1))
        return np.array([[-1.0 if i < languages - 1 and (s >> i) & 1 else 1.0 for s in splits] for i in range(languages)])
    bits = int(np.ceil(15 * np.log2(languages)))
    half = np.where(np.arange(languages) % 2 == 0, 1.0, -1.0)
    draw = np.random.default_rng(20_011)
    return np.stack([draw.permutation(half) for _ in range(bits)], axis=1)


def ngram_slots(text: str) -> np.ndarray:
    """Slots of all n-grams of the text's words, 1 to LONGEST symbols long, a blank on both sides of each word."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if codes.size and codes.max() >= _LETTERS.size:
        letter = np.array([chr(c).isalpha() for c in codes.tolist()], np.bool_)
    else:
        letter = _LETTERS[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    padded = np.concatenate(([32], np.where(letter, codes, 32), [32])).astype(np.uint64)
    blank = padded == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank of each run
    keep[0] = True
    padded = padded[keep]
    out, rolled = [], np.zeros(padded.size, np.uint64)
    for n in range(LONGEST):
        if padded.size <= n:
            break
        rolled = (rolled[: padded.size - n] + padded[n:]) * _FACTORS[n % 3]
        rolled ^= rolled >> np.uint64(29)
        out.append((rolled >> np.uint64(20)) & np.uint64(SLOTS - 1))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray  # of each slot, for each bit

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, a score from 0 to 1 and whether another one is close; ``und`` with 0 without any letter."""
        slots = ngram_slots(text or "")
        if not slots.size or not self.languages:
            return "und", 0.0, True
        if slots.size < SLOTS:
            margins = self.weights[slots].sum(axis=0, dtype=np.float64) / slots.size
        else:
            margins = np.bincount(slots, minlength=SLOTS) @ self.weights / slots.size
        losses = np.logaddexp(0, -SHARPNESS * self.codes * margins).mean(axis=1) * self.codes.shape[1]
        scores = np.exp(losses.min() - losses)
        scores /= scores.sum()
        best = int(np.argmax(scores))
        second = np.partition(scores, -2)[-2] if scores.size > 1 else 0.0
        return self.languages[best], float(scores[best]), bool(scores[best] - second < AMBIGUOUS)


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = FIT_ROWS_PER_LANGUAGE) -> Model:
    """Codewords and bit classifiers from ``rows``; rows without a language do not count.

    About ``per_language`` rows of each language are read, chosen by a hash of the id. Shares are smoothed and every
    language weighs the same. Counts are added up for each language where its rows lie and come to the driver one
    language after another, where they go into the sums of all bits; so however many languages there are, memory
    follows the bits, which are as many as fifteen times the logarithm of the languages.
    """
    rows = rows.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counted = sorted(map(tuple, rows.groupBy("lang").count().collect()))  # a row for each language
    languages = [lang for lang, _ in counted]
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((SLOTS, 0)))
    share = F.create_map(*[F.lit(x) for lang, n in counted for x in (lang, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1_000_000)) / F.lit(1e6)
    sample = rows.filter(place < F.try_element_at(share, F.col("lang"))).repartition(16)

    def packed(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([zlib.compress(v.astype("<i8").tobytes(), 1) for v in sums.values()], pa.binary())], names=["lang", "sums"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                found = np.bincount(ngram_slots(text.as_py() or ""), minlength=SLOTS)
                sums[lang] = sums.get(lang, 0) + found
                if len(sums) > TABLES_AT_ONCE:
                    yield packed({old: sums.pop(old) for old in [next(iter(sums))]})
        yield packed(sums)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for sums in batch.column(1):
                total += np.frombuffer(zlib.decompress(sums.as_py()), "<i8")
        yield packed({key[0].as_py(): total})

    codes = codewords(len(languages))
    with_bit, without = (codes.T > 0).astype(float), (codes.T < 0).astype(float)
    totals = np.zeros((2, codes.shape[1], SLOTS))
    place_of = {lang: i for i, lang in enumerate(languages)}

    def include(lang: str, counts: np.ndarray) -> None:
        shares, at = (counts + 0.5) / (counts.sum() + 0.5 * SLOTS), place_of.pop(lang)
        for side, bits in enumerate((with_bit, without)):
            totals[side, bits[:, at] > 0] += shares

    grouped = sample.select("text", "lang").mapInArrow(count, "lang string, sums binary").groupBy("lang").applyInArrow(add, "lang string, sums binary")
    for r in grouped.toLocalIterator():
        include(r["lang"], np.frombuffer(zlib.decompress(bytes(r["sums"])), "<i8"))
    for lang in list(place_of):  # no row of its own in the sample
        include(lang, np.zeros(SLOTS))
    if len(languages) == 1:
        return Model(languages, codes, np.zeros((SLOTS, 1), np.float32))
    ratio = np.log(totals[0] / with_bit.sum(axis=1, keepdims=True)) - np.log(totals[1] / without.sum(axis=1, keepdims=True))
    return Model(languages, codes, np.ascontiguousarray(ratio.T.astype(np.float32)))


def identify(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, lang_pred, score and ambiguous for every row of ``docs``.

    Texts of any length are read whole; columns but the id and the text are not read, whatever their names.
    A text that is null or has no letter is ``und`` with score 0, as is every text of a model without languages. Ties
    between codewords go to the first language by name. Repeated rows get equal results; an empty table an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t.as_py()) for t in batch.column(2)]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean").withColumnRenamed("doc_id", id_col)
