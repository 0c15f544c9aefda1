"""Language-model scoring by a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are words with A-Z lower-cased, and one end after each text. Three parts grow with the corpus, none is sampled:

* Counts. Every training token is counted. The most frequent words are classes of their own, all other words fall into
  TAILS classes by their last two bytes. A word of such a class has the smoothed share of its count within the class, and
  a word that was never seen is one more word of its class.
* Training. The model predicts the class of a token from the classes of the two before it: a context is the sum of their
  vectors, weighted by place and dimension, and a class scores the inner product of the context with its own vector, plus
  its bias. Every round each task runs noise-contrastive estimation over all its training tokens from the parameters of
  the round before, in numpy: a minibatch shares its noise, so scores and gradients are matrix products. The tasks'
  parameters are averaged by their tokens.
* Scores. The normaliser of every context is a row of a matrix product over all classes; the table of them goes to the
  workers, so a token's log probability is normalised exactly. Words whose counts do not go to the workers, all but the
  most frequent, meet their counts in a join by word.

So the probabilities of all words, the unseen ones among them, add up to 1 after any context.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexolith.llm.common import Stored, kept

#: Classes of single words, the end among them, and classes of all other words.
WORDS, TAILS = 768, 256
#: Parameters of a class's two vectors, and tokens before one that predict it.
DIMS, CONTEXT = 16, 2
#: Passes over the training tokens, tokens of a minibatch, noise tokens of a minibatch, and the rate of adaptive steps.
ROUNDS, MINIBATCH, NOISE, RATE = 1, 1024, 100, 0.05
#: Tokens that a task shuffles before it trains on them.
SHUFFLED = 1 << 16
#: Words whose counts go to the workers: the most frequent ones, and the bytes that such a word may have.
FREQUENT, FREQUENT_BYTES = 200_000, 64
#: Bins of counts in which one and e times it lie apart, when that bound is looked for.
BINS_PER_E = 200
#: Words that a task counts, and tokens that it scores, before it hands them on.
WORDS_AT_ONCE, TOKENS_AT_ONCE = 400_000, 1 << 16
#: The end of a text among words, which have no line feed, and its class.
END, END_CLASS = "\n", 0


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def tail_of(word: bytes) -> int:
    return crc32(word[-2:]) % TAILS


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all tokens of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                counts[END.encode()] += 1
                if len(counts) >= WORDS_AT_ONCE:
                    yield handed_on()
                    counts.clear()
        yield handed_on()

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What workers know of words: for each frequent word its place, class and log10 of its count and one; for each class
    the divisor of the share of a word within it (``mass``, 0 for the class of a single word) and its tokens.

    ``name`` tells vocabularies apart.
    """

    name: str
    places: dict[bytes, int]
    classes: np.ndarray
    logs: np.ndarray
    mass: np.ndarray
    tokens: np.ndarray


class _Places(dict):
    """Places of words; of others -1 less their tail class."""

    def __missing__(self, word: bytes) -> int:
        return -1 - tail_of(word)


def vocabulary(counts: DataFrame, frequent: int = FREQUENT, words: int = WORDS) -> Vocabulary:
    """The vocabulary of ``counts`` (word, c): the end and the most frequent words, as many of them as have counts over a
    bound that ``frequent`` words at most exceed."""
    end = F.col("word") == END
    short = counts.filter(F.octet_length("word") <= FREQUENT_BYTES).withColumn("bin", F.when(end, 1 << 20).otherwise(F.floor(F.log("c") * BINS_PER_E).cast("int")))
    least = held = 0
    for r in sorted(short.groupBy("bin").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):  # 44 x BINS_PER_E rows at most
        if (held := held + r["words"]) > max(frequent, 1):
            break
        least = r["bin"]
    top = short.filter(F.col("bin") >= least).collect() if held else []  # frequent rows of FREQUENT_BYTES at most
    top = sorted(top, key=lambda r: (-r["bin"], -r["c"], r["word"].encode()))
    names, c = [r["word"].encode() for r in top], np.array([r["c"] for r in top], np.int64)
    single = min(words, len(names))
    classes = np.array([i if i < single else words + tail_of(w) for i, w in enumerate(names)], np.int32)
    tail = F.pmod(F.crc32(F.expr("substring(cast(word AS binary), -2, 2)")), F.lit(TAILS))
    tokens, mass = np.zeros(words + TAILS, np.int64), np.zeros(words + TAILS)
    for r in counts.groupBy(tail.alias("tail")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # TAILS rows
        tokens[words + r["tail"]] = r["c"]
        mass[words + r["tail"]] = r["c"] + r["v"]
    for i in range(single):  # words of classes of their own are not in their tails
        at = words + tail_of(names[i])
        tokens[at] -= c[i]
        mass[at] -= c[i] + 1
        tokens[i] = c[i]
    mass[words:] += 1
    return Vocabulary(uuid.uuid4().hex, {w: i for i, w in enumerate(names)}, classes, np.log10(c + 1.0), mass, tokens)


class Reader:
    """Texts as places and classes of their tokens."""

    def __init__(self, v: Vocabulary) -> None:
        self.places, self.words = _Places(v.places), len(v.mass) - TAILS
        tails = self.words + np.arange(TAILS - 1, -1, -1, dtype=np.int32)  # reached by negative places
        self.classes = np.concatenate((v.classes, tails))

    def places_of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))


def contexts(classes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The classes one and two places before each token, the end's before the first of a text."""
    out = []
    for back in range(1, CONTEXT + 1):
        before = np.full(len(classes), END_CLASS, classes.dtype)
        before[back:] = classes[:-back] if back < len(classes) else classes[:0]
        for d in range(back):
            before[np.minimum(starts + d, len(classes) - 1)[starts + d < np.append(starts[1:], len(classes))]] = END_CLASS
        out.append(before)
    return out


@dataclass
class Parameters:
    """``before``: vectors of classes as context; ``after``: as prediction, the bias last; ``places``: weights of the places
    of a context."""

    before: np.ndarray
    after: np.ndarray
    places: np.ndarray

    @staticmethod
    def start(tokens: np.ndarray, dims: int = DIMS) -> Parameters:
        rng = np.random.default_rng(12)
        vectors = rng.normal(0, 0.1, (2, len(tokens), dims))
        bias = np.log((tokens + 1.0) / (tokens + 1.0).sum())
        return Parameters(vectors[0].astype(np.float32), np.column_stack((vectors[1], bias)).astype(np.float32), np.ones((CONTEXT, dims), np.float32))

    def rows(self) -> np.ndarray:
        """A row for each class, and one for each place."""
        wide = np.concatenate((self.before, self.after), axis=1)
        places = np.zeros((CONTEXT, wide.shape[1]), np.float32)
        places[:, : self.before.shape[1]] = self.places
        return np.concatenate((wide, places))

    @staticmethod
    def of_rows(rows: np.ndarray) -> Parameters:
        dims, rows = rows.shape[1] // 2, rows.astype(np.float32)
        return Parameters(rows[:-CONTEXT, :dims].copy(), rows[:-CONTEXT, dims:].copy(), rows[-CONTEXT:, :dims].copy())

    def context(self, before: list[np.ndarray]) -> np.ndarray:
        """The vectors of contexts, with 1 for the bias last."""
        out = np.ones((len(before[0]), self.after.shape[1]), np.float32)
        np.sum([w * self.before.take(b, axis=0) for w, b in zip(self.places, before)], axis=0, out=out[:, :-1])
        return out


class Trainer:
    """Noise-contrastive estimation with adaptive steps over the tokens of one task."""

    def __init__(self, start: Parameters, tokens: np.ndarray, seed: int) -> None:
        self.p, self.rng, self.seen = start, np.random.default_rng(seed), 0
        share = (tokens + 1.0) / (tokens + 1.0).sum()
        self.noise, self.log_noise = np.cumsum(share), np.log(NOISE * share).astype(np.float32)
        self.steps = {n: np.full_like(getattr(start, n), 1e-8) for n in ("before", "after", "places")}

    def _move(self, name: str, at: np.ndarray, gradient: np.ndarray) -> None:
        """A step of the rows ``at``, whose gradients are added up where rows repeat."""
        order = np.argsort(at, kind="stable")
        ordered = at.take(order)
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        rows, g = ordered.take(heads), np.add.reduceat(gradient.take(order, axis=0), heads, axis=0)
        steps = self.steps[name].take(rows, axis=0) + g * g
        self.steps[name][rows] = steps
        getattr(self.p, name)[rows] += RATE * g / np.sqrt(steps)

    def minibatch(self, target: np.ndarray, before: list[np.ndarray]) -> None:
        p, n, dims = self.p, len(target), self.p.before.shape[1]
        noise = np.minimum(np.searchsorted(self.noise, self.rng.random(NOISE)), len(self.noise) - 1).astype(target.dtype)
        context, true, false = p.context(before), p.after.take(target, axis=0), p.after.take(noise, axis=0)
        score = np.einsum("nd,nd->n", context, true) - self.log_noise[target]
        right = 1 / (1 + np.exp(np.minimum(score, 60)))  # how far a true token is from being told as true
        wrong = -1 / (1 + np.exp(np.minimum(self.log_noise[noise] - context @ false.T, 60)))
        right, wrong = (right / n)[:, None], wrong / n
        back = (right * true + wrong @ false)[:, :dims]
        self._move("after", np.concatenate((target, noise)), np.concatenate((right * context, wrong.T @ context)))
        places = np.stack([(back * p.before.take(b, axis=0)).sum(axis=0) for b in before])
        self._move("before", np.concatenate(before), np.concatenate([back * w for w in p.places]))
        self._move("places", np.arange(CONTEXT), places)

    def add(self, classes: np.ndarray, starts: np.ndarray) -> None:
        before = contexts(classes, starts)
        order = self.rng.permutation(len(classes))
        for i in range(0, len(order), MINIBATCH):
            some = order[i : i + MINIBATCH]
            self.minibatch(classes[some], [b[some] for b in before])
        self.seen += len(classes)


def _round(texts: DataFrame, vocabulary_sent, name: str, tokens: np.ndarray, start: Parameters, nth: int) -> Parameters:
    """One pass over ``texts`` by every task from ``start``: the mean of what they get, weighted by their tokens."""
    rows = start.rows()
    sent = texts.sparkSession.sparkContext.broadcast(rows)
    values = [f"v{i}" for i in range(rows.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = kept(("bilinear", name), lambda: Reader(vocabulary_sent.value))
        trainer = Trainer(Parameters.of_rows(sent.value), tokens, TaskContext.get().partitionId() * 1000 + nth)
        held, sizes = [], []

        def train() -> None:
            if held:
                trainer.add(np.concatenate(held), np.concatenate(([0], np.cumsum(sizes)[:-1])))
                held.clear()
                sizes.clear()

        for batch in batches:
            for text in batch.column(0):
                own = np.append(reader.classes[reader.places_of(words_of(text.as_py()))], np.int32(END_CLASS))
                held.append(own)
                sizes.append(len(own))
                if sum(sizes) >= SHUFFLED:
                    train()
        train()
        if trainer.seen:
            found = trainer.p.rows().astype(np.float64) * trainer.seen
            yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array([float(trainer.seen)] * len(found)), *map(pa.array, found.T.copy())], names=["slot", "tokens", *values])

    parts = texts.mapInArrow(run, f"slot int, tokens double, {', '.join(v + ' double' for v in values)}")
    found = parts.groupBy("slot").agg(F.sum("tokens").alias("tokens"), *[F.sum(v).alias(v) for v in values]).collect()  # a row for each class and place
    if not found:
        return start
    mean = np.zeros(rows.shape)
    for r in found:
        mean[r["slot"]] = np.array(r[2:]) / r["tokens"]
    return Parameters.of_rows(mean)


def train(texts: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Parameters:
    """The model of ``texts`` (text): ``rounds`` passes over all their tokens."""
    sent = texts.sparkSession.sparkContext.broadcast(v)
    p = Parameters.start(v.tokens)
    for nth in range(rounds):
        p = _round(texts, sent, v.name, v.tokens, p, nth)
    return p


def normalisers(docs: DataFrame, p: Parameters) -> np.ndarray:
    """Logarithms of the sums over all classes for every context (class before, class two before), worked out by tasks."""
    classes, spark = len(p.after), docs.sparkSession
    sent = spark.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                every = np.arange(classes)
                score = p.context([np.full(classes, i), every]) @ p.after.T
                most = score.max(axis=1)
                z = most + np.log(np.exp(score - most[:, None]).sum(axis=1, dtype=np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([z.astype("<f4").tobytes()], pa.binary())], names=["i", "z"])

    out = np.zeros((classes, classes), np.float32)
    for r in spark.range(0, classes, 1, 16).mapInArrow(run, "i long, z binary").collect():  # classes^2 floats, 4 MB
        out[r["i"]] = np.frombuffer(bytes(r["z"]), "<f4")
    return out


def _scored(docs: DataFrame, v: Vocabulary, p: Parameters, z: np.ndarray) -> DataFrame:
    """Of ``docs`` (doc_id, held_out, text): (row, doc_id, held_out, n_tokens, known, base, model), what is known of the
    frequent tokens, and (row, word, n) of the others."""
    sc = docs.sparkSession.sparkContext
    sent, model, name = sc.broadcast(v), sc.broadcast((p, z)), v.name
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = kept(("bilinear", name), lambda: Reader(sent.value))
        v, (p, z) = sent.value, model.value
        with np.errstate(divide="ignore"):
            share = np.where(v.mass > 0, np.log10(v.mass), 0.0)
        logs = np.append(v.logs, np.zeros(TAILS))  # other words' logarithms are joined
        row, held = TaskContext.get().partitionId() << 40, []

        def handed_on() -> Iterator[pa.RecordBatch]:
            ids, outs, words, places, rows = zip(*held)
            sizes = np.array([len(x) for x in places])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            at = np.concatenate(places)
            classes = reader.classes[at]
            before = contexts(classes, starts)
            score = np.einsum("nd,nd->n", p.context(before), p.after[classes]) - z[before[0], before[1]]
            own = logs[at]
            tail = classes >= reader.words
            each = score.astype(np.float64) / math.log(10) + np.where(tail, own, 0.0) - share[classes]
            total = [np.add.reduceat(x, starts) for x in ((at >= 0).astype(np.int64), own, each)]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(outs, pa.bool_()), pa.array(sizes), *map(pa.array, total), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=names
            )
            rare = [(r, Counter(compress(w, (x < 0).tolist()))) for r, w, x in zip(rows, words, places)]
            found = np.repeat(np.array(rows, np.int64), [len(c) for _, c in rare])
            if n := len(found):
                rare_words = pa.array([w for _, c in rare for w in c], pa.binary()).cast(pa.string())
                none = [pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(found), *none, rare_words, pa.array([k for _, c in rare for k in c.values()], pa.int64())], names=names)

        waiting = 0
        for batch in batches:
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = [*words_of(text.as_py()), END.encode()]
                held.append((doc_id, out, words, reader.places_of(words), row))
                row += 1
                waiting += len(words)
                if waiting >= TOKENS_AT_ONCE:
                    yield from handed_on()
                    held.clear()
                    waiting = 0
        if held:
            yield from handed_on()

    return docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, word string, n long")


def score(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, frequent: int = FREQUENT, words: int = WORDS
) -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Rows for which ``held_out`` does not hold are learned from; where it is null, as for a null id, a row is held out.
    n_known: tokens that occur in training; base_score: log10 probability by single tokens' counts, one added to each;
    score: that of the log-bilinear model. A null text is empty, and an empty text is its end alone. Texts are read whole,
    whatever their length, in words of any length. Repeated rows count and are scored each for itself. Without any training
    rows every token has base probability 1 and the model is untrained. An empty table gives no rows. Other columns are not
    read, so they may have any names.
    """
    out = F.coalesce(held_out, F.lit(True))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), out.alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    learned = rows.filter("NOT held_out").select("text")
    counts = Stored(word_counts(learned)).rows
    n, size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    v = vocabulary(counts, frequent, words)
    if END.encode() not in v.places:  # no training rows
        v = Vocabulary(v.name, {END.encode(): 0}, np.zeros(1, np.int32), np.zeros(1), v.mass, v.tokens)
    p = train(learned, v, rounds)
    stored = Stored(_scored(rows, v, p, normalisers(docs, p))).rows
    rare = stored.filter("word IS NOT NULL").select("row", "word", "n").join(counts, "word")
    sums = rare.groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_logs"))
    found = stored.filter("word IS NULL").drop("word", "n").join(sums, "row", "left")
    logs, known = F.coalesce("rare_logs", F.lit(0.0)), F.col("known") if n else F.lit(0)
    return found.select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (known + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * math.log10(n + size + 1)).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
