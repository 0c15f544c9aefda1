"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model predicts the characters of each word from the few before them. A word equal to the one before it is one event
of its own, with the share that such words have in trusted text: their characters are likely, their repetition is not.
Its counts, continuation counts, discounts and interpolated probabilities come from aggregations and joins that are
sharded by n-gram and by context, over all trusted rows of one half; the order is the same at every size.

Every document then gets a perplexity over its whole text. A model of at most MODEL_ENTRIES n-grams goes to the workers: one
map, in which each scores a distinct word once. A larger one stays sharded, and the distinct words of all texts meet it in
joins. A
document is rejected when its perplexity exceeds that of nearly all trusted documents of its language that the model has
not seen: trusted rows are halved by a hash of their id, the model is fitted on all rows of one half, and the threshold is a
high quantile over the whole other half, so clean text stays and nothing is rejected by quota.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexolith.llm.common import checkpointed, free_name, kept

#: Length of the longest n-gram.
ORDER = 5
#: Trusted rows on which train() fits a small model. classify() and kept_documents() fit on all.
FIT_ROWS = 20_000
#: N-grams of a model that goes to the workers whole; contexts are no more than n-grams. A larger one is joined instead.
MODEL_ENTRIES = 1_500_000
#: Trusted ids that are sent to the texts at once; of more, the texts are read once for each so many.
IDS_AT_ONCE = 2_000_000
#: Tasks, and so checkpoint files, of the tables of train()'s small model.
MODEL_TASKS = 8
#: The quantile of held-out trusted documents' perplexities that is the threshold, and the held-out trusted documents
#: that a language needs to have one of its own.
QUANTILE, LEAST_TRUSTED = 0.998, 50
#: Bins of perplexities in which one and e times it lie apart, when a quantile is looked for.
BINS_PER_E = 1000
#: Characters at the language's usual rate that are added to every document, so that a few odd words do not reject it.
PRIOR_CHARS = 40
#: Words a worker remembers before it starts afresh.
CACHE_WORDS = 300_000
START, END = "\x02", "\x03"
#: What stands for a word equal to the one before it, among words that are never empty.
REPEAT = ""


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney's three discounts from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = (v or 0 for v in counts.agg(*[F.count_if(F.col("c") == i) for i in range(1, 5)]).first())
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), i + 0.95) for i, d in enumerate(raw))


def ngram_counts(words: DataFrame, order: int) -> dict[int, DataFrame]:
    """Tables (g, c) of the n-grams of each length from ``words`` (w, c).

    Longest n-grams, and those at the start of a word, count their occurrences; the others count the different symbols
    that precede them.
    """
    marked = words.select(F.split(F.concat(F.lit(START), "w", F.lit(END)), "").alias("s"), "c")  # an array, whose parts are reached at once
    raw = {}
    for n in range(1, order + 1):
        # one-symbol n-grams leave out the start, which is never predicted
        first = 2 if n == 1 else 1
        raw[n] = marked.select(F.explode(_slices("s", n, first)).alias("g"), "c").groupBy("g").agg(F.sum("c").alias("c"))
    out = {order: raw[order]}
    for n in range(1, order):
        ahead = raw[n + 1].groupBy(F.expr(f"substring(g, 2, {n})").alias("g")).agg(F.count(F.lit(1)).alias("c"))
        out[n] = ahead if n == 1 else ahead.unionByName(raw[n].filter(F.col("g").startswith(START)))
    return out


def _slices(symbols: str, n: int, first: int) -> Column:
    """All runs of ``n`` of an array of symbols, from the place ``first`` (1, 2, ...) on."""
    spots = F.when(F.size(symbols) >= first + n - 1, F.sequence(F.lit(first), F.size(symbols) - (n - 1)))
    return F.transform(spots, lambda i: F.concat(*[F.element_at(symbols, i + k) for k in range(n)]))


def fit(words: DataFrame, order: int = ORDER, tasks: int | None = MODEL_TASKS) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each length, (g, p): log probabilities of the n-grams in ``words`` (w, c), and (g, w): log weights of contexts.

    The probability of an n-gram is its discounted share of its context plus the context's weight times the probability
    of the n-gram without its first symbol; counts, contexts and shorter n-grams meet in joins by those keys.
    """
    model: dict[int, tuple[DataFrame, DataFrame]] = {}
    shorter = None
    for n, counts in sorted(ngram_counts(words, order).items()):
        counts = checkpointed(counts.coalesce(tasks) if tasks else counts)
        d1, d2, d3 = discounts(counts)
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        parts = counts.select("g", "c", F.expr(f"substring(g, 1, {n - 1})").alias("context"), discount.alias("d"))
        sums = parts.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("weight"))
        own = parts.join(sums, "context").select("g", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), "weight")
        if shorter is None:
            symbols = counts.count() + 1  # one more for every symbol that was never seen
            p = own.select("g", (F.col("own") + F.col("weight") / symbols).alias("p"))
            sums = sums.withColumn("weight", F.col("weight") / symbols)
        else:
            tails = shorter.select(F.col("g").alias("tail"), F.col("p").alias("tail_p"))
            joined = own.withColumn("tail", F.expr(f"substring(g, 2, {n - 1})")).join(tails, "tail")
            p = joined.select("g", (F.col("own") + F.col("weight") * F.col("tail_p")).alias("p"))
        shorter = checkpointed(p.coalesce(tasks) if tasks else p)
        model[n] = shorter.select("g", F.log("p").alias("p")), sums.select(F.col("context").alias("g"), F.log("weight").alias("w"))
    return model


@dataclass(frozen=True)
class Model:
    """Log probabilities of n-grams and log weights of contexts, and the share of words that repeat the one before them.

    ``name`` tells models apart.
    """

    name: str
    order: int
    probabilities: dict[str, float]
    weights: dict[str, float]
    repeats: float = 0.5


def sendable(tables: dict[int, tuple[DataFrame, DataFrame]]) -> Model:
    """The model of tables whose size the sample bounds."""
    probabilities: dict[str, float] = {}
    weights: dict[str, float] = {}
    for p, w in tables.values():
        for known, table in ((probabilities, p.toArrow()), (weights, w.toArrow())):
            known |= zip(table["g"].to_pylist(), table.column(1).to_pylist())
    return Model(uuid.uuid4().hex, max(tables), probabilities, weights)


class WordScorer:
    """Negative log probabilities of whole words, their end included, and of repeats."""

    def __init__(self, model: Model) -> None:
        self.order, self.p, self.w = model.order, model.probabilities, model.weights
        self.unseen = model.weights.get("", 0.0)
        self.again, self.anew = -math.log(model.repeats), -math.log1p(-model.repeats)
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        s, order, p, w = START + word + END, self.order, self.p, self.w
        total = self.anew
        for i in range(1, len(s)):
            for a in range(max(0, i + 1 - order), i + 1):
                if (hit := p.get(s[a : i + 1])) is not None:
                    total -= hit
                    break
                if a < i:
                    total -= w.get(s[a:i], 0.0)
            else:
                total -= self.unseen
        return total

    def text(self, text: str) -> tuple[float, int]:
        """The negative log probability of a text and the symbols it is over: characters of words, their ends, and repeats."""
        total, symbols, known, before = 0.0, 0, self.known, None
        for word in text.split():
            if word == before:
                total += self.again
                symbols += 1
                continue
            before = word
            score = known.get(word)
            if score is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                score = known[word] = self.word(word)
            total += score
            symbols += len(word) + 1
        return total, symbols


def score(docs: DataFrame, model: Model, text_col: str, nll: str, symbols: str, keep_text: bool = True) -> DataFrame:
    """``docs`` with the negative log probability of each whole text and what it is over, under the names ``nll`` and ``symbols``."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), model.name
    fields = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    places, at = [docs.columns.index(f.name) for f in fields], docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("quality", name), lambda: WordScorer(sent.value))
        for batch in batches:
            found = [scorer.text(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in places], pa.array([x for x, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())],
                names=[*[batch.schema.names[i] for i in places], nll, symbols],
            )

    schema = T.StructType([*fields, T.StructField(nll, T.DoubleType()), T.StructField(symbols, T.LongType())])
    return docs.mapInArrow(run, schema)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """trusted: the ids of rows with quality 1."""
    return labels.filter("quality = 1").select(F.col(id_col).alias("trusted")).filter("trusted IS NOT NULL").distinct()


def is_held_out() -> Column:
    """Whether a trusted id is in the half that gives the thresholds; the model is fitted on the other one only."""
    return F.pmod(F.xxhash64("trusted", F.lit("held out")), F.lit(2)) == 0


def words_of(docs: DataFrame, trusted: DataFrame, fit_rows: int | None, id_col: str, text_col: str) -> DataFrame:
    """(w, c): the words of the trusted rows that are not held out, repeats as REPEAT: of all, or with ``fit_rows`` of so many
    by a hash of their id."""
    used = trusted.filter(~is_held_out())
    if fit_rows is not None:
        used = used.orderBy(F.xxhash64("trusted"), "trusted").limit(fit_rows)
    used = checkpointed(used)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # bounded numbers of ids go to the texts, one after another, so that no text is shuffled
    n = max(1, -(-used.count() // IDS_AT_ONCE))
    some = [used.filter(F.pmod(F.xxhash64("trusted"), F.lit(n)) == i) for i in range(n)]
    texts = reduce(DataFrame.unionAll, [rows.join(F.broadcast(ids), F.col("id") == F.col("trusted"), "left_semi") for ids in some])
    listed = texts.select(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "").alias("ws"))
    marked = F.transform("ws", lambda w, i: F.when(w == F.get("ws", i - 1), REPEAT).otherwise(w))
    counts = listed.select(F.explode(marked).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    return checkpointed(counts if fit_rows is None else counts.coalesce(MODEL_TASKS))


def n_grams(words: DataFrame, order: int) -> int:
    """How many different n-grams of all lengths the words hold."""
    marked = words.select(F.split(F.concat(F.lit(START), "w", F.lit(END)), "").alias("s"))
    return marked.select(F.explode(F.concat(*[F.coalesce(_slices("s", n, 1), F.array()) for n in range(1, order + 1)])).alias("g")).distinct().count()


def train(
    docs: DataFrame, trusted: DataFrame, fit_rows: int = FIT_ROWS, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", entries: int = MODEL_ENTRIES
) -> Model:
    """The model of at most ``fit_rows`` trusted rows that are not held out, and of so few that they hold at most
    ``entries`` n-grams: the sample is halved until it does."""
    while True:
        words = words_of(docs, trusted, fit_rows, id_col, text_col)
        is_repeat = F.col("w") == REPEAT
        repeats, every = words.agg(F.sum(F.when(is_repeat, F.col("c")).otherwise(0)), F.sum("c")).first()
        words = words.filter(~is_repeat)
        if fit_rows <= 1 or n_grams(words, order) <= entries:
            return replace(sendable(fit(words, order)), repeats=((repeats or 0) + 0.5) / ((every or 0) + 1))
        fit_rows //= 2


@dataclass(frozen=True)
class Fitted:
    """A model of all trusted rows that are not held out: to be sent, or as tables (g, p) of n-grams and (g, w) of contexts."""

    model: Model | None
    probabilities: DataFrame
    weights: DataFrame
    order: int
    repeats: float

    def score(self, docs: DataFrame, text_col: str, nll: str, symbols: str, keep_text: bool = True) -> DataFrame:
        """As score(), whichever way."""
        if self.model is not None:
            return score(docs, self.model, text_col, nll, symbols, keep_text)
        return score_joined(docs, self, text_col, nll, symbols, keep_text)


def fitted(docs: DataFrame, trusted: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", entries: int | None = None, fit_rows: int | None = None) -> Fitted:
    """The model of all trusted rows that are not held out (of ``fit_rows``, if a caller wants that), as tables if it has more
    than ``entries`` n-grams."""
    words = words_of(docs, trusted, fit_rows, id_col, text_col)
    is_repeat = F.col("w") == REPEAT
    repeats, every = words.agg(F.sum(F.when(is_repeat, F.col("c")).otherwise(0)), F.sum("c")).first()
    share = ((repeats or 0) + 0.5) / ((every or 0) + 1)
    tables = fit(words.filter(~is_repeat), order, None)
    probabilities, weights = (reduce(DataFrame.unionByName, [t[i] for t in tables.values()]) for i in (0, 1))
    small = probabilities.count() <= (MODEL_ENTRIES if entries is None else entries)
    return Fitted(replace(sendable(tables), repeats=share) if small else None, probabilities, weights, order, share)


def word_scores(words: DataFrame, model: Fitted) -> DataFrame:
    """w and s: the negative log probability of each word of ``words`` (w, distinct), its end included, by joins. The same as
    WordScorer.word(): at each place the longest known n-gram, and the weights of the contexts that were too long."""
    marked = words.select("w", F.split(F.concat(F.lit(START), "w", F.lit(END)), "").alias("x"))
    places = marked.select("w", "x", F.explode(F.sequence(F.lit(2), F.size("x"))).alias("i"))
    ns = F.sequence(F.lit(1), F.least(F.col("i"), F.lit(model.order)))
    grams = places.select("w", "i", F.explode(F.transform(ns, lambda n: F.struct(n.alias("n"), F.array_join(F.slice("x", F.col("i") - n + 1, n), "").alias("g")))).alias("y"))
    grams = grams.select("w", "i", "y.n", "y.g", F.expr("substring(y.g, 1, y.n - 1)").alias("context"))
    met = grams.join(model.probabilities, "g", "left").join(model.weights.select(F.col("g").alias("context"), F.col("w").alias("weight")), "context", "left")
    tried = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "p", F.coalesce("weight", F.lit(0.0)).alias("weight"))))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(False).alias("hit"))
    step = lambda a, t: F.when(a["hit"], a).otherwise(F.struct((a["s"] - F.coalesce(t["p"], t["weight"])).alias("s"), t["p"].isNotNull().alias("hit")))
    each = met.groupBy("w", "i").agg(F.aggregate(tried, start, step, lambda a: a["s"]).alias("s"))
    return each.groupBy("w").agg((F.sum("s") - math.log1p(-model.repeats)).alias("s"))


def score_joined(docs: DataFrame, model: Fitted, text_col: str, nll: str, symbols: str, keep_text: bool = True) -> DataFrame:
    """score() with a model that is too large to be sent: distinct words of all texts are scored by joins, and texts, named by
    their digests, get the sums over their words. Equal texts have equal sums, so repeated rows need no names of their own."""
    own = docs.withColumn(key := free_name("key", docs), F.sha2(F.col(f"`{text_col}`").cast("binary"), 256))
    listed = own.select(F.col(key).alias("k"), F.filter(F.split(F.col(f"`{text_col}`"), "(?U)[\\s\\x1c-\\x1f]+"), lambda w: w != "").alias("ws"))
    marked = F.transform("ws", lambda w, i: F.when(w == F.get("ws", i - 1), REPEAT).otherwise(w))
    # a row of a text for each of its words: equal texts give equal rows, and one of them counts
    placed = listed.select("k", F.posexplode(marked).alias("at", "w"))
    counts = placed.groupBy("k", "w", "at").agg(F.lit(1).alias("one")).groupBy("k", "w").agg(F.count(F.lit(1)).alias("c"))
    counts = checkpointed(counts)
    scores = word_scores(counts.select("w").filter(F.col("w") != REPEAT).distinct(), model)
    is_repeat = F.col("w") == REPEAT
    met = counts.join(scores, "w", "left")
    sums = met.groupBy("k").agg(
        F.sum(F.col("c") * F.when(is_repeat, -math.log(model.repeats)).otherwise(F.col("s"))).alias("its_nll"), F.sum(F.col("c") * F.when(is_repeat, 1).otherwise(F.length("w") + 1)).alias("its_symbols")
    )
    found = (own if keep_text else own.drop(text_col)).join(sums, F.col(key) == F.col("k"), "left")
    rest = [F.col(f"`{c}`") for c in docs.columns if keep_text or c != text_col]
    return found.select(*rest, F.coalesce("its_nll", F.lit(0.0)).alias(nll), F.coalesce("its_symbols", F.lit(0)).cast("long").alias(symbols))


def quantiles(values: DataFrame, quantile: float) -> DataFrame:
    """lang and limit: for each lang of ``values`` (lang, v > 0), null being one, the ``quantile`` of v, interpolated as by percentile().

    Counts of narrow bins are added up first; only values of the bins in which the quantile lies are then ordered.
    """
    rows = values.withColumn("bin", F.floor(F.log("v") * BINS_PER_E))
    so_far = Window.partitionBy("lang").orderBy("bin")
    bins = rows.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("end", F.sum("n").over(so_far)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    low = F.floor((F.col("all") - 1) * quantile) + 1  # the place of the value below, from 1
    holds = (F.col("end") >= low) & (F.col("end") - F.col("n") <= low)  # the value's own bin or the next one's first value
    picked = bins.filter(holds).select(F.col("lang").alias("its_lang"), F.col("bin").alias("its_bin"), (F.col("end") - F.col("n")).alias("before"), low.alias("low"), "all")
    few = rows.join(F.broadcast(picked), F.col("lang").eqNullSafe(F.col("its_lang")) & (F.col("bin") == F.col("its_bin")))  # two rows for each language
    place = F.col("before") + F.row_number().over(Window.partitionBy("lang", "bin").orderBy("v"))
    near = few.withColumn("place", place).filter((F.col("place") >= F.col("low")) & (F.col("place") <= F.col("low") + 1))
    share = (F.first("all") - 1) * quantile - (F.first("low") - 1)
    return near.groupBy("lang").agg((F.min("v") + share * (F.max("v") - F.min("v"))).alias("limit"))


def judge(known: DataFrame, quantile: float, scored_lang: Column, nll: Column, symbols: Column) -> tuple[Column, Column, Column]:
    """Perplexity, threshold and whether to keep, for scored rows whose columns are given.

    ``known`` (lang, nll, symbols > 0) are the trusted rows that were held out.
    """
    # the usual rate of a language's trusted text, towards which short documents are drawn
    rate = F.sum("nll") / F.sum("symbols")
    grouped = known.filter("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), rate.alias("rate")).filter(F.col("n") >= LEAST_TRUSTED)
    usual = {r["lang"]: r["rate"] for r in grouped.collect()}  # a row for each language with enough trusted rows
    over_all = known.agg(rate).first()[0]
    if over_all is None:
        usual_rate, threshold = F.lit(0.0), F.lit(None).cast("double")
    else:
        v = _perplexity(F.col("nll"), F.col("symbols"), _by_language(F.col("lang"), usual, over_all))
        each = known.select("lang", v.alias("v"))
        each = each.filter(F.col("lang").isin(*usual)).unionByName(each.withColumn("lang", F.lit(None).cast("string"))) if usual else each.withColumn("lang", F.lit(None).cast("string"))
        limits = {r["lang"]: r["limit"] for r in quantiles(each, quantile).collect()}  # as few rows, and one over all
        over_all_limit = limits.pop(None)
        usual_rate = _by_language(scored_lang, usual, over_all)
        threshold = _by_language(scored_lang, limits, over_all_limit)
    perplexity = F.when(symbols > 0, _perplexity(nll, symbols, usual_rate))
    return perplexity, threshold, perplexity.isNotNull() & ~F.coalesce(perplexity > threshold, F.lit(False))


def classify(
    docs: DataFrame, labels: DataFrame, fit_rows: int | None = None, quantile: float = QUANTILE, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The columns of ``docs`` but the text, with __perplexity (per symbol), __threshold and __keep.

    ``labels`` (``id_col``, quality) name the trusted rows: quality 1. A hash of the id holds out half of them. The model
    is fitted on all of the others (on ``fit_rows``, if that is given); thresholds are the ``quantile`` over all held-out rows of a
    language, or of all languages together for a null language and for one with fewer than LEAST_TRUSTED held-out rows.
    A null or empty text, or one of blanks, has no perplexity and is not kept; texts of any length are scored whole.
    Without any held-out rows there is no threshold and all other texts are kept. Repeated rows get equal results; rows
    with a null id are classified but never trusted. A table that has one of the three new columns raises a ValueError.
    Texts are read twice: for the model, and to be scored.
    """
    if clash := {"__perplexity", "__threshold", "__keep"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns named {sorted(clash)} exist already")
    trusted = trusted_ids(labels, id_col)
    model = fitted(docs, trusted, order, id_col, text_col, fit_rows=fit_rows)
    nll, symbols = free_name("nll", docs), free_name("symbols", docs)
    scored = checkpointed(model.score(docs, text_col, nll, symbols, keep_text=False))
    slim = scored.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(nll).alias("nll"), F.col(symbols).alias("symbols"))
    known = slim.filter("symbols > 0").join(trusted.filter(is_held_out()), F.col("id") == F.col("trusted"), "left_semi").select("lang", "nll", "symbols")
    found = judge(known, quantile, F.col(f"`{lang_col}`"), F.col(nll), F.col(symbols))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return scored.select(*rest, *[c.alias(n) for c, n in zip(found, ("__perplexity", "__threshold", "__keep"))])


def kept_documents(
    docs: DataFrame, labels: DataFrame, fit_rows: int | None = None, quantile: float = QUANTILE, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` that classify() keeps, with all their columns, whatever their names.

    Texts are scored a second time where they lie, rather than joined to their scores: no text is shuffled, and repeated
    rows cannot multiply.
    """
    trusted = trusted_ids(labels, id_col)
    model = fitted(docs, trusted, order, id_col, text_col, fit_rows=fit_rows)
    slim = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    scored = model.score(slim, "text", "nll", "symbols", keep_text=False).filter("symbols > 0")
    known = checkpointed(scored.join(trusted.filter(is_held_out()), F.col("id") == F.col("trusted"), "left_semi").select("lang", "nll", "symbols"))
    nll, symbols = free_name("nll", docs), free_name("symbols", docs)
    *_, keep = judge(known, quantile, F.col(f"`{lang_col}`"), F.col(nll), F.col(symbols))
    return model.score(docs, text_col, nll, symbols).filter(keep).select(*[F.col(f"`{c}`") for c in docs.columns])


def _perplexity(nll: Column, symbols: Column, usual_rate: Column) -> Column:
    return F.exp((nll + usual_rate * PRIOR_CHARS) / (symbols + PRIOR_CHARS))


def _by_language(lang: Column, values: dict[str, float], otherwise: float) -> Column:
    """A value for each language from a table of few rows."""
    out = F.lit(float(otherwise))
    if values:
        table = F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])
        out = F.coalesce(F.try_element_at(table, lang), out)
    return out
