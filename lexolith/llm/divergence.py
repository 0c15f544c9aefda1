"""Audit of how sources of a language diverge in the terms they use, by sorting and run-length scans.

1. Runs. Each task turns its documents into runs (lang, term, source, first document, documents, occurrences), as many
   documents together as it holds, so a term of all documents is a few rows of each task.
2. Scan. Runs are repartitioned by (lang, term) and sorted within partitions by (lang, term, source, document). One pass
   over each sorted partition adds up adjacent runs: document frequencies, and occurrences by source. Terms of too few
   documents end here; a kept term leaves one row with the occurrences of the sources that have it.
3. Partials. With the totals of every (lang, source), a second pass over kept terms emits partial pairs, sums of the
   divergence of two sources, and the terms by which a source exceeds its language most, at most TERMS of each run of rows.
4. Partial pairs are added up, partial terms ranked.

A source without a term has the same share for all such terms. So a pair's value starts at V times the divergence of
these shares, worked out once, and the second pass only corrects it where one of the two has the term.

Shares are whole billionths; everything is integers, by Python's own where 64 bits may not do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexolith.llm.common import Stored, checkpointed

#: Documents of a language that a kept term is in.
LEAST_DOCUMENTS = 10
#: Terms of a source that are reported.
TERMS = 10
SCALE = 1_000_000_000
#: Entries of (lang, source, term) that a task gathers before it hands them on.
ENTRIES_AT_ONCE = 400_000
#: Pairs of an occurring (term, source) and a source, and cells of sums of pairs, worked on at once.
CELLS_AT_ONCE, SOURCES_AT_ONCE = 1 << 20, 1024
#: Sources of languages whose totals are sent to the workers at once.
GROUPS_SENT = 200_000
#: What separates terms, as a blank, and A-Z as a-z; all other bytes stay.
_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def runs_of(docs: DataFrame) -> DataFrame:
    """(lang, term, source, document, n_docs, n) of ``docs`` (lang, source, text): a run for each task and handing on.

    document is the place of the run's first document in its task, from which runs of a source are in order.
    """
    names = ["lang", "term", "source", "document", "n_docs", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents: dict[tuple, Counter] = {}
        occurrences: dict[tuple, Counter] = {}
        seen = began = entries = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in documents.items():
                n = len(found)
                terms = pa.array(list(found), pa.binary()).cast(pa.string())
                all_n = occurrences[lang, source]
                columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int32))), terms, pa.array([source], pa.string()).take(pa.array(np.zeros(n, np.int32)))]
                counts = [np.full(n, began, np.int64), np.fromiter(found.values(), np.int64, n), np.fromiter((all_n[t] for t in found), np.int64, n)]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, counts)], names=names)

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2)):
                words = terms_of(text.as_py())
                if words:
                    own = documents.setdefault((lang, source), Counter())
                    before = len(own)
                    own.update(set(words))
                    occurrences.setdefault((lang, source), Counter()).update(words)
                    entries += len(own) - before
                seen += 1
                if entries >= ENTRIES_AT_ONCE:
                    yield from handed_on()
                    documents, occurrences, entries, began = {}, {}, 0, seen
        yield from handed_on()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, term string, source string, document long, n_docs long, n long")


def _changes(*columns: pa.Array) -> np.ndarray:
    """Whether each row differs from the one before it in any of the columns; the first one does."""
    out = np.zeros(len(columns[0]), np.bool_)
    if len(out):
        out[0] = True
        for c in columns:
            out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def scanned(runs: DataFrame, least: int) -> DataFrame:
    """(lang, term, sources, counts) of every term in ``least`` documents or more of its language, by one pass over sorted runs."""
    names = ["lang", "term", "source", "n_docs", "n"]

    def whole_terms(t: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, term, source = (t[c].combine_chunks() for c in names[:3])
        by_term = _changes(lang, term)
        starts = np.flatnonzero(by_term | _changes(source))
        docs, n = (np.add.reduceat(t[c].to_numpy(), starts) for c in names[3:])
        first = np.flatnonzero(by_term[starts])  # of each term, among the runs of its sources
        kept = np.add.reduceat(docs, first) >= least
        sizes = np.diff(np.append(first, len(starts)))
        if kept.any():
            inside = np.repeat(kept, sizes)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes[kept]))).astype(np.int32))
            at = pa.array(starts[first[kept]])
            own = source.take(pa.array(starts[inside]))
            yield pa.RecordBatch.from_arrays([lang.take(at), term.take(at), pa.ListArray.from_arrays(offsets, own), pa.ListArray.from_arrays(offsets, pa.array(n[inside]))], names=["lang", "term", "sources", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = held[-1] if held else None
            held.append(pa.Table.from_batches([batch]).select(names))
            if last is not None and all(last[c][-1].as_py() == batch.column(c)[-1].as_py() for c in names[:2]):
                held = [_added_up(pa.concat_tables(held))]  # still the term that the rows before end with: its rows are added up
                continue
            whole = pa.concat_tables(held)
            end = int(np.flatnonzero(_changes(*(whole[c].combine_chunks() for c in names[:2])))[-1])
            yield from whole_terms(whole.slice(0, end)) if end else ()
            held = [whole.slice(end)]
        if held:
            yield from whole_terms(pa.concat_tables(held))

    def _added_up(t: pa.Table) -> pa.Table:
        starts = np.flatnonzero(_changes(*(t[c].combine_chunks() for c in names[:3])))
        sums = [pa.array(np.add.reduceat(t[c].to_numpy(), starts)) for c in names[3:]]
        return pa.table([*(t[c].combine_chunks().take(pa.array(starts)) for c in names[:3]), *sums], names=names)

    ordered = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    return ordered.select(names).mapInArrow(run, "lang string, term string, sources array<string>, counts array<long>")


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total); ``total`` is the group's occurrences and twice the kept terms."""
    if count.max(initial=0) < (2**63 - 1) // SCALE - 2:
        return 1 + SCALE * (count.astype(np.int64) + 2) // total
    return np.array([1 + SCALE * (int(c) + 2) // int(t) for c, t in zip(count, np.broadcast_to(total, count.shape))], np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _best_terms(sources: list[str], source: np.ndarray, term_of: np.ndarray, names: pa.Array, p: np.ndarray, q: np.ndarray, terms: int) -> Iterator[tuple]:
    """(source, term, value) of the ``terms`` best of each source among those whose share exceeds the language's."""
    value = divergence(p, q)
    over = np.flatnonzero(p > q)
    order = over[np.lexsort((-value[over], source[over]))]
    starts = np.flatnonzero(np.diff(source[order], prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(order))):
        own = order[a:b]
        own = own[value[own] >= value[own[min(terms, len(own)) - 1]]]  # with all ties of the last
        for v, name, i in sorted((-int(value[i]), names[int(term_of[i])].as_py(), int(i)) for i in own)[:terms]:
            yield sources[source[i]], name.decode("utf-8", "surrogatepass"), -v


def _corrections(source: np.ndarray, term_of: np.ndarray, p: np.ndarray, none: np.ndarray, first: int, sums: dict[int, np.ndarray]) -> None:
    """Adds to ``sums`` (by source, a cell for each of the sources from ``first`` on) how pairs diverge more than ``none`` says.

    Rows are occurring (term, source), those of a term together; each meets all sources of the range.
    """
    width = min(SOURCES_AT_ONCE, len(none) - first)
    at_once = max(1, CELLS_AT_ONCE // width)
    heads = np.flatnonzero(np.diff(term_of, prepend=-1))
    ends = np.append(heads[1:], len(term_of))
    for t in range(0, len(heads), at_once):
        a, b = heads[t], ends[min(t + at_once, len(heads)) - 1]
        row, own = term_of[a:b] - term_of[a], source[a:b]
        other = np.broadcast_to(none[first : first + width], (int(row[-1]) + 1, width)).copy()
        has = np.zeros(other.shape, np.bool_)
        inside = (own >= first) & (own < first + width)
        other[row[inside], own[inside] - first] = p[a:b][inside]
        has[row[inside], own[inside] - first] = True
        for i in range(0, b - a, at_once):
            r, o = row[i : i + at_once], own[i : i + at_once]
            more = divergence(p[a + i : a + i + len(r), None], other[r]) - divergence(none[o][:, None], none[None, first : first + width])
            # a pair of which both have the term is met from both sides and counts from the lesser one
            more[has[r] & (o[:, None] > np.arange(first, first + width))] = 0
            order = np.argsort(o, kind="stable")
            starts = np.flatnonzero(np.diff(o[order], prepend=-1))
            for s, line in zip(o[order][starts].tolist(), np.add.reduceat(more[order], starts, axis=0)):
                sums[s] = sums[s] + line if s in sums else line


def partials(kept: DataFrame, groups: dict[str, tuple[list[str], np.ndarray, int]], terms: int) -> DataFrame:
    """(lang, part, source, item, value): partial pairs and terms of every task's kept terms (lang, term, sources, counts).

    ``groups`` has for each language its sources, their totals and its own total, and goes to the workers.
    """
    sent = kept.sparkSession.sparkContext.broadcast(groups)
    names = ["lang", "part", "source", "item", "value"]

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "value" else pa.string()) for n, c in zip(names, columns)], names=names)

    def pairs(lang: str, first: int, sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        sources = sent.value[lang][0]
        for s, line in sums.items():
            others = [(int(j), int(line[j])) for j in np.flatnonzero(line) if s != first + j]
            yield rows_of([(lang, "pair", *sorted((sources[s], sources[first + j])), v) for j, v in others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, np.ndarray]] = {}
        for batch in batches:
            for lang in pc.unique(batch["lang"]).to_pylist():
                own = batch.filter(pc.equal(batch["lang"], lang))
                sources, totals, lang_total = sent.value[lang]
                sizes = pc.list_value_length(own["counts"]).to_numpy()
                term_of, count = np.repeat(np.arange(len(sizes)), sizes), own["counts"].flatten().to_numpy()
                encoded, place = own["sources"].flatten().dictionary_encode(), {s: i for i, s in enumerate(sources)}
                source = np.array([place[s] for s in encoded.dictionary.to_pylist()], np.int64)[encoded.indices.to_numpy()]
                p = shares(count, totals[source])
                whole = np.add.reduceat(count, np.flatnonzero(np.diff(term_of, prepend=-1)))
                q = shares(whole, lang_total)[term_of]
                yield rows_of([(lang, "term", *x) for x in _best_terms(sources, source, term_of, own["term"].cast(pa.binary()), p, q, terms)])
                none = shares(np.zeros(len(sources), np.int64), totals)
                for first in range(0, len(sources), SOURCES_AT_ONCE):
                    # cells of few sources are held until the task ends, those of many handed on at once
                    sums = held.setdefault(lang, {}) if len(sources) <= SOURCES_AT_ONCE else {}
                    _corrections(source, term_of, p, none, first, sums)
                    if len(sources) > SOURCES_AT_ONCE:
                        yield from pairs(lang, first, sums)
        for lang, sums in held.items():
            yield from pairs(lang, 0, sums)

    return kept.select("lang", "term", "sources", "counts").mapInArrow(run, "lang string, part string, source string, item string, value long")


def _parts(kept: DataFrame, totals: DataFrame, terms: int, groups_sent: int) -> DataFrame:
    """partials() with the totals of all languages, as many languages at once as have ``groups_sent`` sources or so together."""
    known = totals.filter("v > 0")
    batches = max(1, -(-known.count() // groups_sent))
    found = None
    for i in range(batches):
        mine = F.pmod(F.xxhash64("lang"), F.lit(batches)) == i
        own = known.filter(mine)
        if batches > 1 and own.count() > 4 * groups_sent:
            raise ValueError(f"a language has more than {groups_sent} sources, and so more pairs of sources than a table can hold")
        groups: dict[str, tuple[list, list, list]] = {}
        for r in own.select("lang", "source", "total", "lang_total").collect():  # groups_sent rows or so
            sources, sums, _ = groups.setdefault(r["lang"], ([], [], r["lang_total"]))
            sources.append(r["source"])
            sums.append(r["total"])
        part = partials(kept.filter(mine), {k: (s, np.array(n, np.int64), t) for k, (s, n, t) in groups.items()}, terms)
        found = part if found is None else found.unionByName(part)
    return found


def audit(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, terms: int = TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", groups_sent: int = GROUPS_SENT
) -> DataFrame:
    """lang, source, part, item, value and rank (from 1) for every (lang, source) of ``docs``.

    A language keeps the terms in ``least`` of its documents. A group's share of a kept term is 1 + floor(SCALE * (count + 2)
    / (N + 2 V)): N its occurrences of kept terms, V the language's kept terms. Two shares diverge by (p - q)^2 / (p + q),
    rounded down. Part ``pair``: every other source of the language and the sum over all kept terms, the most divergent
    first, ties by the name. Part ``term``: the ``terms`` kept terms that the source has and uses more than the language,
    by their divergence from the language's share, ties by the term.

    Null text, language and source are read as empty; the empty language and the empty source are groups like others. A
    source without kept terms, or without any, has its pairs; in a language without kept terms all pairs have 0. A single
    source has no pairs. Every row is a document, so repeated rows count again; texts of any length are read whole and once.
    An empty table gives no rows. Other columns are not read. No task holds more than ENTRIES_AT_ONCE terms and a text's.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    kept = Stored(scanned(runs_of(rows), least)).rows
    groups = rows.select("lang", "source").distinct()
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("lang_n"))
    n, v = F.coalesce("n", F.lit(0)), F.coalesce("v", F.lit(0))
    totals = groups.join(each, ["lang", "source"], "left").join(whole, "lang", "left")
    totals = checkpointed(totals.select("lang", "source", v.alias("v"), (n + 2 * v).alias("total"), (F.coalesce("lang_n", F.lit(0)) + 2 * v).alias("lang_total")))

    parts = Stored(_parts(kept, totals, terms, groups_sent)).rows
    # shares of a term that a source does not have; without kept terms there is nothing to share
    none = F.when(F.col("v") > 0, 1 + F.expr(f"{2 * SCALE}L div total")).otherwise(1).alias("none")
    side = totals.select("lang", "source", "v", none)
    other = side.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"))
    all_pairs = side.join(other, "lang").filter("source < item")  # the report has a row for each pair
    more = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("more"))
    valued = all_pairs.join(more, ["lang", "source", "item"], "left")
    value = F.expr("v * ((none - other_none) * (none - other_none) div (none + other_none))") + F.coalesce("more", F.lit(0))
    once = valued.select("lang", "source", "item", value.cast("long").alias("value"))
    both = once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    found = both.unionByName(parts.filter("part = 'term'").select("lang", "source", "item", "value", "part"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= terms)).select("lang", "source", "part", "item", "value", "rank")
