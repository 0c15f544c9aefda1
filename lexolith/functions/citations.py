"""Citation post-processing of generated answers, as one column expression.

An answer ends with (or holds) a tagged fact map: a JSON array of entries that say which document and pages a numbered
marker stands for. Markers become citations; adjacent markers of one document become one citation; markers that stand
for nothing go.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexolith.functions import pages
from lexolith.functions.markdown import MARKER_RUN
from lexolith.functions.text import is_blank

#: The patterns of fact maps, joined ids and markers, which decide what counts as one.
_TAG = r"(?is)<\s*FACT_MAP_JSON\s*>(.*?)<\s*/\s*FACT_MAP_JSON\s*>"
_JOINED = r"\[(\d+(?:\s*[,;]\s*\d+)+)\]"
_BARE = r"\[\d+\]"
#: How a citation begins.
_PREFIX = "::(Source: ["
#: The forms in which a model may write a marker, around its id; what stands for missing fields.
_MARKER_BEFORE = r"(?i)\[\^?(?:(?:Source|doc|Citation|Ref)[\s:]+)?\s*\Q"
_MARKER_AFTER = r"\E(?:[\s,;:][^\[\]]*)?\]"
_DEFAULTS = {"documentFilename": "UNKNOWN_FILE", "individualPageNumbers": pages.NOT_AVAILABLE, "documentId": "UNKNOWN_ID"}

OUTCOME = "struct<formatted:string,json_block:boolean,empty_fact_map:boolean,inline_markers:int,rendered:int,stripped:int>"


def trimmed(text: Column) -> Column:
    """Without control characters and blanks at both ends."""
    return F.regexp_replace(text, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def split_joined_ids(text: Column) -> Column:
    """``[1, 2]`` and ``[1; 2]`` as ``[1][2]``; commas elsewhere stay."""
    starts = F.split(text, r"(?=\[\d+(?:\s*[,;]\s*\d+)+\])", -1)

    def spread(piece: Column) -> Column:
        ids = F.regexp_extract(piece, r"\A" + _JOINED, 1)
        rest = F.regexp_replace(piece, r"\A" + _JOINED, "")
        return F.when(ids != "", F.concat(F.lit("["), F.regexp_replace(ids, r"\s*[,;]\s*", "]["), F.lit("]"), rest)).otherwise(piece)

    return F.array_join(F.transform(starts, spread), "")


def without_code_fences(payload: Column) -> Column:
    # fixed value: the fences that models put around JSON
    return F.regexp_replace(F.regexp_replace(payload, r"\A\s*```(?:json|JSON)?\s*", ""), r"\s*```\s*\z", "")


def bare_markers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_BARE))


def without_markers(text: Column) -> Column:
    return F.regexp_replace(split_joined_ids(text), _BARE, "")


def _field(entry: Column, key: str) -> Column:
    """A field as text: arrays comma-joined, null if it is missing or null."""
    value = F.try_element_at(entry, F.lit(key))
    items = F.transform(F.split(F.regexp_replace(value, r"\A\s*\[\s*|\s*\]\s*\z", ""), r"\s*,\s*"), lambda x: F.regexp_replace(x, r'\A"|"\z', ""))
    return F.when(value.rlike(r"(?s)\A\s*\[.*\]\s*\z"), F.array_join(items, ",")).otherwise(value)


def entries_of(payload: Column) -> Column:
    """The fact map's entries, null if it is not a JSON array of objects."""
    parsed = F.when(payload.rlike(r"\A\s*\["), F.from_json(payload, "array<map<string,string>>"))

    def entry(e: Column) -> Column:
        shown = {k: F.when(F.map_contains_key(e, k), F.coalesce(_field(e, k), F.lit("null"))).otherwise(d) for k, d in _DEFAULTS.items()}
        return F.struct(
            _field(e, "citationId").alias("id"),
            _field(e, "documentId").alias("document"),
            _field(e, "individualPageNumbers").alias("pages"),
            _field(e, "pageNumbers").alias("ranges"),
            shown["documentFilename"].alias("file"),
            shown["individualPageNumbers"].alias("shown_pages"),
            shown["documentId"].alias("shown_document"),
        )

    return F.when(~F.exists(parsed, lambda e: e.isNull()), F.transform(parsed, entry))


def _citation(file: Column, ranges: Column, individual: Column, document: Column) -> Column:
    return F.concat(F.lit(_PREFIX), file, F.lit("], Pages "), ranges, F.lit("|"), individual, F.lit("|documentId="), document, F.lit(")"))


def merged_runs(text: Column, entries: Column) -> Column:
    """Runs of adjacent markers with neighbours of one document put together; other markers stay as they are."""
    known = F.filter(entries, lambda e: ~is_blank(e["id"]))

    def first(marker: Column) -> Column:
        return F.get(F.filter(known, lambda e: e["id"] == marker), F.lit(0))

    def closed(ids: Column, document: Column) -> Column:
        own = F.transform(F.array_distinct(ids), first)
        union = pages.united(F.transform(own, lambda e: e["pages"]))
        many = _citation(F.get(own, F.lit(0))["file"], pages.compressed(union), union, document)
        return F.when(F.size(ids) >= 2, many).when(F.size(ids) == 1, F.concat(F.lit("["), F.get(ids, F.lit(0)), F.lit("]"))).otherwise("")

    def rebuilt(run: Column) -> Column:
        ids = F.regexp_extract_all(run, F.lit(r"\[(\d{1,4})\]"), F.lit(1))
        start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(None).cast("string").alias("document"), F.array().cast("array<struct<ids:array<string>,document:string>>").alias("groups"))

        def step(s: Column, marker: Column) -> Column:
            document = first(marker)["document"]
            same = F.coalesce(document == s["document"], F.lit(False)) & (F.size(s["ids"]) > 0)
            ids = F.when(same, F.concat(s["ids"], F.array(marker))).otherwise(F.array(marker))
            groups = F.when(same, s["groups"]).otherwise(F.concat(s["groups"], F.array(F.struct(s["ids"].alias("ids"), s["document"].alias("document")))))
            return F.struct(ids.alias("ids"), document.alias("document"), groups.alias("groups"))

        groups = F.aggregate(ids, start, step, lambda s: F.concat(s["groups"], F.array(F.struct(s["ids"].alias("ids"), s["document"].alias("document")))))
        return F.array_join(F.transform(groups, lambda g: closed(g["ids"], g["document"])), "")

    runs = F.transform(F.regexp_extract_all(text, F.lit(MARKER_RUN), F.lit(0)), rebuilt)
    gaps = F.split(text, MARKER_RUN, -1)
    woven = F.flatten(F.zip_with(gaps, F.concat(runs, F.array(F.lit(""))), lambda g, r: F.array(g, r)))
    return F.when(F.size(known) > 0, F.array_join(woven, "")).otherwise(text)


def substituted(text: Column, entries: Column) -> Column:
    """Markers in any accepted form replaced by their citations, entry by entry over what earlier entries left."""

    def one(t: Column, e: Column) -> Column:
        ranges = F.when(~is_blank(e["ranges"]) & (e["ranges"] != pages.NOT_AVAILABLE), e["ranges"]).otherwise(pages.compressed(F.nullif(e["shown_pages"], F.lit("null"))))
        shown = _citation(e["file"], ranges, e["shown_pages"], e["shown_document"])
        literal = F.replace(F.replace(shown, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        pattern = F.concat(F.lit(_MARKER_BEFORE), e["id"], F.lit(_MARKER_AFTER))
        return F.when(is_blank(e["id"]), t).otherwise(F.regexp_replace(t, pattern, literal))

    return F.aggregate(entries, text, one)


def rendered_citations(text: Column) -> Column:
    return F.size(F.split(text, r"::\(Source: \[", -1)) - 1


def with_outcome(answers, raw_col: str, out_col: str = "outcome"):
    """``answers`` with a struct of the formatted text and what became of its markers (OUTCOME).

    The steps are columns of their own, so that none is worked out again inside the next; the input's columns stay as they
    are, whatever their names, but for one that is called as the outcome is, which gives way to it.
    """
    rows = answers.select(F.struct(*[F.col(f"`{c}`") for c in answers.columns]).alias("row"), F.col(f"`{raw_col}`").alias("raw"))
    raw = F.col("raw")
    found = rows.withColumn("blocks", F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(_TAG), F.lit(0)))
    found = found.withColumn("block", F.when(F.size("blocks") > 0, F.element_at("blocks", -1)))
    after = F.element_at(F.split(F.coalesce(raw, F.lit("")), _TAG, -1), -1)
    found = found.withColumn("after", after)
    before = F.substring(raw, F.lit(1), F.length(raw) - F.length("after") - F.length("block"))
    body = F.when(F.col("block").isNull(), F.coalesce(raw, F.lit(""))).otherwise(trimmed(F.concat(before, F.lit(" "), "after")))
    found = found.withColumn("body", split_joined_ids(body)).withColumn("inline", bare_markers(F.col("body")))
    payload = trimmed(without_code_fences(F.regexp_extract("block", _TAG, 1)))
    found = found.withColumn("entries", entries_of(payload))
    found = found.withColumn("merged", F.when(F.col("entries").isNotNull(), merged_runs(F.col("body"), F.col("entries"))))
    found = found.withColumn("cited", substituted(F.col("merged"), F.col("entries")))
    usable = F.col("entries").isNotNull()
    found = found.withColumn("formatted", trimmed(without_markers(F.when(usable, F.col("cited")).otherwise(F.col("body")))))
    blank = is_blank(raw)
    outcome = F.struct(
        F.when(blank, "").otherwise(F.col("formatted")).alias("formatted"),
        (~blank & F.col("block").isNotNull()).alias("json_block"),
        (~blank & usable & (F.size("entries") == 0)).alias("empty_fact_map"),
        F.when(blank, 0).otherwise(F.col("inline")).alias("inline_markers"),
        F.when(~blank & usable, rendered_citations(F.col("formatted"))).otherwise(0).alias("rendered"),
        F.when(blank, 0).when(usable, bare_markers(F.col("cited"))).otherwise(F.col("inline")).alias("stripped"),
    )
    rest = [F.col("row")[c].alias(c) for c in answers.columns if c != out_col]
    return found.select(*rest, outcome.cast(OUTCOME).alias(out_col))
