"""Structure and prose of generated answers, and how well they keep to the citation format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexolith.functions.text import let

#: The tags that answers must put around their fact map, and the words from which an answer is substantive.
OPEN_TAG, CLOSE_TAG = "<FACT_MAP_JSON>", "</FACT_MAP_JSON>"
SUBSTANTIVE_WORDS = 50
#: The patterns of markers, runs of them and blocks; their bounds decide what is counted.
MARKER = r"\[(\d+)\]"
MARKER_RUN = r"\[\d{1,4}\](?:[ \t]{0,3}\[\d{1,4}\]){1,50}"
ANY_CITATION = r"(?i)\[\^?(?:(?:Source|doc|Citation|Ref)[\s:]{1,3})?\d[^\[\]]{0,40}\]"
_BLOCK = r"(?is)<FACT_MAP_JSON>(.*?)</FACT_MAP_JSON>"


def structure(text: Column) -> Column:
    """h1, headings and bullets among the stripped lines of a text."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.struct(
        F.size(F.filter(lines, lambda x: x.startswith("# "))).alias("h1"),
        F.size(F.filter(lines, lambda x: x.startswith("##"))).alias("headings"),
        F.size(F.filter(lines, lambda x: x.startswith("- ") | x.startswith("* "))).alias("bullets"),
    )


def has_fact_map(raw: Column) -> Column:
    return F.coalesce(raw, F.lit("")).rlike(_BLOCK)


def without_fact_map(raw: Column) -> Column:
    return F.regexp_replace(F.coalesce(raw, F.lit("")), _BLOCK, "")


def prose(raw: Column) -> Column:
    """The narrative alone: fact maps and bracketed tokens out, white space folded."""
    bare = F.regexp_replace(without_fact_map(raw), r"\[[^\[\]]{0,64}\]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def word_count(prose_text: Column) -> Column:
    return F.when(prose_text == "", 0).otherwise(F.size(F.split(prose_text, " ")))


def document_of(raw: Column) -> Column:
    """A map from the citation ids in the fact maps of an answer to their documents; an id's first entry holds."""
    blocks = F.array_join(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(_BLOCK), F.lit(1)), "\n")
    # fixed values: the forms of entries and their fields
    objects = F.regexp_extract_all(blocks, F.lit(r"\{[^{}]{0,600}\}"), F.lit(0))
    entries = F.transform(
        objects,
        lambda o: F.struct(
            F.regexp_extract(o, r'"citationId"\s*:\s*"?(\d{1,6})"?', 1).try_cast("int").alias("id"), F.regexp_extract(o, r'"documentId"\s*:\s*"([^"]{0,80})"', 1).alias("doc")
        ),
    )
    usable = F.filter(entries, lambda e: e["id"].isNotNull() & (e["doc"] != ""))
    start = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))
    first = lambda m, e: F.when(F.map_contains_key(m, e["id"]), m).otherwise(F.map_concat(m, F.map_from_arrays(F.array(e["id"]), F.array(e["doc"]))))
    return F.aggregate(usable, start, first)


def stacked_runs(raw: Column) -> Column:
    """Runs of adjacent markers in which two neighbours stand for the same document."""
    runs = F.regexp_extract_all(without_fact_map(raw), F.lit(MARKER_RUN), F.lit(0))

    def stacked(run: Column, documents: Column) -> Column:
        ids = F.transform(F.regexp_extract_all(run, F.lit(MARKER), F.lit(1)), lambda i: F.try_element_at(documents, i.try_cast("int")))
        return let(ids, lambda d: F.exists(F.zip_with(F.slice(d, 1, F.size(d) - 1), F.slice(d, 2, F.size(d) - 1), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda p: p))

    return let(document_of(raw), lambda documents: F.size(F.filter(runs, lambda run: stacked(run, documents))))


def compliance(raw: Column, formatted: Column) -> Column:
    """How one answer keeps to the citation format.

    inline_markers, drifted (citations in any other bracket form), json_entries, inline_in_json (every inline id has an
    entry, and there is one), substituted, json_block, prose_chars, prose_words, cited_pages and stacked_runs.
    """
    raw = F.coalesce(raw, F.lit(""))
    body = without_fact_map(raw)
    inline = F.transform(F.regexp_extract_all(body, F.lit(MARKER), F.lit(1)), lambda i: i.try_cast("bigint"))
    # fixed values: the forms of fields in raw answers
    listed = F.transform(F.regexp_extract_all(raw, F.lit(r'"citationId"\s*:\s*(\d+)'), F.lit(1)), lambda i: i.try_cast("bigint"))
    pages = F.regexp_extract_all(raw, F.lit(r'"individualPageNumbers"\s*:\s*"([^"]{0,200})"'), F.lit(1))
    cited = F.filter(F.flatten(F.transform(pages, lambda p: F.split(p, ","))), lambda t: F.trim(t) != "")
    text = prose(raw)
    return F.struct(
        F.size(inline).alias("inline_markers"),
        F.greatest(F.lit(0), F.regexp_count(body, F.lit(ANY_CITATION)) - F.size(inline)).alias("drifted"),
        F.size(listed).alias("json_entries"),
        ((F.size(inline) > 0) & (F.size(F.array_except(inline, listed)) == 0)).alias("inline_in_json"),
        F.coalesce(F.contains(formatted, F.lit("::(Source")), F.lit(False)).alias("substituted"),
        has_fact_map(raw).alias("json_block"),
        F.length(text).alias("prose_chars"),
        word_count(text).alias("prose_words"),
        F.size(cited).alias("cited_pages"),
        stacked_runs(raw).alias("stacked_runs"),
    )
