"""Column expressions on hand-made rows."""

from __future__ import annotations

import json
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexolith.functions import citations, ids, markdown, metadata, pages, predicates, text, vectors

PAIRS = "array<struct<key:string,value:string>>"


def values(spark, expression, rows, schema="x string"):
    df = spark.createDataFrame([(*r,) if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(expression.alias("out")).collect()]


def test_tokens_and_shingles(spark):
    rows = ["The  Cat, sat!", "Straße über 42", "", None, "one"]
    assert values(spark, text.tokens(F.col("x")), rows) == [["the", "cat", "sat"], ["stra", "e", "ber", "42"], [], [], ["one"]]
    assert values(spark, text.shingles(text.tokens(F.col("x")), 2), ["a b a b", "one", "", None]) == [["a b", "b a"], ["one"], [], []]


def test_escapes_and_cleaning(spark):
    assert values(spark, text.escape_search_syntax(F.col("x")), [r'a\b+c [d] "e" f/g! $h', "x.y,z'"]) == [r"a\\b\+c \[d\] \"e\" f\/g! $h", "x.y,z'"]
    assert values(spark, text.double_quotes(F.col("x")), ["it's ''", "plain"]) == ["it''s ''''", "plain"]
    assert values(spark, text.unescape(F.col("x")), [r"a\nb \"c\""]) == ['a\nb "c"']
    assert values(spark, text.without_trailing_slash(F.col("x")), ["a//", "a/", "a"]) == ["a/", "a", "a"]
    assert values(spark, text.salvaged_json(F.col("x")), ['pre {"a":{"b":1}} post', "none"]) == ['{"a":{"b":1}}', "none"]
    assert values(spark, text.csv_items(F.col("x")), [" a, ,b,", None]) == [["a", "b"], []]
    assert values(spark, text.truncated(F.col("x"), 4), ["abcd", "abcde"]) == ["abcd", "abc…"]
    assert values(spark, text.is_blank(F.col("x")), [None, " ", "a"]) == [True, True, False]


def test_ids(spark):
    names = ["client:1", "  padded ", ""]
    reference = [str(uuid.UUID(bytes=__import__("hashlib").md5(n.strip().encode()).digest(), version=3)) for n in names]
    assert values(spark, ids.name_uuid(F.col("x")), names) == reference
    good = values(spark, ids.parsed_blob_name(F.col("x")), ["doc123_20240101.pdf", "c=client-1/doc123_20240101.pdf", "doc123.pdf", "d_20241301.pdf", "d_20240101", "a_b_20240101.pdf", "c=x/y/d_20240101.pdf"])
    assert [r and (r.client_id, r.document_id) for r in good] == [(None, "doc123"), ("client-1", "doc123"), None, None, None, None, None]
    assert values(spark, ids.is_uuid(F.col("x")), [str(uuid.uuid4()), "x", "", None]) == [True, False, False, False]
    assert values(spark, ids.partition_key(F.col("x"), F.lit("k")), ["c", " ", None]) == ["c", "k", "k"]


def test_similarity(spark):
    rows = [([1.0, 2.0, 3.0], [4.0, 5.0, 6.0]), ([1.0, 0.0], [0.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])]
    assert values(spark, vectors.similarity(F.col("a"), F.col("b")), rows, "a array<float>, b array<float>") == [32.0, 0.0, 0.0, 0.0]
    assert values(spark, vectors.is_valid_vector(F.col("a"), 2), [([1.0, 2.0],), ([1.0],), (None,)], "a array<float>") == [True, False, False]


def test_active_and_metadata(spark):
    mark = lambda *v: [("is_active", x) for x in v]
    rows = [(None,), ([],), (mark("true"),), (mark("false"),), (mark("true", "false"),), ([("foo", "b' or '1'='1")],)]
    assert values(spark, predicates.is_active(F.col("m")), rows, f"m {PAIRS}") == [True, True, True, False, True, True]
    assert values(spark, predicates.is_strictly_active(F.col("m")), rows, f"m {PAIRS}") == [True, True, True, False, False, True]
    assert values(spark, predicates.matches_all(F.col("m"), [("foo", "b' or '1'='1")]), rows, f"m {PAIRS}") == [False] * 5 + [True]
    with pytest.raises(ValueError):
        predicates.retrievable(F.col("m"), F.col("c"), None, [("Is_Active", "true")])
    assert values(spark, predicates.within_size(F.col("s")), [(83_886_079,), (83_886_080,)], "s long") == [True, False]


def test_page_lists(spark):
    lists = ["1,2,3,5,6", "7", "1,2", "", None, "N/A", "iv,2", "3,2,1", " 1 , 2,3,"]
    assert values(spark, pages.compressed(F.col("x")), lists) == ["1-3,5,6", "7", "1,2", "N/A", "N/A", "N/A", "iv,2", "3,2,1", "1-3"]
    assert values(spark, pages.united(F.col("l")), [(["3,7", "7,8,2"],), (["iv,2", "3"],), ([None, "N/A"],)], "l array<string>") == ["2,3,7,8", "2,3,iv", "N/A"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, 40), min_size=1, max_size=15), min_size=1, max_size=20))
def test_compressed_pages_expand_again(spark, lists):
    def expanded(ranges):
        out = []
        for part in ranges.split(","):
            a, _, b = part.partition("-")
            out += range(int(a), int(b or a) + 1)
        return out

    got = values(spark, pages.compressed(F.col("x")), [",".join(map(str, x)) for x in lists])
    assert [expanded(g) for g in got] == lists


def entry(i, doc="d1", page="7", file="f.pdf", **more):
    return {"citationId": i, "documentFilename": file, "individualPageNumbers": page, "documentId": doc, **more}


def answer(body, *entries):
    return f"{body} <FACT_MAP_JSON>{json.dumps(list(entries))}</FACT_MAP_JSON>"


def cite(ranges="7", page="7", doc="d1", file="f.pdf"):
    return f"::(Source: [{file}], Pages {ranges}|{page}|documentId={doc})"


CITATIONS = {
    "plain": (answer("x [1].", entry(1)), f"x {cite()}.", (True, False, 1, 1, 0)),
    "forms": (answer("[1:7] [1, page 7] **[1]** [^1] [ 1 ] [citation 1] [Citation: 1] [Source 1] [1 p.7] (1)", entry("1")), " ".join([cite()] * 2 + [f"**{cite()}**"] + [cite()] * 6) + " (1)", (True, False, 1, 9, 0)),
    "joined": (answer("x [1, 2] 6, 7 [1; 2]", entry(1, "A"), entry(2, "B")), f"x {cite(doc='A')}{cite(doc='B')} 6, 7 {cite(doc='A')}{cite(doc='B')}", (True, False, 4, 4, 0)),
    "merged": (answer("[1] [2]", entry(1, "A", "10,11"), entry(2, "A", "12")), cite("10-12", "10,11,12", "A"), (True, False, 2, 1, 0)),
    "lines do not merge": (answer("[1]\n[2]", entry(1, "A"), entry(2, "A")), f"{cite(doc='A')}\n{cite(doc='A')}", (True, False, 2, 2, 0)),
    "mixed run": (answer("[1][2][3]", entry(1, "A"), entry(2, "A", "8"), entry(3, "B")), cite("7,8", "7,8", "A") + cite(doc="B"), (True, False, 3, 2, 0)),
    "unknown id": (answer("[1][9][2]", entry(1, "A"), entry(2, "A")), cite(doc="A") * 2, (True, False, 3, 2, 1)),
    "repeated id": (answer("[1][1]", entry(1, "A", "4,5")), cite("4,5", "4,5", "A"), (True, False, 2, 1, 0)),
    "page array": (answer("q [1]", entry(1, "A", [7, 8, 9])), "q " + cite("7-9", "7,8,9", "A"), (True, False, 1, 1, 0)),
    "given ranges": (answer("q [1]", entry(1, pageNumbers="p. 7")), "q " + cite("p. 7"), (True, False, 1, 1, 0)),
    "missing fields": (answer("q [1]", {"citationId": 1}), "q " + cite("N/A", "N/A", "UNKNOWN_ID", "UNKNOWN_FILE"), (True, False, 1, 1, 0)),
    "fenced": ("t [1] < fact_map_json >```json\n" + json.dumps([entry("1")]) + "\n```</FACT_MAP_JSON> tail", f"t {cite()}   tail", (True, False, 1, 1, 0)),
    "last block counts": ("see <FACT_MAP_JSON></FACT_MAP_JSON> [1]" + answer("", entry(1)), f"see <FACT_MAP_JSON></FACT_MAP_JSON> {cite()}", (True, False, 1, 1, 0)),
    "special characters": (answer("[1] $5", entry(1, file="a$1\\b.pdf")), cite(file="a$1\\b.pdf") + " $5", (True, False, 1, 1, 0)),
    "no block": ("a [1] b [2, 3]", "a  b", (False, False, 3, 0, 3)),
    "unreadable block": ("a [1] <FACT_MAP_JSON>[{oops</FACT_MAP_JSON>", "a", (True, False, 1, 0, 1)),
    "refusal": ("none <FACT_MAP_JSON>[]</FACT_MAP_JSON>", "none", (True, True, 0, 0, 0)),
    "loop": ("".join(f"[{i}]" for i in range(1, 201)), "", (False, False, 200, 0, 200)),
    "blank": ("  ", "", (False, False, 0, 0, 0)),
    "null": (None, "", (False, False, 0, 0, 0)),
}


def test_citations(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CITATIONS.items()], "k string, raw string")
    got = {r.k: tuple(r.outcome) for r in citations.with_outcome(df, "raw").collect()}
    assert got == {k: (v[1], *v[2]) for k, v in CITATIONS.items()}


def test_markdown_and_compliance(spark):
    got = values(spark, markdown.structure(F.col("x")), ["# A\n## B\n - c\n* d\n#e", None])
    assert [tuple(r) for r in got] == [(1, 1, 2), (0, 0, 0)]
    raw = answer("One two [1][2] three [Source 1].", entry(1, "A", "1, 2"), entry("2", "A", "3"))
    c = values(spark, markdown.compliance(F.col("x"), F.lit("::(Source")), [raw, None])
    assert (c[0].inline_markers, c[0].drifted, c[0].json_entries, c[0].inline_in_json, c[0].cited_pages, c[0].stacked_runs, c[0].prose_words) == (2, 1, 1, False, 3, 1, 4)
    assert c[1].prose_words == 0 and not c[1].json_block


def test_metadata_maps(spark):
    rows = [([("a", "1"), ("b", "2"), ("a", "3")],), (None,)]
    assert values(spark, metadata.last_wins(F.col("m")), rows, f"m {PAIRS}") == [{"a": "3", "b": "2"}, {}]
    assert values(spark, metadata.first_wins(F.col("m")), rows, f"m {PAIRS}") == [{"a": "1", "b": "2"}, {}]
    given = [({"documentId": "mine", "x": "y"},), (None,)]
    assert values(spark, metadata.overlaid(F.lit("d"), F.col("m")), given, "m map<string,string>") == [{"document_id": "d", "documentId": "mine", "x": "y"}, {"document_id": "d", "documentId": "d"}]
    assert [len(x) for x in values(spark, metadata.pairs_of(F.col("m")), given, "m map<string,string>")] == [2, 0]


def test_character_references(spark):
    rows = ["a &amp; b&lt;c&gt;", "lt; &#233;&#xE9;&#x1F600;", "&amp;lt; &unknown; &#0; &#55296; &#1114112; &", "&copy;&middot;&nbsp;x", "", None]
    want = ["a & b<c>", "lt; éé😀", "&lt; &unknown; &#0; &#55296; &#1114112; &", "©· x", "", None]
    assert values(spark, text.without_entities(F.col("x")), rows) == want


def test_outcomes_leave_columns_of_any_name_alone(spark):
    raw = 'so it is [1]. <FACT_MAP_JSON>[{"citationId":1,"documentFilename":"a.pdf","individualPageNumbers":"1,2","documentId":"d"}]</FACT_MAP_JSON>'
    rows = spark.createDataFrame([(raw, "own", "b", 7)], "raw string, block string, row string, outcome int")
    got = citations.with_outcome(rows, "raw").first()
    assert (got["raw"], got["block"], got["row"]) == (raw, "own", "b")
    assert got["outcome"]["formatted"] == "so it is ::(Source: [a.pdf], Pages 1,2|1,2|documentId=d)."


def test_lines_of_odd_pages(spark):
    """Worked out by hand from the rules of HTML, not by patterns."""
    from lexolith.sources.payloads import lines_of, page_lines

    pages = {
        '<p title="a > b">one</p><p>two': ["one", "two"],
        "<p data-x='</p>'>quoted</p>": ["quoted"],
        "<div>a<!-- <p>no</p> > -->b</div>": ["a b"],
        '<script>if (a > b) { t = "</p>"; }</script>text<style>p > a {}</style>': ["text"],
        "x<br>y<br/>z": ["x", "y", "z"],
        "<p>un<b>clo<i>sed</p>next": ["un clo sed", "next"],
        "a &lt;b&gt; &amp;amp; &#233;&#xe9; &copy; &nosuch;": ["a <b> &amp; éé © &nosuch;"],
        "1 < 2 and 3 > 2": ["1 < 2 and 3 > 2"],
        "<p>line\nbreak\tin a\r\nparagraph</p>": ["line break in a paragraph"],
        "<!DOCTYPE html><html><head><title>T</title></head><body><h1>H</h1><ul><li>i</li><li>j</li></ul></body></html>": ["T", "H", "i", "j"],
        "<svg><![CDATA[drawn]]></svg>": ["drawn"],
        "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>": ["a b", "c"],
        "": [],
        "   \n ": [],
        "<script>never closed": [],
    }
    for html, want in pages.items():
        assert lines_of(html) == want, html
    long = "<p>word</p>" * 300_000 + "x" * 2_000_000
    df = spark.createDataFrame([(i, h) for i, h in enumerate([*pages, None, long])], "i int, h string")
    got = {r.i: r.lines for r in df.select("i", page_lines(F.col("h")).alias("lines")).collect()}
    assert [got[i] for i in range(len(pages))] == list(pages.values()) and got[len(pages)] is None
    assert len(got[len(pages) + 1]) == 300_001


def test_references_without_a_semicolon_stay():
    from lexolith.sources.payloads import lines_of

    for html, want in (("a&amp b &ampfoo; c", "a&amp b &ampfoo; c"), ("&&amp&amp;&amp;lt; R&D", "&&amp&&lt; R&D"), ("&lt;&#65;&#x42;&eacute;&none; &", "<ABé&none; &"), ("\ue000&copy<i title='&lt'>x</i>&copy;", "\ue000&copy x ©")):
        assert lines_of(f"<p>{html}</p>") == [want], html
