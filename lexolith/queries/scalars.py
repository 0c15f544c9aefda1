"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexolith.functions import ids, metadata, pages, text
from lexolith.functions.markdown import prose, structure, word_count
from lexolith.functions.predicates import is_reasoning_model, reserved_keys_in, within_size
from lexolith.queries import query
from lexolith.sources.tables import table


@query("""
SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))::bigint AS n_tokens,
    md5(array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), ' ')) AS tokens_md5
FROM documents
""")
def token_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.tokens(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.md5(F.array_join("w", " ").cast("binary")).alias("tokens_md5"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '([\\+\-&|(){}\[\]^"~*?:/;<>=@#%`])', '\\\1', 'g')) AS escaped_md5 FROM documents""")
def search_syntax_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.escape_search_syntax(F.col("text")).cast("binary")).alias("escaped_md5"))


@query("SELECT conv_id, turn, md5(replace(text, '''', '''''')) AS quoted_md5 FROM conversations")
def filter_literal_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.double_quotes(F.col("text")).cast("binary")).alias("quoted_md5"))


@query("""
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' ||
    substr('89ab', ('0x' || substr(h, 17, 1))::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS row_key,
    coalesce(nullif(trim(source), ''), doc_id::varchar) AS partition_key
FROM (SELECT doc_id, source, md5(trim(source || ':' || doc_id)) AS h FROM documents)
""")
def row_key_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", ids.name_uuid(name).alias("row_key"), ids.partition_key(F.col("source"), F.col("doc_id").cast("string")).alias("partition_key"))


@query(r"""
WITH names AS (
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'c=client' || o_custkey || '/' ELSE '' END || 'doc' || o_orderkey ||
        CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE '_' END || strftime(o_orderdate, '%Y%m%d') || '.pdf' AS name, o_orderdate FROM orders
)
SELECT o_orderkey, name, nullif(regexp_extract(name, '^(?:c=([^/]+)/)?([^/_]+)_(\d{8})\.([^./]+)$', 2), '') AS document_id,
    nullif(regexp_extract(name, '^(?:c=([^/]+)/)?([^/_]+)_(\d{8})\.([^./]+)$', 1), '') AS client_id,
    CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day
FROM names
""")
def blob_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built from orders: every seventh name is malformed."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    client = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("client"), F.col("o_custkey").cast("string")))
    built = ids.blob_name(F.concat(F.lit("doc"), F.col("o_orderkey").cast("string")), F.col("o_orderdate"), F.lit("pdf"), client)
    named = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.replace(built, F.lit("_"), F.lit("-"))).otherwise(built).alias("name"))
    parsed = ids.parsed_blob_name(F.col("name"))
    return named.select("o_orderkey", "name", parsed["document_id"].alias("document_id"), parsed["client_id"].alias("client_id"), parsed["day"].cast("string").alias("day"))


PAGE_LISTS = "SELECT o_orderkey, string_agg(l_linenumber::varchar, ',' ORDER BY l_linenumber, l_partkey) AS page_list FROM (SELECT l_orderkey AS o_orderkey, l_linenumber + l_suppkey % 2 AS l_linenumber, l_partkey FROM lineitem) GROUP BY o_orderkey"


def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of pages for each order, from its line numbers, with repetitions and gaps."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") + F.col("l_suppkey") % 2).alias("page"), "l_partkey")
    listed = lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("page", "l_partkey"))).alias("p"))
    return listed.select("o_orderkey", F.array_join(F.transform("p", lambda x: x["page"].cast("string")), ",").alias("page_list"))


@query(f"""
WITH lists AS ({PAGE_LISTS}),
items AS (SELECT o_orderkey, page_list, generate_subscripts(string_split(page_list, ','), 1) AS i, unnest(string_split(page_list, ','))::bigint AS page FROM lists),
starts AS (SELECT *, CASE WHEN page = lag(page) OVER w + 1 THEN 0 ELSE 1 END AS s FROM items WINDOW w AS (PARTITION BY o_orderkey ORDER BY i)),
islands AS (SELECT *, sum(s) OVER (PARTITION BY o_orderkey ORDER BY i) AS island FROM starts),
ranges AS (SELECT o_orderkey, page_list, island, min(page) AS a, max(page) AS b FROM islands GROUP BY ALL)
SELECT o_orderkey, page_list, string_agg(CASE WHEN a = b THEN a::varchar WHEN b = a + 1 THEN a || ',' || b ELSE a || '-' || b END, ',' ORDER BY island) AS ranges
FROM ranges GROUP BY o_orderkey, page_list
""")
def page_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_lists(spark, sf_dir).select("o_orderkey", "page_list", pages.compressed(F.col("page_list")).alias("ranges"))


@query(f"""
WITH lists AS ({PAGE_LISTS}), by_customer AS (SELECT o_custkey, l.page_list FROM lists l JOIN orders o USING (o_orderkey))
SELECT o_custkey, array_to_string(list_sort(list_distinct(list_transform(string_split(string_agg(page_list, ','), ','), lambda x: x::bigint))), ',') AS pages FROM by_customer GROUP BY o_custkey
""")
def page_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = page_lists(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return owned.groupBy("o_custkey").agg(F.collect_list("page_list").alias("lists")).select("o_custkey", pages.united(F.col("lists")).alias("pages"))


@query(r"""
WITH p AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\[[^\[\]]{0,64}\]', '', 'g'), '\s+', ' ', 'g')) AS prose FROM conversations)
SELECT conv_id, turn, length(prose)::bigint AS prose_chars, CASE WHEN prose = '' THEN 0 ELSE len(string_split(prose, ' ')) END::bigint AS prose_words FROM p
""")
def prose_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", prose(F.col("text")).alias("prose"))
    return rows.select("conv_id", "turn", F.length("prose").cast("bigint").alias("prose_chars"), word_count(F.col("prose")).cast("bigint").alias("prose_words"))


@query(r"""
WITH l AS (SELECT doc_id, list_transform(string_split(CASE WHEN doc_id % 2 = 0 THEN '# ' || replace(text, '. ', chr(10) || '- ') ELSE replace(text, ', ', chr(10) || '## ') END, chr(10)), lambda x: trim(x)) AS lines FROM documents)
SELECT doc_id, len(list_filter(lines, lambda x: starts_with(x, '# ')))::bigint AS h1, len(list_filter(lines, lambda x: starts_with(x, '##')))::bigint AS headings,
    len(list_filter(lines, lambda x: starts_with(x, '- ') OR starts_with(x, '* ')))::bigint AS bullets FROM l
""")
def markdown_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# "), F.replace("text", F.lit(". "), F.lit("\n- ")))).otherwise(F.replace("text", F.lit(", "), F.lit("\n## ")))
    rows = table(spark, sf_dir, "documents").select("doc_id", structure(marked).alias("s"))
    return rows.select("doc_id", *[F.col(f"s.{c}").cast("bigint").alias(c) for c in ("h1", "headings", "bullets")])


@query("""
SELECT doc_id, length(text) // 4 AS tokens, CASE WHEN length(text) > 200 THEN left(text, 199) || '…' ELSE text END AS short, n_chars * 100000 < 80 * 1024 * 1024 AS within_limit FROM documents
""")
def size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token estimate, shortened text, and whether a file of 100,000 bytes a character is within the limit."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"), text.truncated(F.col("text"), 200).alias("short"), within_size(F.col("n_chars") * 100_000).alias("within_limit"))


@query("SELECT doc_id, text FROM documents WHERE length(trim(text)) > 10")
def min_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.length(F.trim("text")) > 10).select("doc_id", "text")


@query("""
SELECT event_id, nullif(json_extract_string(props, '$.k'), '') IS NOT NULL AS has_k, 'gpt-' || user_id AS model, regexp_matches('gpt-' || user_id, '^(gpt-?5|o1|o3|o4)') AS reasons,
    CASE WHEN user_id % 3 = 0 THEN 'IS_ACTIVE' ELSE '' END AS reserved FROM events
""")
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reserved metadata keys in any case, and which models reason."""
    pair = F.struct(F.when(F.col("user_id") % 3 == 0, "IS_ACTIVE").otherwise("topic").alias("key"), F.lit("x").alias("value"))
    model = F.concat(F.lit("gpt-"), F.col("user_id").cast("string"))
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.coalesce(F.nullif(F.get_json_object("props", "$.k"), F.lit("")).isNotNull(), F.lit(False)).alias("has_k"), model.alias("model"), is_reasoning_model(model).alias("reasons"), F.array_join(reserved_keys_in(F.array(pair)), ",").alias("reserved"))


@query("""
WITH p AS (SELECT user_id, event_type AS key, event_id::varchar AS value, event_id FROM events)
SELECT user_id, key, arg_max(value, event_id) AS last_value, arg_min(value, event_id) AS first_value FROM p GROUP BY 1, 2
""")
def metadata_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as metadata pairs, most keys of which repeat, as maps by both rules."""
    pair = F.struct("event_id", F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"))
    listed = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(pair)).alias("p"))
    pairs = F.transform("p", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    maps = listed.select("user_id", metadata.last_wins(pairs).alias("last"), metadata.first_wins(pairs).alias("first"))
    return maps.select("user_id", "first", F.explode("last").alias("key", "last_value")).select("user_id", "key", "last_value", F.col("first")[F.col("key")].alias("first_value"))
