"""Requests, tenants, metrics and loads over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexolith.functions import requests
from lexolith.operators import evaluation, lifecycle, migrate
from lexolith.queries import ORACLE_SQL, query
from lexolith.queries.evaluation import ok_runs
from lexolith.sources.tables import table


def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's caller: a UUID made of the customer's key, in odd forms for some."""
    key = F.md5(F.col("o_custkey").cast("string").cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    header = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit(" "), F.upper(uuid))).when(F.col("o_orderkey") % 5 == 2, key).otherwise(uuid)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", header.alias("header"), uuid.alias("uuid"))


TENANT_SQL = """
u AS (SELECT o_orderkey, o_custkey, md5(o_custkey::varchar) AS k, substr(k, 1, 8) || '-' || substr(k, 9, 4) || '-' || substr(k, 13, 4) || '-' || substr(k, 17, 4) || '-' || substr(k, 21, 12) AS uuid FROM orders),
t AS (SELECT *, CASE WHEN o_orderkey % 5 IN (1, 3, 4) THEN uuid END AS client_id, CASE WHEN o_orderkey % 5 IN (1, 3, 4) THEN 'OWN' ELSE 'UNAUTHORISED' END AS access FROM u)"""


@query(f"WITH {TENANT_SQL} SELECT o_orderkey, client_id, access FROM t")
def tenant_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callers(spark, sf_dir).select("o_orderkey", requests.tenant(F.col("header"), True).alias("t")).select("o_orderkey", "t.*")


@query(f"""
WITH {TENANT_SQL}
SELECT t.o_orderkey, t.access = 'OWN' AND t.o_custkey % 2 = 1 AS found FROM t
""")
def tenant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each caller asks for its own customer; the rows of every second customer belong to another client."""
    own = callers(spark, sf_dir)
    rows = own.select("o_custkey", F.when(F.col("o_custkey") % 2 == 1, F.col("uuid")).otherwise("other").alias("client_id"))
    asked = own.select("o_orderkey", "o_custkey", requests.tenant(F.col("header"), True).alias("t")).select("o_orderkey", "o_custkey", "t.*")
    return requests.found_for(asked, rows, "o_custkey").select("o_orderkey", "found")


@query("""
SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'error' THEN 'query: must not be blank' END, CASE WHEN value IS NULL OR value < 10 THEN 'score: must be 10 or more' END, CASE WHEN user_id % 2 = 0 THEN 'user: must be odd' END], lambda x: x IS NOT NULL), '; ') AS messages FROM events
""")
def validation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("  ")
    rules = requests.required(query=text) | {"user": (F.col("user_id") % 2 == 1, "must be odd"), "score": (F.col("value") >= 10, "must be 10 or more")}
    return table(spark, sf_dir, "events").select("event_id", F.array_join(requests.violations(rules), "; ").alias("messages"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup of one key is the feature."""
    return lifecycle.point_get(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), {"o_orderkey": 7})


@query("""
WITH p AS (SELECT user_id % 11 AS variant, CASE WHEN event_type <> 'signup' THEN value END AS similarity, CASE event_type WHEN 'error' THEN 'UNPARSED' WHEN 'view' THEN NULL ELSE 'SAME' END AS verdict, event_id % 5 AS structure_a, event_id % 7 AS structure_b FROM events)
SELECT variant, count(similarity) AS n_similar, CASE WHEN count(similarity) = 0 THEN 'n/a' ELSE printf('%.3f', avg(similarity)) END AS mean_similarity, count(*) FILTER (verdict = 'SAME') AS n_judged,
    round(coalesce(avg(structure_a::double) FILTER (verdict = 'SAME'), 0), 6) AS mean_structure_a, round(coalesce(avg(structure_b::double) FILTER (verdict = 'SAME'), 0), 6) AS mean_structure_b FROM p GROUP BY variant
""")
def judged_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    verdict = F.when(kind == "error", "UNPARSED").when(kind != "view", "SAME")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 11).alias("variant"), F.when(kind != "signup", F.col("value")).alias("similarity"), verdict.alias("verdict"), (F.col("event_id") % 5).alias("structure_a"), (F.col("event_id") % 7).alias("structure_b"))
    return evaluation.judged_summary(rows, "variant")


@query("""
SELECT to_json(map_from_entries(list_filter([{'k': 'kind', 'v': event_type}, {'k': 'group', 'v': CASE WHEN user_id % 3 > 0 THEN (user_id % 3)::varchar END}], lambda x: x.v IS NOT NULL)))::varchar AS attributes,
    floor(value / 5) * 5 AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2
""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 3).alias("group"), "value")
    return evaluation.histogram(rows, "value", 5.0, "kind", "group").withColumn("bin", F.col("bin").cast("double"))


@query(f"""
WITH r AS (SELECT *, turn % 4 <> 3 AS ok FROM ({ORACLE_SQL["compliance_runs"]}))
SELECT conv_id % 10 AS cell, coalesce(sum(prose_words) FILTER (ok), 0)::bigint AS total_prose_words, coalesce(sum(cited_pages) FILTER (ok), 0)::bigint AS total_cited_pages,
    coalesce(sum(stacked_runs) FILTER (ok), 0)::bigint AS total_stacked_runs, count(*) FILTER (ok AND inline_in_json) || '/' || count(*) AS matched FROM r GROUP BY 1
""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.report_totals(ok_runs(spark, sf_dir), "cell")


@query("""
SELECT l_orderkey, l_linenumber, coalesce(nullif(trim(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE ' ' END), ''), 'q' || l_orderkey) || CASE WHEN l_linenumber > 1 THEN ' v' || (l_linenumber - 1) ELSE '' END AS label,
    CASE WHEN l_linenumber % 3 = 0 THEN '{}' ELSE '{"line":' || l_linenumber || '}' END AS body FROM lineitem
""")
def query_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with version suffixes, and JSON that is {} where there is nothing."""
    lines = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_linenumber") % 2 == 0, F.trim("l_returnflag")).otherwise(" ")
    body = F.when(F.col("l_linenumber") % 3 != 0, F.struct(F.col("l_linenumber").alias("line")))
    version = F.col("l_linenumber") - 1
    return lines.select("l_orderkey", "l_linenumber", requests.query_label(label, F.concat(F.lit("q"), F.col("l_orderkey").cast("string")), version).alias("label"), requests.json_or_empty(body).alias("body"))


@query("""
SELECT d.doc_id, d.lang, c.least_source FROM documents d LEFT JOIN (SELECT lang, min(source) AS least_source FROM documents WHERE lang <> 'en' GROUP BY lang) c ON c.lang = d.lang
""")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as results whose language names their configuration; English has none."""
    docs = table(spark, sf_dir, "documents")
    configs = docs.filter("lang <> 'en'").select("lang", F.col("source").alias("least_source"))
    return evaluation.labelled(docs.select("doc_id", "lang"), configs, "lang")


@query("SELECT n_nationkey, n_name FROM nation")
def stored_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without what a store added to them."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit("x").alias("etag"), F.lit("y").alias("n_name@type"), F.current_timestamp().alias("Timestamp"))
    return migrate.data_columns(rows)
