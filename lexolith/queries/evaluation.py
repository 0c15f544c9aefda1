"""Evaluation analytics over conversations, events and orders that stand for runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexolith.functions.markdown import compliance
from lexolith.functions.citations import with_outcome
from lexolith.operators import evaluation
from lexolith.queries import query
from lexolith.queries.answers import CITED_SQL, answers
from lexolith.sources.shared import new_place
from lexolith.sources.tables import table


@query("""
SELECT item_id AS query_id, r_name AS prompt, n_name AS model, iteration::int AS iteration
FROM benchmark, region, (SELECT n_name FROM nation WHERE n_regionkey = 0), range(1, 3) t(iteration)
""")
def matrix_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    prompts = table(spark, sf_dir, "region").select(F.col("r_name").alias("prompt"))
    models = table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.col("n_name").alias("model"))
    return evaluation.run_matrix(queries, prompts, models, 2)


@query("""
WITH v AS (SELECT conv_id AS query_id, turn AS version_nr, text FROM conversations)
SELECT a.query_id, a.version_nr, a.text, b.text AS base_text FROM v a JOIN v b ON a.query_id = b.query_id AND b.version_nr = 0 WHERE a.version_nr > 0
""")
def version_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as versions of the first."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("version_nr"), "text")
    return evaluation.paired_versions(rows).select("query_id", "version_nr", "text", "base_text")


@query("""
WITH runs AS (SELECT user_id AS query_id, event_type AS variant, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2),
pairs AS (SELECT lag(event_type) OVER (ORDER BY first, event_type) AS before, event_type AS after FROM (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1))
SELECT a.query_id, p.before, p.after, a.v AS value_before, b.v AS value_after FROM pairs p JOIN runs a ON a.variant = p.before JOIN runs b ON b.variant = p.after AND b.query_id = a.query_id
""")
def chain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as variants in the order in which they first appear."""
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("variant"), "value", "event_id")
    pairs = evaluation.chained(runs, "event_id", "variant")
    found = evaluation.compared(runs, pairs, "variant", ["query_id"], "value", "event_id")
    return found.select("query_id", "before", "after", "value_before", "value_after")


@query("SELECT o_orderstatus AS verdict, count(*) AS n, round(avg(o_totalprice::double), 2) AS mean_value FROM orders GROUP BY 1")
def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "verdict")
    means = orders.groupBy("verdict").agg(F.round(F.avg(F.col("o_totalprice").cast("double")), 2).alias("mean_value"))
    return evaluation.verdicts(orders).join(means, "verdict").orderBy("verdict")


@query("""
SELECT event_type AS query_type, 'client' || user_id % 7 AS client_id, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS greatest
FROM events WHERE value IS NOT NULL GROUP BY 1, 2
""")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("query_type"), F.concat(F.lit("client"), (F.col("user_id") % 7).cast("string")).alias("client_id"), "value")
    return evaluation.distribution(rows, "value", "query_type", "client_id")


@query("SELECT event_type AS query_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest, true AS in_bound FROM events WHERE value IS NOT NULL GROUP BY 1")
def score_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in four batches, one of which runs twice: merged sketches, and whether the ranks of their quantiles over all
    scores are within twice the bound."""
    shares, place = [0.1, 0.5, 0.9, 0.99], new_place(spark, "sketches")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("query_type"), "value", "event_id")
    for number in (0, 1, 2, 3, 1):
        evaluation.publish_sketches(rows.filter(F.col("event_id") % 4 == number), "value", place, number, "query_type")
    merged = evaluation.sketched_distribution(spark, place, shares, "query_type")
    every = rows.filter("value IS NOT NULL").join(merged.select("query_type", "n", "quantiles"), "query_type")
    # the share of scores below a quantile and up to it hold the share asked for between them, but for the bound
    off = lambda i: F.greatest(F.count_if(F.col("value") < F.col("quantiles")[i]) / F.first("n") - shares[i], shares[i] - F.count_if(F.col("value") <= F.col("quantiles")[i]) / F.first("n"))
    checked = every.groupBy("query_type").agg(*[off(i).alias(f"off{i}") for i in range(len(shares))])
    in_bound = F.greatest(*[f"off{i}" for i in range(len(shares))]) <= 2 * evaluation.RANK_ERROR
    return merged.join(checked, "query_type").select("query_type", "n", "mean", "least", "greatest", in_bound.alias("in_bound"))


@query(rf"""
WITH {CITED_SQL},
parts AS (
    SELECT *, body || CASE WHEN block = '' THEN '' ELSE ' ' END AS narrative, body || block AS raw, conv_id % 5 >= 2 AS entries FROM outcomes
),
counts AS (
    SELECT *, regexp_extract_all(narrative, '\[(\d+)\]', 1) AS inline, regexp_extract_all(raw, '"citationId"\s*:\s*(\d+)', 1) AS listed,
        trim(regexp_replace(regexp_replace(narrative, '\[[^\[\]]{{0,64}}\]', '', 'g'), '\s+', ' ', 'g')) AS prose FROM parts
)
SELECT conv_id, turn, len(inline)::int AS inline_markers,
    greatest(0, len(regexp_extract_all(narrative, '(?i)\[\^?(?:(?:Source|doc|Citation|Ref)[\s:]{{1,3}})?\d[^\[\]]{{0,40}}\]')) - len(inline))::int AS drifted,
    len(listed)::int AS json_entries, len(inline) > 0 AND len(list_filter(inline, lambda i: NOT list_contains(listed, i))) = 0 AS inline_in_json,
    contains(formatted, '::(Source') AS substituted, block <> '' AS json_block, length(prose)::int AS prose_chars,
    CASE WHEN prose = '' THEN 0 ELSE len(string_split(prose, ' ')) END::int AS prose_words, CASE WHEN entries THEN 4 ELSE 0 END::int AS cited_pages,
    CASE WHEN entries AND conv_id % 2 = 0 THEN len(regexp_extract_all(narrative, '\[1\][ \t]{{0,3}}\[2\]')) ELSE 0 END::int AS stacked_runs
FROM counts
""")
def compliance_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of compliance() for every answer."""
    rows = with_outcome(answers(spark, sf_dir), "raw")
    return rows.select("conv_id", "turn", compliance(F.col("raw"), F.col("outcome.formatted")).alias("c")).select("conv_id", "turn", "c.*")


def ok_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compliance of every answer, its cell, and whether the run is OK: of every four turns one has failed, in one of
    the three ways."""
    kind = F.when(F.col("turn") % 4 == 3, F.col("conv_id") % 3)
    status = F.when(kind == 0, "ANSWER_GENERATION_FAILED").otherwise("ANSWER_GENERATED")
    response, error = F.when(kind == 1, None).otherwise("text"), F.when(kind == 2, "error")
    return compliance_runs(spark, sf_dir).withColumn("cell", F.col("conv_id") % 10).withColumn("ok", evaluation.is_ok(status, response, error))


@query(r"""
WITH a AS (
    SELECT conv_id, turn, conv_id % 5 >= 1 AS json_block, conv_id % 5 >= 2 AS entries, turn % 4 <> 3 AS ok,
        replace(text, '. ', ' [' || (turn % 3 + 1) || ', ' || (conv_id % 4 + 1) || ']. ') || ' [1][2]' AS body FROM conversations WHERE role = 'assistant'
),
p AS (SELECT *, trim(regexp_replace(regexp_replace(body || ' ', '\[[^\[\]]{0,64}\]', '', 'g'), '\s+', ' ', 'g')) AS prose FROM a)
SELECT conv_id % 10 AS cell, count(*) AS runs, count(*) FILTER (ok) AS ok, count(*) FILTER (ok AND json_block) AS json_block, count(*) FILTER (ok AND entries) AS substituted,
    count(*) FILTER (ok AND NOT entries AND len(string_split(prose, ' ')) >= 50) AS uncited,
    (coalesce(sum(length(prose)) FILTER (ok), 0) // greatest(count(*) FILTER (ok), 1))::bigint AS mean_prose_chars,
    (coalesce(sum(len(string_split(prose, ' '))) FILTER (ok), 0) // greatest(count(*) FILTER (ok), 1))::bigint AS mean_prose_words,
    (coalesce(sum(CASE WHEN entries THEN 4 ELSE 0 END) FILTER (ok), 0) // greatest(count(*) FILTER (ok), 1))::bigint AS mean_cited_pages
FROM p GROUP BY 1
""")
def compliance_cell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ok_runs(spark, sf_dir)
    names = ["cell", "runs", "ok", "json_block", "substituted", "uncited", "mean_prose_chars", "mean_prose_words", "mean_cited_pages"]
    return evaluation.cell_stats(runs, "cell").select(*names)
