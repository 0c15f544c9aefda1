"""Contexts, citations and the guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexolith.functions import citations
from lexolith.operators.answers import contexts, guarded, status_view, with_scores
from lexolith.queries import query
from lexolith.queries.retrieval import CHUNKS_SQL, NEAREST_SQL, vector_pool
from lexolith.sources.tables import table

#: Assistant turns with markers and a fact map added by a fixed rule, in both engines.
ANSWERS_SQL = """
answers AS (
    SELECT conv_id, turn, replace(text, '. ', ' [' || (turn % 3 + 1) || ', ' || (conv_id % 4 + 1) || ']. ') || ' [1][2]' AS body,
        CASE WHEN conv_id % 5 = 0 THEN '' WHEN conv_id % 5 = 1 THEN ' <FACT_MAP_JSON>[]</FACT_MAP_JSON>' ELSE
            ' <FACT_MAP_JSON>[{"citationId":1,"documentFilename":"a.pdf","individualPageNumbers":"1,2,3","documentId":"d1"},{"citationId":"2","documentFilename":"b.pdf","individualPageNumbers":"' || turn || '","documentId":"d' || (conv_id % 2 + 1) || '"}]</FACT_MAP_JSON>' END AS block
    FROM conversations WHERE role = 'assistant'
)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    marker = F.concat(F.lit(" ["), (F.col("turn") % 3 + 1).cast("string"), F.lit(", "), (F.col("conv_id") % 4 + 1).cast("string"), F.lit("]. "))
    body = F.concat(F.replace(F.col("text"), F.lit(". "), marker), F.lit(" [1][2]"))
    entries = F.concat(
        F.lit(' <FACT_MAP_JSON>[{"citationId":1,"documentFilename":"a.pdf","individualPageNumbers":"1,2,3","documentId":"d1"},{"citationId":"2","documentFilename":"b.pdf","individualPageNumbers":"'),
        F.col("turn").cast("string"), F.lit('","documentId":"d'), (F.col("conv_id") % 2 + 1).cast("string"), F.lit('"}]</FACT_MAP_JSON>'),
    )
    block = F.when(F.col("conv_id") % 5 == 0, "").when(F.col("conv_id") % 5 == 1, " <FACT_MAP_JSON>[]</FACT_MAP_JSON>").otherwise(entries)
    return turns.select("conv_id", "turn", body.alias("body"), block.alias("block"), F.concat(body, block).alias("raw"))


@query(r"""
WITH l AS (SELECT doc_id AS query_id, generate_subscripts(string_split(text, chr(10)), 1) AS rank, unnest(string_split(text, chr(10))) AS chunk FROM documents),
c AS (SELECT *, rank % 3 AS document_id, 'f' || query_id || '.txt' AS file_name, CASE WHEN rank % 4 > 0 THEN rank % 4 END AS page_number FROM l),
docs AS (
    SELECT query_id, document_id, min(rank) AS rank, '<document><id>' || document_id || '</id><name>' || arg_min(file_name, rank) || '</name>' ||
        string_agg('<passage><page>' || coalesce(page_number::varchar, '') || '</page><text>' || chunk || '</text></passage>', '' ORDER BY rank) || '</document>' AS d
    FROM c GROUP BY query_id, document_id
)
SELECT query_id, md5('<documents>' || string_agg(d, '' ORDER BY rank) || '</documents>') AS context_md5 FROM docs GROUP BY query_id
""")
def doc_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a question whose passages are all its lines, dealt over three documents; a group is one text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.posexplode(F.split("text", "\n")).alias("at", "chunk"))
    rank = F.col("at") + 1
    rows = docs.select(
        "query_id", (rank % 3).alias("document_id"), rank.alias("rank"), "chunk", F.concat(F.lit("f"), F.col("query_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.when(rank % 4 > 0, rank % 4).alias("page_number"), F.array(F.struct(F.lit("lang").alias("key"), F.lit("en").alias("value"))).alias("custom_metadata"),
    )
    return contexts(rows).select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query(f"""
WITH {CHUNKS_SQL}, {NEAREST_SQL},
c AS (
    SELECT n.query_id, n.doc_id % 5 AS document_id, n.rank, c.chunk, 'f' || n.doc_id || '.txt' AS file_name, CASE WHEN n.doc_id % 4 > 0 THEN n.doc_id % 4 END AS page_number
    FROM near n JOIN chunks c USING (doc_id)
),
docs AS (
    SELECT query_id, document_id, min(rank) AS rank, '<document><id>' || document_id || '</id><name>' || arg_min(file_name, rank) || '</name>' ||
        string_agg('<passage><page>' || coalesce(page_number::varchar, '') || '</page><text>' || chunk || '</text></passage>', '' ORDER BY rank) || '</document>' AS d
    FROM c GROUP BY query_id, document_id
)
SELECT query_id, md5('<documents>' || string_agg(d, '' ORDER BY rank) || '</documents>') AS context_md5 FROM docs GROUP BY query_id
""")
def pool_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts of each vector query's ranked pool, NEAREST chunks at most, dealt over five documents."""
    pool = vector_pool(spark, sf_dir)
    rows = pool.select(
        "query_id", (F.col("doc_id") % 5).alias("document_id"), "rank", "chunk",
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 4).alias("page_number"),
        F.array().cast("array<struct<key:string,value:string>>").alias("custom_metadata"),
    )
    return contexts(rows).select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query(rf"""
WITH {ANSWERS_SQL}
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(body, '\[(\d+)\s*[,;]\s*(\d+)\]', '[\1][\2]', 'g'), '\[\d+\]', '', 'g')) AS stripped,
    len(regexp_extract_all(regexp_replace(body, '\[(\d+)\s*[,;]\s*(\d+)\]', '[\1][\2]', 'g'), '\[\d+\]'))::bigint AS n_markers
FROM answers
""")
def citation_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir)
    body = F.col("body")
    return rows.select("conv_id", "turn", F.trim(citations.without_markers(body)).alias("stripped"), citations.bare_markers(citations.split_joined_ids(body)).cast("bigint").alias("n_markers"))


@query(rf"""
WITH {ANSWERS_SQL},
n AS (SELECT *, trim(regexp_replace(body, '\[(\d+)\s*[,;]\s*(\d+)\]', '[\1][\2]', 'g')) AS text FROM answers),
m AS (SELECT *, len(regexp_extract_all(text, '\[\d+\]'))::int AS inline FROM n)
SELECT conv_id, turn, block <> '' AS json_block, conv_id % 5 = 1 AS empty_fact_map, inline AS inline_markers,
    CASE WHEN conv_id % 5 < 2 THEN inline ELSE len(regexp_extract_all(text, '\[[34]\]'))::int END AS stripped FROM m
""")
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = citations.with_outcome(answers(spark, sf_dir), "raw")
    return rows.select("conv_id", "turn", *[F.col(f"outcome.{c}").alias(c) for c in ("json_block", "empty_fact_map", "inline_markers", "stripped")])


#: Two markers side by side: of one document they are one citation, with the pages of both.
CITED_SQL = rf"""
{ANSWERS_SQL},
split AS (
    SELECT *, trim(regexp_replace(body, '\[(\d+)\s*[,;]\s*(\d+)\]', '[\1][\2]', 'g')) AS text, conv_id % 2 = 0 AS same, turn::varchar AS t,
        CASE WHEN turn BETWEEN 1 AND 3 THEN '1,2,3' WHEN turn < 1 THEN turn || ',1,2,3' ELSE '1,2,3,' || turn END AS pages_of_both,
        CASE WHEN turn BETWEEN 1 AND 3 THEN '1-3' WHEN turn = 0 THEN '0-3' WHEN turn = 4 THEN '1-4' WHEN turn < 0 THEN turn || ',1-3' ELSE '1-3,' || turn END AS ranges_of_both
    FROM answers
),
forms AS (
    SELECT *, '::(Source: [a.pdf], Pages 1-3|1,2,3|documentId=d1)' AS one, '::(Source: [b.pdf], Pages ' || t || '|' || t || '|documentId=d' || (conv_id % 2 + 1) || ')' AS two,
        '], Pages ' || ranges_of_both || '|' || pages_of_both || '|documentId=d1)' AS rest FROM split
),
cited AS (
    SELECT *, CASE WHEN conv_id % 5 < 2 THEN text ELSE replace(replace(replace(replace(
        CASE WHEN same THEN replace(replace(text, '[1][2]', '::(Source: [a.pdf' || rest), '[2][1]', '::(Source: [b.pdf' || rest) ELSE text END,
        '[1][1]', one), '[2][2]', two), '[1]', one), '[2]', two) END AS shown FROM forms
),
outcomes AS (
    SELECT conv_id, turn, body, block, trim(regexp_replace(shown, '\[\d+\]', '', 'g')) AS formatted, block <> '' AS json_block, conv_id % 5 = 1 AS empty_fact_map,
        len(regexp_extract_all(text, '\[\d+\]'))::int AS inline_markers, CASE WHEN block <> '' THEN len(string_split(shown, '::(Source: [')) - 1 ELSE 0 END::int AS rendered,
        len(regexp_extract_all(shown, '\[\d+\]'))::int AS stripped
    FROM cited
)"""


@query(f"WITH {CITED_SQL} SELECT conv_id, turn, formatted, json_block, empty_fact_map, inline_markers, rendered, stripped FROM outcomes")
def citation_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.with_outcome(answers(spark, sf_dir), "raw").select("conv_id", "turn", "outcome.*")


@query("""
WITH o AS (
    SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'OFF' WHEN 1 THEN 'DELIVER' ELSE 'REJECT' END AS mode, (event_id % 3 + 1)::int AS attempt,
        event_type = 'click' AS json_block, event_id % 2 = 0 AS empty_fact_map, (event_id % 5)::int AS inline, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS rendered FROM events
),
f AS (SELECT *, mode = 'OFF' OR rendered >= 1 OR (json_block AND empty_fact_map AND inline = 0) AS fine FROM o)
SELECT event_id, mode, CASE WHEN fine THEN 'DELIVER' WHEN attempt < 3 THEN 'RETRY' WHEN mode = 'DELIVER' THEN 'DELIVER_DEGRADED' ELSE 'FAIL' END AS verdict,
    CASE WHEN NOT fine THEN 'Citations missing: block=' || json_block || ', inline=' || inline || ', rendered=' || rendered END AS reason FROM f
""")
def guard_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.struct(
        (F.col("event_type") == "click").alias("json_block"), (F.col("event_id") % 2 == 0).alias("empty_fact_map"), (F.col("event_id") % 5).cast("int").alias("inline_markers"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("rendered"),
    )
    mode = F.when(F.col("user_id") % 3 == 0, "OFF").when(F.col("user_id") % 3 == 1, "DELIVER").otherwise("REJECT")
    rows = table(spark, sf_dir, "events").select("event_id", mode.alias("mode"), (F.col("event_id") % 3 + 1).cast("int").alias("attempt"), outcome.alias("outcome"))
    return guarded(rows).select("event_id", "mode", "verdict", "reason")


STATUS_SQL = """
WITH a AS (
    SELECT o_orderkey AS transaction_id, o_orderstatus AS status, (o_orderkey % 4 - 1)::bigint AS duration_ms FROM orders
    UNION ALL SELECT -o_orderkey, o_orderstatus, (o_orderkey % 4 - 1)::bigint FROM orders WHERE o_orderkey > 0 AND o_orderkey % 100 = 0
),
s AS (SELECT l_orderkey AS transaction_id, arg_max(l_quantity::double, (l_linenumber, l_partkey, l_quantity)) AS groundedness FROM lineitem GROUP BY 1)
SELECT transaction_id, status, CASE WHEN duration_ms > 0 THEN duration_ms ELSE 0 END::bigint AS duration_ms, groundedness FROM a LEFT JOIN s USING (transaction_id)
"""


@query(STATUS_SQL)
def answer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers, all lines as their scores; copies of some orders under negative keys have no line, so no score."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("transaction_id"))
    unscored = orders.filter("o_orderkey > 0 AND o_orderkey % 100 = 0").withColumn("transaction_id", -F.col("o_orderkey"))
    empty = F.lit(None).cast("string")
    generated = orders.unionByName(unscored).select("transaction_id", F.col("o_orderstatus").alias("status"), empty.alias("reason"), empty.alias("response"), (F.col("o_orderkey") % 4 - 1).cast("bigint").alias("duration_ms"), F.lit(None).cast("double").alias("groundedness"))
    lines = table(spark, sf_dir, "lineitem")
    scores = lines.select(F.col("l_orderkey").alias("transaction_id"), F.col("l_quantity").cast("double").alias("groundedness"), F.struct("l_linenumber", "l_partkey", "l_quantity").alias("scored_at"))
    scored = with_scores(generated, scores)
    return status_view(scored).join(scored.select("transaction_id", "groundedness"), "transaction_id").select("transaction_id", "status", F.coalesce("duration_ms", F.lit(0).cast("bigint")).alias("duration_ms"), "groundedness")


@query(STATUS_SQL)
def answer_status_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its former name."""
    return answer_status(spark, sf_dir)
