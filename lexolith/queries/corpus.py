"""Ingestion and migration over the documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexolith.config import Chunking
from lexolith.functions.predicates import is_active
from lexolith.functions.text import joined_lines
from lexolith.operators import ingestion, migrate
from lexolith.queries import query
from lexolith.sources.payloads import page_lines
from lexolith.sources.tables import metadata, table

CHUNKING = Chunking()


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.col("source").alias("client_id"), "text")


CHUNKS_SQL = """
cuts AS (
    SELECT doc_id AS document_id, source AS client_id, text, unnest(range(0, greatest(0, ceil((length(text) - 500) / 3500.0)::int - 1) + 1)) AS chunk_index FROM documents
),
chunks AS (SELECT document_id, client_id, chunk_index, substr(text, chunk_index * 3500 + 1, 4000) AS chunk FROM cuts),
kept AS (SELECT * FROM chunks WHERE length(trim(chunk)) > 10)"""


@query(f"WITH {CHUNKS_SQL} SELECT document_id, chunk_index::int AS chunk_index, length(chunk)::int AS n_chars, md5(chunk) AS chunk_md5 FROM kept")
def chunk_fixed_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingestion.chunked(document_pages(spark, sf_dir), ingestion.strided(F.col("text"), CHUNKING), CHUNKING)
    return rows.select("document_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingestion.chunked_recursively(document_pages(spark, sf_dir), CHUNKING)


@query("SELECT doc_id AS document_id, length(text)::int AS n_chars, true AS whole, true AS fits, true AS overlaps FROM documents WHERE length(text) > 0")
def chunk_promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the recursive splitter promises, checked for every document: segments are its text from start to end without a
    gap, none is longer than the size, and none repeats more of the one before than the overlap."""
    parts = ingestion.segmented(document_pages(spark, sf_dir).select("document_id", "text"), CHUNKING)
    own = F.substring(F.col("text"), F.col("start") + 1, F.length("chunk")) == F.col("chunk")
    place = F.array_sort(F.collect_list(F.struct("chunk_index", "start", (F.col("start") + F.length("chunk")).alias("end"))))
    found = parts.groupBy("document_id", F.length("text").alias("n_chars")).agg(F.bool_and(own).alias("own"), F.max(F.length("chunk")).alias("longest"), place.alias("p"))
    steps = F.transform("p", lambda x, i: F.when(i == 0, F.struct(x["start"].alias("back"), (x["start"] == 0).alias("joined"))).otherwise(
        F.struct((F.get("p", i - 1)["end"] - x["start"]).alias("back"), ((F.get("p", i - 1)["end"] >= x["start"]) & (x["chunk_index"] == i)).alias("joined"))))
    whole = F.col("own") & F.forall(steps, lambda x: x["joined"]) & (F.element_at("p", -1)["end"] == F.col("n_chars"))
    return found.select("document_id", "n_chars", whole.alias("whole"), (F.col("longest") <= CHUNKING.size).alias("fits"), F.forall(steps, lambda x: x["back"] <= CHUNKING.overlap).alias("overlaps"))


LINE_CHUNKS_SQL = """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS page_number, unnest(string_split(text, chr(10))) AS line FROM documents),
cuts AS (SELECT *, unnest(range(0, greatest(0, ceil((length(line) - 500) / 3500.0)::int - 1) + 1)) AS chunk_index FROM l),
chunks AS (SELECT *, substr(line, chunk_index * 3500 + 1, 4000) AS chunk FROM cuts)
SELECT doc_id AS document_id, page_number::int AS page_number, chunk_index::int AS chunk_index, length(chunk)::int AS n_chars FROM chunks WHERE length(trim(chunk)) > 10
"""


@query(LINE_CHUNKS_SQL)
def chunk_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as a page: page numbers from 1, chunk numbers from 0 within the page; long lines have several chunks."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(None).cast("string").alias("client_id"), F.posexplode(F.split("text", "\n")).alias("page_number", "text"))
    pages = docs.withColumn("page_number", F.col("page_number") + 1)
    rows = ingestion.chunked(pages, ingestion.strided(F.col("text"), CHUNKING), CHUNKING)
    return rows.select("document_id", "page_number", "chunk_index", F.length("chunk").alias("n_chars"))


@query(LINE_CHUNKS_SQL)
def chunk_ordinals_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its former name."""
    return chunk_ordinals(spark, sf_dir)


@query(f"""
WITH {CHUNKS_SQL},
numbered AS (SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1) // 8 AS batch FROM kept)
SELECT document_id, batch, count(*) AS n_chunks, sum(length(chunk))::bigint AS n_chars, (sum(length(chunk)) // count(*))::bigint AS mean_chars, (sum(length(chunk)) // 4)::bigint AS tokens
FROM numbered GROUP BY document_id, batch
""")
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In batches of eight, so that long documents fill several."""
    rows = ingestion.chunked(document_pages(spark, sf_dir), ingestion.strided(F.col("text"), CHUNKING), CHUNKING)
    return ingestion.embedding_batches(rows, 8)


@query(r"""
WITH bare AS (
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'),
        '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/title|/head|/nav|/ul|/ol|/table)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages
),
plain AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM bare),
texts AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), ' ') AS text FROM plain),
cuts AS (SELECT page_id, text, unnest(range(0, greatest(0, ceil((length(text) - 500) / 3500.0)::int - 1) + 1)) AS i FROM texts),
chunks AS (SELECT page_id, i, substr(text, i * 3500 + 1, 4000) AS chunk, md5('|' || page_id || '|1|' || i) AS h FROM cuts)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id,
    page_id AS document_id, 1 AS page_number, NULL::varchar AS client_id, i::int AS chunk_index, chunk FROM chunks WHERE length(trim(chunk)) > 10
""")
def page_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages to lines to chunks."""
    pages = table(spark, sf_dir, "pages")
    texts = pages.select(F.col("page_id").alias("document_id"), F.lit(1).alias("page_number"), F.lit(None).cast("string").alias("client_id"), joined_lines(page_lines(F.col("html"))).alias("text"))
    return ingestion.chunked(texts, ingestion.strided(F.col("text"), CHUNKING), CHUNKING)


@query("""
SELECT d.doc_id, d.source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0) AND d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS newly_off,
    NOT coalesce(l.toxic = 1, false) AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AS active
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def supersede_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of low quality are superseded; those that were inactive before get no second mark."""
    own = F.array(F.struct(F.lit("documentId").alias("key"), F.col("doc_id").cast("string").alias("value")))
    rows = metadata(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat("custom_metadata", own).alias("custom_metadata"))
    gone = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("document_id"))
    after = ingestion.superseded(rows, gone)
    off = F.exists("custom_metadata", lambda m: (m["key"] == "is_active") & (m["value"] == "false"))
    hit = after.join(gone.distinct(), after["id"] == gone["document_id"], "left").withColumn("newly_off", F.col("document_id").isNotNull() & off)
    return hit.select(F.col("id").alias("doc_id"), "newly_off", is_active(F.col("custom_metadata")).alias("active"))


@query("""
WITH v AS (SELECT doc_id AS id, 1 AS arrived_at, text FROM documents UNION ALL SELECT doc_id, 2, upper(lang) FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 3, source FROM documents WHERE doc_id % 6 = 0)
SELECT id, arrived_at, text FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at DESC) = 1
""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    version = lambda rows, nr, text: rows.select(F.col("doc_id").alias("id"), F.lit(nr).alias("arrived_at"), text.alias("text"))
    later = version(docs.filter("doc_id % 3 = 0"), 2, F.upper("lang")).unionByName(version(docs.filter("doc_id % 6 = 0"), 3, F.col("source")))
    return ingestion.upserted(version(docs, 1, F.col("text")), later)


@query("""
WITH r AS (SELECT doc_id, md5(doc_id::varchar) AS id FROM documents)
SELECT substr(id, 1, 1) AS shard, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM r GROUP BY 1
""")
def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("id"))
    return migrate.sharded(rows).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("SELECT 'embeddings' AS name, count(*) AS n_source, count(*) FILTER (len(embedding) = 64) AS n_target, count(*) = count(*) FILTER (len(embedding) = 64) AS equal FROM embeddings")
def copy_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    target = migrate.copied(source.withColumn("client_id", F.lit(None).cast("string")), "client-1", 64)
    return migrate.verified_counts("embeddings", source, target)


@query("SELECT source || '-' || (doc_id % 40) AS row_key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_rowkeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), (F.col("doc_id") % 40).cast("string")).alias("row_key"))
    return migrate.duplicate_keys(keyed, "row_key")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 1000")
def capped_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record cap of a copy is exact: the limit is the feature."""
    return migrate.capped(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), 1000, "event_id")
