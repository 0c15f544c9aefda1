"""Messages, chunks as callers see them, judges' replies and uploads over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexolith.operators import chunks, evaluation, lifecycle
from lexolith.queries import query
from lexolith.sources import payloads, queue, streams
from lexolith.sources.shared import new_place, written
from lexolith.sources.tables import table
from lexolith.streaming import scoring


@query("""
SELECT event_id, CASE WHEN user_id % 7 < 2 THEN 'again' WHEN event_type = 'error' OR event_id % 5 = 0 OR event_id % 11 = 0 THEN 'dropped' ELSE 'work' END AS outcome,
    CASE WHEN user_id % 7 >= 2 AND event_type <> 'error' THEN event_type END AS query FROM events
""")
def message_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answer requests: blank and unreadable ones come again, those without a mandatory field are dropped."""
    filters = F.when(F.col("event_id") % 11 == 0, F.array()).otherwise(F.array(F.struct(F.lit("k").alias("key"), F.lit("v").alias("value"))))
    prompt = F.when(F.col("event_id") % 5 > 0, "p")
    asked = F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(" ")
    request = F.to_json(F.struct(F.col("event_id").cast("string").alias("transactionId"), asked.alias("userQuery"), prompt.alias("queryPrompt"), filters.cast(payloads.PAIRS).alias("metadataFilter")))
    body = F.when(F.col("user_id") % 7 == 0, "  ").when(F.col("user_id") % 7 == 1, F.concat(F.lit("{"), request)).otherwise(request)
    work, again, dropped = payloads.triaged(table(spark, sf_dir, "events").select("event_id", body.alias("body")))
    asked = F.when(F.trim("userQuery") != "", F.col("userQuery")).alias("query")
    named = lambda rows, name, asked: rows.select("event_id", F.lit(name).alias("outcome"), asked)
    return named(work, "work", asked).unionByName(named(dropped, "dropped", asked)).unionByName(named(again, "again", F.lit(None).cast("string").alias("query")))


@query("""
SELECT event_id, event_id % 3 = 2 AS poisoned, CASE WHEN event_id % 3 < 2 THEN ts + INTERVAL 300 SECOND END AS visible_at FROM events
""")
def failed_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as failed deliveries, each the first, second or third."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3 + 1).alias("deliveries"))
    return streams.after_failure(events, "generation").select("event_id", "poisoned", F.col("visible_at").cast("timestamp_ntz").alias("visible_at"))


@query("""
SELECT doc_id, 'd' || doc_id AS document_id, CASE WHEN doc_id % 4 > 0 THEN 'f' || doc_id || '.txt' END AS file, (doc_id % 9)::int AS page, md5(text) AS text_md5,
    CASE WHEN doc_id % 4 > 0 AND doc_id % 3 > 0 THEN 'lang=' || lang END AS metadata, CASE WHEN doc_id % 4 > 0 THEN source END AS client_id FROM documents
""")
def chunk_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as segments that meet their documents' names and metadata, as a caller sees them."""
    docs = table(spark, sf_dir, "documents")
    document_id = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    segments = docs.select(F.col("doc_id").alias("id"), document_id.alias("document_id"), (F.col("doc_id") % 9).cast("int").alias("page_number"), F.lit(0).alias("chunk_index"), F.col("text").alias("chunk"))
    metadata = F.when(F.col("doc_id") % 3 > 0, F.create_map(F.lit("lang"), F.col("lang")))
    known = docs.filter("doc_id % 4 > 0").select(document_id.alias("document_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.lit("u").alias("url"), F.col("source").alias("client_id"), metadata.alias("metadata"))
    rows = chunks.with_document(segments, known)
    view = rows.select("id", "client_id", F.explode(chunks.chunk_views(F.array(F.struct(*rows.columns)))).alias("v"))
    pairs = F.array_join(F.transform("v.metadata", lambda m: F.concat(m["key"], F.lit("="), m["value"])), ",")
    return view.select(F.col("id").alias("doc_id"), "v.document_id", "v.file", "v.page", F.md5(F.col("v.text").cast("binary")).alias("text_md5"), pairs.alias("metadata"), "client_id")


@query("SELECT vec_id AS id, 'c' AS client_id, len(embedding)::int AS dimensions FROM embeddings")
def client_search_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that a client's search reads of an index that has more."""
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.lit("x").alias("chunk"), none.alias("document_file_name"), none.alias("document_id"), F.lit(1).alias("page_number"), none.alias("document_file_url"),
        none.alias("custom_metadata"), F.col("embedding").alias("chunk_vector"), F.lit("c").alias("client_id"), F.lit("z").alias("unread"),
    )
    found = chunks.retrieved(rows, "c")
    if found.columns != chunks.retrieved_columns("c") or "unread" in found.columns:
        raise ValueError("the search reads other columns")
    return found.select("id", "client_id", F.size("chunk_vector").alias("dimensions"))


@query("""
SELECT d.doc_id, EXISTS (SELECT 1 FROM labels l JOIN documents o USING (doc_id) WHERE l.doc_id = d.doc_id AND (CASE WHEN d.doc_id % 5 = 0 THEN 'other' ELSE d.source END) IS NOT DISTINCT FROM o.source) AS known FROM documents d
""")
def duplicate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads, every fifth by another client; those with a label were processed before."""
    docs = table(spark, sf_dir, "documents")
    outcomes = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("document_id"), F.col("source").alias("client_id"))
    uploads = docs.select("doc_id", F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("source")).alias("client_id"))
    return chunks.already_processed(uploads, outcomes).select("doc_id", "known")


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'UNPARSED' ELSE event_type END AS verdict, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 3 END::int AS missing_a, 0 AS missing_b,
    CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 6 END::int AS structure_a, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE 0.5 END::double AS similarity,
    CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 2 = 0 THEN repeat('n', 99) || '…' ELSE 'short' END AS note FROM events
""")
def judged_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a judge's replies: JSON amid prose, with fields missing, and a quarter that is none."""
    missing = F.slice(F.array(F.lit("x"), F.lit("y")), F.lit(1), (F.col("event_id") % 3).cast("int"))
    note = F.when(F.col("event_id") % 2 == 0, F.repeat(F.lit("n"), 150)).otherwise("short")
    given = F.struct(F.col("event_type").alias("verdict"), missing.alias("factsMissingFromA"), (F.col("event_id") % 6).alias("structureScoreA"), F.lit(0.5).alias("similarity"), note.alias("note"))
    raw = F.when(F.col("event_id") % 4 == 0, "no reply").otherwise(F.concat(F.lit("Here it is: "), F.to_json(given), F.lit(" so far.")))
    rows = table(spark, sf_dir, "events").select("event_id", evaluation.judge_result(raw).alias("j"))
    return rows.select("event_id", *[F.col(f"j.{c}").alias(c) for c in ("verdict", "missing_a", "missing_b", "structure_a", "similarity", "note")])


@query("SELECT DISTINCT o_custkey AS row_key, 1::bigint AS version FROM orders WHERE o_custkey % 3 > 0")
def insert_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders claim their customers' rows, a third of which are taken; each winner gets its version."""
    current = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("row_key"))
    arrived = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row_key"), "o_orderkey")
    return lifecycle.insert_versions(current, arrived, ["row_key"], ["o_orderkey"])


@query("""
WITH m AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS place, (count(*) OVER () + 4) // 5 AS size FROM conversations)
SELECT place, conv_id, turn, least(place // size + 1, 3)::int AS deliveries, place // size >= 3 AND place // size < 5 AS poisoned FROM m
""")
def queue_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns through a queue in five batches, whose work fails no time, once, twice, and so on: three deliveries at most."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").orderBy("conv_id", "turn")
    place, size = new_place(spark, "queue"), -(-turns.count() // 5)
    queue.enqueue(turns.select(F.to_json(F.struct("conv_id", "turn")).alias("body")), f"{place}/queue")

    def work(rows: DataFrame, number: int) -> None:
        first = rows.select("deliveries").first()
        if first is not None and first[0] <= number:
            raise RuntimeError("the work failed")
        rows.write.mode("overwrite").parquet(f"{place}/done/batch={number}")

    queue.drained(spark, f"{place}/queue", work, f"{place}/state", batchSize=size, mostDeliveries=3)
    done = spark.read.schema(queue.SCHEMA).parquet(f"{place}/done/batch=*").withColumn("poisoned", F.lit(False))
    every = done.unionByName(queue.poisoned(spark, f"{place}/queue").withColumn("poisoned", F.lit(True)))
    turn = F.from_json("body", "conv_id long, turn long")
    return every.select("place", turn["conv_id"].alias("conv_id"), turn["turn"].cast(turns.schema["turn"].dataType).alias("turn"), "deliveries", "poisoned")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, min(l_quantity)::double AS quantity, min(l_shipdate) AS shipped FROM lineitem GROUP BY ALL),
m AS (SELECT *, l_orderkey || '-' || l_linenumber AS filename, (l_orderkey + l_linenumber) % 100 AS wait FROM p)
SELECT filename, CASE WHEN wait <= 60 AND l_orderkey % 10 <> 3 THEN quantity END AS score FROM m
WHERE shipped + INTERVAL (wait) MINUTE < (SELECT max(shipped) FROM p) - INTERVAL 2 DAY
""")
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as payloads and, up to 99 minutes later, as messages that ask for their scores; every tenth order has no payload.

    Messages of all but the last two days, by when the watermark has passed them, with and without a score.
    """
    lines = written(table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("double").alias("quantity"), F.min("l_shipdate").cast("timestamp").alias("shipped")), "lines")
    n, end = lines.agg(F.count(F.lit(1)), F.max("shipped")).first()
    slices = -(-n // scoring.ROWS_AT_ONCE)
    # the times at which a slice ends: about equal numbers of lines
    edges = lines.select(F.percentile_approx(F.unix_seconds("shipped"), [i / slices for i in range(1, slices)], 10_000)).first()[0] if slices > 1 else []
    edges, files = sorted({e for e in edges or [] if e is not None} - {lines.agg(F.min(F.unix_seconds("shipped"))).first()[0]}), scoring.FILES_AT_ONCE
    name = F.concat_ws("-", "l_orderkey", "l_linenumber")
    asked_at = F.timestamp_seconds(F.unix_seconds("shipped") + (F.col("l_orderkey") + F.col("l_linenumber")) % 100 * 60)
    place = new_place(spark, "scoring")
    asked = lines.select(name.alias("filename"), asked_at.alias("asked_at"))
    given = lines.filter("l_orderkey % 10 <> 3").select(name.alias("name"), F.col("shipped").alias("written_at"), F.to_json(F.struct("quantity")).alias("payload"))
    stream = spark.readStream
    if edges:
        scoring.arrived(asked, "asked_at", edges, f"{place}/messages", files)
        scoring.arrived(given, "written_at", edges, f"{place}/payloads", files)
        stream = stream.option("maxFilesPerTrigger", files)
    else:
        asked.write.parquet(f"{place}/messages")
        given.write.parquet(f"{place}/payloads")
    messages = stream.schema("filename string, asked_at timestamp").parquet(f"{place}/messages")
    payloads_ = stream.schema("name string, written_at timestamp, payload string").parquet(f"{place}/payloads")
    found = scoring.scored_messages(messages, payloads_, lambda p: F.get_json_object(p, "$.quantity").cast("double"))
    scoring.scored_as_they_come(found, place).awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{place}/scores/batch=*")
    return rows.filter(F.col("asked_at") < F.lit(end) - F.expr("INTERVAL 2 DAYS")).select("filename", "score")


@query("""
WITH e AS (SELECT quantile_disc(doc_id, [0.25, 0.5, 0.75]) AS edges FROM documents),
b AS (SELECT doc_id, source, lang || '|' || doc_id % 40 AS document, (doc_id > edges[1])::int + (doc_id > edges[2])::int + (doc_id > edges[3])::int AS batch FROM documents, e)
SELECT doc_id, batch::int AS batch FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.document = b.document AND o.source = b.source AND o.batch < b.batch)
""")
def stream_new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files that arrive in four batches; a file whose document had an outcome in a batch before is skipped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("client_id"), F.concat_ws("|", "lang", F.col("doc_id") % 40).alias("document_id"))
    place, n = new_place(spark, "files"), docs.count()
    edges = docs.selectExpr("percentile_disc(0.25) WITHIN GROUP (ORDER BY doc_id) AS a", "percentile_disc(0.5) WITHIN GROUP (ORDER BY doc_id) AS b", "percentile_disc(0.75) WITHIN GROUP (ORDER BY doc_id) AS c").first() if n else (0, 0, 0)
    part = sum((F.when(F.col("doc_id") > e, 1).otherwise(0) for e in edges), F.lit(0))
    for i in range(4):  # four arrivals, one after another
        docs.filter(part == i).coalesce(1).write.mode("append").parquet(f"{place}/arrived")
    files = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/arrived")

    def work(rows: DataFrame, number: int) -> DataFrame:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/done/number={number}")
        return rows.withColumn("status", F.lit("INGESTION_SUCCESS"))

    scoring.new_documents(files, scoring.Outcomes(spark, f"{place}/outcomes"), work, f"{place}/state").awaitTermination()
    return spark.read.schema("doc_id long, batch int").parquet(f"{place}/done/number=*")
