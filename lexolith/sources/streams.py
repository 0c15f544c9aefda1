"""Streams of messages and of arriving files, and their sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexolith.functions.ids import parsed_blob_name
from lexolith.functions.predicates import within_size
from lexolith.sources.payloads import parsed_messages

#: Files that a micro-batch takes for each kind of message.
FILES_AT_ONCE = {"generation": 4, "ingestion": 1, "scoring": 2}
#: How often a message of each kind is delivered at most, and the seconds after which a failed one is seen again.
MOST_DELIVERIES = {"generation": 3, "ingestion": 3, "scoring": 2}
VISIBLE_AFTER = {"generation": 300, "ingestion": 300, "scoring": 30}


def message_stream(spark: SparkSession, folder: str, kind: str, lines: bool = False) -> DataFrame:
    """body of each message in a folder, as files arrive: a message a file, or a message a line as send() writes them."""
    return spark.readStream.option("maxFilesPerTrigger", FILES_AT_ONCE[kind]).option("recursiveFileLookup", "true").text(folder, wholetext=not lines).withColumnRenamed("value", "body")


def send(rows: DataFrame, folder: str, number: int) -> None:
    """Puts a message for each row into a queue's folder, in the place of a batch, so that a batch sent again replaces itself."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(f"{folder}/batch={number}")


def after_failure(failures: DataFrame, kind: str) -> DataFrame:
    """``failures`` (at, deliveries so far) with poisoned, and visible_at: when the message is delivered again, null if it is poisoned."""
    poisoned = F.col("deliveries") >= MOST_DELIVERIES[kind]
    return failures.withColumn("poisoned", poisoned).withColumn("visible_at", F.when(~poisoned, F.col("at") + F.make_interval(secs=F.lit(VISIBLE_AFTER[kind]))))


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, size and bytes of each file that arrives under a folder, client folders included."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"((?:c=[^/]+/)?[^/]+)$", 1)
    return files.select(name.alias("name"), F.col("length").alias("size"), "content")


def accepted_files(files: DataFrame, limit_mib: int = 80) -> DataFrame:
    """``files`` (name, size) with the parts of their names and the status that they start with."""
    parsed = files.withColumn("parts", parsed_blob_name(F.col("name")))
    status = F.when(F.col("parts").isNull(), "INVALID_NAME").when(within_size(F.col("size"), limit_mib), "AWAITING_INGESTION").otherwise("FILE_SIZE_OVER_LIMIT")
    return parsed.withColumn("status", status).select("*", "parts.*").drop("parts")


def handled(messages: DataFrame, schema: str, checkpoint: str, work: Callable[[DataFrame, int], None], rejected: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs ``work`` on the readable messages of each micro-batch and ``rejected`` on the others.

    A batch that fails is delivered again with the same number, by which both can tell that they saw it before.
    """

    def batch(rows: DataFrame, number: int) -> None:
        good, bad = parsed_messages(rows, schema)
        work(good, number)
        rejected(bad, number)

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
