"""Scoring as a second stream, and arriving files against outcomes that change while the stream runs.

Messages that ask for a score and the payloads that they name are two streams. They meet in a join under watermarks: a
payload is written before its message, at most a while, so both sides' state is bounded, and a message whose payload has
not come when the watermark has passed that while is dropped by rule: it comes out without a score.

Arriving files meet the table of outcomes as it is when their micro-batch runs: a file whose document has an outcome is
skipped, and what is worked on adds its outcome, which the next batches see.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from lexolith.operators.chunks import already_processed
from lexolith.sources.shared import new_place

#: Rows of a slice of time that a micro-batch takes, and the files that hold them.
ROWS_AT_ONCE, FILES_AT_ONCE = 4_000_000, 16
#: Seconds by which a message may follow its payload, and by which rows of either stream may be late.
FOLLOWS_WITHIN, LATE_SECONDS = 3600, 600


def scored_messages(messages: DataFrame, payloads: DataFrame, score: Callable[[Column], Column], within: int = FOLLOWS_WITHIN, late: int = LATE_SECONDS) -> DataFrame:
    """filename, asked_at, payload and score of every message of a stream (filename, asked_at), from a stream of payloads
    (name, written_at, payload); payload and score are null if no payload of that name was written in the ``within``
    seconds up to the message.

    A payload of several messages scores each; of a name's several payloads each gives a row, so writers name them apart.
    """
    asked = messages.withWatermark("asked_at", f"{late} seconds")
    written = payloads.withWatermark("written_at", f"{late} seconds")
    follows = F.expr(f"written_at <= asked_at AND written_at >= asked_at - INTERVAL {within} SECONDS")
    met = asked.join(written, (F.col("filename") == F.col("name")) & follows, "left_outer")
    return met.select("filename", "asked_at", "payload", F.when(F.col("payload").isNotNull(), score(F.col("payload"))).alias("score"))


def scored_as_they_come(scores: DataFrame, place: str) -> StreamingQuery:
    """Writes a stream of scored messages under ``place``, each micro-batch in a folder of its number."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/scores/batch={number}")

    return scores.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()


def arrived(rows: DataFrame, at: str, edges: Sequence[int], path: str, files: int) -> None:
    """Writes ``rows`` to ``path`` as files that arrive in the order of the time ``at``: those before the first of ``edges``
    (seconds, ascending), then those before the next, and so on, each time in exactly ``files`` files.

    A stream that takes so many files at once sees a slice of time in each micro-batch: no row is late, and the state of a
    join holds no more than two slices. Slices with fewer rows than files raise a ValueError.
    """
    spark, waiting = rows.sparkSession, new_place(rows.sparkSession, "waiting")
    number = sum((F.when(F.unix_seconds(at) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    rows.withColumn("slice", number).write.partitionBy("slice").parquet(waiting)
    staged = spark.read.schema(StructType([*rows.schema.fields, StructField("slice", IntegerType())])).parquet(waiting)
    for i in range(len(edges) + 1):
        staged.filter(F.col("slice") == i).drop("slice").repartition(files).write.mode("append").parquet(path)
        if (found := len(spark.read.schema(rows.schema).parquet(path).inputFiles())) != files * (i + 1):
            raise ValueError(f"{found} files in {i + 1} slices of {files}")


class Outcomes:
    """The table of outcomes (document_id, client_id, status) in a folder, to which each batch adds a folder of its number."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.schema = "document_id string, client_id string, status string, batch int"
        spark.createDataFrame([], self.schema).drop("batch").coalesce(1).write.mode("append").parquet(f"{path}/batch=-1")

    def before(self, number: int) -> DataFrame:
        """The outcomes of what came before a batch: a batch that runs again does not see its own."""
        return self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("batch") < number)

    def add(self, rows: DataFrame, number: int) -> None:
        rows.select("document_id", "client_id", "status").write.mode("overwrite").parquet(f"{self.path}/batch={number}")


def new_documents(files: DataFrame, outcomes: Outcomes, work: Callable[[DataFrame, int], DataFrame], checkpoint: str) -> StreamingQuery:
    """Runs ``work`` (the batch's new files, its number) on a stream of files (document_id, client_id, ...) and adds the
    outcomes (document_id, client_id, status) that it gives. Files of known documents are skipped; of one document's files in
    a batch all are new."""

    def batch(rows: DataFrame, number: int) -> None:
        fresh = already_processed(rows, outcomes.before(number)).filter("NOT known").drop("known")
        outcomes.add(work(fresh, number), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
