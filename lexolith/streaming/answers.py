"""The answer lifecycle over streams: what is written in which order, and the scores that follow.

A micro-batch is written step by step: the chunks that went in, then, of answers that did not fail, the payload for
scoring, then the ended rows, and last the messages that ask for scores. Each step's place holds the batch's number, so a
batch that is delivered again replaces what it had written, and a reader of a later step finds all earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexolith.functions.ids import artefact_name
from lexolith.operators.answers import with_scores

STEPS = ("chunks", "payloads", "answers", "scoring")


def persist(answers: DataFrame, place: str, number: int) -> None:
    """Writes a batch of ``answers`` (transaction_id, status, response, chunks, query) under ``place``."""
    good = answers.filter("status = 'ANSWER_GENERATED'")
    parts = {
        "chunks": answers.select("transaction_id", "chunks"),
        "payloads": good.select(artefact_name("payload", F.col("transaction_id")).alias("name"), F.to_json(F.struct("transaction_id", "query", "response", "chunks")).alias("payload")),
        "answers": answers.select("transaction_id", "status", "response"),
        "scoring": good.select(artefact_name("payload", F.col("transaction_id")).alias("filename")),
    }
    for step in STEPS:
        parts[step].write.mode("overwrite").parquet(f"{place}/{step}/batch={number}")


def persisted(answers: DataFrame, place: str) -> StreamingQuery:
    """Runs persist() on every micro-batch of a stream of answers."""
    write = lambda rows, number: persist(rows, place, number)
    return answers.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()


def scored(place: str, answers: DataFrame, score) -> DataFrame:
    """``answers`` with the scores of what persist() wrote under ``place``: each scoring message meets its payload, and
    ``score`` makes a column of the payload; scores without a transaction go nowhere."""
    spark = answers.sparkSession
    asked = spark.read.parquet(f"{place}/scoring").select(F.col("filename").alias("name")).distinct()
    payloads = spark.read.parquet(f"{place}/payloads").join(asked, "name", "left_semi").dropDuplicates(["name"])
    scores = payloads.select(F.get_json_object("payload", "$.transaction_id").alias("transaction_id"), score(F.col("payload")).alias("groundedness"), F.col("name").alias("scored_at"))
    return with_scores(answers, scores)
