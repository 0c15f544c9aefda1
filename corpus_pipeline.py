"""A corpus on its way to training: quality, near copies, secrets, mixture, packing.

Each stage works on all that its predecessor kept and applies one operator of lexolith.llm with the parameters of
production. STAGES lists them in order; run() applies them to the table of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexolith.llm import jaccard, mixing, packing, quality, queries, secrets
from lexolith.llm.common import checkpointed, free_name, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; the trusted rows are those of the table of labels.

    Null and empty texts go; texts of any length are scored whole. Repeated rows get the same verdict; an empty table stays
    empty; without labels all texts stay. Columns may have any names.
    """
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the one with the least id.

    A row without an id counts after all others; of rows of a group that share the least id, one stays. Rows that share
    an id but no group are different documents. Null and empty texts, which are in no group, all stay. What goes is told
    by hashes of rows, so texts are shuffled only if the hashes that go are too many to be sent to the workers, or if
    rows repeat. Texts of any length are compared whole. An empty table stays empty; columns may have any names.
    """
    rows = checkpointed(jaccard.linked_rows(docs, shingle=5, percent=80)).filter("root IS NOT NULL")
    tasks = max(2, -(-rows.count() // jaccard.ROWS_PER_TASK))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("first"))
    others = checkpointed(rows.join(first, "root").filter("row_key <> first").select("row_key").distinct().coalesce(tasks))
    key = free_name("row_key", docs)
    others = others.withColumnRenamed("row_key", "gone")
    keyed = docs.withColumn(key, jaccard.row_key("doc_id", "text"))
    kept = keyed.join(F.broadcast(others) if others.count() <= jaccard.LOOKUP_NODES else others, F.col(key) == others["gone"], "left_anti")
    again = checkpointed(rows.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("row_key").alias("again")).coalesce(tasks))
    if n := again.count():
        again = F.broadcast(again) if n <= jaccard.LOOKUP_NODES else again
        repeated = F.col(key) == F.col("again")
        kept = kept.join(again, repeated, "left_anti").unionByName(kept.join(again, repeated, "left_semi").dropDuplicates([key]))
    return kept.drop(key)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that a scan finds masked in their texts; the ledger of the corpus is kept.

    Null and empty texts, repeated rows and empty tables pass as they are; texts of any length are scanned whole; columns may
    have any names.
    """
    masked = secrets.redact_secrets(docs, queries.ledger_of(spark, sf_dir))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh as the square roots of their sizes, in a global shuffle.

    A null source is a source of its own; rows without an id share one count; null, empty and very
    long texts are rows like others. An empty table stays empty; columns may have any names.
    """
    return mixing.mix_sources(docs, temperature=0.5, seed="mix")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens; a null or empty text is the end token alone, repeated rows are packed
    again, very long texts take as many pieces as they need. An empty table gives no rows; other columns are not read."""
    return packing.pack(docs, capacity=2048, end_id=1)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Training a model, following links and encoding tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
