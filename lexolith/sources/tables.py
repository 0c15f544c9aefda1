"""The star-schema tables of a data folder, and the engine's own entities as views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, client_id and custom_metadata of every document; toxic documents are marked inactive."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("toxic"))
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    pairs = F.array(pair("lang", F.col("lang")), pair("source", F.col("source")))
    inactive = F.concat(pairs, F.array(pair("is_active", F.lit("false"))))
    marked = docs.join(toxic, "doc_id", "left")
    return marked.select("doc_id", F.col("source").alias("client_id"), F.when(F.col("toxic"), inactive).otherwise(pairs).alias("custom_metadata"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each document that has an embedding: doc_id, chunk, vector, client_id, custom_metadata."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chunk"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return vectors.join(texts, "doc_id").join(metadata(spark, sf_dir), "doc_id")
