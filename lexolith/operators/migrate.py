"""Bulk copies between stores: stamping, caps, shards, checks and cut-over."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexolith.functions.vectors import is_valid_vector


def copied(source: DataFrame, client_id: str | None, dimensions: int, vector: str = "vector") -> DataFrame:
    """Rows with a valid vector, stamped with a client if one is given, everything else as it is."""
    rows = source.filter(is_valid_vector(F.col(vector), dimensions))
    return rows if client_id is None else rows.withColumn("client_id", F.lit(client_id))


def capped(rows: DataFrame, most: int, order: str) -> DataFrame:
    return rows.orderBy(order).limit(most)


def sharded(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """``rows`` with the leading digit of a hexadecimal id as shard."""
    return rows.withColumn("shard", F.substring(id_col, 1, 1))


def page_after(rows: DataFrame, lower: str | None, upper: str | None, cursor: str | None, size: int, id_col: str = "id") -> DataFrame:
    """A page of a key range after a cursor, in key order."""
    found = rows
    for bound, keep in ((lower, F.col(id_col) >= F.lit(lower)), (upper, F.col(id_col) < F.lit(upper)), (cursor, F.col(id_col) > F.lit(cursor))):
        if bound is not None:
            found = found.filter(keep)
    return found.orderBy(id_col).limit(size)


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def rekeyed(rows: DataFrame, client_id: str, partition_key: str = "partition_key", row_key: str = "row_key") -> DataFrame:
    """Rows under one client's partition key; row keys that would then collide are an error."""
    clash = duplicate_keys(rows, row_key).limit(1).count()
    if clash:
        raise ValueError(f"{row_key} is not unique: rows would overwrite each other under one {partition_key}")
    return rows.withColumn(partition_key, F.lit(client_id))


def verified_counts(name: str, source: DataFrame, target: DataFrame) -> DataFrame:
    """name, n_source, n_target, equal."""
    a, b = source.agg(F.count(F.lit(1)).alias("n_source")), target.agg(F.count(F.lit(1)).alias("n_target"))
    return a.join(F.broadcast(b)).select(F.lit(name).alias("name"), "n_source", "n_target", (F.col("n_source") == F.col("n_target")).alias("equal"))


#: Columns that a store adds to rows and that no copy takes along.
SYSTEM_COLUMNS = ("timestamp", "etag", "odata.etag", "odata.metadata")


def data_columns(rows: DataFrame) -> DataFrame:
    """``rows`` without what a store added: system columns and annotations, which have an @ in their names."""
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() not in SYSTEM_COLUMNS and "@" not in c])


def schema_with_name(text: str, name: str) -> tuple[str, T.StructType]:
    """The target's name and the schema of an index definition in JSON (name, fields of name, type and fields); the
    definition's own name gives way to ``name``."""
    simple = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}

    def of(field: dict) -> T.DataType:
        kind = field["type"]
        inner = kind.removeprefix("array<").removesuffix(">")
        if inner not in simple and inner != "struct":
            raise ValueError(f"{field['name']} has the unknown type {kind}")
        own = T.StructType([T.StructField(f["name"], of(f)) for f in field["fields"]]) if inner == "struct" else simple[inner]
        return T.ArrayType(own) if kind.startswith("array<") else own

    return name, T.StructType([T.StructField(f["name"], of(f)) for f in json.loads(text)["fields"]])


def ensure_table(spark: SparkSession, name: str, schema: T.StructType) -> bool:
    """Creates a table if there is none; whether it did."""
    if spark.catalog.tableExists(name):
        return False
    spark.createDataFrame([], schema).write.mode("ignore").saveAsTable(name)
    return True


def uploaded(rows: DataFrame, name: str, batch_rows: int = 100_000) -> dict[str, int]:
    """Appends rows to a table, in files of ``batch_rows`` at most, every task its own; the columns are the table's, those
    that it lacks stay behind and missing ones are null. Gives the counts of uploaded(), skipped and all rows.

    Rows with a null id are skipped.
    """
    target = rows.sparkSession.table(name)
    watch = Observation()
    seen = rows.observe(watch, F.count(F.lit(1)).alias("submitted"), F.count_if(F.col("id").isNull()).alias("skipped")).filter("id IS NOT NULL")
    columns = [(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema.fields]
    seen.select(*columns).write.option("maxRecordsPerFile", batch_rows).mode("append").saveAsTable(name)
    found = watch.get
    return {"submitted": found["submitted"], "skipped": found["skipped"], "succeeded": found["submitted"] - found["skipped"]}


def cut_over(view: str, target_table: str) -> str:
    """The statement that points readers at the new table."""
    return f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM {target_table}"


def remaining(copied_rows: int, all_rows: int, seconds: float) -> str:
    """HH:MM:SS that the rest of a copy takes at the pace so far."""
    if copied_rows <= 0 or seconds <= 0:
        return "unknown"
    left = round((all_rows - copied_rows) * seconds / copied_rows)
    return f"{left // 3600:02d}:{left % 3600 // 60:02d}:{left % 60:02d}"
