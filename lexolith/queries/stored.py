"""Stored indexes: upserts that touch what changed, rows by client, copies that go on where they stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexolith.operators.stored_index import StoredIndex, copy_ranges
from lexolith.queries import query
from lexolith.sources.shared import new_place
from lexolith.sources.tables import table


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of an index: their priority is the client."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("client_id"), F.col("o_orderstatus").alias("status"), F.lit(0).alias("version"))


def order_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """All orders; then, in a second write, versions of the urgent ones from their lines, of which those with many lines go."""
    index = StoredIndex(spark, new_place(spark, "index"))
    index.upsert(orders(spark, sf_dir), [F.col("version")])
    urgent = orders(spark, sf_dir).filter("client_id LIKE '1%'").select("id", "client_id")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("version"), F.col("l_linestatus").alias("status"))
    index.upsert(lines.join(urgent, "id").groupBy("id", "client_id", "version").agg(F.max("status").alias("status")), [F.col("version")], F.col("version") >= 6)
    return index


ORDER_INDEX_SQL = """
rows AS (
    SELECT o_orderkey AS id, o_orderpriority AS client_id, coalesce(l.status, o_orderstatus) AS status, coalesce(l.version, 0)::int AS version
    FROM orders LEFT JOIN (
        SELECT l_orderkey, max(l_linenumber) AS version, max(l_linestatus) FILTER (l_linenumber = most) AS status
        FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS most FROM lineitem) GROUP BY 1
    ) l ON l.l_orderkey = o_orderkey AND o_orderpriority LIKE '1%' WHERE coalesce(l.version, 0) < 6
)"""


@query(f"WITH {ORDER_INDEX_SQL} SELECT * FROM rows")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after both writes."""
    return order_index(spark, sf_dir).rows()


@query(f"WITH {ORDER_INDEX_SQL} SELECT * FROM rows WHERE client_id IN (SELECT o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY 1 HAVING count(*) * 5 > (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0))")
def index_of_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the clients that have more than a fifth of the orders of customers in credit; only their folders are read."""
    busy = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"))
    all_busy = busy.count()
    clients = busy.groupBy(F.col("o_orderpriority").alias("client_id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * 5 > all_busy)
    return order_index(spark, sf_dir).of_clients(clients)


@query("SELECT o_orderkey AS id, o_orderpriority AS client_id, o_orderstatus AS status, 0::int AS version FROM orders")
def resumed_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy that stopped after some ranges and went on: every row once."""
    place, rows = new_place(spark, "copy"), orders(spark, sf_dir)
    copy_ranges(rows, place, 8, only=[0, 3, 5])
    copy_ranges(rows, place, 8)
    return spark.read.schema(rows.schema).parquet(f"{place}/rows").drop("range")
