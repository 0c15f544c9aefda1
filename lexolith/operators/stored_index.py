"""An index of chunks as a stored table: snapshots, upserts that touch only what changed, layout by client, resumable copies.

A table is a folder of data and a log of pointers. Rows lie by client in partitions and, within them, in files by bucket of
their id, sorted by id. A snapshot lists, for each (client, bucket), the folder that holds it. An upsert reads and rewrites
the (client, bucket)s that arriving rows fall into, writes their new folders beside the old ones, and the next pointer
last: a write that fails leaves the old snapshot as it was, untouched buckets keep their files, and of two writers at once
the second one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexolith.sources.shared import shared_folder

#: Buckets of a client's ids.
BUCKETS = 16
#: Pieces of a snapshot whose list is sent to the workers.
PIECES_SENT = 100_000
_PIECES = "client string, bucket int, folder string"


def _named(client: str) -> Column:
    """A client in folders' names: never empty, and different from no client."""
    return F.coalesce(F.concat(F.lit("of-"), F.col(client).cast("string")), F.lit("none"))


class Storage:
    """Small files through Spark's own file systems, so that the driver reaches what executors do."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), path.rstrip("/")

    def _at(self, name: str):
        at = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return at.getFileSystem(self.conf), at

    def has(self, name: str) -> bool:
        files, at = self._at(name)
        return files.exists(at)

    def read(self, name: str) -> str:
        files, at = self._at(name)
        stream = files.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        files, at = self._at(folder)
        return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []

    def write(self, name: str, text: str) -> None:
        """Writes beside the file and moves it into its place, which must be empty, so readers see it whole or not at all."""
        files, hidden = self._at(f".{uuid.uuid4().hex}")
        stream = files.create(hidden)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        _, at = self._at(name)
        files.mkdirs(at.getParent())
        if files.exists(at) or not files.rename(hidden, at):
            raise OSError(f"{name} is there already")


class StoredIndex:
    """A table of chunks at ``path``, keyed by (client, ``id_col``); ``client_col`` may be null."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "id", client_col: str = "client_id", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.id_col, self.client_col = spark, path.rstrip("/"), id_col, client_col
        self.storage = Storage(spark, path)
        self.buckets = self._pointer().get("buckets", buckets)

    def _pointer(self) -> dict:
        """What is known of the current snapshot, the last one in the log."""
        known = self.storage.names("log")
        return json.loads(self.storage.read(f"log/{known[-1]}")) if known else {}

    def snapshot(self) -> int:
        return self._pointer().get("snapshot", 0)

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("client", _named(self.client_col)).withColumn("bucket", F.pmod(F.xxhash64(self.id_col), F.lit(self.buckets)).cast("int"))

    def pieces(self) -> DataFrame:
        """(client, bucket, folder) of the current snapshot."""
        pointer = self._pointer()
        if not pointer:
            return self.spark.createDataFrame([], _PIECES)
        return self.spark.read.schema(_PIECES).parquet(f"{self.path}/snapshots/{pointer['snapshot']}")

    def _schema(self) -> T.StructType | None:
        pointer = self._pointer()
        return T.StructType.fromJson(pointer["schema"]) if pointer else None

    def _whole(self) -> T.StructType:
        return T.StructType([*self._schema().fields, *(T.StructField(n, t) for n, t in (("folder", T.StringType()), ("client", T.StringType()), ("bucket", T.IntegerType())))])

    def _stored(self, pieces: DataFrame) -> DataFrame:
        """The rows of some pieces of the current snapshot, with client and bucket. Folders are pruned as the join runs: the
        list of pieces, worked out before, is sent to the scan, if it is short enough to be sent."""
        shared_folder(self.spark)
        stored = self.spark.read.schema(self._whole()).parquet(f"{self.path}/data")
        named = pieces.select("folder", "client", "bucket").checkpoint().filter("bucket >= 0")
        return stored.join(F.broadcast(named) if self._pointer()["pieces"] <= PIECES_SENT else named, ["folder", "client", "bucket"]).drop("folder")

    def rows(self) -> DataFrame:
        """The rows of the current snapshot."""
        return self._stored(self.pieces()).drop("client", "bucket")

    def of_clients(self, clients: DataFrame, client: str = "client_id") -> DataFrame:
        """The rows of the clients in a table: only their folders are read, which Spark finds out from the table as it runs."""
        wanted = clients.select(_named(client).alias("client")).distinct()
        return self._stored(self.pieces().join(wanted, "client", "left_semi")).drop("client", "bucket")

    def upsert(self, arrived: DataFrame, newest: list[Column], deleted: Column | None = None, before_commit=None) -> dict[str, int]:
        """Puts the rows of ``arrived``, with the columns of the table, in place of those with the same client and id.

        Of several rows of a key in ``arrived`` the first in the order ``newest`` counts, ties by all columns; a key's versions
        are compared by partial aggregation, not in one task. Rows for which ``deleted`` holds go. Gives the numbers of pieces
        written and kept. Rows with a null id raise a ValueError.
        """
        if arrived.filter(F.col(self.id_col).isNull()).limit(1).count():
            raise ValueError("a row has no id")
        pointer, schema = self._pointer(), self._schema() or arrived.schema
        columns = [f.name for f in schema.fields]
        snapshot = pointer.get("snapshot", 0) + 1
        gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
        keyed = self._keyed(arrived.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in columns], gone.alias("_gone"), F.struct(*newest, F.xxhash64(*columns)).alias("_order")))
        last = keyed.groupBy("client", "bucket", self.id_col).agg(F.max_by(F.struct(*columns, "_gone"), "_order").alias("_row"))
        fresh = last.select("client", "bucket", F.col("_row.*")).persist()
        try:
            touched = fresh.select("client", "bucket").distinct()
            kept = fresh.filter("NOT _gone").select(*columns, "client", "bucket")
            old = self.pieces()
            if pointer:
                before = self._stored(old.join(touched, ["client", "bucket"], "left_semi"))
                kept = before.join(fresh.select("client", "bucket", F.col(self.id_col)), ["client", "bucket", self.id_col], "left_anti").select(*columns, "client", "bucket").unionByName(kept)
            folder = f"{snapshot}-{uuid.uuid4().hex[:8]}"
            dealt = kept.withColumn("folder", F.lit(folder)).repartition("client", "bucket").sortWithinPartitions("client", "bucket", self.id_col)
            dealt.write.mode("append").partitionBy("folder", "client", "bucket").parquet(f"{self.path}/data")
            new = kept.select("client", "bucket").distinct().withColumn("folder", F.lit(folder))  # a bucket that lost all rows has no piece
            rest = old.join(touched, ["client", "bucket"], "left_anti")
            rest.select("client", "bucket", "folder").unionByName(new.select("client", "bucket", "folder")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/snapshots/{snapshot}")
            if before_commit is not None:
                before_commit()
            pieces = self.spark.read.schema(_PIECES).parquet(f"{self.path}/snapshots/{snapshot}")
            counts = {r["mine"]: r["n"] for r in pieces.groupBy((F.col("folder") == folder).alias("mine")).agg(F.count(F.lit(1)).alias("n")).collect()}
            self.storage.write(f"log/{snapshot:012d}", json.dumps({"snapshot": snapshot, "buckets": self.buckets, "schema": schema.jsonValue(), "pieces": sum(counts.values())}))
            return {"written": counts.get(True, 0), "kept": counts.get(False, 0)}
        finally:
            fresh.unpersist()


def copy_ranges(source: DataFrame, target: str, ranges: int, id_col: str = "id", only: list[int] | None = None) -> dict[str, int]:
    """Copies ``source`` to the folder ``target`` range by range of ids, and goes on where a copy has stopped.

    The bounds of ranges are written down once, so that all runs deal rows alike. A range's rows are written to a folder of
    its own, and a line in the table of cursors, written after it, says that it is whole. A run copies the ranges that have
    no cursor and reads only rows within their bounds; a range that was half written is written again in its place. Rows
    with a null id belong to the first range. ``only`` restricts a run to some ranges. Gives the ranges copied and skipped.
    """
    spark = source.sparkSession
    storage = Storage(spark, target)
    if storage.has("ranges"):
        bounds = json.loads(storage.read("ranges"))
    else:
        found = source.select(F.col(id_col).alias("v")).filter("v IS NOT NULL").repartitionByRange(ranges, "v")
        least = found.groupBy(F.spark_partition_id().alias("p")).agg(F.min("v").alias("v")).orderBy("v").collect()  # a row for each range
        bounds = [str(r["v"]) for r in least][1:]
        storage.write("ranges", json.dumps(bounds))
    edges = [None, *bounds, None]
    copied = skipped = 0
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        if storage.has(f"cursors/range={i}"):
            skipped += 1
            continue
        if only is not None and i not in only:
            continue
        key, part = F.col(id_col), source
        bound = lambda v: F.lit(v).cast(source.schema[id_col].dataType)
        if low is not None:
            part = part.filter(key >= bound(low))
        if high is not None:
            part = part.filter((key < bound(high)) | key.isNull() if low is None else key < bound(high))
        part.write.mode("overwrite").parquet(f"{target}/rows/range={i}")
        storage.write(f"cursors/range={i}", "whole")
        copied += 1
    return {"copied": copied, "skipped": skipped, "ranges": len(edges) - 1}
