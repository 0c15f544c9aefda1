"""The stored index: what an upsert touches, what a failed one leaves, which folders a client's search reads; resumable copies."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexolith.operators.ingestion import superseded
from lexolith.operators.stored_index import StoredIndex, copy_ranges

SCHEMA = "id long, client_id string, text string, at int"
CLIENTS = ("a", "b", "c", None, "")


def rows(spark, ids, at=0, text="old"):
    return spark.createDataFrame([(i, CLIENTS[i % 5], f"{text}{i}", at) for i in ids], SCHEMA)


def plain(df):
    return sorted(map(repr, map(tuple, df.select("id", "client_id", "text", "at").collect())))


def files(path):
    return {str(f.relative_to(path)) for f in Path(path).rglob("*.parquet") if "/data/" in str(f)}


def index_of(spark, path, n=400, buckets=4):
    index = StoredIndex(spark, str(path), buckets=buckets)
    index.upsert(rows(spark, range(n)), [F.col("at")])
    return index


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    index = index_of(spark, tmp_path)
    before = files(tmp_path)
    live = lambda: {tuple(r) for r in index.pieces().collect()}
    old = live()
    assert len(old) == 20 and index.snapshot() == 1
    counts = index.upsert(rows(spark, [1, 6, 1000], 5, "new"), [F.col("at")])
    assert counts["kept"] >= 17 and counts["written"] + counts["kept"] in (20, 21)
    assert before <= files(tmp_path)  # nothing is written over
    assert len(live() & old) == counts["kept"]  # untouched pieces are the same folders, and so the same files
    want = [(i, CLIENTS[i % 5], f"new{i}" if i in (1, 6) else f"old{i}", 5 if i in (1, 6) else 0) for i in range(400)] + [(1000, "a", "new1000", 5)]
    assert plain(index.rows()) == sorted(map(repr, want))
    assert plain(StoredIndex(spark, str(tmp_path)).rows()) == sorted(map(repr, want))  # buckets are the table's own


def test_a_failed_write_leaves_the_old_snapshot(spark, tmp_path):
    index = index_of(spark, tmp_path, 60)
    want = plain(index.rows())

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        index.upsert(rows(spark, range(30), 9, "new"), [F.col("at")], before_commit=fail)
    assert index.snapshot() == 1 and plain(index.rows()) == want
    index.upsert(rows(spark, [3], 9, "new"), [F.col("at")])
    assert index.snapshot() == 2 and plain(index.rows()) != want


def test_of_two_writers_the_second_fails(spark, tmp_path):
    index = index_of(spark, tmp_path, 20)
    other = StoredIndex(spark, str(tmp_path))
    with pytest.raises(OSError, match="there already"):
        index.upsert(rows(spark, [1], 1, "mine"), [F.col("at")], before_commit=lambda: other.upsert(rows(spark, [2], 1, "theirs"), [F.col("at")]))
    assert {r.text for r in index.rows().filter("at = 1").collect()} == {"theirs2"}


def test_versions_ties_deletes_and_odd_keys(spark, tmp_path):
    index = index_of(spark, tmp_path, 10)
    arrived = spark.createDataFrame([(1, "b", "first", 3), (1, "b", "last", 4), (1, "a", "another client", 1), (2, "c", "gone", 1), (4, "", "x" * 2_000_000, 1), (3, None, "same", 7), (3, None, "same", 7)], SCHEMA)
    index.upsert(arrived, [F.col("at")], F.col("text") == "gone")
    got = {(r.id, r.client_id): r.text[:20] for r in index.rows().collect()}
    assert len(got) == index.rows().count() == 10  # one gone, one new
    assert got[1, "b"] == "last" and got[1, "a"] == "another client" and (2, "c") not in got and got[3, None] == "same" and got[4, ""] == "x" * 20
    with pytest.raises(ValueError, match="no id"):
        index.upsert(spark.createDataFrame([(None, "a", "t", 1)], SCHEMA), [F.col("at")])
    index.upsert(rows(spark, []), [F.col("at")])
    assert index.rows().count() == 10
    empty = StoredIndex(spark, f"{tmp_path}/empty")
    empty.upsert(rows(spark, []), [F.col("at")])
    assert empty.rows().count() == 0
    index.upsert(index.rows(), [F.col("at")], F.lit(True))
    assert index.rows().count() == 0 and index.pieces().count() == 0


def test_superseded_rows_are_put_back_by_an_upsert(spark, tmp_path):
    pair = "array<struct<key:string,value:string>>"
    df = spark.createDataFrame([(i, "abc"[i % 3], [("documentId", f"d{i % 4}")]) for i in range(24)], f"id long, client_id string, custom_metadata {pair}")
    index = StoredIndex(spark, str(tmp_path), buckets=8)
    index.upsert(df, [F.lit(0)])
    was = index.rows()
    changed = superseded(was, spark.createDataFrame([("d1",)], "document_id string")).join(was.select("id", F.col("custom_metadata").alias("old")), "id").filter("size(custom_metadata) > size(old)").drop("old")
    counts = index.upsert(changed, [F.lit(0)])
    assert {r.id for r in index.rows().filter("size(custom_metadata) = 2").collect()} == set(range(1, 24, 4)) and counts["kept"] > 0


def test_only_the_folders_of_a_client_are_read(spark, tmp_path):
    index = index_of(spark, tmp_path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    clients = spark.createDataFrame([("b",), ("nobody",)], "client_id string")
    found = index.of_clients(clients)
    got = found.collect()
    assert {r.client_id for r in got} == {"b"} and len(got) == 80
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*dynamicpruningexpression\(client#\d+ IN dynamicpruning", plan)
    assert [m["numFiles"] for m in _metrics(found) if m["data"]] == [4]  # of the 20 files
    assert [m["numFiles"] for m in _metrics(index.rows()) if m["data"]] != [4]
    assert {r.client_id for r in index.of_clients(spark.createDataFrame([(None,)], "client_id string")).collect()} == {None}


def _metrics(df):
    """numFiles of the scans of a frame's executed plan."""
    out = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec":
            out.append({"numFiles": node.metrics().apply("numFiles").value(), "data": "/data" in node.relation().location().rootPaths().toString()})
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_copy_goes_on_where_it_stopped(spark, tmp_path, kind):
    source = spark.range(500).select(F.when(F.col("id") % 100 == 3, None).otherwise(F.col("id")).cast(kind).alias("id"), F.col("id").alias("n")).repartition(4)
    target = str(tmp_path / "copy")
    seen = spark.sparkContext.accumulator(0)
    assert copy_ranges(source, target, 6, only=[1, 4]) == {"copied": 2, "skipped": 0, "ranges": 6}
    # a range that was half written before the machine was lost
    source.limit(3).write.parquet(f"{target}/rows/range=2")
    done = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "copy" / "rows" / "range=1").glob("*.parquet")}
    assert copy_ranges(source, target, 6) == {"copied": 4, "skipped": 2, "ranges": 6}
    assert {str(f): f.stat().st_mtime_ns for f in (tmp_path / "copy" / "rows" / "range=1").glob("*.parquet")} == done and seen.value == 0
    copied = spark.read.parquet(f"{target}/rows")
    assert sorted(r.n for r in copied.collect()) == list(range(500))
    assert copy_ranges(source, target, 6) == {"copied": 0, "skipped": 6, "ranges": 6}


def test_a_second_run_reads_only_what_is_missing(spark, tmp_path):
    """Bounds reach the scan, so files and row groups outside a range are not read."""
    spark.range(1000).repartitionByRange(10, "id").write.parquet(f"{tmp_path}/source")
    source, target = spark.read.parquet(f"{tmp_path}/source"), f"{tmp_path}/copy"
    copy_ranges(source, target, 5, only=[0])
    import json

    low, high = json.loads((Path(target) / "ranges").read_text())[1:3]
    part = source.filter((F.col("id") >= F.lit(low).cast("long")) & (F.col("id") < F.lit(high).cast("long")))
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id," in part._jdf.queryExecution().executedPlan().toString()
    assert copy_ranges(source, target, 5)["copied"] == 4 and spark.read.parquet(f"{target}/rows").count() == 1000


def test_copies_of_few_and_no_rows(spark, tmp_path):
    for n in (0, 1):
        df = spark.range(n)
        copy_ranges(df, f"{tmp_path}/{n}", 4)
        assert spark.read.schema("id long").parquet(f"{tmp_path}/{n}/rows").count() == n
