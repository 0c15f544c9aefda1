"""The queue data source: order, batches, deliveries that are counted, poison, and commits that are repeated."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexolith.sources import queue
from lexolith.sources.queue import Folder, Log, QueueStreamReader


def bodies(spark, n, start=0):
    return spark.range(start, start + n, 1, 3).select(F.concat(F.lit("m"), "id").alias("body"))


def plain(df):
    return sorted(map(tuple, df.collect()))


def test_messages_keep_their_order_and_text(spark, tmp_path):
    path = f"{tmp_path}/q"
    odd = ["", "line\nbreak", "a b\u0085c\r", "é😀", None, "x" * 3_000_000]
    queue.enqueue(bodies(spark, 7), path)
    queue.enqueue(spark.createDataFrame([(b,) for b in odd], "body string").coalesce(1), path)
    queue.enqueue(bodies(spark, 0), path)
    got = plain(queue.queue_messages(spark, path))
    assert [(p, d) for p, _, d in got] == [(i, 1) for i in range(13)]
    assert [b for _, b, _ in got] == [f"m{i}" for i in range(7)] + odd
    with pytest.raises(Exception, match="appended"):
        bodies(spark, 1).write.format(queue.NAME).mode("overwrite").save(path)


def test_an_empty_queue(spark, tmp_path):
    assert queue.drained(spark, f"{tmp_path}/q", lambda rows, number: None, f"{tmp_path}/state") == 0
    assert queue.queue_messages(spark, f"{tmp_path}/q").count() == 0 and queue.poisoned(spark, f"{tmp_path}/q").count() == 0


def test_failed_batches_are_delivered_again_and_then_poisoned(spark, tmp_path):
    """Batches of four: the second fails once, the third always. Nothing is lost, nothing handled twice."""
    path, done, counts = f"{tmp_path}/q", [], []
    queue.enqueue(bodies(spark, 14), path)

    def work(rows, number):
        found = rows.collect()
        counts.append((number, found[0].deliveries if found else 0))
        assert rows.count() == len(found)  # a second action delivers nothing again
        if number == 1 and found[0].deliveries < 2 or number == 2 and found:
            raise RuntimeError
        done.extend(found)

    assert queue.drained(spark, path, work, f"{tmp_path}/state", batchSize=4, mostDeliveries=3) == 4
    assert counts == [(0, 1), (1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (2, 0), (3, 1)]
    assert sorted((r.place, r.body, r.deliveries) for r in done) == [(i, f"m{i}", 2 if 4 <= i < 8 else 1) for i in [*range(8), 12, 13]]
    assert plain(queue.poisoned(spark, path)) == [(i, f"m{i}", 3) for i in range(8, 12)]
    assert plain(queue.queue_messages(spark, path).select("body")) == sorted((f"m{i}",) for i in range(14))  # the batch form still has all

    queue.enqueue(bodies(spark, 3, 14), path)  # the stream goes on where it was
    done.clear()
    assert queue.drained(spark, path, work, f"{tmp_path}/state", batchSize=4, mostDeliveries=3) == 0
    assert sorted(r.place for r in done) == [14, 15, 16]
    assert not Folder(path).names("consumers/all/deliveries") or Folder(path).names("consumers/all/deliveries")[0].startswith(f"{14:020d}")


def test_a_new_checkpoint_starts_after_what_was_acknowledged(spark, tmp_path):
    path, seen = f"{tmp_path}/q", []
    queue.enqueue(bodies(spark, 6), path)
    queue.drained(spark, path, lambda rows, n: seen.extend(r.place for r in rows.collect()), f"{tmp_path}/one", batchSize=3)
    reader = QueueStreamReader(path, "all", 3, 3)
    assert reader.initialOffset()["place"] in (3, 6)  # Spark acknowledges a batch when it plans the next
    again = []
    queue.drained(spark, path, lambda rows, n: again.extend(r.place for r in rows.collect()), f"{tmp_path}/two", batchSize=3, consumer="other")
    assert sorted(seen) == sorted(again) == list(range(6))


def test_stream_writes_enter_once(spark, tmp_path):
    """A stream from one queue to another; a commit that comes twice is one entry."""
    queue.enqueue(bodies(spark, 5), f"{tmp_path}/a")
    for _ in range(2):
        rows = queue.queue_stream(spark, f"{tmp_path}/a", batchSize=9).select("body")
        running = rows.writeStream.format(queue.NAME).option("path", f"{tmp_path}/b").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        running.awaitTermination()
    assert sorted(b for _, b, _ in plain(queue.queue_messages(spark, f"{tmp_path}/b"))) == [f"m{i}" for i in range(5)]
    writer = queue.QueueStreamWriter(f"{tmp_path}/c", "p")
    parts = [writer.write(iter([("x",)])), writer.write(iter([]))]
    for _ in range(2):
        writer.commit(parts, 0)
    assert Log(Folder(f"{tmp_path}/c")).end == 1
    writer.abort([writer.write(iter([("y",)]))], 1)
    assert len(Folder(f"{tmp_path}/c").names("segments")) == 1


def test_slices_of_a_log():
    log = Log.__new__(Log)
    log.starts, log.segments, log.end = [0, 3, 25_003], ["a", "b", "c"], 25_005
    assert log.slices(0, 2) == [("a", 0, 2, 0)]
    assert log.slices(2, 10_004) == [("a", 2, 3, 2), ("b", 0, 10_000, 3), ("b", 10_000, 10_001, 10_003)]
    assert log.slices(25_002, 25_005) == [("b", 24_999, 25_000, 25_002), ("c", 0, 2, 25_003)]
    assert log.slices(25_005, 25_005) == []
