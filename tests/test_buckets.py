"""Streams whose keys share their states, timers and calls in buckets."""

import pytest
from pyspark.sql import functions as F

from lexolith.streaming import buckets, dedupe, guard, redelivery

S = redelivery.MICROS
DAY = 86_400 * S


def written(spark, path, *files):
    """One file for each list of (key, event_id, at_us, takes_us, failures), which arrive in their order."""
    for rows in files:
        df = spark.createDataFrame(rows, "key string, event_id long, at_us long, takes_us long, failures int")
        df.withColumn("ts", F.timestamp_micros("at_us")).coalesce(1).write.mode("append").parquet(path)


def timers_of(spark, path, transform):
    """Timers that a stream over the files registers."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, redelivery.STORE[provider])
    try:
        rows = transform(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
        running = rows.writeStream.format("noop").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.unset(provider)
    return sum(op["customMetrics"]["numRegisteredTimers"] for p in running.recentProgress for op in p["stateOperators"])


@pytest.mark.parametrize("transform", [lambda e: dedupe.first_within(e, 3600), redelivery.delivered], ids=["dedupe", "timers"])
def test_timers_are_as_many_as_buckets_not_as_rows(spark, tmp_path, transform):
    rows = [(f"k{i % 20}", i, DAY + i * 61 * S, 0, 0) for i in range(400)]
    written(spark, f"{tmp_path}/rows", [*rows, ("end", 999, 30 * DAY, 0, 0)])
    assert 0 < timers_of(spark, f"{tmp_path}/rows", transform) <= 2 * 21  # of each key's bucket: at first and after its rows


def test_one_bucket_or_many_give_the_same(spark, tmp_path):
    """The state of several keys in a bucket: rows that wait on, keys that are forgotten and come back, keys that go on."""
    first = [("a", 1, DAY, 60 * S, 0), ("b", 2, DAY + 5 * S, 900 * S, 3), ("b", 3, DAY + 2 * S, 0, 0), ("b", 4, DAY + 900 * S, 0, 1)]
    files = [first, *([("b", 10 + d, d * DAY, 60 * S, 4), ("c", 20 + d, d * DAY, 0, 9)] for d in (10, 15)), [("a", 40, 20 * DAY, 0, 0)], [("end", 50, 40 * DAY, 0, 0)]]
    written(spark, f"{tmp_path}/many", *files)
    for transform in (lambda e, n: redelivery.delivered(e, buckets=n), lambda e, n: dedupe.first_within(e, 86_400, buckets=n)):
        one, many = ([tuple(r) for r in guard.replayed(spark, f"{tmp_path}/many", lambda e, n=n: transform(e, n), settings=redelivery.STORE, files_at_once=1).collect()] for n in (1, 4096))
        assert sorted(map(repr, one)) == sorted(map(repr, many)) and {r[0] for r in one} == {"a", "b", "c"}
        assert {r[1] for r in one if r[0] == "a"} == {1, 40}
    found = guard.replayed(spark, f"{tmp_path}/many", lambda e: redelivery.delivered(e, buckets=1), settings=redelivery.STORE, files_at_once=1)
    assert [r.outcome for r in found.filter("event_id = 40").orderBy("version").collect()] == ["CLAIMED", "DONE"]  # its end of day 1 is forgotten


def test_steps_of_a_key_with_many_rows_are_taken_in_order():
    """Steps of equal times and ids too; what waits is not changed by taking."""
    steps = [redelivery.Step(i * 37 % 101 * S, False, i, 1, i % 3 * S, i % 5) for i in range(2000)] + [redelivery.Step(S, False, 1, 1, 0, 0)] * 2
    given = list(steps)
    found, _, left, _ = redelivery.due_steps(guard.Message(lease_until=0), steps, 50 * S, redelivery.Timing())
    assert steps == given and all(s.due_us > 50 * S for s in left)
    assert [s.due_us for s, *_ in found] == sorted(s.due_us for s, *_ in found)


def test_timers_are_not_before_their_time():
    assert [buckets.timer_of(us) for us in (0, 1, 1000, 1001)] == [0, 1, 1, 2]
    assert buckets.arrays("key string, at_us long") == "key array<string>, at_us array<long>"
