"""Lifecycles as batches over events, and the same by streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexolith.operators import lifecycle
from lexolith.queries import query
from lexolith.sources.tables import table
from lexolith.streaming import dedupe, guard, redelivery


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""
WITH k AS (
    SELECT user_id, bool_or(event_type IN ('purchase', 'error')) AS terminal, count(*) AS n_events, arg_min(event_type, (ts, event_id)) FILTER (event_type IN ('purchase', 'error')) AS first_end, arg_max(event_type, (ts, event_id)) AS latest
    FROM events GROUP BY 1
)
SELECT user_id, CASE WHEN terminal THEN first_end ELSE latest END AS status, terminal, n_events FROM k
""")
def lifecycle_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.col("event_type").isin("purchase", "error")
    return lifecycle.latest_status(events(spark, sf_dir), ["user_id"], "event_type", "ts", ends, "event_id")


@query("""
WITH r AS (SELECT event_id, user_id, event_type = 'error' AS failed, coalesce(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, ts FROM events),
n AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) % 3 + 1 AS attempt FROM r)
SELECT event_id, user_id, attempt::int AS attempt, CASE WHEN NOT failed THEN 'DONE' WHEN attempt >= 3 THEN 'FAILED' ELSE 'RETRY' END AS outcome FROM n
""")
def retry_exhaustion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.attempts(events(spark, sf_dir), ["user_id"], F.col("event_type") == "error", 3, ["ts", "event_id"])
    return found.select("event_id", "user_id", "attempt", "outcome")


@query("""
SELECT event_id, user_id, coalesce(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) + INTERVAL 600 SECOND > ts, false) AS conflict FROM events
""")
def lease_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.lease_conflicts(events(spark, sf_dir), ["user_id", "event_type"], "ts", 600, "event_id")
    return found.select("event_id", "user_id", "conflict")


@query("""
WITH c AS (SELECT c_custkey AS row_key, 1::bigint AS version, c_mktsegment AS status FROM customer),
u AS (SELECT o_custkey AS row_key, (max(o_orderkey) % 2 + 1)::bigint AS version, max(o_orderstatus) AS status FROM orders GROUP BY 1)
SELECT c.row_key, CASE WHEN u.version = c.version THEN u.status ELSE c.status END AS status, c.version + CASE WHEN u.version = c.version THEN 1 ELSE 0 END AS version FROM c LEFT JOIN u USING (row_key)
""")
def compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the changes expect a version that is gone."""
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_key"), F.col("c_mktsegment").alias("status"), F.lit(1).cast("bigint").alias("version"))
    changes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("row_key")).agg((F.max("o_orderkey") % 2 + 1).cast("bigint").alias("version"), F.max("o_orderstatus").alias("status"))
    return lifecycle.updated_if_unchanged(current, changes, ["row_key"], ["status"])[0]


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 9 = 0)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "supplier").filter("s_suppkey % 9 = 0").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    return lifecycle.inserted_if_absent(current, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])[0]


@query("""
WITH d AS (SELECT user_id::varchar || '|' || event_type AS key, event_id, ts, event_type = 'error' AS failed FROM events)
SELECT key, count(*) AS deliveries FROM d GROUP BY key
""")
def stream_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of all events, counted by key: the replay of a stream equals the batch."""
    return guard.replayed(spark, f"{sf_dir}/events.parquet", guard.counted_deliveries, "complete")


@query("""
WITH d AS (SELECT user_id::varchar || '|' || event_type AS key, event_id, event_id % 3 > 0 AS failed, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events),
last AS (SELECT key, least(coalesce(min(nth) FILTER (NOT failed), 3), 3) AS last FROM d GROUP BY key)
SELECT key, event_id, CASE WHEN nth > last THEN 'SKIPPED' WHEN NOT failed THEN 'DONE' WHEN nth = 3 THEN 'FAILED' ELSE 'RETRY' END AS outcome, least(nth, last)::int AS attempts, (2 * least(nth, last))::bigint AS version
FROM d JOIN last USING (key)
""")
def stream_idempotent_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as deliveries of messages (user, type): claims, leases, retries and terminal states, in event time.

    A failure gives its lease back, so the next delivery is handled whenever it comes.
    """
    return guard.replayed(spark, f"{sf_dir}/events.parquet", guard.guarded_deliveries)


@query("""
WITH RECURSIVE e AS (SELECT user_id::varchar || '|' || event_type AS key, event_id, epoch_us(ts) AS at_us FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_us, event_id) AS nth FROM e WHERE at_us <= (SELECT (max(at_us) // 1000 - 3600000) * 1000 FROM e)),
f AS (
    SELECT key, event_id, nth, at_us AS last_us, true AS first FROM r WHERE nth = 1
    UNION ALL
    SELECT r.key, r.event_id, r.nth, CASE WHEN r.at_us >= f.last_us + 86400000000 THEN r.at_us ELSE f.last_us END, r.at_us >= f.last_us + 86400000000 FROM f JOIN r ON r.key = f.key AND r.nth = f.nth + 1
)
SELECT key, event_id FROM f WHERE first
""")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first delivery of each message within a day; those of the last hour still wait."""
    rows = lambda e: guard.deliveries(e).select("key", "event_id", "ts", F.unix_micros("ts").alias("at_us"))
    return guard.replayed(spark, f"{sf_dir}/events.parquet", lambda e: dedupe.first_within(rows(e), 86_400), settings=redelivery.STORE)


@query("SELECT user_id::varchar || '|' || event_type AS key, event_id FROM events")
def stream_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice, the second time up to nine minutes later: each is handed on once."""
    return guard.replayed(spark, f"{sf_dir}/events.parquet", guard.redelivered)


#: Events are hours apart, so leases and delays are hours too; a message's work takes up to two leases.
TIMING = redelivery.Timing(lease=6 * 3600, visible=6 * 3600)


def timed_deliveries(events: DataFrame) -> DataFrame:
    """Events as messages (user, type) whose work takes 0 to 12 hours and whose first 0 to 4 runs fail."""
    takes = F.col("event_id") % 7 * (2 * 3600 * redelivery.MICROS)
    return guard.deliveries(events).select("key", "event_id", "ts", F.unix_micros("ts").alias("at_us"), takes.alias("takes_us"), (F.col("event_id") % 5).cast("int").alias("failures"))


@query(f"""
WITH RECURSIVE e AS (SELECT user_id::varchar || '|' || event_type AS key, event_id, epoch_us(ts) AS at_us, event_id % 7 * 7200000000 AS takes, event_id % 5 AS failures FROM events),
until AS (SELECT (max(at_us) // 1000 - 3600000) * 1000 AS until_us FROM e),
run AS (
    SELECT key, 0 AS nth, NULL::varchar AS status, 0 AS attempts, 0::bigint AS lease, 0::bigint AS version, NULL::varchar AS outcome, NULL::bigint AS visible_us,
        list_sort(list(struct_pack(due := at_us, kind := 1, event_id := event_id, delivery := 1, takes := takes, failures := failures, claim := 0::bigint))) AS pending,
        NULL::struct(due bigint, kind integer, event_id bigint, delivery integer, takes bigint, failures bigint, claim bigint) AS step
    FROM e GROUP BY key
    UNION ALL
    SELECT key, nth + 1, CASE WHEN o IN ('CLAIMED', 'DONE', 'FAILED') THEN o ELSE status END, attempts + (o = 'CLAIMED')::int,
        CASE WHEN o = 'CLAIMED' THEN s.due + {TIMING.lease}000000 WHEN o IN ('DONE', 'FAILED', 'RETRY') THEN 0 ELSE lease END, v, o, CASE WHEN again THEN s.due + {TIMING.visible}000000 END,
        list_sort(pending[2:] || CASE
            WHEN o = 'CLAIMED' THEN [struct_pack(due := s.due + s.takes, kind := 0, event_id := s.event_id, delivery := s.delivery, takes := s.takes, failures := s.failures, claim := v)]
            WHEN again THEN [struct_pack(due := s.due + {TIMING.visible}000000, kind := 1, event_id := s.event_id, delivery := s.delivery + 1, takes := s.takes, failures := s.failures, claim := 0::bigint)] ELSE [] END), s
    FROM (
        SELECT *, o IN ('CONFLICT', 'RETRY') AND s.delivery < {TIMING.deliveries} AS again, version + (o IN ('CLAIMED', 'DONE', 'FAILED', 'RETRY'))::int AS v FROM (
            SELECT *, CASE WHEN s.kind = 0 THEN CASE WHEN status IN ('DONE', 'FAILED') OR s.claim <> version THEN 'FENCED' WHEN s.delivery > s.failures THEN 'DONE' WHEN attempts >= 3 THEN 'FAILED' ELSE 'RETRY' END
                WHEN status IN ('DONE', 'FAILED') THEN 'SKIPPED' WHEN lease > s.due THEN 'CONFLICT' ELSE 'CLAIMED' END AS o
            FROM (SELECT * EXCLUDE (step, outcome, visible_us), pending[1] AS s FROM run WHERE len(pending) > 0), until WHERE s.due <= until_us
        )
    )
)
SELECT key, step.event_id AS event_id, step.delivery AS delivery, step.due AS at_us, outcome, attempts::int AS attempts, version, coalesce(visible_us, 0) AS visible_us FROM run WHERE nth > 0
""")
def stream_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every message as its timers come: claims, live leases, fenced ends, runs that failed and came back;
    visible_us is 0 where the message does not come back."""
    found = guard.replayed(spark, f"{sf_dir}/events.parquet", lambda e: redelivery.delivered(timed_deliveries(e), TIMING), settings=redelivery.STORE)
    return found.withColumn("visible_us", F.coalesce("visible_us", F.lit(0).cast("bigint")))
