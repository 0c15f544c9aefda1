"""Messages that come back by their own timers: claims, leases, fences and redelivery at the visible time, in event time.

The state of a bucket of keys is what is known of their messages and the steps that are still due: deliveries, and ends of
work that a delivery began. Its timer is that of the first step. Nothing is done when a row arrives, only when the watermark
has passed a step's time: then all due steps of each key are taken in the order of their times, so results do not hang on
the order or the batches in which rows came.

A delivery claims the message, is skipped because it has ended, or meets a live lease. Work that was begun ends after the
time it takes, under the version of its claim. A failed run, and a delivery that met a lease, make the message visible
again after a while, as the next delivery, unless it was the last: then nothing more is written. A key is forgotten a
while after its last step.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from lexolith.streaming.buckets import BUCKETS, MICROS, Bucketed, in_buckets
from lexolith.streaming.guard import RETENTION_SECONDS, Message, claimed, ended

#: The state store that timers and lists need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUTCOME = "key string, event_id long, delivery int, at_us long, outcome string, attempts int, version long, visible_us long"


@dataclass(frozen=True)
class Timing:
    """Seconds of a lease, seconds until a failed message is visible again, and deliveries at most."""

    lease: int = 300
    visible: int = 300
    deliveries: int = 3


class Step(NamedTuple):
    """A delivery of a message, or (``ends``) the end of the work under the claim ``version``; the first ``failures`` runs fail."""

    due_us: int
    ends: bool
    event_id: int
    delivery: int
    takes_us: int
    failures: int
    version: int = 0

    @property
    def place(self) -> tuple:
        """Ends come before deliveries of the same time."""
        return self.due_us, not self.ends, self.event_id, self.delivery


def taken(message: Message, step: Step, timing: Timing) -> tuple[str, Message, Step | None]:
    """The outcome of a step, the message after it, and the step that follows from it, if any. Leases are in microseconds."""
    again = step._replace(due_us=step.due_us + timing.visible * MICROS, ends=False, delivery=step.delivery + 1, version=0) if step.delivery < timing.deliveries else None
    if step.ends:
        outcome, after = ended(message, step.version, step.delivery <= step.failures)
        return outcome, after, again if outcome == "RETRY" else None
    outcome, after = claimed(message, step.due_us)
    if outcome == "CLAIMED":
        after = after._replace(lease_until=step.due_us + timing.lease * MICROS)
        return outcome, after, step._replace(due_us=step.due_us + step.takes_us, ends=True, version=after.version)
    return outcome, after, again if outcome == "CONFLICT" else None


def due_steps(message: Message, pending: list[Step], until_us: int, timing: Timing) -> tuple[list[tuple], Message, list[Step], int]:
    """All steps up to a time, in order: (step, outcome, message after it, when it is visible again), what is left, and the last time."""
    out, last, heap = [], 0, [(s.place, s) for s in pending]
    heapify(heap)
    while heap and heap[0][1].due_us <= until_us:
        _, step = heappop(heap)
        outcome, message, after = taken(message, step, timing)
        out.append((step, outcome, message, None if after is None or after.ends else after.due_us))
        if after is not None:
            heappush(heap, (after.place, after))
        last = step.due_us
    return out, message, [s for _, s in heap], last


class Redelivery(Bucketed):
    """Of a key its message is known, and when its last step was."""

    WAITING = "key string, due_us long, ends boolean, event_id long, delivery int, takes_us long, failures int, version long"
    KNOWN = "key string, status string, attempts int, lease_us long, version long, last_us long"
    keep_us = RETENTION_SECONDS * MICROS

    def __init__(self, timing: Timing) -> None:
        self.timing = timing

    def arrived(self, rows: pd.DataFrame) -> list[list]:
        n, given = len(rows), {c: rows[c].tolist() for c in ("key", "at_us", "event_id", "takes_us", "failures")}
        return [given["key"], given["at_us"], [False] * n, given["event_id"], [1] * n, given["takes_us"], given["failures"], [0] * n]

    def advanced(self, rows: list[tuple], known: tuple | None, now_us: int) -> tuple[list[tuple], list[tuple], tuple]:
        message = Message(*known[:4]) if known else Message(lease_until=0)
        out, message, left, last = due_steps(message, [Step(*r) for r in rows], now_us, self.timing)
        found = [(s.event_id, s.delivery, s.due_us, outcome, m.attempts, m.version, visible) for s, outcome, m, visible in out]
        return found, left, (message.status, message.attempts, int(message.lease_until), message.version, last)

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        columns = [c.split()[0] for c in OUTCOME.split(", ")]
        return pd.DataFrame(out, columns=columns).astype({"visible_us": "Int64", "delivery": "int32", "attempts": "int32"})


def delivered(rows: DataFrame, timing: Timing = Timing(), late_seconds: int = 3600, buckets: int = BUCKETS) -> DataFrame:
    """The outcome of every step of a stream of messages (key, event_id, ts, at_us, takes_us, failures), as far as the
    watermark, ``late_seconds`` behind the newest row, has come. Rows later than it are dropped.

    The session's state store must be the one of STORE.
    """
    timed = rows.withWatermark("ts", f"{late_seconds} seconds").select("key", "event_id", "ts", "at_us", "takes_us", "failures")
    return in_buckets(timed, Redelivery(timing), OUTCOME, buckets)

