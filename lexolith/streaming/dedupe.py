"""The first delivery of each key within a while of event time, whatever order rows come in.

Rows wait in the state of their key's bucket until the watermark has passed them and are then taken by time and id. A row is the first if
no row of its key was handed on in the while before it; what is handed on, and not when it arrived, sets the next while.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from lexolith.streaming.buckets import BUCKETS, MICROS, Bucketed, in_buckets

FIRST = "key string, event_id long"


def firsts(waiting: list[tuple[int, int]], last_us: int | None, within_us: int) -> tuple[list[int], int | None]:
    """The ids of ``waiting`` (microseconds, id) that are handed on, in order, and when the last one was."""
    out = []
    for at, event_id in sorted(waiting):
        if last_us is None or at >= last_us + within_us:
            out.append(event_id)
            last_us = at
    return out, last_us


class FirstWithin(Bucketed):
    """Of a key the time is known when it was last handed on; it is forgotten when the while after it is over."""

    WAITING, KNOWN = "key string, at_us long, event_id long", "key string, last_us long"

    def __init__(self, within_us: int) -> None:
        self.keep_us = within_us

    def arrived(self, rows: pd.DataFrame) -> list[list]:
        return [rows[c].tolist() for c in ("key", "at_us", "event_id")]

    def advanced(self, rows: list[tuple], known: tuple | None, now_us: int) -> tuple[list[tuple], list[tuple], tuple]:
        out, last = firsts([r for r in rows if r[0] <= now_us], known and known[0], self.keep_us)
        return [(event_id,) for event_id in out], [r for r in rows if r[0] > now_us], (last,)

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["key", "event_id"])


def first_within(rows: DataFrame, seconds: int, late_seconds: int = 3600, buckets: int = BUCKETS) -> DataFrame:
    """key and event_id of the first rows of a stream (key, event_id, ts, at_us) within ``seconds``, of equal times the least
    id, as far as the watermark, ``late_seconds`` behind the newest row, has come. The state store must be that of STORE."""
    timed = rows.withWatermark("ts", f"{late_seconds} seconds").select("key", "event_id", "ts", "at_us")
    return in_buckets(timed, FirstWithin(seconds * MICROS), FIRST, buckets)
