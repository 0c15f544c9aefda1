"""Keyed states in buckets: many keys share one state, one timer and one call of Python.

Each call of a stateful processor, each timer and each look at a state is a message between Spark and Python, which takes
longer than the work for a row. With a state for each key they number several for each row; in a bucket of keys there are a
few for each micro-batch, whatever the number of its keys and rows. Rows wait in a list of columns, an element for each
piece that arrived, so that appending reads nothing. What is known of the keys is one value of columns.

A bucket has one timer, at the time when the first of its keys has something due or may be forgotten. As it expires, all
keys are taken as far as the watermark has come, so a bucket is read and written once in a micro-batch at most.
"""

from __future__ import annotations

from abc import abstractmethod
from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000
#: Buckets of a stream, unless it asks for others: with a bucket's rows a task must have memory. The state of a stream that
#: has begun holds for its own number only.
BUCKETS = 4096
#: Rows of an element of what waits.
ROWS_AT_ONCE = 10_000


def timer_of(us: int) -> int:
    """The millisecond at which a timer of a time fires: not before it."""
    return -(-us // 1000)


def columns_of(rows: Sequence[tuple]) -> tuple[list, ...]:
    return tuple(map(list, zip(*rows)))


def arrays(schema: str) -> str:
    """The schema of columns of rows: an array for each field."""
    return ", ".join("{} array<{}>".format(*field.split()) for field in schema.split(", "))


class Bucketed(StatefulProcessor):
    """WAITING is the schema of the rows that wait, first the key and microseconds when they are due; KNOWN that of what is
    known of a key, first the key and last microseconds ``keep_us`` before it may be forgotten if nothing of it waits."""

    WAITING: str
    KNOWN: str
    keep_us: int

    @abstractmethod
    def arrived(self, rows: pd.DataFrame) -> Sequence[Sequence]:
        """The columns of WAITING of arriving rows."""

    @abstractmethod
    def advanced(self, rows: list[tuple], known: tuple | None, now_us: int) -> tuple[list[tuple], list[tuple], tuple]:
        """What comes of a key's waiting rows up to a time, the rows that wait on, and what is known then; all without the key."""

    @abstractmethod
    def frame(self, out: list[tuple]) -> pd.DataFrame:
        """The output of what came, the key before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", arrays(self.WAITING))
        self.known = handle.getValueState("known", arrays(self.KNOWN))
        self.wake = handle.getValueState("wake", "at_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            columns = tuple(map(list, self.arrived(batch)))
            self.waiting.appendValue(columns)
            first = min(columns[1]) if first is None else min(first, *columns[1])
        before = self.wake.get()
        if first is not None and (before is None or timer_of(first) < before[0]):
            if before is not None:
                self.handle.deleteTimer(before[0])
            self._wake_at(timer_of(first))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        by_key, out, left = defaultdict(list), [], []
        for columns in self.waiting.get():
            for row in zip(*columns):
                by_key[row[0]].append(row[1:])
        known = {row[0]: row[1:] for row in zip(*(self.known.get() or ()))}
        for name, rows in by_key.items():
            if min(rows)[0] <= now_us:
                found, rows, known[name] = self.advanced(rows, known.get(name), now_us)
                out += [(name, *f) for f in found]
            left += [(name, *r) for r in rows]
        waits = {row[0] for row in left}
        known = {k: v for k, v in known.items() if k in waits or v[-1] + self.keep_us > now_us}
        ahead = [row[1] for row in left] + [v[-1] + self.keep_us for k, v in known.items() if k not in waits]
        self.waiting.clear()
        if left:
            self.waiting.put([columns_of(left[i : i + ROWS_AT_ONCE]) for i in range(0, len(left), ROWS_AT_ONCE)])
        if known:
            self.known.update(columns_of([(k, *v) for k, v in known.items()]))
        else:
            self.known.clear()
        if ahead:
            self._wake_at(timer_of(min(ahead)))
        else:
            self.wake.clear()
        return iter([self.frame(out)] if out else [])

    def _wake_at(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.wake.update((ms,))

    def close(self) -> None:
        pass


def in_buckets(rows: DataFrame, processor: Bucketed, output: str, buckets: int = BUCKETS) -> DataFrame:
    """What a processor gives for a stream (key, ...) with a watermark, its keys in ``buckets`` buckets. The session's state
    store must be RocksDB's."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(processor, output, "Append", "EventTime")
