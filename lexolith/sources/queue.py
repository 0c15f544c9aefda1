"""A message queue in a shared folder as a Python data source: batch and stream reads and writes, deliveries, poison.

A queue is a log. Writers put messages into segment files, and one entry of the log names the segments of each commit, so
messages have places: 0, 1, 2, ... in the order of commits, partitions and rows. A stream's offsets are places. It takes
``batchSize`` messages at a time and acknowledges a batch by its end once Spark has committed it.

A batch that fails is delivered again with the same offsets when the stream starts anew. Each start counts the batch's
delivery before it hands it out, in the queue's folder, and every message carries that count. A batch that has been
delivered ``mostDeliveries`` times in vain goes to the queue's poison instead, message by message, and the stream goes on.

The folder is reached through pyarrow's filesystems, from all machines. One writer commits at a time.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lexolith.sources.streams import FILES_AT_ONCE, MOST_DELIVERIES

NAME = "message_queue"
SCHEMA = "place long, body string, deliveries int"
#: Messages of a task.
PER_TASK = 10_000


class Folder:
    """Small files of a queue, by name."""

    def __init__(self, path: str) -> None:
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def names(self, kind: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{kind}", allow_not_found=True))
        return sorted(i.base_name for i in found if i.type == fs.FileType.File and not i.base_name.startswith("."))

    def has(self, name: str) -> bool:
        return self.files.get_file_info(f"{self.root}/{name}").type == fs.FileType.File

    def read(self, name: str) -> str:
        with self.files.open_input_stream(f"{self.root}/{name}") as f:
            return f.readall().decode()

    def write(self, name: str, text: str) -> None:
        """Writes a file that readers see whole or not at all."""
        folder, _, base = f"{self.root}/{name}".rpartition("/")
        self.files.create_dir(folder, recursive=True)
        hidden = f"{folder}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(hidden) as f:
            f.write(text.encode())
        self.files.move(hidden, f"{folder}/{base}")

    def drop(self, name: str) -> None:
        if self.has(name):
            self.files.delete_file(f"{self.root}/{name}")


class Log:
    """The entries of a queue: which segment holds which places."""

    def __init__(self, folder: Folder) -> None:
        self.starts, self.segments, self.end = [], [], 0
        for name in folder.names("log"):
            for segment, n in json.loads(folder.read(f"log/{name}")):
                self.starts.append(self.end)
                self.segments.append(segment)
                self.end += n

    def slices(self, start: int, end: int) -> list[tuple[str, int, int, int]]:
        """(segment, first line, last line + 1, place of the first) of all messages from ``start`` to ``end``, PER_TASK at most each."""
        out = []
        for i in range(max(0, bisect_right(self.starts, start) - 1), len(self.starts)):
            own, last = self.starts[i], self.starts[i + 1] if i + 1 < len(self.starts) else self.end
            for a in range(max(start, own), min(end, last), PER_TASK):
                out.append((self.segments[i], a - own, min(a + PER_TASK, end, last) - own, a))
        return out


@dataclass
class Slice(InputPartition):
    segment: str
    first: int
    last: int
    place: int
    deliveries: int
    poison: str | None = None


def _lines(path: str, part: Slice | None) -> Iterator[Row]:
    if part is None:  # what Spark hands out where there are no partitions
        return
    folder = Folder(path)
    lines = folder.read(f"segments/{part.segment}").splitlines()[part.first : part.last]
    if part.poison is not None:
        folder.write(f"poison/{part.poison}", "".join(json.dumps([part.place + i, json.loads(line), part.deliveries]) + "\n" for i, line in enumerate(lines)))
        return
    for i, line in enumerate(lines):
        yield Row(place=part.place + i, body=json.loads(line), deliveries=part.deliveries)


class QueueReader(DataSourceReader):
    """All messages of the queue, acknowledged or not, as if delivered for the first time."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        log = Log(Folder(self.path))
        return [Slice(*s, 1) for s in log.slices(0, log.end)]

    def read(self, partition: InputPartition) -> Iterator[Row]:
        return _lines(self.path, partition)


class QueueStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, consumer: str, batch: int, most: int) -> None:
        self.path, self.batch, self.most = path, batch, most
        self.state = f"consumers/{consumer}"
        self.planned: int | None = None
        self.counted: dict[tuple[int, int], int] = {}

    def _acknowledged(self) -> int:
        folder = Folder(self.path)
        return int(folder.read(f"{self.state}/acknowledged")) if folder.has(f"{self.state}/acknowledged") else 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"place": self._acknowledged()}

    def latestOffset(self) -> dict:  # noqa: N802
        """The end of the next batch: ``batch`` messages after what this stream has planned, or else acknowledged, so far."""
        at = self._acknowledged() if self.planned is None else self.planned
        return {"place": min(at + self.batch, max(at, Log(Folder(self.path)).end))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The messages of a batch; its delivery is counted once by each start of the stream, however often it is planned."""
        folder, (a, b) = Folder(self.path), (start["place"], end["place"])
        self.planned = max(b, self.planned or 0)
        if (a, b) not in self.counted:
            name = f"{self.state}/deliveries/{a:020d}-{b:020d}"
            self.counted[a, b] = 1 + (int(folder.read(name)) if folder.has(name) else 0)
            folder.write(name, str(self.counted[a, b]))
        n = self.counted[a, b]
        poisoned = n > self.most
        slices = Log(folder).slices(a, b)
        return [Slice(*s, min(n, self.most), f"{s[3]:020d}" if poisoned else None) for s in slices]

    def read(self, partition: InputPartition) -> Iterator[Row]:
        return _lines(self.path, partition)

    def commit(self, end: dict) -> None:
        folder = Folder(self.path)
        if end["place"] > self._acknowledged():
            folder.write(f"{self.state}/acknowledged", str(end["place"]))
        for name in folder.names(f"{self.state}/deliveries"):
            if int(name.split("-")[1]) <= end["place"]:
                folder.drop(f"{self.state}/deliveries/{name}")


@dataclass
class Segment(WriterCommitMessage):
    name: str
    n: int


class _Writing:
    """Segments by tasks; a commit makes them an entry of the log, an abort leaves none."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        lines = [json.dumps(row[0]) + "\n" for row in iterator]
        name = uuid.uuid4().hex if lines else ""
        if lines:
            Folder(self.path).write(f"segments/{name}", "".join(lines))
        return Segment(name, len(lines))

    def _enter(self, messages: list, key: str) -> None:
        folder, found = Folder(self.path), [(m.name, m.n) for m in messages if m is not None and m.n]
        entries = folder.names("log")
        if found and not any(e.partition("-")[2] == key for e in entries):  # a commit that is repeated changes nothing
            folder.write(f"log/{len(entries):020d}-{key}", json.dumps(found))

    def _undo(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.n:
                Folder(self.path).drop(f"segments/{m.name}")


class QueueWriter(_Writing, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._enter(messages, uuid.uuid4().hex)

    def abort(self, messages: list) -> None:
        self._undo(messages)


class QueueStreamWriter(_Writing, DataSourceStreamWriter):
    def __init__(self, path: str, producer: str) -> None:
        super().__init__(path)
        self.producer = producer

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._enter(messages, f"{self.producer}-{batchId}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._undo(messages)


class MessageQueue(DataSource):
    """Options: path; for streams kind (generation, ingestion or scoring, which sets the next two), batchSize,
    mostDeliveries, and consumer or producer, the name under which progress is kept."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a queue needs a path")
        return self.options["path"].rstrip("/")

    def reader(self, schema: StructType) -> DataSourceReader:
        return QueueReader(self._path())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        kind = self.options.get("kind", "generation")
        batch, most = int(self.options.get("batchsize", FILES_AT_ONCE[kind])), int(self.options.get("mostdeliveries", MOST_DELIVERIES[kind]))
        return QueueStreamReader(self._path(), self.options.get("consumer", "all"), batch, most)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a queue can only be appended to")
        return QueueWriter(self._path())

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return QueueStreamWriter(self._path(), self.options.get("producer", "all"))


def registered(spark: SparkSession) -> None:
    spark.dataSource.register(MessageQueue)


def queue_stream(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """place, body and deliveries of the messages of a queue, as a stream."""
    registered(spark)
    return spark.readStream.format(NAME).options(**options).load(path)


def queue_messages(spark: SparkSession, path: str) -> DataFrame:
    """place, body and deliveries (1) of all messages that a queue has had."""
    registered(spark)
    return spark.read.format(NAME).load(path)


def enqueue(bodies: DataFrame, path: str) -> None:
    """Appends the only column of ``bodies``, text, to a queue, in the order of its rows."""
    registered(bodies.sparkSession)
    bodies.write.format(NAME).mode("append").save(path)


def drained(spark: SparkSession, path: str, work: Callable[[DataFrame, int], None], checkpoint: str, **options: object) -> int:
    """Runs ``work`` (messages, batch number) on a queue's batches until none is left; how often a batch failed.

    A failed batch stops the stream; it starts anew and the batch is delivered again, until it is poisoned.
    """
    failures = 0
    while True:
        seen = []

        def batch(rows: DataFrame, number: int) -> None:
            seen.append(number)
            work(rows, number)

        running = queue_stream(spark, path, **options).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            running.awaitTermination()
        except StreamingQueryException:
            if not seen:  # what failed is not the work
                raise
            failures += 1
            continue
        if not seen:
            return failures


def poisoned(spark: SparkSession, path: str) -> DataFrame:
    """place, body and deliveries of the messages that a queue has given up."""
    folder = Folder(path.rstrip("/"))
    if not folder.names("poison"):
        return spark.createDataFrame([], SCHEMA)
    found = spark.read.text(f"{path.rstrip('/')}/poison").selectExpr("from_json(value, 'array<string>') AS x")
    return found.selectExpr("cast(x[0] AS long) AS place", "x[1] AS body", "cast(x[2] AS int) AS deliveries")
