"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexolith.sources.shared import shared_folder
from lexolith.sources.tables import table  # noqa: F401


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Stored:
    """A frame written as a table in the shared folder, more compact than a checkpoint, until it is dropped."""

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


_kept: tuple = (None, None)


def kept(name: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this worker process between tasks until another operator keeps something under another name.

    So what an operator remembers serves all its tasks, and is gone when the next operator runs.
    """
    global _kept
    if _kept[0] != name:
        _kept = (None, None)  # frees the old one first
        give_back()
        _kept = (name, make())
    return _kept[1]


def give_back() -> None:
    """Gives memory that this process no longer uses back to the machine: allocators keep it otherwise, for each worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[None]:
    """Settings of the session, dots written as __, that hold inside a with statement."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def free_name(wanted: str, *taken: DataFrame | list[str]) -> str:
    """``wanted`` with as many underscores in front as no column of ``taken`` is called so, whatever its case."""
    names = {c.lower() for t in taken for c in (t if isinstance(t, list) else t.columns)}
    while wanted.lower() in names:
        wanted = "_" + wanted
    return wanted
