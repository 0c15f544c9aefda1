"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, or that of ``spark.checkpoint.dir``.

    Only a local session, as in tests, may fall back to a temporary folder: on a cluster other machines could not read it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lexolith-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def new_place(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "rows") -> DataFrame:
    """``df`` written to the shared folder as a table and read from there, so that what reads it again works nothing out anew."""
    path = new_place(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
