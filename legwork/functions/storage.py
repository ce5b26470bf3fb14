"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process's tables by context, deleted when it ends.
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, on one machine alone, a new temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A folder of its own in the shared one, deleted when the process ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, folder))
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, and its size is known to the planner.

    (Sizes of checkpointed frames are estimates that multiply with every join of an iteration.) The table is deleted when
    the process ends, or by ``discard`` as soon as nothing reads it any more: results that are read later may need it.
    """
    spark = df.sparkSession
    folder = new_folder(spark)
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._stored_in = folder
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the tables of stored frames that no frame will read again: those of an iteration's last round, once the next is stored."""
    for frame in frames:
        folder = getattr(frame, "_stored_in", None)
        if folder and (entry := (frame.sparkSession, folder)) in _written:
            _written.remove(entry)
            _delete(*entry)


def _delete(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def delete_stored() -> None:
    """Deletes the tables that this process has stored; frames that read them can't be used any more."""
    while _written:
        _delete(*_written.pop())


atexit.register(delete_stored)
