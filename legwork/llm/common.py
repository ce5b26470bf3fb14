"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legwork.functions.storage import stored as durable  # noqa: F401  used by the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(column: pa.ChunkedArray | pa.Array) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes of a string column end to end and the n + 1 places where its values begin; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = column.fill_null("").cast(pa.large_binary())
    begins = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    body = array.buffers()[2]
    if body is None or not len(array):
        return b"", np.zeros(len(array) + 1, np.int64)
    return body[begins[0] : begins[-1]].to_pybytes(), begins - begins[0]


def slices(batches, rows: int = 512, size: int = 4 << 20):
    """Arrow batches cut into slices of at most ``rows`` rows and about ``size`` bytes, so that a task's memory is bounded."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            part = batch.slice(at, n)
            while n > 1 and part.get_total_buffer_size() and part.nbytes > size:
                n = max(1, n // 2)
                part = batch.slice(at, n)
            yield part
            at += n


_held: dict[tuple, object] = {}


def held(key: tuple, make):
    """This worker's large object (an encoder): made once and kept between tasks, until a task needs another one."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drops what this worker has kept: it serves the tasks of many stages, and an earlier stage's object must not stay beside a model."""
    if _held:
        _held.clear()
        gc.collect()


def text_crc(column: str = "doc_id"):
    """crc32 of a column's text form, as the folds of the queries use it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def hashed_sample(rows: DataFrame, total: int, n: int) -> DataFrame:
    """The ``n`` of ``total`` rows that come first by a hash of doc_id (ties by doc_id), found without sending n rows from every task.

    Only hashes below a bound that about 8 n rows pass are ordered; with fewer than 8 n rows all are.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    bound = (1 << 30) if total <= 8 * n else -(-(8 * n << 30) // total)
    return rows.where(place < bound).orderBy(place, "doc_id").limit(n)


def free(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so (names differ by more than their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
