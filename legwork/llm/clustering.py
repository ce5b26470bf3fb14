"""Centroid clustering (Lloyd's rounds in whole numbers) by scalar lookup tables.

1. One pass turns every kept vector into integers, floor(scale * x), and writes blocks of at most ``BLOCK`` vectors: for
   each dimension the sorted list of the integers that occur in the block, and for each vector the places of its
   components in those lists.
2. A round reads the blocks. For each dimension, occurring integer and centroid it tabulates the squared difference; a
   vector's distances are then gathers from these tables and their sum. A task sends one row of sums for each cluster,
   Spark adds them up, and k * dims whole numbers come to the driver, whatever the data.
3. After the last round vectors are assigned once more.

A table has at most as many rows as its block has vectors, so memory is bounded whatever values occur, and no list of
all values is gathered. All sums are exact; nothing depends on the order of rows, so a task may run again anywhere.

Cases: vectors that are null, of another length, or with null or non-finite components are left out; repeated rows count
each; equal distances take the smaller number; a centroid without vectors stays. Start vectors are those of least hash of
their id; null ids come after all others and equal ids in order of components. With fewer than k kept vectors there are
fewer centroids; no kept vector gives an empty result. Integers beyond 2**27 could overflow a long distance and raise
an ``OverflowError``. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, slices

#: Vectors of a block; places in its lists fit in 16 bits.
BLOCK = 4096
#: Largest integer whose squared differences, summed over 256 dimensions, fit in a long.
LARGEST = 1 << 27

BLOCKS = "ids array<long>, sizes binary, lists binary, places binary"


def integers(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the kept vectors of a list column, and floor(scale * x) of their components."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # null becomes NaN
    whole = np.isfinite(x).all(axis=1)
    v = np.floor(scale * x[whole])
    if v.size and np.abs(v).max() > LARGEST:
        raise OverflowError(f"a component is beyond {LARGEST} after scaling: distances would not fit in a long")
    return rows[whole], v.astype(np.int64)


def encoded(ids: list, v: np.ndarray) -> dict:
    """A block: for each dimension its occurring integers, and where each vector's component stands among them."""
    lists, places = zip(*(np.unique(v[:, d], return_inverse=True) for d in range(v.shape[1])), strict=True)
    return {"ids": ids, "sizes": np.array([len(u) for u in lists], np.int32).tobytes(), "lists": np.concatenate(lists).tobytes(), "places": np.concatenate(places).astype(np.uint16).tobytes()}


class Block:
    """A stored block of vectors."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        sizes = np.frombuffer(row["sizes"], np.int32)
        self.lists = np.split(np.frombuffer(row["lists"], np.int64), np.cumsum(sizes)[:-1])
        self.places = np.frombuffer(row["places"], np.uint16).reshape(len(sizes), -1)

    def vectors(self) -> np.ndarray:
        return np.stack([u[p] for u, p in zip(self.lists, self.places, strict=True)], axis=1)

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distances to all centroids: one table a dimension, gathered and summed."""
        total = np.zeros((self.places.shape[1], len(centroids)), np.int64)
        for u, p, c in zip(self.lists, self.places, centroids.T, strict=True):
            table = (u[:, None] - c[None, :]) ** 2
            total += table[p]
        return total


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("lists", pa.binary()), ("places", pa.binary())])
    for part in slices(batches, BLOCK, 64 << 20):
        rows, v = integers(part.column(1), dims, scale)
        if len(rows):
            yield pa.RecordBatch.from_pylist([encoded(part.column(0).take(pa.array(rows)).to_pylist(), v)], schema)


def _stored_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch.slice(i, 1).to_pylist()[0])


def start_vectors(blocks: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of least sha256 of ``seed:id``; each task offers its own k."""

    def least(batches):
        best: list[tuple] = []
        for b in _stored_blocks(batches):
            hashes = ["~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in b.ids]  # ~ sorts after all digits
            some = heapq.nsmallest(k, set(hashes))
            chosen = [j for j, h in enumerate(hashes) if h <= some[-1]] if len(some) == k else range(len(hashes))
            v = b.vectors()
            best = heapq.nsmallest(k, [*best, *heapq.nsmallest(k, ((hashes[j], v[j].tolist()) for j in chosen))])
        yield pa.RecordBatch.from_pydict({"hash": [h for h, _ in best], "vector": pa.array([v for _, v in best], pa.list_(pa.int64()))})

    found = blocks.mapInArrow(least, "hash string, vector array<long>").orderBy("hash", "vector").limit(k).collect()
    return np.array([r["vector"] for r in found], np.int64)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor(sum / count) of their vectors; those without vectors stay."""

    def sums(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in _stored_blocks(batches):
            nearest, v = b.distances(centroids).argmin(axis=1), b.vectors()
            count += np.bincount(nearest, minlength=len(centroids))
            for c in np.unique(nearest):
                total[c] += v[nearest == c].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(len(count)), pa.int32()), "n": count, "total": pa.array(total.tolist(), pa.list_(pa.int64()))})

    rows = blocks.mapInArrow(sums, "cluster int, n long, total array<long>").where("n > 0")
    parts = rows.select("cluster", "n", F.posexplode("total").alias("dim", "s")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = centroids.copy()
    for r in parts.collect():  # k * dims rows
        out[r["cluster"], r["dim"]] = r["s"] // r["n"]
    return out


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every kept vector, and the final centroids."""
    blocks = durable(embeddings.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).mapInArrow(lambda b: _blocks(b, dims, scale), BLOCKS))
    centroids = start_vectors(blocks, k, seed)
    if not len(centroids):
        return blocks.selectExpr("0L as id", "0 as cluster", "0L as distance").where("false"), np.zeros((0, dims), np.int64)
    for _ in range(rounds):
        centroids = moved(blocks, centroids)

    def assigned(batches):
        for b in _stored_blocks(batches):
            d = b.distances(centroids)
            nearest = d.argmin(axis=1)  # the first of equal ones
            yield pa.RecordBatch.from_pydict({"id": pa.array(b.ids, pa.int64()), "cluster": pa.array(nearest, pa.int32()), "distance": d[np.arange(len(d)), nearest]})

    return durable(blocks.mapInArrow(assigned, "id long, cluster int, distance long")), centroids


def digests(centroids: np.ndarray) -> list[str]:
    """sha256 of each centroid's components as decimal integers joined by commas."""
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]


def report(embeddings: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = cluster(embeddings, k, rounds, dims, scale, seed)
    spark = embeddings.sparkSession
    inertia = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    facts = spark.createDataFrame([(c, s, sum(inertia.values()), digests(centroids)[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.withColumnRenamed("id", "vec_id").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
