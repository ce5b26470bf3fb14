"""Approximate nearest neighbours by largest inner product: a graph by NN-descent, searched greedily.

Index, over all rows:

1. Equal vectors become one node, which keeps the ids of least number (one more than is asked for), so any number of
   copies costs one node and no copy is lost to a query. A node carries its vector as 8-bit numbers; one component more
   lifts all vectors to the same length, so that the graph's nearest ones are those of largest inner product.
2. The first lists come from sorted runs: in each of ``tables`` passes nodes are sorted by signs of projections (on
   differences between vectors of a bounded sample) and every run of ``RUN`` nodes is compared within itself.
3. A round of NN-descent joins every node's neighbours and reverse neighbours with the node table, and meets them at the
   node: neighbours of neighbours are compared if one of both is new, and better pairs go into the lists of both ends. A
   node that many others list is met in several parts of at most ``PART`` reverse neighbours each, every part with all
   of its own neighbours. Rounds end when less than ``settled`` of all list entries are new. The graph links every node
   to those of its list and to the nearest of those whose lists it is in.

Search: each query starts at its own node and keeps the ``beam`` best nodes found. A round opens the best unopened ones,
joins their lists, and scores what they name; a query is done when its beam is open throughout. The nodes of the beam are
then scored on the original vectors in double precision and expanded to their ids.

Lists have ``degree`` entries, groups at most ``degree`` + ``PART`` rows, beams ``beam`` rows: memory does not grow with
the data. All tables of a round are written to the shared folder, so a lost executor costs a task.

Cases: vectors that are null, empty, all zero or hold null or non-finite components take no part, nor do rows without id;
a row that repeats both id and vector counts once; vectors of different lengths are never compared; equal scores rank by
id; with fewer candidates than ``k`` all are returned; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable

RUN = 128  #: nodes of a sorted run
OFFERED = 16  #: neighbours that a run offers to each of its nodes
PART = 64  #: reverse neighbours met at once
SAMPLE = 1024  #: vectors that the projections are drawn from
BITS = 32  #: signs of a sort key
EDGES = "a long, b long, s float"


def matrix(column: pa.Array, kind=np.int8) -> np.ndarray:
    """Binary values of one length as rows of numbers."""
    begins = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], kind, (begins[-1] - begins[0]) // np.dtype(kind).itemsize, begins[0]).reshape(len(column), -1)


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch's rows in parts whose binary values in ``column`` have the same length."""
    sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1])
    if not len(sizes) or (sizes == sizes[0]).all():
        yield batch
    else:
        for n in np.unique(sizes):
            yield batch.take(pa.array(np.flatnonzero(sizes == n)))


def best(rows: DataFrame, key: str, other: str, n: int) -> DataFrame:
    """(key, other) pairs of the ``n`` highest ``s`` of each key, repeated pairs once; a pair is new if it was not there before."""
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("s"), other))
    return rows.withColumn("_r", rank).where(F.col("_r") <= n).groupBy(key, other).agg(F.max("s").alias("s"), F.min("new").alias("new"))


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` in the shared folder; the shuffle files that led to it go once both languages have dropped their plans."""
    out = durable(df)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


class Index:
    """Nodes (node, code, scale), their vectors (node, v, sq, ids) and the graph (a, b) of a table of vectors."""

    def __init__(self, nodes: DataFrame, vectors: DataFrame, rows: DataFrame, graph: DataFrame, rounds: int):
        self.nodes, self.vectors, self.rows, self.graph, self.rounds = nodes, vectors, rows, graph, rounds


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _coded(vectors: DataFrame, longest: float) -> DataFrame:
    def code(batches):
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for n in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == n)))
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                x = np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None]], axis=1)
                scale = np.abs(x).max(axis=1) / 127
                codes = np.rint(x / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_pydict({"node": part.column("node"), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "scale": pa.array(scale.astype(np.float32))})

    return vectors.select("node", "v").mapInArrow(code, "node long, code binary, scale float")


def _planes(sample: list[bytes], length: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions between vectors of the sample, and the sample's median along them."""
    draw = np.random.default_rng([table, length])
    x = np.array([np.frombuffer(c, np.int8) for c in sample if len(c) == length], np.float32).reshape(-1, length)
    if len(x) < 2:
        return draw.normal(size=(length, BITS)).astype(np.float32), np.zeros(BITS, np.float32)
    first = draw.integers(0, len(x), BITS)
    second = (first + draw.integers(1, len(x), BITS)) % len(x)
    planes = (x[first] - x[second]).T
    return planes, np.median(x @ planes, axis=0)


def _first_lists(nodes: DataFrame, tables: int) -> DataFrame:
    sample = [bytes(r["code"]) for r in nodes.orderBy(F.xxhash64("node"), "node").select("code").limit(SAMPLE).collect()]

    def keys(batches):
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for part in by_length(batch, "code"):
                x = matrix(part.column("code")).astype(np.float32)
                for t in range(tables):
                    planes, at = _planes(sample, x.shape[1], t)
                    key = (x @ planes > at) @ weights
                    yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(len(x), t, np.int32)), "size": pa.array(np.full(len(x), x.shape[1], np.int32)), "key": key, "node": part.column("node"), "code": part.column("code"), "scale": part.column("scale")})

    def runs(batches):
        for batch in batches:
            group = np.stack([batch.column("t").to_numpy(), batch.column("size").to_numpy()], axis=1)
            cuts = np.r_[0, np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, len(group)]
            node, scale = batch.column("node").to_numpy(), batch.column("scale").to_numpy()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                x = matrix(batch.column("code").slice(lo, hi - lo)).astype(np.float32)
                out = []
                for at in range(0, hi - lo, RUN):
                    at = max(0, min(at, hi - lo - RUN))  # the last run is as long as the others
                    y = x[at : at + RUN]
                    if len(y) < 2:
                        continue
                    w, ids = scale[lo + at : lo + at + len(y)], node[lo + at : lo + at + len(y)]
                    s = (y @ y.T) * (w[:, None] * w[None, :])
                    np.fill_diagonal(s, -np.inf)
                    n = min(OFFERED, len(y) - 1)
                    near = np.argpartition(-s, n - 1, axis=1)[:, :n]
                    out.append((np.repeat(ids, n), ids[near].ravel(), np.take_along_axis(s, near, 1).ravel()))
                if out:
                    a, b, s = map(np.concatenate, zip(*out, strict=True))
                    yield pa.RecordBatch.from_pydict({"a": a, "b": b, "s": pa.array(s.astype(np.float32))})

    cells = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = ["t", "size", "key", "node"]
    keyed = nodes.mapInArrow(keys, "t int, size int, key long, node long, code binary, scale float")
    return keyed.repartitionByRange(cells, *sort).sortWithinPartitions(*sort).mapInArrow(runs, EDGES)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys of a sorted stream; a run may span batches."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        k = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
        cuts = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1]
        yield from (batch.slice(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True))
        held = batch.slice(cuts[-1])
    if held is not None:
        yield held


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours of a node that are better than the worst of either's list."""
    out, waiting = [], 0

    def flush():
        a, b, s = map(np.concatenate, zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_pydict({"a": a, "b": b, "s": pa.array(s)})

    for group in _groups(batches, ["u", "part"]):
        fresh = group.column("new").to_numpy(zero_copy_only=False)
        if not fresh.any():
            continue
        m, first = np.unique(group.column("m").to_numpy(), return_index=True)  # new ones stand first
        fresh, bar = fresh[first], group.column("bar").to_numpy()[first]
        scale, x = group.column("scale").to_numpy()[first], matrix(group.column("code"))[first].astype(np.float32)
        new = np.flatnonzero(fresh)
        s = (x[new] @ x.T) * (scale[new][:, None] * scale[None, :])
        good = (s > np.minimum(bar[new][:, None], bar[None, :])) & (m[new][:, None] != m[None, :])
        i, j = np.nonzero(good)
        i, s = new[i], s[i, j]
        for p, q in ((i, j), (j, i)):
            better = s > bar[p]
            if better.any():
                out.append((m[p[better]], m[q[better]], s[better]))
                waiting += len(out[-1][0])
        if waiting > 200_000:
            yield flush()
            waiting = 0
    if out:
        yield flush()


def _round(nodes: DataFrame, edges: DataFrame, degree: int, turn: int) -> DataFrame:
    """The lists after one round of NN-descent."""
    bars = edges.groupBy(F.col("a").alias("node")).agg(F.when(F.count("*") >= degree, F.min("s")).otherwise(F.lit(float("-inf"))).cast("float").alias("bar"))
    known = nodes.join(bars, "node", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf")).cast("float"))).withColumnRenamed("node", "m")
    listed = edges.groupBy(F.col("b").alias("u")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    own = edges.select(F.col("a").alias("u"), F.col("b").alias("m"), "new").join(listed, "u", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    reverse = edges.select(F.col("b").alias("u"), F.col("a").alias("m"), "new").join(listed, "u", "left").withColumn("part", F.pmod(F.xxhash64("m", F.lit(turn)), parts).cast("int"))
    members = own.drop("parts").unionByName(reverse.drop("parts")).join(known, "m").select("u", "part", "m", "new", "code", "scale", "bar")
    met = members.repartition("u", "part").sortWithinPartitions("u", "part", F.desc("new")).mapInArrow(_meet, EDGES)
    return best(edges.withColumn("new", F.lit(False)).unionByName(met.withColumn("new", F.lit(True))), "a", "b", degree)


def build(embeddings: DataFrame, k: int = 20, degree: int = 48, tables: int = 12, settled: float = 0.1, id_column: str = "vec_id", vector_column: str = "embedding") -> Index:
    """The index of all usable rows, for at most ``k`` neighbours of a query."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))  # cut to k + 1 of a vector in each task, before any shuffle
    vectors = rows.withColumn("_r", least).where(F.col("_r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vectors = written(spark, vectors.withColumn("node", F.monotonically_increasing_id()).withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    longest = vectors.agg(F.max("sq")).first()[0] or 0.0
    nodes = written(spark, _coded(vectors, longest))
    edges = written(spark, best(_first_lists(nodes, tables).withColumn("new", F.lit(True)), "a", "b", degree))
    turn = 0
    while True:
        total, new = edges.agg(F.count("*"), F.count_if("new")).first()
        if new <= settled * total:
            break
        edges = written(spark, _round(nodes, edges, degree, turn))
        turn += 1
    back = best(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "s", "new"), "a", "b", degree)  # a search also walks from a node to those that list it
    return Index(nodes, vectors, rows, written(spark, edges.unionByName(back).select("a", "b").distinct()), turn)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inner products of the vectors' own components (the last one belongs to the graph alone)."""
    for batch in batches:
        for part in by_length(batch, "code"):
            if part.num_rows:
                x, y = (matrix(part.column(c))[:, :-1].astype(np.float32) for c in ("code", "query_code"))
                s = np.einsum("ij,ij->i", x, y) * part.column("scale").to_numpy() * part.column("query_scale").to_numpy()
                yield pa.RecordBatch.from_pydict({"q": part.column("q"), "node": part.column("node"), "s": pa.array(s.astype(np.float32))})


def search(index: Index, queries: DataFrame, k: int = 20, beam: int = 64, opened: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows of each query; ``queries`` (id, v) are rows of the index."""
    spark = queries.sparkSession
    asked = written(spark, queries.join(index.vectors.select("node", "v"), "v").select("id", F.col("node").alias("q")).distinct())
    starts = written(spark, asked.select("q").distinct().join(index.nodes.withColumnRenamed("node", "q"), "q").withColumnsRenamed({"code": "query_code", "scale": "query_scale"}))
    links = index.graph.select(F.col("a").alias("node"), F.col("b").alias("next"))
    found = starts.select("q", F.col("q").alias("node"), F.lit(float("inf")).cast("float").alias("s"), F.lit(True).alias("new"))
    while True:
        order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "node"))
        front = found.where("new").withColumn("_r", order).where(F.col("_r") <= opened).select("q", "node")
        named = front.join(links, "node").select("q", F.col("next").alias("node")).where("q != node").distinct()
        scored = named.join(index.nodes, "node").join(starts, "q").mapInArrow(_scored, "q long, node long, s float")
        shut = found.join(front.withColumn("open", F.lit(True)), ["q", "node"], "left").select("q", "node", "s", (F.col("new") & F.col("open").isNull()).alias("new"))
        found = written(spark, best(shut.unionByName(scored.withColumn("new", F.lit(True))), "q", "node", beam))
        if found.where("new").isEmpty():
            break

    def exact(batches):
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in ("v", "w"))
            sizes = np.diff(batch.column("v").offsets.to_numpy())  # equal in both
            score = np.add.reduceat(x * y, np.r_[0, np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"q": batch.column("q"), "score": score, "ids": batch.column("ids")})

    own = index.vectors.select(F.col("node").alias("q"), F.col("v").alias("w"))
    scored = found.select("q", "node").join(index.vectors.select("node", "v", "ids"), "node").join(own, "q").select("q", "v", "w", "ids").mapInArrow(exact, "q long, score double, ids array<long>")
    each = scored.select("q", "score", F.explode("ids").alias("id"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    nearest = each.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("all"))
    others = F.slice(F.filter("all", lambda x: x["id"] != F.col("query_id")), 1, k)
    return asked.withColumnRenamed("id", "query_id").join(nearest, "q").select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def neighbours(embeddings: DataFrame, k: int = 20, every: int = 20, degree: int = 48, beam: int = 64) -> DataFrame:
    """The ``k`` nearest of all other rows for each row whose vec_id is divisible by ``every``."""
    index = build(embeddings, k, degree)
    return search(index, index.rows.where(F.col("id") % every == 0), k, beam)
