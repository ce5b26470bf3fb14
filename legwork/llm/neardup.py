"""Near-duplicate classes by DartMinHash signatures and banded joining.

Elements are the shingles of ``words`` words of a text (lower case A-Z, parted by
white space; a shorter text is one shingle), weighted by one, by their count or by
1 + ln(count). Hashed darts fall on the region [0, weight) x [0, infinity) of every
element as a Poisson process that depends on the element alone: a hash gives each
dart its height in the weight, its rank and one of ``bands * rows`` coordinates. A
text is hit by about k ln k + 2k darts of the lowest ranks, whatever its weights;
the earliest dart of each coordinate is its signature (the rank bound doubles for
texts that leave a coordinate empty). Two texts agree in a coordinate with a
probability equal to their weighted Jaccard similarity.

1. Equal texts (by MD5) are one node, so copies cost no pairs.
2. Bands of ``rows`` coordinates meet by hash. First every node is set against the
   least node alone of each bucket of two neighbouring bands, where hardly any but
   near copies meet; this makes one class of most of a large group of them, and
   settles nothing else.
3. Then all pairs of nodes of different classes that share a bucket are compared: a
   bucket's nodes are dealt into chunks of about CHUNK, every two chunks of a bucket
   meet in a task, each pair in the first of its common bands. Pairs whose signatures
   agree in a share of ``similarity`` less SLACK of the coordinates are compared
   exactly on their shingles there, unless links found in the task already join
   their classes; only links leave it. So every pair that shares a band and passes
   the signature's bar is compared exactly, or is of one class by other links. No
   pair is dropped, and none is written out.
4. Links give classes by minimum labels with pointer jumping; later links join
   classes, so only the classes' own small graph is worked on.

A bucket of n nodes that agree in a band but are unlike costs n * n / CHUNK rows
and n * n / 2 signature comparisons inside tasks.

Nothing is collected; stages that are read again are written to the shared folder.

Cases: null text counts as empty; texts without words are alike only if equal;
repeated rows are copies; null ids are rows like others; an empty table gives an
empty result; extra columns are ignored by ``classes`` and kept by ``distinct``,
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, free, slices
from .words import MULTIPLIER, Slice, mixed, rolling

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Over four standard deviations of the estimate from 144 coordinates at a similarity of 0.8.
SLACK = 0.16
#: Nodes of a bucket that are worked on in one task against others.
CHUNK = 256


class Darts:
    """Signatures of ``k`` coordinates."""

    def __init__(self, k: int):
        self.k = k
        self.target = k * math.log(k) + 2 * k

    def throw(self, text: np.ndarray, cell: np.ndarray, height: np.ndarray, n: int) -> np.ndarray:
        """Earliest dart (rank bits, number) by text and coordinate.

        text, cell, height: for each unit of weight its text (ascending), a hash of
        element and unit, and how much of the unit the weight fills (1 but for a last part).
        """
        out = np.full(n * self.k, np.iinfo(np.uint64).max, np.uint64)
        weight = np.bincount(text, weights=height, minlength=n)
        bound = self.target / np.maximum(weight, 1e-9)
        todo = np.ones(len(text), bool)
        while todo.any():
            owner, key, top = text[todo], cell[todo], height[todo]
            limit, rank, step = bound[owner], np.zeros(len(owner)), 0
            while len(owner):
                key = mixed(key + MULTIPLIER)
                rank = rank - np.log1p(-(key >> np.uint64(11)).astype(np.float64) * 2.0**-53)
                go = rank <= limit
                owner, key, top, limit, rank = owner[go], key[go], top[go], limit[go], rank[go]
                place = mixed(key ^ MULTIPLIER)
                inside = (place >> np.uint64(40)).astype(np.float64) * 2.0**-24 < top
                at = owner[inside] * self.k + ((place[inside] & np.uint64(0xFFFFFF)) % np.uint64(self.k)).astype(np.int64)
                dart = rank[inside].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | key[inside] >> np.uint64(32)
                np.minimum.at(out, at, dart)
                step += 1
            empty = (out.reshape(n, self.k) == np.iinfo(np.uint64).max).any(1) & (weight > 0)
            bound = bound * 2
            todo = empty[text]
        return out.reshape(n, self.k)


def shingles(column, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, shingle hash) of all shingles of a string column, and the number of texts."""
    part = Slice(column, LOWER)
    begins = part.begins
    n = len(begins) - 1
    hashes, ok = part.runs(words)
    text = np.repeat(np.arange(n), np.diff(begins))[: len(hashes)][ok]
    hashes = hashes[ok]
    sizes = np.diff(begins)
    few = np.flatnonzero((sizes > 0) & (sizes < words))
    if len(few):
        whole = np.array([rolling(part.numbers[begins[i] : begins[i + 1]], int(sizes[i]))[0] for i in few.tolist()], np.uint64)
        text, hashes = np.concatenate([text, few]), np.concatenate([hashes, whole])
        order = np.argsort(text, kind="stable")
        text, hashes = text[order], hashes[order]
    return text, hashes, n


def weighted(text: np.ndarray, hashes: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, height) of the units of weight: the n-th unit of an element is a cell of its own, the last may be filled in part."""
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(text)])))
    text, hashes = text[first], hashes[first]
    if weights == "one":
        return text, hashes, np.ones(len(text))
    weight = count.astype(float) if weights == "count" else 1 + np.log(count)
    units = np.ceil(weight).astype(np.int64)
    nth = np.arange(int(units.sum())) - np.repeat(np.cumsum(units) - units, units)
    height = np.minimum(1.0, np.repeat(weight, units) - nth)
    return np.repeat(text, units), mixed(np.repeat(hashes, units) + nth.astype(np.uint64) * MULTIPLIER), height


def signatures(texts: DataFrame, words: int, bands: int, rows: int, weights: str) -> DataFrame:
    """node, band hashes and 8-bit coordinates for the rows of ``texts`` (node, text) that have a word; equal nodes of a slice give one row."""
    kind = dict(texts.dtypes)["node"]

    def run(batches):
        darts = Darts(bands * rows)
        for batch in slices(batches, rows=256, size=512 << 10):
            if kind == "binary":
                first = dict((n, i) for i, n in reversed(list(enumerate(batch.column("node").to_pylist()))))
                batch = batch.take(pa.array(sorted(first.values())))
            text, hashes, n = shingles(batch.column("text"), words)
            text, cell, height = weighted(text, hashes, weights)
            got = darts.throw(text, cell, height, n)
            some = np.flatnonzero(np.bincount(text, minlength=n) > 0)
            got = got[some].reshape(len(some), bands, rows)
            band = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(some), bands))
            for r in range(rows):
                band = mixed(band * MULTIPLIER + got[:, :, r])
            coordinates = mixed(got.reshape(len(some), bands * rows)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node").take(pa.array(some)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(band.astype(np.int64).ravel())),
                    pa.array([c.tobytes() for c in coordinates], pa.binary()),
                ],
                ["node", "bands", "signature"],
            )

    return texts.select("node", "text").mapInArrow(run, f"node {kind}, bands array<long>, signature binary")


def profiles(texts: DataFrame, words: int, weights: str) -> DataFrame:
    """node, cells (sorted hashes of the units of weight) and heights (empty where all are 1) of ``texts`` (node, text)."""

    def run(batches):
        for batch in slices(batches, rows=256, size=1 << 20):
            text, hashes, n = shingles(batch.column("text"), words)
            text, cell, height = weighted(text, hashes, weights)
            order = np.lexsort((cell, text))
            cell, height = cell[order], height[order].astype(np.float32)
            at = np.searchsorted(text, np.arange(n + 1))
            some = [slice(a, b) for a, b in zip(at, at[1:], strict=False)]
            heights = [height[p].tobytes() if weights == "log" else b"" for p in some]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([cell[p].tobytes() for p in some], pa.binary()), pa.array(heights, pa.binary())], ["node", "cells", "heights"])

    return texts.select("node", "text").mapInArrow(run, "node long, cells binary, heights binary")


class Profile:
    """The shingles of many nodes: cells and heights of each."""

    def __init__(self, cells: list[bytes], heights: list[bytes]):
        self.cells = [np.frombuffer(c, np.uint64) for c in cells]
        self.heights = [np.frombuffer(h, np.float32) if h else np.ones(len(c), np.float32) for c, h in zip(self.cells, heights, strict=True)]
        self.total = np.array([h.sum(dtype=np.float64) for h in self.heights])

    def similar(self, k: int, others: np.ndarray, similarity: float, right: Profile | None = None) -> np.ndarray:
        """Whether the k-th node's (weighted) Jaccard similarity with each of ``others`` (of ``right``) is at least ``similarity``."""
        right, own = right or self, self.cells[k]
        sizes = np.array([len(right.cells[o]) for o in others])
        if not len(own) or not sizes.sum():
            return np.zeros(len(others), bool)
        every = np.concatenate([right.cells[o] for o in others])
        at = np.searchsorted(own, every)
        at[at == len(own)] = 0
        both = np.where(own[at] == every, np.minimum(self.heights[k][at], np.concatenate([right.heights[o] for o in others])), 0.0)
        sums = np.concatenate(([0.0], np.cumsum(both, dtype=np.float64)))
        end = np.cumsum(sizes)
        shared = sums[end] - sums[end - sizes]
        return (shared > 0) & (shared >= similarity * (self.total[k] + right.total[others] - shared) - 1e-6)


def alike(pairs: DataFrame, similarity: float, least: float) -> DataFrame:
    """a, b of the pairs (a, b, with x_ and y_ signature, cells and heights) that are similar, by signature and exactly."""

    def run(batches):
        for batch in slices(batches, rows=1024):
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x_signature", "y_signature"))
            batch = batch.filter(pa.array((left == right).mean(1) >= least))
            x, y = (Profile(batch.column(f"{p}_cells").to_pylist(), batch.column(f"{p}_heights").to_pylist()) for p in "xy")
            keep = [bool(x.similar(i, np.array([i]), similarity, y)[0]) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of the connected component of each node in links (a, b)."""
    edges = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        # pointer jumping: a label's own label
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = durable(step.join(jump, "new", "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        changed = step.where("new <> label").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def to_leaders(found: DataFrame) -> DataFrame:
    """(a, b): each node (node, bands) with the least node of its buckets of two neighbouring bands."""
    pair = F.transform(F.sequence(F.lit(1), F.size("bands") - 1), lambda i: F.xxhash64(F.element_at("bands", i), F.element_at("bands", i + 1)))
    rows = found.select("node", F.explode(F.when(F.size("bands") > 1, pair).otherwise(F.col("bands"))).alias("band"))
    heads = rows.groupBy("band").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(heads, "band").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()


def opened(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(band, node, label, n) of the buckets that hold more than one class, with their size."""
    if labels is None:
        rows = rows.withColumn("label", F.col("node"))
    else:
        rows = rows.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    several = rows.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("band", "n")
    return rows.join(several, "band")


class Forest:
    """Classes joined so far in a task."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x


def compared(group: dict, similarity: float, least: float, forest: Forest) -> list[tuple[int, int]]:
    """New links between the two chunks of a bucket: ``group`` has its rows as arrays."""
    node, label, at, signature, bands = (group[c] for c in ("node", "label", "at", "signature", "bands"))
    i, j = group["i"][0], group["j"][0]
    left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
    if not len(left) or not len(right) or (label == label[0]).all():
        return []
    own = int(np.argmax(bands[0] == np.uint32(int(group["band"][0]) & 0xFFFFFFFF)))
    cells, out = None, []
    for k in left.tolist():
        others = right[label[right] != label[k]]
        if i == j:
            others = others[node[others] > node[k]]
        if len(others):
            others = others[(signature[others] == signature[k]).mean(1) >= least]
        if len(others) and own:  # pairs that an earlier band compares
            others = others[~(bands[others, :own] == bands[k, :own]).any(1)]
        if not len(others):
            continue
        root = forest.root(int(label[k]))
        others = others[[forest.root(x) != root for x in label[others].tolist()]]
        if not len(others):
            continue
        cells = cells or Profile(group["cells"], group["heights"])
        for o in others[cells.similar(k, others, similarity)].tolist():
            a, b = forest.root(int(label[k])), forest.root(int(label[o]))
            if a != b:
                forest.parent[max(a, b)] = min(a, b)
                out.append((int(node[k]), int(node[o])))
    return out


def across(rows: DataFrame, marks: DataFrame, similarity: float, least: float) -> DataFrame:
    """(a, b): links between nodes of different classes that share a bucket, enough of them to join all classes that such links join.

    ``rows`` are (band, node, label, n), ``marks`` (node, bands, signature, cells, heights). A bucket's nodes are dealt
    into chunks by a hash, every two chunks meet once.
    """
    chunks = F.ceil(F.col("n") / CHUNK)
    dealt = rows.withColumn("at", F.pmod(F.xxhash64("node"), chunks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    met = dealt.select("band", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), "at", "node", "label").join(marks, "node")
    met = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    plain = ("band", "i", "j", "at", "node", "label")

    def arrays(batch) -> dict:
        out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in plain}
        out["signature"] = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        bands = batch.column("bands")
        out["bands"] = bands.flatten().to_numpy(zero_copy_only=False).astype(np.uint64).astype(np.uint32).reshape(batch.num_rows, -1)
        return out | {c: batch.column(c).to_pylist() for c in ("cells", "heights")}

    def joined_up(parts: list[dict]) -> dict:
        return {c: sum((p[c] for p in parts), []) if isinstance(parts[0][c], list) else np.concatenate([p[c] for p in parts]) for c in parts[0]} if len(parts) > 1 else parts[0]

    def run(batches):
        forest, held = Forest(), None  # rows of the group that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            got = arrays(batch) if held is None else joined_up([held, arrays(batch)])
            band, i, j = got["band"], got["i"], got["j"]
            new = (np.flatnonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()
            found = []
            for a, b in zip([0, *new], new, strict=False):
                found += compared({c: v[a:b] for c, v in got.items()}, similarity, least, forest)
            held = {c: v[new[-1] if new else 0 :] for c, v in got.items()}
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        if held is not None:
            found = compared(held, similarity, least, forest)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 6, weights: str = "one") -> tuple[DataFrame, DataFrame] | None:
    """(node, id) of the nodes that share a bucket and (node as id, label) of those in classes of more than one; None without any.

    ``nodes`` are (node binary, text); equal nodes are equal texts.
    """
    found = durable(signatures(nodes, words, bands, rows, weights).groupBy("node").agg(F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature")))
    every = found.select("node", F.explode("bands").alias("band"))
    shared = every.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    shared = durable(every.join(shared, "band"))
    # numbers for nodes, fixed by being written
    ids = durable(shared.select("node").distinct().select("node", F.monotonically_increasing_id().alias("id")))
    if ids.limit(1).count() == 0:
        return None
    buckets = durable(shared.join(ids, "node").select("band", F.col("id").alias("node")))
    # the nodes grow with the documents: merged at every size
    texts = nodes.join(ids.hint("merge"), "node").groupBy(F.col("id").alias("node")).agg(F.any_value("text").alias("text"))
    marks = found.join(ids, "node").select(F.col("id").alias("node"), "bands", "signature")
    marks = durable(marks.join(profiles(texts, words, weights), "node"))

    def with_both(pairs: DataFrame) -> DataFrame:
        side = lambda key, p: marks.select(F.col("node").alias(key), *(F.col(c).alias(f"{p}_{c}") for c in ("signature", "cells", "heights")))
        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")

    least = similarity - SLACK
    labels = components(durable(alike(with_both(to_leaders(marks)), similarity, least)))
    return ids, joined(labels, durable(across(opened(buckets, labels), marks, similarity, least)))


def joined(labels: DataFrame, new: DataFrame) -> DataFrame:
    """The classes (node, label) after new links (a, b) between them: only the classes' own graph is worked on."""
    if new.limit(1).count() == 0:
        return labels
    own = lambda key: labels.select(F.col("node").alias(key), F.col("label").alias(f"l{key}"))
    named = new.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = durable(components(named.where("a <> b")).select(F.col("node").alias("label"), F.col("label").alias("to")))
    known = labels.unionByName(merged.select(F.col("label").alias("node"), "label").join(labels.select("node"), "node", "left_anti"))
    return durable(known.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def text_node():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 6, weights: str = "one") -> DataFrame:
    """One row for each document: doc_id, class_id (a text), representative (least doc_id of the class), node (MD5 of the text)."""
    nodes = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_node().alias("node"))
    found = links(nodes.select("node", "text"), words, similarity, bands, rows, weights)
    ids = nodes.select("doc_id", "node")
    least = ids.groupBy("node").agg(F.min("doc_id").alias("first"))
    if found is None:
        placed = least.select("node", F.lower(F.hex("node")).alias("class_id"), F.col("first").alias("representative"))
    else:
        numbers, labels = found
        own = least.join(numbers.join(labels.withColumnRenamed("node", "id"), "id").select("node", "label"), "node", "left")
        own = durable(own.select("node", "first", F.lower(F.hex("node")).alias("name"), "label"))
        heads = own.where("label is not null").groupBy("label").agg(F.min("name").alias("class_id"), F.min("first").alias("representative"))
        placed = own.join(heads, "label", "left").select("node", F.coalesce("class_id", "name").alias("class_id"), F.when(F.col("class_id").isNull(), F.col("first")).otherwise(F.col("representative")).alias("representative"))
    return ids.join(placed, "node").select("doc_id", "class_id", "representative", "node")


def distinct(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, the one of least doc_id; all columns kept. Of rows with that id, one stays."""
    placed = durable(classes(docs, **options))
    kept = placed.where("doc_id <=> representative").groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n"), F.min("class_id").alias("class_id"))
    # one node for each class: rows of equal id but different texts of a class
    one = kept.groupBy("class_id").agg(F.min(F.struct("doc_id", "node", "n")).alias("x")).select("x.*")
    inner = [f"c{i}" for i in range(len(docs.columns))]  # the input's own names may clash with those of the join
    marked = docs.withColumn(free(docs.columns, "node"), text_node()).toDF(*inner, "node").withColumn("doc_id", F.col(inner[docs.columns.index("doc_id")]))
    right = one.select(F.col("doc_id").alias("id"), F.col("node").alias("at"), "n")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("node") == F.col("at"))
    once = marked.join(right.where("n = 1"), same, "left_semi")
    more = marked.join(right.where("n > 1"), same, "left_semi").dropDuplicates(["doc_id", "node"])
    return once.unionByName(more).select(*(F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True)))
