"""Boosted regression trees of many settings and folds grown together: a pass over binned rows serves one level of all of them.

Every task adds up counts and sums of its rows by node, feature and bin; Spark adds up the tasks by node, and the driver
chooses splits from one small table for each open node. What is read is the binned table, once for each level, however
many settings and folds there are. The method is that of Spark's GBTRegressor with squared loss (same gains, leaves, steps);
rows are drawn by a hash and features by the node's number, so the draws don't depend on the layout of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wide import _mixed

#: Steps of the quantiles from which bins are made; a number with at most ``maxBins`` values among them has a bin for each.
STEPS = 1000


def settled(estimator: object) -> tuple | None:
    """The step and the other parameters of a GBTRegressor, apart from its trees; None for an estimator that must be fitted by itself."""
    if not isinstance(estimator, GBTRegressor) or estimator.getLossType() != "squared" or estimator.isDefined("weightCol") or estimator.isDefined("validationIndicatorCol"):
        return None
    e = estimator
    if e.getMaxBins() > 256 or e.getMinWeightFractionPerNode() > 0:
        return None
    return e.getStepSize(), (e.getMaxDepth(), e.getSubsamplingRate(), e.getFeatureSubsetStrategy(), e.getSeed(), e.getMinInstancesPerNode(), e.getMinInfoGain(), e.getMaxBins())


def subset_size(strategy: str, count: int) -> int:
    """How many of ``count`` features a node may split by."""
    named = {"auto": count, "all": count, "sqrt": math.ceil(math.sqrt(count)), "log2": max(1, math.ceil(math.log2(count))), "onethird": math.ceil(count / 3)}
    if strategy.lower() in named:
        return named[strategy.lower()]
    return min(count, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * count)


class Binned:
    """Blocks of some thousand rows, one record each, as moving single rows to Python costs more than counting them.

    A block has the bytes of ``bins`` (features by rows, a byte each), ``y``, ``year`` and ``hash``, and the years that lack a
    target in it (``lacks``). ``sizes`` are the bins of each feature, ``categories`` tells which are categories.
    """

    def __init__(self, rows: DataFrame, sizes: list[int], categories: list[bool]):
        self.rows, self.sizes, self.categories = rows, sizes, categories


def binned(prepared: PipelineModel, rows: DataFrame, first: DataFrame, year: str, target: str, bins: int) -> Binned:
    """Bins of the columns that ``prepared`` (by ``models.tree_stages``) assembles, from quantiles over ``first``; the hash is over all columns of ``rows``."""
    names = prepared.stages[-1].getInputCols()
    levels = {c: len(v) + 1 for s in prepared.stages if hasattr(s, "labelsArray") for c, v in zip(s.getOutputCols(), s.labelsArray, strict=True)}  # and one for others
    if most := [c for c, v in levels.items() if v > bins]:
        raise ValueError(f"more levels than bins: {most}")
    numbers = [c for c in names if c not in levels]
    steps = F.array(*(F.lit(i / STEPS) for i in range(STEPS + 1)))
    cuts: dict[str, np.ndarray] = {}
    if numbers:
        ends = [a for i, c in enumerate(numbers) for a in (F.percentile_approx(c, steps, 10_000).alias(f"q{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"))]
        found = prepared.transform(first).agg(*ends).first()
        for i, c in enumerate(numbers):
            seen = np.array([found[f"a{i}"], *(found[f"q{i}"] or []), found[f"b{i}"]], float)
            values = np.unique(seen[~np.isnan(seen)])
            if len(values) > bins:
                values = np.unique(seen[np.linspace(0, len(seen) - 1, bins).round().astype(int)])
            cuts[c] = (values[:-1] + values[1:]) / 2

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.empty((len(names), batch.num_rows), np.uint8)
            for j, c in enumerate(names):
                v = batch.column(c).to_numpy(zero_copy_only=False)
                x[j] = np.searchsorted(cuts[c], v) if c in cuts else v
            y, when, h = (batch.column(c).to_numpy(zero_copy_only=False).astype(k) for c, k in (("y", np.float64), ("year", np.int32), ("hash", np.int64)))
            lacks = np.unique(when[np.isnan(y)]).tolist()
            yield pa.RecordBatch.from_pydict({"bins": [x.tobytes()], "y": [y.tobytes()], "year": [when.tobytes()], "hash": [h.tobytes()], "lacks": pa.array([lacks], pa.list_(pa.int32()))})

    wide = prepared.transform(rows.withColumn("_hash", F.xxhash64(*rows.columns)))
    wide = wide.select(*(F.col(c).cast("double").alias(c) for c in names), F.col(target).cast("double").alias("y"), F.col(year).cast("int").alias("year"), F.col("_hash").alias("hash"))
    blocks = wide.mapInArrow(pack, "bins binary, y binary, year binary, hash binary, lacks array<int>")
    return Binned(blocks, [levels.get(c) or len(cuts[c]) + 1 for c in names], [c in levels for c in names])


class Tree:
    """Nodes in the order they were made: feature (-1: a leaf), first child, bins that go there, mean; ``open`` are those to split next."""

    def __init__(self, bins: int):
        self.feature, self.child, self.left, self.value = np.array([-1]), np.array([0]), np.ones((1, bins), bool), np.zeros(1)
        self.depth, self.open = 0, [0]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The node of each row (``x``: features by rows)."""
        node, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        for _ in range(self.depth):
            f = self.feature[node]
            node = np.where(f < 0, node, self.child[node] + ~self.left[node, x[f, rows]])
        return node

    def split(self, found: dict[int, np.ndarray], data: Binned, settings: tuple, number: int) -> None:
        """Splits the open nodes by their sums (node: counts and sums by feature and bin) where that gains; their children are open if they may be split."""
        depth, _, strategy, seed, least, gain, _ = settings
        opened, width = [], self.left.shape[1]
        for node in self.open:
            n, s = found[node] if node in found else np.zeros((2, len(data.sizes), width))
            size, total = n[0].sum(), s[0].sum()
            if not size:
                continue
            if node == 0:
                self.value[0] = total / size
            chosen, best = range(len(data.sizes)), None
            k = subset_size(strategy, len(data.sizes))
            if k < len(data.sizes):
                chosen = sorted(np.random.default_rng([seed % 2**32, number, node]).choice(len(data.sizes), k, replace=False))
            for f in chosen:
                count, add = n[f, : data.sizes[f]], s[f, : data.sizes[f]]
                order = np.arange(len(count))
                if data.categories[f]:
                    order = np.argsort(np.divide(add, count, out=np.full(len(add), np.inf), where=count > 0), kind="stable")
                a, b = np.cumsum(count[order])[:-1], np.cumsum(add[order])[:-1]
                ok = (a >= max(least, 1)) & (size - a >= max(least, 1))
                if ok.any():
                    gains = np.full(len(a), -np.inf)
                    gains[ok] = (b[ok] ** 2 / a[ok] + (total - b[ok]) ** 2 / (size - a[ok]) - total**2 / size) / size
                    i = int(gains.argmax())
                    if best is None or gains[i] > best[0]:
                        best = gains[i], f, order[: i + 1], a[i], b[i]
            if best is None or best[0] < gain or best[0] <= 1e-12 * (total / size) ** 2:
                continue
            _, f, bins, count, add = best
            at = len(self.feature)
            self.feature[node], self.child[node], self.left[node] = f, at, np.isin(np.arange(width), bins)
            self.feature, self.child = np.append(self.feature, [-1, -1]), np.append(self.child, [0, 0])
            self.left, self.value = np.vstack([self.left, np.ones((2, width), bool)]), np.append(self.value, [add / count, (total - add) / (size - count)])
            opened += [at, at + 1]
        self.depth += bool(opened)
        self.open = opened if self.depth < depth else []


class Fit:
    """One setting in one fold: the years it learns from, the year it is measured on, its trees so far and how many it shall have."""

    def __init__(self, name: str, step: float, settings: tuple, past: list[int], now: int):
        self.name, self.settings, self.step, self.past, self.now = name, settings, step, past, now
        self.trees: list[Tree] = []
        self.wanted = 0

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape[1])
        for i, t in enumerate(self.trees[: self.wanted]):
            out += (self.step if i else 1.0) * t.value[t.place(x)]
        return out


def _unpacked(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bins as features by rows, y, year, hash) of each block."""
    for batch in batches:
        for block in zip(*(batch.column(c) for c in ("bins", "y", "year", "hash")), strict=True):
            x, y, year, h = (np.frombuffer(v.as_buffer(), k) for v, k in zip(block, (np.uint8, np.float64, np.int32, np.uint64), strict=True))
            yield x.reshape(count, -1), y, year, h


def _drawn(h: np.ndarray, share: float, seed: int, number: int) -> np.ndarray:
    salt = _mixed(np.array([(seed + number) % 2**64], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return _mixed(h ^ salt) < np.uint64(int(share * (2**64 - 1))) if share < 1 else np.ones(len(h), bool)


def _level(data: Binned, work: list[tuple[Fit, Tree]]) -> list[dict[int, np.ndarray]]:
    """For each tree the counts and sums of its open nodes by feature and bin: one pass."""
    sizes, width, spread = data.sizes, max(data.sizes), [f for f, k in enumerate(data.sizes) if k > 1]

    def run(batches):
        slots = []
        for _, tree in work:
            slot = np.full(len(tree.feature), -1)
            slot[tree.open] = np.arange(len(tree.open))
            slots.append(slot)
        total = [np.zeros((len(t.open), 2, len(sizes), width)) for _, t in work]
        for x, y, year, h in _unpacked(batches, len(sizes)):
            chosen: dict[tuple, tuple] = {}
            for (fit, tree), slot, out in zip(work, slots, total, strict=True):
                _, share, _, seed, *_ = fit.settings
                key = (tuple(fit.past), share, seed, len(fit.trees))
                if key not in chosen:
                    at = np.flatnonzero(np.isin(year, fit.past) & _drawn(h, share, seed, len(fit.trees)))
                    chosen[key] = x[:, at], y[at]
                xs, ys = chosen[key]
                place = slot[tree.place(xs)]
                if (place < 0).any():
                    at = np.flatnonzero(place >= 0)
                    xs, ys, place = xs[:, at], ys[at], place[at]
                g = 2 * (ys - fit.predict(xs)) if fit.trees else ys
                for f in spread or [0]:
                    cell = place * width + xs[f]
                    out[:, 0, f] += np.bincount(cell, minlength=len(out) * width).reshape(-1, width)
                    out[:, 1, f] += np.bincount(cell, g, minlength=len(out) * width).reshape(-1, width)
                if 0 not in spread and spread:  # a node's size and sum are read from the first feature
                    out[:, 0, 0, 0] += np.bincount(place, minlength=len(out))
                    out[:, 1, 0, 0] += np.bincount(place, g, minlength=len(out))
        for i, ((_, tree), out) in enumerate(zip(work, total, strict=True)):
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out[0].size, pa.int32()), out.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), i, np.int32)), pa.array(tree.open, pa.int32()), sums], ["tree", "node", "sums"])

    def add(key, table):
        order = pc.sort_indices(table, [("part", "ascending")])
        values = table.take(order).column("sums").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([values.sum(axis=0)])})

    parts = data.rows.mapInArrow(run, "tree int, node int, sums array<double>").withColumn("part", F.spark_partition_id())
    sums = parts.groupBy("tree", "node").applyInArrow(add, "tree int, node int, sums array<double>").collect()  # open nodes times features times bins
    found: list[dict[int, np.ndarray]] = [{} for _ in work]
    for r in sums:
        found[r["tree"]][r["node"]] = np.array(r["sums"]).reshape(2, len(sizes), width)
    return found


def grow(data: Binned, fits: list[Fit]) -> None:
    """Adds trees until every fit has those it shall have; all that are open grow by a level in a pass. First trees don't depend on the step, so fits share them."""
    while todo := [f for f in fits if len(f.trees) < f.wanted]:
        groups: dict[tuple, list[Fit]] = {}
        for f in todo:
            groups.setdefault((tuple(f.past), f.settings, f.name if f.trees else None, len(f.trees)), []).append(f)
        made = [(same[0], Tree(max(data.sizes))) for same in groups.values()]
        while work := [(f, t) for f, t in made if t.open]:
            for (f, t), found in zip(work, _level(data, work), strict=True):
                t.split(found, data, f.settings, len(f.trees))
        for same, (_, tree) in zip(groups.values(), made, strict=True):
            for f in same:
                f.trees.append(tree)


def errors(data: Binned, fits: list[Fit]) -> list[tuple[int, float | None]]:
    """(rows, RMSE) of each fit in its later year: one pass; rows without a target count, but have no error."""
    count = len(data.sizes)

    def run(batches):
        n, known, sse = (np.zeros(len(fits)) for _ in range(3))
        for x, y, year, _ in _unpacked(batches, count):
            for now in {f.now for f in fits}:
                at = np.flatnonzero(year == now)
                xs, ys = x[:, at], y[at]
                there = ~np.isnan(ys)
                for i, f in enumerate(fits):
                    if f.now == now:
                        n[i], known[i] = n[i] + len(at), known[i] + there.sum()
                        sse[i] += ((f.predict(xs) - ys)[there] ** 2).sum()
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(fits)), pa.int32()), "n": n, "known": known, "sse": sse})

    sums = data.rows.mapInArrow(run, "i int, n double, known double, sse double").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "known", "sse"))).collect()
    found = {r["i"]: (int(r["n"]), math.sqrt(r["sse"] / r["known"]) if r["known"] else None) for r in sums}
    return [found.get(i, (0, None)) for i in range(len(fits))]
