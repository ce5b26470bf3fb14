"""Best-fit packing of tokenised documents by minimum bin slack.

1. One pass over the texts cuts every document's ids into pieces of at most
   ``capacity`` tokens and keeps, for each piece, its place, length, checksum and
   its number among the pieces of that length in its task. No ids travel.
2. The pieces' lengths are counted: at most ``capacity`` numbers, whatever the
   data. Over these the driver plans bins: the longest length left opens a bin, a
   subset-sum table kept as a bitset over the lengths still available finds the
   fullest way to complete it, and that combination is taken as often as the
   counts allow and removed.
3. A piece's rank among all pieces of its length (task offset plus its number in
   the task) picks its bin and place from the plan.

The pieces are written to the shared folder between 1 and 2, so numbers given by a
task stay valid when executors are lost. A frequent length is no hot key: ranks
need one row for each task and length, and pieces join them by both.

Cases: null and empty texts are one token (the end id); repeated rows are packed
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, held, slices


class Codes(dict):
    """Numbers for strings in order of first use; new ones wait in ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class Encoder:
    """Token ids of texts. White space never joins two tokens, so each stretch between white space is encoded once and remembered."""

    #: Stretches remembered in a worker; beyond them it starts anew.
    KEPT = 800_000
    #: Stretches encoded at once: an encoding takes some kilobytes until its ids are read.
    BATCH = 20_000
    #: Split by str.split() but not white space to the tokenizer.
    ODD = (b"\x1c", b"\x1d", b"\x1e", b"\x1f")

    def __init__(self, path: str, end_id: int = 0):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self._clear()

    def _clear(self) -> None:
        self.codes = Codes()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 1
        self.flat[0] = self.end_id
        self.begin, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.codes[" "] = 0  # no stretch is a blank: it stands for the end
        self.count[0] = 1

    def _learn(self) -> None:
        fresh, self.codes.fresh = self.codes.fresh, []
        at = len(self.codes) - len(fresh)
        while len(self.begin) < len(self.codes):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        found = [e.ids for i in range(0, len(fresh), self.BATCH) for e in self.tokenizer.encode_batch_fast(fresh[i : i + self.BATCH], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter((x for ids in found for x in ids), np.int32, total)
        self.count[at : at + len(fresh)] = sizes
        self.begin[at : at + len(fresh)] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, the end id after each text, and the places where the texts end."""
        if len(self.codes) > self.KEPT:
            self._clear()
        parts, sizes, odd = [], [], []
        for i, text in enumerate(texts):
            text = text or ""
            if not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f"):
                odd.append(i)
                text = ""
            words = text.split()
            words.append(" ")
            parts += words
            sizes.append(len(words))
        codes = np.fromiter(map(self.codes.__getitem__, parts), np.int64, len(parts))
        if self.codes.fresh:
            self._learn()
        count = self.count[codes]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.begin[codes] - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        ends = ends[np.cumsum(sizes) - 1] if sizes else ends
        if odd:
            rows = np.split(ids, ends[:-1])
            for i in odd:
                rows[i] = np.array([*self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.end_id], np.int32)
            ids, ends = np.concatenate(rows), np.cumsum([len(r) for r in rows])
        return ids, ends


def encoder(path: str, end_id: int) -> Encoder:
    """This worker's encoder; kept between tasks."""
    return held(("encoder", path, end_id), lambda: Encoder(path, end_id))


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and (task, number): the piece is the number-th of its length in its task."""

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encode = encoder(tokenizer, end_id)
        for batch in slices(batches):
            ids, ends = encode(batch.column("text").to_pylist())
            ids = ids.astype("<u4", copy=False)
            begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
            sizes = ends - begins
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            low = begins[row] + start
            crc = [zlib.crc32(ids[a : a + m].tobytes()) for a, m in zip(low.tolist(), length.tolist(), strict=True)]
            number = np.zeros(len(row), np.int64)
            order = np.argsort(length, kind="stable")
            values, first, counts = np.unique(length[order], return_index=True, return_counts=True)
            number[order] = seen[length[order]] + np.arange(len(row)) - np.repeat(first, counts)
            seen[values] += counts
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(number)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, task int, number long")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The lengths, each used at most its count, whose sum is the largest up to ``room``: bitset subset sums, longest first."""
    mask, reach, tables = (1 << room + 1) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        tables.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            reach |= reach << step * length & mask
            left -= step
            step *= 2
        if reach >> room & 1:
            tables.append((0, reach))
            break
    target, out = reach.bit_length() - 1, []
    for length, before in reversed(tables):
        while length and not before >> target & 1:
            out.append(length)
            target -= length
    return out


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths of a bin): every counted length is used up, the longest left always opens the next bin."""
    counts = {k: v for k, v in counts.items() if v}
    lengths, plan = sorted(counts, reverse=True), []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        bin_ = [first, *fullest(lengths, counts, capacity - first)]
        counts[first] += 1
        uses = {x: bin_.count(x) for x in set(bin_)}
        times = min(counts[x] // n for x, n in uses.items())
        for x, n in uses.items():
            counts[x] -= times * n
        lengths = [x for x in lengths if counts[x]]
        plan.append((times, bin_))
    return plan


def places(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, uses in a bin, first bin and the offsets in it, of every part of the plan that uses it."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    bins = 0
    for times, bin_ in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in bin_:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, o in offsets.items():
            out.setdefault(x, []).append((used.get(x, 0), len(o), bins, o))
            used[x] = used.get(x, 0) + times * len(o)
        bins += times
    return {x: (*(np.array([p[k] for p in parts], np.int64) for k in range(3)), np.cumsum([0, *(p[1] for p in parts)])[:-1], np.array([o for p in parts for o in p[3]], np.int64)) for x, parts in out.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: see the module's text."""
    spark = docs.sparkSession
    cut = durable(pieces(docs, tokenizer, capacity, end_id))
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    where = spark.sparkContext.broadcast(places(minimum_slack(counts, capacity)))

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("rank"))

    def run(batches):
        plan = where.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                rows = np.flatnonzero(length == x)
                low, uses, bins, begin, at = plan[x]
                k = np.searchsorted(low, rank[rows], side="right") - 1
                r = rank[rows] - low[k]
                sequence[rows] = bins[k] + r // uses[k]
                offset[rows] = at[begin[k] + r % uses[k]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
