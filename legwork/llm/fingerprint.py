"""Document fingerprints of improbable features.

Every window of ``width`` bytes has an entropy class. A first pass counts the
classes over all documents; the rarer a class, the lower the rank of its windows
(windows of almost no entropy are left out). In every run of ``run`` neighbouring
windows the leftmost of lowest rank gets a point; windows with ``points`` points
or more are the features. Their hashes go, in order of place, into a chain of
Bloom filters of BITS bits with at most ``fill`` features each. A text with fewer
windows than a run is one run; one shorter than a window is one feature.

Likeness: each filter of the shorter chain is set against every filter of the
longer one; the common bits beyond those expected by chance, over the most there
could be, are its score; the best scores are averaged by the filters' numbers of
features. Equal fingerprints have likeness 1, an empty text and another 0.

Finding each document's successor: rows are ordered by doc_id and, for equal ids, a
hash of the text. A pass over ids and hashes alone cuts this order into cells of
about CELL_BYTES of text (Spark's range partitioning, so skewed ids do not matter);
each row's cell is found by binary search in the bounds, two numbers for each cell.
Rows that equal several bounds, such as copies of a row, are spread over their
cells. Then one shuffle moves each text once, the first document of each cell goes
to the cell before as well, and a task streams over its sorted rows, holding one
slice of them.

Cases: null text counts as empty; an empty table gives an empty result; ids may be
of any type that orders; rows with the same id follow each other in the order of a
hash of their texts; rows without an id precede the others; the last document is
followed by the first, a single one by itself; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, raw, slices

BITS = 2048
BYTES = BITS // 8
CLASSES = 200
#: Text in a cell, about: its bounds are two numbers.
CELL_BYTES = 16 << 20


class Windows:
    """Entropy classes of all windows of a buffer."""

    def __init__(self, width: int):
        self.width = width
        c = np.arange(1, width + 1)
        total = np.rint(1000 * c * np.log2(c)).astype(np.int64)
        self.gain = np.concatenate(([0], np.diff(np.concatenate(([0], total))))).astype(np.int32)  # of the c-th equal byte
        self.top = int(total[-1])

    def classes(self, body: np.ndarray) -> np.ndarray:
        """Class of the window at each place: CLASSES - 1 when all its bytes are equal, 0 when all differ."""
        n, w = len(body), self.width
        if n < w:
            return np.zeros(0, np.uint8)
        ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
        for d in range(1, w):
            same = (body[:-d] == body[d:]).view(np.uint8)
            ahead[:-d] += same
            behind[d:] += same
        first = int(self.gain[[int((body[max(0, i - w + 1) : i + 1][-(i + 1) :] == body[i]).sum()) for i in range(w)]].sum())
        change = self.gain[behind[w:]] - self.gain[ahead[: n - w]]
        sums = np.empty(n - w + 1, np.int64)
        sums[0] = first
        np.cumsum(change, out=sums[1:], dtype=np.int64)
        sums[1:] += first
        return (sums * (CLASSES - 1) // self.top).astype(np.uint8)


def inside(begins: np.ndarray, n: int, width: int) -> np.ndarray:
    """Whether the window at each place lies within one text."""
    ok = np.ones(max(0, n - width + 1), bool)
    for b in begins[1:-1].tolist():
        ok[max(0, b - width + 1) : b] = False
    return ok


def census(docs: DataFrame, width: int) -> np.ndarray:
    """How often each entropy class occurs over all documents."""

    def run(batches):
        windows, total = Windows(width), np.zeros(256, np.int64)
        for batch in slices(batches):
            body, begins = raw(batch.column("text"))
            found = windows.classes(np.frombuffer(body, np.uint8))
            if len(found):
                total += np.bincount(found[inside(begins, len(body), width)], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], ["class", "n"])

    counts = docs.select("text").mapInArrow(run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(256, np.int64)
    for r in counts:
        out[r["class"]] = r["n"]
    return out


def ranks(counts: np.ndarray, weakest: float = 0.6) -> np.ndarray:
    """Rank of each class: 0 for the rarest; 255 for windows with almost no entropy, which are no features."""
    out = np.full(256, 255, np.uint8)
    usable = [c for c in range(CLASSES) if c < weakest * CLASSES]
    for k, c in enumerate(sorted(usable, key=lambda c: (counts[c], c))):
        out[c] = k
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Digest:
    """Fingerprints of many texts at once."""

    def __init__(self, rank: np.ndarray, width: int, run: int, points: int, fill: int):
        self.rank, self.width, self.run, self.points, self.fill = rank, width, run, points, fill
        self.windows = Windows(width)

    def features(self, body: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every feature, in order of place, each hash once in a text."""
        n, w, r = len(body), self.width, self.run
        sizes = np.diff(begins)
        places = np.zeros(0, np.int64)
        if n >= w:
            rank = self.rank[self.windows.classes(body)]
            ok = inside(begins, n, w)
            rank = np.where(ok, rank, 255)
            kind = np.uint32 if n < 1 << 23 else np.int64
            key = (rank.astype(kind) << (23 if kind is np.uint32 else 40)) | np.arange(len(rank), dtype=kind)
            low, span = key, 1
            while span < r and len(low) > span:  # least of the run from each place on, doubling
                step = min(span, r - span)
                low = np.minimum(low[: len(low) - step], low[step:])
                span += step
            mask = (1 << (23 if kind is np.uint32 else 40)) - 1
            if span == r:
                begin = np.arange(len(low))
                row = np.searchsorted(begins, begin, side="right") - 1 if len(sizes) > 1 else np.zeros(len(begin), np.int64)
                whole = begin + r - 1 + w <= begins[1:][row]
                at = (low[whole] & kind(mask)).astype(np.int64)
                change = np.flatnonzero(np.diff(at)) + 1
                first = np.concatenate(([0], change)) if len(at) else change
                count = np.diff(np.concatenate((first, [len(at)])))
                places = at[first][count >= self.points] if len(at) else places
                places = places[rank[places] < 255]
            few = [np.argmin(rank[b : b + m - w + 1]) + b for b, m in zip(begins[:-1].tolist(), sizes.tolist(), strict=True) if w <= m < w + r - 1]
            places = np.sort(np.concatenate([places, np.array(few, np.int64)]))
        row = np.searchsorted(begins, places, side="right") - 1
        grams = body[places[:, None] + np.arange(w)] if len(places) else np.zeros((0, w), np.uint8)
        words = np.ascontiguousarray(np.pad(grams, ((0, 0), (0, -w % 8)))).view(np.uint64)
        value = np.zeros(len(places), np.uint64)
        for k in range(words.shape[1]):
            value = mix(value + words[:, k] + np.uint64(k + 1))
        tiny = np.flatnonzero((sizes > 0) & (np.bincount(row, minlength=len(sizes)) == 0))
        if len(tiny):  # texts without a feature are one themselves
            whole = np.array([int.from_bytes(hashlib.blake2b(body[begins[i] : begins[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in tiny], np.uint64)
            row, value = np.concatenate([row, tiny]), np.concatenate([value, whole])
        order = np.lexsort((np.arange(len(row)), value, row))
        again = np.zeros(len(row), bool)
        again[1:] = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
        keep = np.sort(order[~again])
        keep = keep[np.argsort(row[keep], kind="stable")]
        return row[keep], value[keep]

    def __call__(self, body: bytes, begins: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(filters, features in each) of every text; a filter is BYTES bytes."""
        buffer = np.frombuffer(body, np.uint8)
        row, value = self.features(buffer, begins)
        count = np.bincount(row, minlength=len(begins) - 1)
        n = -(-count // self.fill)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        which = np.repeat(np.cumsum(n) - n, count) + number // self.fill
        bits = np.zeros((int(n.sum()), BITS), np.uint8)
        for k in range(5):
            bits[which, (value >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = 1
        filters = np.packbits(bits, axis=1)
        held = np.bincount(which, minlength=len(filters))
        end = np.cumsum(n)
        return [(filters[e - m : e], held[e - m : e]) for e, m in zip(end.tolist(), n.tolist(), strict=True)]


def text_form(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """Features of each filter, and the filters in base64."""
    filters, held = print_
    return ",".join(map(str, held.tolist())) + ":" + base64.b64encode(filters.tobytes()).decode()


def parsed(form: str) -> tuple[np.ndarray, np.ndarray]:
    held, _, body = form.partition(":")
    return np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, BYTES), np.array([int(x) for x in held.split(",") if x], np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: see the module's text."""
    if len(a[0]) == len(b[0]) and np.array_equal(a[0], b[0]):
        return 1.0
    if not len(a[0]) or not len(b[0]):
        return 0.0
    if (len(a[0]), a[1].sum()) > (len(b[0]), b[1].sum()):
        a, b = b, a
    best = np.zeros(len(a[0]))
    set_a, set_b = np.bitwise_count(a[0]).sum(1, dtype=np.int64), np.bitwise_count(b[0]).sum(1, dtype=np.int64)
    for k in range(len(b[0])):
        common = np.bitwise_count(a[0] & b[0][k]).sum(1, dtype=np.int64)
        chance = set_a * set_b[k] / BITS
        most = np.minimum(set_a, set_b[k])
        # a filter that holds few features against a full one is met by chance sooner: no less than 8 bits count
        score = (common - chance) / np.maximum(most - chance, 8)
        share = np.minimum(1.0, b[1][k] / np.maximum(a[1], 1))  # of a's features that a smaller filter can hold
        best = np.maximum(best, score * share)
    return float(np.clip(np.average(best, weights=a[1]), 0, 1))


class Cells:
    """Bounds of cells in the order of (id, tie), ids without a value first."""

    def __init__(self, bounds: list[tuple]):
        self.empty = np.sort(np.array([t for i, t in bounds if i is None], np.int64))
        some = [(i, t) for i, t in bounds if i is not None]
        self.ids, self.ties = [i for i, _ in some], np.array([t for _, t in some], np.int64)
        self.ids = np.array(self.ids) if all(isinstance(i, int) for i in self.ids) else np.array(self.ids, object)

    def __call__(self, ids: pa.Array, tie: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Number of the cell of each row: one that ends at or holds its key; rows equal to bounds may go to any cell between."""
        low, high = np.zeros(len(tie), np.int64), np.zeros(len(tie), np.int64)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        low[null], high[null] = (np.searchsorted(self.empty, tie[null], side) for side in ("left", "right"))
        rest = np.flatnonzero(~null)
        if len(self.ids) and len(rest):
            values = ids.take(pa.array(rest))
            values = values.to_numpy(zero_copy_only=False) if self.ids.dtype != object else np.array(values.to_pylist(), object)
            first, last = np.searchsorted(self.ids, values, "left"), np.searchsorted(self.ids, values, "right")
            low[rest], high[rest] = first, last
            shared = np.flatnonzero(first < last)  # ids that are bounds themselves: their ties decide
            for a, b in {(int(first[k]), int(last[k])) for k in shared}:
                some = rest[shared[(first[shared] == a) & (last[shared] == b)]]
                low[some], high[some] = (a + np.searchsorted(self.ties[a:b], tie[some], side) for side in ("left", "right"))
        low[rest] += len(self.empty)
        high[rest] += len(self.empty)
        return low + (spread.astype(np.uint64) % (high - low + 1).astype(np.uint64)).astype(np.int64)


def in_cells(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` (doc_id, text, tie) with cell and tail: rows of a cell follow each other in order, and a tail is the first row of the cell after it."""
    spark = docs.sparkSession
    spread = F.xxhash64(F.monotonically_increasing_id())
    n = max(1, -(-size // CELL_BYTES))
    ranged = docs.select("doc_id", "tie", spread.alias("spread")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie", "spread")
    # the order of Spark's structs: null first, as in the cells
    starts = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc_id", "tie")).alias("x")).orderBy("part").select("x.*").collect()  # a row for each cell
    cells = spark.sparkContext.broadcast(Cells([(r["doc_id"], r["tie"]) for r in starts[1:]]))

    def place(batches):
        for batch in batches:
            out = cells.value(batch.column("doc_id"), batch.column("tie").to_numpy(), batch.column("spread").to_numpy())
            yield batch.append_column("cell", pa.array(out, pa.int64()))

    kinds = ", ".join(f"{c} {k}" for c, k in docs.dtypes)
    # firsts come from keys alone; texts are placed by the same function
    keyed = docs.select("doc_id", "tie", spread.alias("spread")).mapInArrow(place, f"doc_id {dict(docs.dtypes)['doc_id']}, tie long, spread long, cell long")
    firsts = durable(keyed.groupBy("cell").agg(F.min(F.struct("doc_id", "tie")).alias("x")).select("cell", "x.*"))
    order = [r["cell"] for r in firsts.select("cell").orderBy("cell").collect()]  # a number for each cell
    before = {c: order[i - 1] for i, c in enumerate(order)}  # the last cell gets the first document
    after = spark.sparkContext.broadcast(before)

    def hand_on(batches):
        for batch in batches:
            yield batch.set_column(0, "cell", pa.array([after.value[c] for c in batch.column("cell").to_pylist()], pa.int64()))

    links = firsts.mapInArrow(hand_on, ", ".join(f"{c} {k}" for c, k in firsts.dtypes)).select("cell", F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
    placed = docs.withColumn("spread", spread).mapInArrow(place, f"{kinds}, spread long, cell long").select("doc_id", "text", "tie", "cell", F.lit(False).alias("tail"))
    # one text for each key that begins a cell, however many rows have it
    same = docs["doc_id"].eqNullSafe(links["_id"]) & (docs["tie"] == links["_tie"])
    texts = docs.join(F.broadcast(links.select("_id", "_tie").distinct()), same, "left_semi").groupBy("doc_id", "tie").agg(F.any_value("text").alias("text"))
    tails = texts.join(F.broadcast(links), texts["doc_id"].eqNullSafe(links["_id"]) & (texts["tie"] == links["_tie"])).select("doc_id", "text", "tie", "cell", F.lit(True).alias("tail"))
    return placed.unionByName(tails).repartition(n, "cell").sortWithinPartitions("cell", "tail", F.col("doc_id").asc_nulls_first(), "tie")


def fingerprints(docs: DataFrame, width: int = 16, run: int = 32, points: int = 12, fill: int = 128) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter of code points replaced by
    the first as many of the next document.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    digest = spark.sparkContext.broadcast(Digest(ranks(census(docs, width)), width, run, points, fill))
    size = int(docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0)
    id_type = dict(docs.dtypes)["doc_id"]

    def prints(make, bodies: list[str]) -> list:
        out = []
        for part in slices(pa.table({"text": pa.array(bodies, pa.large_string())}).to_batches(), rows=1024):
            out += make(*raw(part.column("text")))
        return out

    def finished(rows: list[tuple], kind) -> pa.RecordBatch:
        """Rows (id, text, print, next text, its print)."""
        edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for _, t, _, n, _ in rows]
        changed = prints(digest.value, edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], kind),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([text_form(r[2]) for r in rows], pa.string()),
                pa.array([text_form(p) for p in changed], pa.string()),
                pa.array([likeness(r[2], p) for r, p in zip(rows, changed, strict=True)], pa.float64()),
                pa.array([likeness(r[2], r[4]) for r in rows], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def work(batches):
        last = None  # id, text, print, cell, tail of the row before
        for batch in slices(batches):
            kind, texts = batch.column("doc_id").type, batch.column("text").to_pylist()
            fresh = zip(batch.column("doc_id").to_pylist(), texts, prints(digest.value, texts), batch.column("cell").to_pylist(), batch.column("tail").to_pylist(), strict=True)
            rows = []
            for row in fresh:
                if last is not None and not last[4]:  # its follower, of the same cell
                    if last[3] != row[3]:
                        raise RuntimeError("a cell has no tail: the rows came in another order than before")
                    rows.append((*last[:3], row[1], row[2]))
                last = row
            if rows:
                yield finished(rows, kind)
        if last is not None and not last[4]:
            raise RuntimeError("a cell has no tail: the rows came in another order than before")

    return in_cells(docs, size).mapInArrow(work, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
