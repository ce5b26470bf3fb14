"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised test items, end to end in one automaton, are streamed over by
the words of the training documents: the state after each word gives the
longest run of words ending there that some item holds. A run of ``window``
words or more is a window occurrence; an item shorter than that counts when the
whole of it occurs. Words outside the items' vocabulary reset the automaton, so
only stretches of known words are walked; the rest is array work.

The items go to the tasks in blocks of about ``block_chars`` characters, each with
its own automaton. One block is decided in the task that reads the documents and
nothing is shuffled. More items mean one pass a block over the documents: each
stores the hits of the texts that have some (one row for equal texts), and the last
joins them by the text's MD5. At any time the driver and each task hold one block
and one Arrow slice.

Cases: null or wordless texts have no words and no hits; null or wordless items
occur nowhere; repeated documents are decided each on its own; items with equal
ids count once; extra columns are carried by ``decontaminate`` and ignored else.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, free, raw, slices

#: Bytes that end a word become a blank, A-Z become a-z; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Automaton:
    """Suffix automaton of several word sequences; ``items`` are (id, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.grams: dict[tuple, set[str]] = {}
        for name, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            last = 0
            for x in ids:
                last = self._extend(last, x)
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                self.grams.setdefault(tuple(ids[i : i + window]), set()).add(name)
        self.short = sorted({len(g) for g in self.grams if len(g) < window})
        self.least = min((len(g) for g in self.grams), default=window)

    def _new(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, x: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(x) == q:
            self.step[p][x] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, p: int, x: int) -> int:
        if (q := self.step[p].get(x)) is not None:
            return q if self.length[q] == self.length[p] + 1 else self._split(p, x, q)
        new = self._new(self.length[p] + 1, {}, 0)
        while p >= 0 and x not in self.step[p]:
            self.step[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, x, q)
        return new

    def matches(self, ids: list[int]):
        """(end, words) of each window occurrence among known words ``ids``."""
        state = found = 0
        step, link, length = self.step, self.link, self.length
        for i, x in enumerate(ids):
            while state and x not in step[state]:
                state = link[state]
                found = length[state]
            if (to := step[state].get(x)) is not None:
                state, found = to, found + 1
            if found >= self.window:
                yield i + 1, self.window
            for n in self.short:
                if found >= n and tuple(ids[i + 1 - n : i + 1]) in self.grams:
                    yield i + 1, n

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items whose windows occur."""
        hit = np.zeros(len(words), bool)
        names: set[str] = set()
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([-1], ids, [-1])) >= 0))
        for low, high in edge.reshape(-1, 2):
            if high - low >= self.least:
                run = ids[low:high].tolist()
                for end, n in self.matches(run):
                    hit[low + end - n : low + end] = True
                    names |= self.grams[tuple(run[end - n : end])]
        return hit, names


def block(items: DataFrame, window: int, k: int, n: int) -> Automaton:
    """The automaton of the k-th of n blocks of the items, dealt by a hash of the text."""
    rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
    pairs = ((i, t.encode().translate(FOLD).split()) for i, t in rows)
    return Automaton([(i, w) for i, w in pairs if i is not None and w], window)


def words_of(batch: pa.RecordBatch) -> tuple[bytes, np.ndarray, bytes]:
    body, begins = raw(batch.column("text"))
    return body, begins, body.translate(FOLD)


def stored_hits(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """node, ranges of hit words and items of the distinct texts of ``docs`` (node, text) that have any."""
    sent = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        for batch in slices(batches):
            _, begins, folded = words_of(batch)
            rows = []
            for i, node in enumerate(batch.column("node").to_pylist()):
                hit, names = sent.value.hits(folded[begins[i] : begins[i + 1]].split())
                if names:
                    rows.append((node, np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])))).tolist(), sorted(names)))
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["node", "ranges", "names"])

    found = docs.mapInArrow(run, "node binary, ranges array<long>, names array<string>")
    return durable(found.groupBy("node").agg(F.any_value("ranges").alias("ranges"), F.any_value("names").alias("names")))


def scan(docs: DataFrame, items: DataFrame, decide, schema: str, columns: list[str], window: int, block_chars: int) -> DataFrame:
    """``decide(batch, body, begins, hits)`` for every slice; hits(i) gives words, hit flags and items of its row i."""
    items = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string"), "text")
    n = -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    docs = docs.select(*columns)
    if n <= 1:
        sent = docs.sparkSession.sparkContext.broadcast(block(items, window, 0, 1))

        def run(batches):
            for batch in slices(batches):
                body, begins, folded = words_of(batch)

                def hits(i, begins=begins, folded=folded):
                    words = folded[begins[i] : begins[i + 1]].split()
                    return words, *sent.value.hits(words)

                yield decide(batch, body, begins, hits)

        return docs.mapInArrow(run, schema)

    node = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    texts = docs.select(node.alias("node"), "text")
    found = stored_hits(texts, block(items, window, 0, n))
    for k in range(1, n):
        found = found.unionByName(stored_hits(texts, block(items, window, k, n)))
    found = found.groupBy("node").agg(F.collect_list("ranges").alias("r"), F.flatten(F.collect_list("names")).alias("n"))  # a row for each block at most
    key, ranges, names = (free(columns, x) for x in ("node", "ranges", "names"))
    joined = docs.withColumn(key, node).join(found.toDF(key, ranges, names), key, "left").select(*columns, ranges, names)

    def merge(batches):
        for batch in slices(batches):
            body, begins, folded = words_of(batch)
            edges, items_ = batch.column(ranges).to_pylist(), batch.column(names).to_pylist()

            def hits(i, begins=begins, folded=folded, edges=edges, items_=items_):
                words = folded[begins[i] : begins[i + 1]].split()
                hit = np.zeros(len(words), bool)
                for edge in edges[i] or ():
                    for low, high in zip(edge[::2], edge[1::2], strict=True):
                        hit[low:high] = True
                return words, hit, set(items_[i] or ())

            yield decide(batch.select(columns), body, begins, hits)

    return joined.mapInArrow(merge, schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_chars: int = 4_000_000) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""

    def decide(batch, body, begins, hits):
        rows = []
        for i in range(batch.num_rows):
            words, hit, names = hits(i)
            names = sorted(names)
            n = int(hit.sum())
            rows.append((len(words), n, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n > 0, names))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()))
        names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items")
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", *names])

    id_type = dict(docs.dtypes)["doc_id"]
    return scan(docs, items, decide, f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>", ["doc_id", "text"], window, block_chars)


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``text`` begin and end, in bytes."""
    inside = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    return edge[::2], edge[1::2]


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """``text`` without the stretches of hit words; the white space before a cut goes with it."""
    begin, end = word_places(text)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
    out, at = [], 0
    for low, high in edge.reshape(-1, 2):
        out.append(text[at : begin[low]].rstrip(b" \t\r\n"))
        at = end[high - 1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, coverage: float = 0.8, block_chars: int = 4_000_000) -> DataFrame:
    """``docs`` without benchmark passages, all columns kept.

    Stretches of hit words are cut out; a document of which at least ``coverage``
    of the words are hit goes as a whole. Other rows come back unchanged.
    n_chars, where there is one, is counted anew for texts that were cut.
    """
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def decide(batch, body, begins, hits):
        texts, keep, cuts = batch.column("text").to_pylist(), [], {}
        for i in range(batch.num_rows):
            words, hit, _ = hits(i)
            n = int(hit.sum())
            if n and n >= coverage * len(words):
                continue
            keep.append(i)
            if n:
                cuts[i] = texts[i] = cut(body[begins[i] : begins[i + 1]], hit).decode()
        out = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        if chars is not None and cuts:
            counts = [len(cuts[i]) if i in cuts else v for i, v in enumerate(batch.column(chars).to_pylist())]
            out = out.set_column(chars, batch.schema.field(chars), pa.array(counts, batch.schema.field(chars).type))
        return out.take(pa.array(keep, pa.int64()))

    return scan(docs, items, decide, docs.schema, docs.columns, window, block_chars)
