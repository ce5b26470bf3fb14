"""Exact substring deduplication with fixed-block anchors.

A repeated run of ``window`` words holds, in either text, a whole block of
``block = (window + 1) // 2`` words that begins at a multiple of ``block``.

1. Texts are dealt into groups. A group sends the hash of every rolling window of
   ``block`` words to the hash's bucket (each hash once, sorted and packed to 32 bits
   beside the bucket's number), and says which of them stand at an anchor, a
   non-overlapping reference block.
2. A bucket indexes the anchors of all groups and answers each group's probes with a
   bit: whether an anchor of another group has it.
3. A place hits if an anchor elsewhere has its hash: in another group (the
   answers) or in its own. Hits are extended to both sides: every run of
   ``window`` words around a hit goes to its bucket as a hash of 96 bits beside the
   bucket's number, and the bucket answers with a bit whether the run stands in two
   groups, or twice in one. Runs that are repeated and touch or overlap make up one
   maximal repeat. (A probe that meets by chance costs a few runs more, no result.)
4. Each group removes the words that repeats cover.

All tables are parted by hash and their parts follow the data: nothing is collected
but the size of all texts, nothing broadcast. Copies and hot sources spread over
the groups; a passage shared by a third of all rows costs each group one hash a
window. A group is about GROUP_BYTES of text (or one longer text), a bucket about
BUCKET_WINDOWS hashes.

Cases: null text has no words; a document with fewer words than a window keeps
all; repeated rows count as separate documents, so their windows are repeated;
null ids are rows like others; an empty table gives an empty result; extra columns
are ignored. Rows are dealt by their place in the input too (repeated rows
spread), so the input must come in the same order if a task is run again, as a
table's files do.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, slices
from .words import Slice

#: Bytes of text in a group, and windows in a bucket, about.
GROUP_BYTES, BUCKET_WINDOWS = 8 << 20, 1 << 21
NONE = np.zeros(0, np.uint64)
LOW = np.uint64(0xFFFFFFFF)
#: Documents of a group that are worked on at once.
AT_ONCE = {"rows": 4096, "size": 4 << 20}


def keyed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (from the upper half) and lower half of each hash, in one number."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) & ~LOW) | hashes & LOW


def cuts(keys: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """The buckets of sorted keys, and where the keys of each stand."""
    some, at = np.unique(keys >> np.uint64(32), return_index=True)
    edge = [*at.tolist(), len(keys)]
    return some.astype(np.int64), [slice(a, b) for a, b in zip(edge, edge[1:], strict=False)]


def messages(grp: int, keys: np.ndarray, **columns) -> pa.Table:
    """One row for each bucket that some of the sorted keys belong to; ``columns`` are arrays beside the keys."""
    some, parts = cuts(keys)
    lower = keys.astype(np.uint32)
    out = {"bucket": pa.array(some), "grp": pa.array([grp] * len(some), pa.int64()), "lower": pa.array([lower[p].tobytes() for p in parts], pa.binary())}
    for name, x in columns.items():
        out[name] = pa.array([np.packbits(x[p]).tobytes() if x.dtype == bool else x[p].tobytes() for p in parts], pa.binary())
    return pa.table(out)


def runs_of(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(h, kind) for h in table.column(name).to_pylist()]


def flags(table: pa.Table, name: str, sizes) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(a, np.uint8), count=n).astype(bool) for a, n in zip(table.column(name).to_pylist(), sizes, strict=True)]


def answered(keys: np.ndarray, answers: pa.Table) -> np.ndarray:
    """The answers (bucket, bits) to a group's sorted keys."""
    some, parts = cuts(keys)
    bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
    out = np.zeros(len(keys), bool)
    for k, p in zip(some.tolist(), parts, strict=True):
        out[p] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=p.stop - p.start)
    return out


def sorted_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each occurs."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    return first[at], second[at], np.diff(np.concatenate((at, [len(first)])))


def held(first: np.ndarray, second: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of each pair (a, b) among the sorted distinct pairs (first, second), or -1."""
    out = np.full(len(a), -1)
    if not len(first):
        return out
    at = np.searchsorted(first, a)
    left = np.arange(len(a))
    while len(left):  # one step each, but for pairs that agree in the first half alone
        left = left[at[left] < len(first)]
        left = left[first[at[left]] == a[left]]
        same = second[at[left]] == b[left]
        out[left[same]] = at[left[same]]
        left = left[~same]
        at[left] += 1
    return out


class Group:
    """The rolling windows of a group's texts and the runs around its hits."""

    def __init__(self, texts: pa.Table, window: int, block: int, buckets: int):
        self.texts, self.window, self.block, self.buckets = texts, window, block, buckets
        found, own = [NONE], [np.zeros(0, bool)]
        for cut in self.parts():
            hashes, ok = cut.runs(block)
            found.append(keyed(hashes[ok], buckets))
            own.append(cut.anchored(len(hashes), block)[ok])
        keys, own = np.concatenate(found), np.concatenate(own)
        order = np.argsort(keys)
        keys, own = keys[order], own[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[first]
        self.anchors = np.add.reduceat(own, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)

    def parts(self):
        for part in slices(self.texts.to_batches(), **AT_ONCE):
            yield Slice(part.column("text"))

    def runs(self, answers: pa.Table):
        """(number of the part, first, second, place): the runs around hits in each part, as keys and further 64 bits."""
        elsewhere = answered(self.keys, answers) if len(self.keys) else np.zeros(0, bool)
        if not elsewhere.any() and not (self.anchors > 0).any():
            return
        window, block = self.window, self.block
        for n, cut in enumerate(self.parts()):
            short, ok = cut.runs(block)
            at = np.searchsorted(self.keys, keyed(short, self.buckets))
            at[~ok] = 0
            hit = ok & (elsewhere[at] | (self.anchors[at] > cut.anchored(len(short), block)))
            if not hit.any():
                continue
            a, b, fits = cut.wide_runs(window)
            sums = np.concatenate(([0], np.cumsum(hit)))
            place = np.flatnonzero(fits & (sums[window - block + 1 :][: len(a)] > sums[: len(a)]))
            yield n, keyed(a[place], self.buckets), b[place], place


def distinct_runs(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return sorted_pairs(np.concatenate([NONE, *(f[1] for f in found)]), np.concatenate([NONE, *(f[2] for f in found)]))


def lookup(table):
    """A bucket's answer: for each group's probes whether an anchor of another group has them."""
    runs = runs_of(table, "lower", np.uint32)
    own = flags(table, "anchors", map(len, runs))
    index, groups = np.unique(np.concatenate([np.zeros(0, np.uint32), *(r[f] for r, f in zip(runs, own, strict=True))]), return_counts=True)
    out = []
    for run, flag in zip(runs, own, strict=True):
        at = np.searchsorted(index, run)
        at[at == len(index)] = 0
        there = groups[at] * (index[at] == run) if len(index) else np.zeros(len(run), np.int64)
        out.append(np.packbits(there > flag).tobytes())
    return pa.table({"grp": table.column("grp"), "step": pa.array([1] * len(out), pa.int32()), "bucket": table.column("bucket"), "bits": pa.array(out, pa.binary())})


def meet(table):
    """A bucket's answer: for each group's runs whether they stand in another group too, or in its own again."""
    one, two = runs_of(table, "lower", np.uint32), runs_of(table, "seconds", np.uint64)
    again = flags(table, "again", map(len, one))
    first, second, groups = sorted_pairs(np.concatenate([np.zeros(0, np.uint32), *one]), np.concatenate([NONE, *two]))
    out = [np.packbits((groups[held(first, second, a, b)] > 1) | twice).tobytes() for a, b, twice in zip(one, two, again, strict=True)]
    return pa.table({"grp": table.column("grp"), "step": pa.array([2] * len(out), pa.int32()), "bucket": table.column("bucket"), "bits": pa.array(out, pa.binary())})


def mark(group: Group, answers: pa.Table) -> pa.Table:
    """Each document of a group without the words that its repeats cover."""
    texts, step = group.texts, answers.column("step")
    found = list(group.runs(answers.filter(pc.equal(step, 1))))
    first, second, _ = distinct_runs(found)
    again = answered(first, answers.filter(pc.equal(step, 2))) if len(first) else np.zeros(0, bool)
    first, second = first[again], second[again]
    places = {n: place[held(first, second, a, b) >= 0] for n, a, b, place in found}
    total, removed, digest, kept, spans = [], [], [], [], []
    for n, part in enumerate(slices(texts.to_batches(), **AT_ONCE)):
        body, begins = raw(part.column("text"))
        covered = None
        if n in places and len(places[n]):
            cut = Slice(part.column("text"))
            change = np.zeros(int(cut.begins[-1]) + 1, np.int64)
            change[places[n]] += 1
            change[places[n] + group.window] -= 1
            covered = np.cumsum(change)[:-1] > 0
        for i in range(part.num_rows):
            words = body[begins[i] : begins[i + 1]].split()
            gone = covered[cut.begins[i] : cut.begins[i + 1]] if covered is not None else np.zeros(0, bool)
            k = int(gone.sum())
            rest = b" ".join(words if not k else [words[j] for j in np.flatnonzero(~gone).tolist()])
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])))).reshape(-1, 2) if k else []
            total.append(len(words))
            removed.append(k)
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode() if k else None)
            spans.append([{"first": int(x), "words": int(y - x)} for x, y in edge])
    kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
    return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, kind)})


def repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, null if all do), spans (maximal repeats as first word and number)."""
    block = (window + 1) // 2
    docs = docs.select("doc_id", "text")
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    groups, buckets = max(4, -(-size // GROUP_BYTES)), max(4, -(-size // (6 * BUCKET_WINDOWS)))
    dealt = docs.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.crc32("text"), F.monotonically_increasing_id()), F.lit(groups)))

    def probe(key, texts):
        group = Group(texts, window, block, buckets)
        return messages(key[0].as_py(), group.keys, anchors=group.anchors > 0)

    def extend(key, texts, answers):
        first, second, count = distinct_runs(list(Group(texts, window, block, buckets).runs(answers)))
        return messages(key[0].as_py(), first, seconds=second, again=count > 1)

    def finish(texts, answers):
        return mark(Group(texts, window, block, buckets), answers)

    answer = "grp long, step int, bucket long, bits binary"
    hits = dealt.groupBy("grp").applyInArrow(probe, "bucket long, grp long, lower binary, anchors binary").groupBy("bucket").applyInArrow(lookup, answer)
    around = dealt.groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(extend, "bucket long, grp long, lower binary, seconds binary, again binary")
    again = around.groupBy("bucket").applyInArrow(meet, answer)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<first: long, words: long>>"
    return dealt.groupBy("grp").cogroup(hits.unionByName(again).groupBy("grp")).applyInArrow(finish, schema)
