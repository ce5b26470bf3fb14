"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples: for each label the ``examples`` labelled rows that come first by a hash
of their ids, while their texts before them have less than ``size`` bytes; documented
bounds on the classifier's sample, taken alike at every size. Terms are all words of
the examples and all beginnings of STEM letters of longer words, weighed by TF-IDF
alone; document frequencies are counted over all documents.

Index: the examples in blocks of ``block`` neighbours (ordered by label and main
term); for each term the blocks that hold it with their largest weight, the block
maximum, and the postings within; terms that many examples hold are rows of a matrix,
with their block maxima beside it. A query's terms give every block an upper bound; the
matrix alone gives every example a lower one, and blocks whose bound is below the
k-th of these are skipped. The others are scored exactly, so the k nearest are exact.
The index has a size set by the examples and goes to the executors once; texts are
scored where they are read, whole.

Votes weigh an example by its closeness, by how much rarer its label is in the sample
than among all labelled rows, and by what makes it close: CLOSE of its cosine counts as
it is, the rest for each shared term by how far the term is bound to label 1 in the
distinct example texts (root of the log-likelihood ratio, beyond CHANCE). So the
neighbours are those of the cosine, and among them the ones that share telling words
have the larger say. A monotone fit of label against vote, made
on the examples with themselves left out, turns a vote into the score; texts
without a term in common give the rate of such examples. ``evidence`` names the
examples that speak for a score above the general rate.

Cases: null and empty texts have no terms and get the rate of such examples; an
unlabelled table gives score 0; labels other than 0 and 1 and null ids are left out
of the examples, an id with both labels counts as 1; ids may be of any type; ties
between examples go to the smaller number in the index; repeated rows are scored
each; an empty table gives an empty result; extra columns are ignored, and kept by
``drop_toxic`` whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, hashed_sample, release, slices, text_crc

WORD = re.compile(r"[^\W\d_]+")
STEM = 5
#: A term is a row of the index's matrix if one example in DENSE holds it; a row takes at most DENSE times its list's room.
DENSE = 16
#: Share of a term that speaks for no label in a vote, and root of the log-likelihood ratio that chance explains.
CLOSE, CHANCE = 0.1, 2.0


def terms_of(text: str | None) -> dict[str, int]:
    """All terms of a text and how often they occur: words with a blank after them, and beginnings as they are."""
    out: dict[str, int] = {}
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        out[word + " "] = n
        if len(word) > STEM:
            out[word[:STEM]] = out.get(word[:STEM], 0) + n
    return out


class Vocabulary:
    """The examples' terms by number; counts them in texts."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.words = {t[:-1]: i for i, t in enumerate(terms) if t.endswith(" ")}
        self.stems = {t: i for i, t in enumerate(terms) if not t.endswith(" ")}

    def counts(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        if not text:
            return out
        words, stems = self.words.get, self.stems.get
        for word, n in Counter(WORD.findall(text.lower())).items():
            if (i := words(word)) is not None:
                out[i] = n
            if len(word) > STEM and (i := stems(word[:STEM])) is not None:
                out[i] = out.get(i, 0) + n
        return out


def arrays(counts) -> tuple[np.ndarray, np.ndarray]:
    """Terms and how often they occur, of a dictionary or as they are."""
    if isinstance(counts, dict):
        return np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))
    return counts


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    size = end - begin
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def association(in1: np.ndarray, in0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Signed root of the log-likelihood ratio between occurrence and label."""
    n, both = max(1, n1 + n0), in1 + in0
    total = np.zeros(len(in1))
    for seen, expected in ((in1, both * n1 / n), (in0, both * n0 / n), (n1 - in1, (n - both) * n1 / n), (n0 - in0, (n - both) * n0 / n)):
        some = seen > 0
        total[some] += seen[some] * np.log(seen[some] / expected[some])
    return np.sqrt(np.maximum(2 * total, 0)) * np.sign(in1 * n0 - in0 * n1)


class Index:
    """Block-max inverted index of the examples, and the fit from votes to scores."""

    def __init__(self, vectors: list, labels: list[int], ids: list, term_weight: np.ndarray, telling: np.ndarray, factor: np.ndarray, k: int, block: int):
        self.term_weight, self.k, self.block = term_weight, k, block
        self.telling = telling.astype(np.float32)
        vectors = [arrays(v) for v in vectors]
        main = [int(at[np.lexsort((at, -n * term_weight[at]))[0]]) if len(at) else -1 for at, n in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (labels[i], main[i], i))
        self.ids = [ids[i] for i in order]
        self.labels = np.array([labels[i] for i in order], np.float64)
        self.weight = factor[self.labels.astype(int)]
        terms, places, weights = [], [], []
        for place, i in enumerate(order):
            at, w = self.vector(vectors[i])
            terms.append(at)
            weights.append(w)
            places.append(np.full(len(at), place))
        term, place, weight = (np.concatenate(x) if x else np.zeros(0) for x in (terms, places, weights))
        by_term = np.lexsort((place, term))
        term, self.place, self.posting = term[by_term].astype(np.int64), place[by_term].astype(np.int32), weight[by_term].astype(np.float32)
        # terms of many examples are rows of a matrix instead: reading a long list costs more than multiplying it
        often = np.bincount(term, minlength=len(term_weight)) * DENSE >= max(1, len(order))
        self.row = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        self.matrix = np.zeros((int(often.sum()), len(order)), np.float32)
        long = often[term]
        self.matrix[self.row[term[long]], self.place[long]] = self.posting[long]
        self.blocks = -(-len(order) // block)
        edges = np.arange(0, len(order), block)
        self.peaks = np.maximum.reduceat(self.matrix, edges, axis=1) if len(order) else np.zeros((len(self.matrix), 0), np.float32)
        held = self.place // block
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (held[1:] != held[:-1])
        begin = np.flatnonzero(new)
        self.begin = np.concatenate((begin, [len(term)])).astype(np.int32)  # of an entry's postings
        self.held = held[begin]  # an entry's block
        self.most = np.maximum.reduceat(self.posting, begin) if len(begin) else np.zeros(0, np.float32)
        self.entries = np.searchsorted(term[begin], np.arange(len(term_weight) + 1)).astype(np.int32)  # of a term
        votes, truth, weight, self.bare = [], [], [], [0.0, 0.0]
        for place, i in enumerate(order):
            if place % 256 == 0:
                begun = self.begun([vectors[j] for j in order[place : place + 256]])
            vote, _ = self.vote(vectors[i], without=place, begun=begun[place % 256])
            if vote is None:
                self.bare[0] += self.weight[place] * self.labels[place]
                self.bare[1] += self.weight[place]
            else:
                votes.append(vote)
                truth.append(self.labels[place])
                weight.append(self.weight[place])
        total = float(self.weight.sum())
        self.rate = float((self.weight * self.labels).sum() / total) if total else 0.0
        self.at, self.fit = monotone(np.array(votes), np.array(truth), np.array(weight))

    def vector(self, counts) -> tuple[np.ndarray, np.ndarray]:
        at, n = arrays(counts)
        w = (1 + np.log(n)) * self.term_weight[at]
        norm = math.sqrt(float(w @ w))
        return at, (w / norm if norm else w).astype(np.float32)

    def begun(self, texts: list) -> list[tuple]:
        """For each of many texts (counts) its vector without the matrix's terms, and what those give to every example and to every block's bound."""
        vectors = [self.vector(c) for c in texts]
        dense = np.zeros((len(texts), len(self.matrix)), np.float32)
        rest = []
        for i, (at, w) in enumerate(vectors):
            row = self.row[at]
            some = row >= 0
            dense[i, row[some]] = w[some]
            rest.append((at[~some], w[~some]))
        return [(*r, b, p) for r, b, p in zip(rest, dense @ self.matrix, dense @ self.peaks, strict=True)]

    def nearest(self, counts, without: int = -1, begun: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a term in common, and their cosines: exact."""
        at, w, base, peaks = begun or self.begun([counts])[0]
        begin, end = self.entries[at], self.entries[at + 1]
        entry, part = ranges(begin, end), np.repeat(w, end - begin)
        held = self.held[entry]
        bound = np.bincount(held, weights=part * self.most[entry], minlength=self.blocks) + peaks
        if without >= 0:
            base = base.copy()
            base[without] = 0
        # no example of the k nearest scores less than the k-th by the matrix alone: blocks bounded by less stay unread
        least = np.partition(base, -self.k)[-self.k] - 1e-6 if len(base) > self.k else 0.0
        wanted = (bound >= least) & (bound > 0)
        if not wanted.all():
            some = wanted[held]
            entry, part = entry[some], part[some]
        low, high = self.begin[entry], self.begin[entry + 1]
        posting = ranges(low, high)
        got = base + np.bincount(self.place[posting], weights=np.repeat(part, high - low) * self.posting[posting], minlength=len(self.labels))
        got[~np.repeat(wanted, self.block)[: len(got)]] = 0
        if without >= 0:
            got[without] = 0
        rows = np.flatnonzero(got >= max(np.partition(got, -self.k)[-self.k], 1e-12)) if len(got) > self.k else np.flatnonzero(got > 0)
        best = rows[np.lexsort((rows, -got[rows]))[: self.k]]
        return best, got[best]

    def told(self, counts) -> np.ndarray:
        """For every example the parts of its cosine, each times how far the shared term is bound to label 1."""
        at, w = self.vector(counts)
        some = self.telling[at] > 0
        at, w = at[some], w[some] * self.telling[at[some]]
        low, high = self.begin[self.entries[at]], self.begin[self.entries[at + 1]]
        posting = ranges(low, high)
        return np.bincount(self.place[posting], weights=np.repeat(w, high - low) * self.posting[posting], minlength=len(self.labels))

    def vote(self, counts, without: int = -1, begun: tuple | None = None):
        """Share of label 1 among the nearest, by closeness and by what makes them close; None without any."""
        counts = arrays(counts)
        if not len(counts[0]):
            return None, ()
        rows, scores = self.nearest(counts, without, begun)
        if not len(rows):
            return None, ()
        scores = np.minimum(scores, 1)
        w = self.weight[rows] * (CLOSE * scores + self.told(counts)[rows]) / (1.02 - scores)
        return float((w * self.labels[rows]).sum() / w.sum()), rows

    def scores(self, texts: list) -> list[tuple[float, list]]:
        """Score and evidence of each of many texts (counts)."""
        texts = [arrays(c) for c in texts]
        return [self.score(c, b) for c, b in zip(texts, self.begun(texts), strict=True)]

    def score(self, counts, begun: tuple | None = None) -> tuple[float, list]:
        vote, rows = self.vote(counts, begun=begun)
        if vote is None:
            return self.bare[0] / self.bare[1] if self.bare[1] else self.rate, []
        score = float(np.interp(vote, self.at, self.fit)) if len(self.at) else self.rate
        return score, [self.ids[r] for r in rows if self.labels[r] == 1] if score > self.rate else []


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic fit of y over x by pooling neighbours: places and values to interpolate between."""
    pools: list[list[float]] = []  # weight, weight * y, weight * x
    for i in np.lexsort((y, x)).tolist():
        pools.append([w[i], w[i] * y[i], w[i] * x[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many hold each term."""
    size = len(vocabulary.terms)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        release()
        own, total = sent.value, np.zeros(size + 1, np.int64)
        for batch in slices(batches):
            total[size] += batch.num_rows
            for text in batch.column("text").to_pylist():
                if found := own.counts(text):
                    total[np.fromiter(found, np.int64, len(found))] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])

    out = np.zeros(size + 1, np.int64)
    counted = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out[counted["term"].to_numpy()] = counted["n"].to_numpy()
    return int(out[size]), out[:size]


def train(docs: DataFrame, labelled: DataFrame, examples: int = 1000, k: int = 32, block: int = 64, size: int = 32 << 20) -> tuple[Vocabulary, Index] | None:
    """The index over ``labelled`` (doc_id, label 0/1), rows of ``docs`` (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    labelled = labelled.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast(kind).alias("doc_id")).agg(F.max("label").alias("label"))
    totals = dict(labelled.groupBy("label").count().collect())
    if not totals:
        return None
    picked = [hashed_sample(labelled.where(F.col("label") == x), n, examples) for x, n in sorted(totals.items())]
    chosen = durable(picked[0].unionByName(picked[-1]) if len(picked) > 1 else picked[0])  # at most 2 * examples rows

    def run(batches):
        for batch in slices(batches):
            found = [terms_of(t) for t in batch.column("text").to_pylist()]
            lists = [pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "label", "tie")), *lists], ["doc_id", "label", "tie", "term", "n"])

    sample = durable(docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).join(F.broadcast(chosen), "doc_id"))
    earlier = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)  # lengths of the examples alone
    within = sample.select("doc_id", "label", "tie", F.octet_length("text").alias("bytes")).withColumn("before", F.sum("bytes").over(earlier)).where(F.coalesce("before", F.lit(0)) < size)
    sample = sample.join(F.broadcast(within.select("doc_id", "tie").distinct()), ["doc_id", "tie"])
    table = sample.mapInArrow(run, f"doc_id {kind}, label int, tie long, term array<string>, n array<int>").toArrow()  # the examples' terms: packed, as their texts may be long
    # one row for each example, the same whatever the order of the rows
    ids, ties = table.column("doc_id").to_pylist(), table.column("tie").to_pylist()
    first: dict = {}
    for i in sorted(range(len(ids)), key=lambda i: (ids[i], ties[i])):
        first.setdefault(ids[i], i)
    if not first:
        return None
    table = table.take(pa.array(list(first.values()))).combine_chunks()
    ids, labels = list(first), table.column("label").to_pylist()
    terms = pc.list_flatten(table.column("term").combine_chunks()).dictionary_encode()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    code, amount = terms.indices.to_numpy().astype(np.int64), pc.list_flatten(table.column("n").combine_chunks()).to_numpy().astype(np.float64)
    cut = np.concatenate(([0], np.cumsum(pc.list_value_length(table.column("term")).to_numpy())))
    vectors = [(code[a:b], amount[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    number = terms.dictionary.to_pylist()
    del table, terms
    seen, counts, known = np.zeros((2, len(number))), [0, 0], set()
    for (at, times), label in zip(vectors, labels, strict=True):
        order = np.argsort(at)
        if (key := (label, hashlib.blake2b(at[order].tobytes() + times[order].tobytes()).digest())) not in known:  # distinct texts
            known.add(key)
            counts[label] += 1
            seen[label, at] += 1
    vocabulary = Vocabulary(number)
    total, df = frequencies(docs, vocabulary)
    weight = np.log((1 + total) / (1 + df)) + 1
    telling = np.maximum(association(seen[1], seen[0], counts[1], counts[0]) - CHANCE, 0)
    factor = np.array([totals.get(x, 0) / max(1, labels.count(x)) for x in (0, 1)])
    return vocabulary, Index(vectors, labels, ids, weight, telling, factor, k, block)


def score(docs: DataFrame, model: tuple[Vocabulary, Index] | None, columns: list[str], rejects: float | None = None, threshold: float = 0.7) -> DataFrame:
    """``columns`` of docs with score, predicted and evidence; with ``rejects`` the rows that score less, as they are."""
    kinds = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        release()
        model = sent.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            got = model[1].scores([model[0].counts(t) for t in texts]) if model else [(0.0, [])] * len(texts)
            scores = np.array([g[0] for g in got], np.float64)
            if rejects is not None:
                yield batch.filter(pa.array(scores < rejects))
                continue
            more = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array([g[1] for g in got], pa.list_(batch.column("doc_id").type))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *more], [*columns, "score", "predicted", "evidence"])

    if rejects is not None:
        return docs.mapInArrow(run, docs.schema)
    return docs.select("text", *columns).mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in columns), f"score double, predicted int, evidence array<{kinds['doc_id']}>"]))


def learnt(docs: DataFrame, labels: DataFrame) -> tuple[Vocabulary, Index] | None:
    """The model of the labelled rows whose crc32 of doc_id leaves 0 or 2 by 3."""
    labelled = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(F.pmod(text_crc(), F.lit(3)) != 1)
    return train(docs, labelled)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every document."""
    held_out = F.coalesce(F.pmod(text_crc(), F.lit(3)) == 1, F.lit(False))
    docs = docs.select("doc_id", "text")
    return score(docs.withColumn("held_out", held_out), learnt(docs, labels), ["doc_id", "held_out"])


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score less than ``threshold``, all columns as they are."""
    return score(docs, learnt(docs, labels), docs.columns, rejects=threshold)
