"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed
greedily against each of them: from where the last phrase ended, the longest
match in the labelled text is the next phrase (a character that occurs nowhere
is one of its own and counts twice: it must be named as well). Phrases, times the bits that name a place in the labelled
text, over characters, estimate the cross entropy; the smallest wins.

Labelled text is bounded: for each language whole distinct texts in the order of a
hash of their ids until ``chars`` characters are reached (the one that passes the
bound is cut there), among the first ``texts`` rows. The automata are sent once to
each executor: dense tables for the ``dense`` commonest characters, sorted
transitions for all others, so every character of the labelled text can match; their
size follows ``chars`` and the number of languages, not the data. Scoring walks all
texts of a slice at once, one table lookup for each character and language; when
few long texts are left, one by one. The parse of a text never starts anew. Nothing
is shuffled but the labelled sample.

Cases: a text that is null or has no letter is ``und`` with score 0; ties go to
the first language by name; without labelled text all are ``und``; repeated rows
are scored each; null ids are learnt from as not held out; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_crc

#: Flags of a table's entry beside the next state: phrases that the character begins (an unknown one counts twice).
PHRASE = 29
NEW = 1 << PHRASE


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Normaliser:
    """Lower case, letters only, one blank between words."""

    def __init__(self):
        self.letter = letters()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts (0 after each text), and the place where each ends."""
        folded = [(t or "").lower() for t in texts]
        points = np.frombuffer("\0".join([*folded, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, folded), np.int64, len(folded))
        end = np.cumsum(sizes + 1) - 1
        points = np.where(self.letter[points], points, 32).astype(np.uint32)
        points[end] = 0
        blank = points == 32
        keep = np.ones(len(points), bool)
        keep[1:] = ~(blank[1:] & (blank[:-1] | (points[:-1] == 0)))
        if len(keep):
            keep[0] = not blank[0]
        keep[:-1] &= ~(blank[:-1] & (points[1:] == 0))
        points = points[keep]
        return points, np.flatnonzero(points == 0)


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Model:
    """Tables of all languages. An entry is the next state, plus NEW for each phrase that the character begins."""

    #: With fewer texts left than this they are walked one by one.
    FEW = 24

    def __init__(self, texts: dict[str, np.ndarray], dense: int):
        self.langs = sorted(texts)
        points, n = np.unique(np.concatenate([*texts.values(), np.array([32], np.uint32)]), return_counts=True)
        self.points = points[np.argsort(-n, kind="stable")]  # class k + 1; class 0: characters of no labelled text
        self.width = min(dense, len(self.points) + 1)
        to_class = self.to_class()
        parts, self.roots, keys, nexts, at = [], [], [], [], 0
        for lang in self.langs:
            step = automaton(to_class[texts[lang]].tolist())
            table = np.full((len(step), self.width), -1, np.int64)
            for s, to in enumerate(step):
                for c, t in to.items():
                    if c < self.width:
                        table[s, c] = t + at
                    else:
                        keys.append((s + at) << 21 | c)
                        nexts.append(t + at + (NEW if s == 0 else 0))
            root = np.where(table[0] < 0, at + NEW, table[0]) + NEW
            table = np.where(table < 0, root, table)
            table[0] = root  # a phrase begins with every step from the root
            parts.append(table)
            self.roots.append(at)
            at += len(step)
        self.table = np.concatenate(parts).astype(np.int32).ravel()
        # transitions by the other characters; a state without one begins a phrase at its root
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.nexts = np.array(keys, np.int64)[order], np.array(nexts, np.int64)[order]
        self.root_of = np.repeat(self.roots, np.diff([*self.roots, at])).astype(np.int64)
        self.bits = np.array([math.log2(len(texts[x]) + 2) for x in self.langs])

    def to_class(self) -> np.ndarray:
        out = np.zeros(0x110000, np.int32)
        out[self.points] = np.arange(1, len(self.points) + 1)
        return out

    def sparse(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Entries of states and characters beyond the dense table."""

        def found(s):
            if not len(self.keys):
                return np.zeros(len(s), bool), np.zeros(len(s), np.int64)
            key = s << 21 | c
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            return self.keys[at] == key, self.nexts[at]

        root = self.root_of[state]
        (here, to), (there, begun) = found(state), found(root)
        return np.where(here, to, np.where(there, begun, root + 2 * NEW))

    def phrases(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of each text by language; ``codes`` are character classes, texts in descending size."""
        width, langs = self.width, len(self.langs)
        state = np.repeat(np.array(self.roots, np.int64)[:, None], len(begin), 1)
        count = np.zeros((langs, len(begin)), np.int64)
        active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        t = 0
        while t < len(active) and (n := int(active[t])) >= self.FEW:
            if n < state.shape[1]:
                state = np.ascontiguousarray(state[:, :n])
            c = codes[begin[:n] + t]
            rare = np.flatnonzero(c >= width)
            got = self.table[state * width + np.where(c < width, c, 0)].astype(np.int64)
            if len(rare):
                got[:, rare] = self.sparse(state[:, rare].ravel(), np.tile(c[rare], langs)).reshape(langs, -1)
            count[:, :n] += got >> PHRASE
            state = got & (NEW - 1)
            t += 1
        if t < len(active):  # the rest of the longest texts
            table = memoryview(self.table)
            for i in range(int(active[t])):
                rest = codes[begin[i] + t : begin[i] + int(size[i])].tolist()
                for k in range(langs):
                    s, new = int(state[k, i]), 0
                    for c in rest:
                        got = table[s * width + c] if c < width else int(self.sparse(np.array([s]), np.array([c]))[0])
                        new += got >> PHRASE
                        s = got & (NEW - 1)
                    count[k, i] += new
        return count


def sample(docs: DataFrame, label: str, keep, texts: int, chars: int) -> dict[str, list[str]]:
    """For each label its first ``texts`` texts by a hash of doc_id, as many as ``chars`` characters take, in one job."""
    labelled = docs.where(keep & F.col(label).isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col(label).alias("label"), "text")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    totals = labelled.groupBy("label").count()
    # about twice as many rows as are wanted, so that no task orders more
    few = labelled.withColumn("place", place).join(F.broadcast(totals), "label").where(F.col("place") < F.lit(2.0 * texts * (1 << 30)) / F.col("count"))
    few = few.select("label", "place", "doc_id", F.substring("text", 1, chars).alias("text")).withColumn("size", F.length("text"))
    order = Window.partitionBy("label").orderBy("place", "doc_id", "text")
    few = few.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= texts)
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = few.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 2 * chars).select("label", "nth", "text").collect()  # texts up to twice the bound: copies go
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["label"], r["nth"])):
        out.setdefault(r["label"], []).append(r["text"])
    return out


def train(docs: DataFrame, keep, texts: int = 2048, chars: int = 24_000, dense: int = 120) -> Model | None:
    """The model of the rows of ``docs`` (doc_id, text, lang) that ``keep`` holds for."""
    normal, bodies = Normaliser(), {}
    for lang, rows in sample(docs, "lang", keep, texts, chars).items():
        points, _ = normal(list(dict.fromkeys(rows)))
        points = np.where(points == 0, 32, points)[:chars].astype(np.uint32)
        if len(points):
            bodies[lang] = points
    return Model(bodies, dense) if bodies else None


_kept: dict[str, object] = {}


def normaliser() -> Normaliser:
    if "n" not in _kept:
        _kept["n"] = Normaliser()
    return _kept["n"]


def predict(docs: DataFrame, model: Model | None, extra: list[str]) -> DataFrame:
    """doc_id, the columns of ``extra``, lang_pred, score, phrases by language in bits a character."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ["doc_id", *extra]), "lang_pred string", "score double", "bits array<double>"])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, normal = sent.value, normaliser()
        to_class = model.to_class() if model else None
        for batch in slices(batches, rows=4096, size=16 << 20):
            points, end = normal(batch.column("text").to_pylist())
            begin = np.concatenate(([0], end[:-1] + 1)).astype(np.int64) if len(end) else end
            size = end - begin
            some = size > 0  # only letters and single blanks between them are left
            names, scores, bits = ["und"] * len(size), np.zeros(len(size)), [None] * len(size)
            if model and some.any():
                order = np.argsort(-size, kind="stable")
                total = np.zeros((len(model.langs), len(size)))
                total[:, order] = model.phrases(to_class[points], begin[order], size[order])
                rate = total * model.bits[:, None] / np.maximum(size, 1)
                best = rate.argmin(0)
                second = np.partition(rate, 1, 0)[1] if len(model.langs) > 1 else rate[0] * 2
                first = rate.min(0)
                scores = np.where(some, second / np.maximum(first + second, 1e-9), 0.0)
                for i in np.flatnonzero(some).tolist():
                    names[i] = model.langs[best[i]]
                    bits[i] = rate[:, i].tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["doc_id", *extra]), pa.array(names), pa.array(scores), pa.array(bits, pa.list_(pa.float64()))], ["doc_id", *extra, "lang_pred", "score", "bits"])

    return docs.select("doc_id", "text", *extra).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from three quarters of the rows by crc32 of doc_id, predicts all: doc_id, held_out, lang_pred, score, bits."""
    fold = F.coalesce(F.pmod(text_crc(), F.lit(4)), F.lit(0))
    model = train(docs, fold != 2)
    return predict(docs.select("doc_id", "text").withColumn("held_out", fold == 2), model, ["held_out"])
