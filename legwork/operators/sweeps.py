"""Sweeps over a time line: counts in bands, next events, interval subtraction. Work is linear in the events: no pairs are made.

A line is cut into bins of ``width`` seconds; running counts stay inside a bin, and the bins' totals, one row for each
bin, are added. So a key with a third of all events is spread over its bins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import discard, stored

one = "*"
MICROS = 1_000_000


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi join in which null keys meet null keys; the keys of ``left`` stay."""
    right = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return left.join(right, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys)), how).drop(*(f"_k_{k}" for k in keys))


def band_counts(probes: DataFrame, events: DataFrame, row: str, keys: list[str], probe_time: str, event_time: str, low: int, high: int, kind: str, kinds: list, width: int = 3600) -> DataFrame:
    """row, n_0, n_1, ...: for each probe the events of each of ``kinds`` with equal keys and event - probe time in [low, high] seconds.

    ``row`` names a probe. Each probe asks twice, for the events before its band and for those up to its end; events and
    questions are put on one line in order of time and the running counts at the questions are subtracted. ``kinds`` is a
    short list (a column each). Null keys match null keys; times may be ties.
    """
    count = [f"n_{i}" for i in range(len(kinds))]
    marks = events.select(*keys, micros(event_time).alias("_at"), F.lit(1).alias("_tag"), F.lit(None).cast(dict(probes.dtypes)[row]).alias(row), *((F.col(kind).eqNullSafe(F.lit(k))).cast("int").alias(c) for k, c in zip(kinds, count, strict=True)))
    ask = F.inline(F.array(F.struct((micros(probe_time) + low * MICROS).alias("_at"), F.lit(0).alias("_tag")), F.struct((micros(probe_time) + high * MICROS).alias("_at"), F.lit(2).alias("_tag"))))
    asked = probes.select(*keys, row, ask).withColumns({c: F.lit(0) for c in count})
    line = marks.unionByName(asked).withColumn("_bin", F.floor(F.col("_at") / (width * MICROS)))
    totals = line.groupBy(*keys, "_bin").agg(*(F.sum(c).alias(f"_b_{c}") for c in count))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    totals = totals.select(*keys, "_bin", *(F.coalesce(F.sum(f"_b_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in count))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_at", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    running = line.withColumns({c: F.sum(c).over(inside) for c in count}).where("_tag <> 1")
    found = _met(running, totals, [*keys, "_bin"]).select(row, "_tag", *((F.col(c) + F.col(f"_b_{c}")).alias(c) for c in count))
    sign = F.when(F.col("_tag") == 2, 1).otherwise(-1)
    return found.groupBy(row).agg(*(F.sum(F.col(c) * sign).alias(c) for c in count))


def next_later(rows: DataFrame, keys: list[str], time: str, name: str, width: int = 3600) -> DataFrame:
    """``rows`` with ``name``: the microseconds to the first row of equal keys that is strictly later; null for the last."""
    line = rows.withColumn("_at", micros(time)).withColumn("_bin", F.floor(F.col("_at") / (width * MICROS)))
    later = Window.partitionBy(*keys, "_bin").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("_next", F.min("_at").over(later))
    bins = line.groupBy(*keys, "_bin").agg(F.min("_at").alias("_first"))
    bins = bins.withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bin"))).drop("_first")  # a row for each bin
    return _met(line, bins, [*keys, "_bin"], "left").select(*rows.columns, (F.coalesce("_next", "_after") - F.col("_at")).alias(name))


def merged_spans(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end of the union of day spans (both ends belong to a span); spans that touch become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.where(F.col(start) <= F.col(end)).withColumn("_new", F.when(F.col(start) > F.date_add(reach, 1), 1).when(reach.isNull(), 1).otherwise(0))
    return cut.withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_n").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_n")


def subtracted(spans: DataFrame, others: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The parts of ``spans`` that no span of ``others`` with equal keys covers; the other columns of ``spans`` are kept.

    A sweep over both: the others are merged first, then every stretch between two of their ends that lies in a span is
    one part. A span meets only the merged others of its keys, in order, each once.
    """
    extra = [c for c in spans.columns if c not in (*keys, start, end)]
    held = merged_spans(others, keys, start, end).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(start, end))).alias("_held"))
    both = _met(spans, held, keys, "left").select(*spans.columns, F.coalesce("_held", F.array().cast(held.schema["_held"].dataType)).alias("_held"))
    near = F.filter("_held", lambda x: (x[end] >= F.col(start)) & (x[start] <= F.col(end)))
    opens = F.concat(F.array(F.col(start)), F.transform("_near", lambda x: F.date_add(x[end], 1)))
    shuts = F.concat(F.transform("_near", lambda x: F.date_sub(x[start], 1)), F.array(F.col(end)))
    parts = F.filter(F.arrays_zip(opens.alias("a"), shuts.alias("b")), lambda x: x["a"] <= x["b"])
    out = both.withColumn("_near", near).select(*keys, *extra, F.explode(parts).alias("_p"))
    return out.select(*keys, *extra, F.col("_p.a").alias(start), F.col("_p.b").alias(end))


def components(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, int]:
    """(a, label) for every value of both ends, and the rounds taken: ends that are linked, directly or over others, get the
    least value of their component.

    Star contraction: in turn each node links its larger neighbours, then its smaller ones, to the least node it knows, so
    every component becomes a star after a number of rounds that grows with the logarithm of its length. A round is two
    aggregates and two joins by node; the links are stored once a round, and a node with many links is no group of rows.
    """
    links = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    nodes = edges.select(F.explode(F.array(a, b)).alias("node")).distinct()

    def starred(links: DataFrame, larger: bool) -> DataFrame:
        whole = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else links
        least = whole.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        joined = whole.join(least, "u")
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if larger else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    rounds, state = 0, None
    while True:
        before, links = links, stored(starred(starred(links, True), False))
        discard(before)
        rounds += 1
        now = tuple(links.agg(F.count(one), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return nodes.join(links, nodes["node"] == links["u"], "left").select(F.col("node").alias(a), F.coalesce("v", "node").alias("label")), rounds
