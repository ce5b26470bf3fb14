"""Joins beyond the plain equi join. Each states its key so that Spark shuffles by it; no cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast, after they were counted.
SMALL = 50_000


#: Bytes up to which a side is broadcast: rows times the columns' usual sizes.
SMALL_BYTES = 64 << 20


#: Rows of a part of ``dealt``.
DEALT = 1_000_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and about SMALL_BYTES, else as it is (Spark then shuffles)."""
    width = sum(20 + (60 if k == "string" or "<" in k else 0) for _, k in df.dtypes)
    rows = min(rows, SMALL_BYTES // max(1, width))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def interval_checks(intervals: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """check, violations: inverted intervals, overlaps and gaps with the next one."""
    w = Window.partitionBy(F.lit(0)).orderBy(start)  # an interval dimension is a few rows
    nxt = F.lead(start).over(w)
    seen = intervals.withColumn("_next", nxt)
    counts = seen.agg(
        F.count_if(F.col(end) < F.col(start)).alias("inverted"),
        F.count_if(F.col("_next") <= F.coalesce(end, F.lit("9999-12-31").cast("date"))).alias("overlap"),
        F.count_if(F.col("_next") > F.date_add(end, 1)).alias("gap"),
    )
    return counts.unpivot([], ["inverted", "overlap", "gap"], "check", "violations")


def interval_join(facts: DataFrame, intervals: DataFrame, day: str, start: str = "start", end: str = "end", until: str = "2199-12-31", how: str = "left") -> DataFrame:
    """Each fact with the interval that holds its day; an open end runs to ``until``.

    Intervals become one row a day, so this is an equi join, broadcast if they are few.
    """
    spans = intervals.withColumn(day, F.explode(F.sequence(F.col(start), F.coalesce(end, F.lit(until).cast("date"))))).drop(start, end)
    return facts.join(small(spans, 1_000_000), day, how)


def lookup(facts: DataFrame, dim: DataFrame, on: list[str], fill: dict | None = None, required: bool = False) -> DataFrame:
    """Many-to-one join with unique keys; ``required`` raises on unmatched keys, ``fill`` replaces nulls."""
    double = dim.groupBy(*on).count().where("count > 1").limit(5).collect()
    if double:
        raise ValueError(f"keys are not unique: {[tuple(r)[:-1] for r in double]}")
    side = small(dim)
    if required:
        lost = facts.join(side, on, "left_anti").select(*on).distinct().limit(5).collect()
        if lost:
            raise ValueError(f"keys without a match: {[tuple(r) for r in lost]}")
    out = facts.join(side, on, "left")
    return out.fillna(fill) if fill else out


def lagged_join(facts: DataFrame, daily: DataFrame, day: str, keys: list[str], lag: int = 2) -> DataFrame:
    """Each fact with the row of ``daily`` that is ``lag`` days older; equal keys, row count kept (daily keys are unique)."""
    return facts.join(daily.withColumn(day, F.date_add(day, lag)), [day, *keys], "left")


def utc_hour(local: Column, zone: str) -> Column:
    """UTC hour of a local time without zone: the spring gap moves on, the autumn hour that comes twice is null."""
    utc = F.to_utc_timestamp(local, zone)
    again = F.from_utc_timestamp(utc + F.expr("INTERVAL 1 HOUR"), zone) == local.cast("timestamp")
    return F.when(~again, F.date_trunc("hour", utc).cast("timestamp_ntz"))


def neighbour_days(daily: DataFrame, day: str, keys: list[str], values: list[str]) -> DataFrame:
    """Values of the day before and after as columns; days may be missing, so the neighbour's date is checked."""
    w = Window.partitionBy(*keys).orderBy(day)
    out = {}
    for v in values:
        out[f"{v}_before"] = F.when(F.lag(day).over(w) == F.date_sub(day, 1), F.lag(v).over(w))
        out[f"{v}_after"] = F.when(F.lead(day).over(w) == F.date_add(day, 1), F.lead(v).over(w))
    return daily.withColumns(out)


def role(dim: DataFrame, key: str, name: str, prefix: str) -> DataFrame:
    """A dimension in a role: key renamed to ``name``, other columns prefixed."""
    return dim.select(F.col(key).alias(name), *(F.col(c).alias(f"{prefix}{c}") for c in dim.columns if c != key))


def undirected(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ends of a pair, least first."""
    return F.least(a, b), F.greatest(a, b)


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, low: int, high: int, how: str = "inner") -> DataFrame:
    """Pairs with equal ``on`` and left_time - right_time in [low, high] seconds.

    Times are cut into bins as wide as the band; each right row goes to the at most
    two bins it can meet, so the join has an equi key however many rows share ``on``.
    """
    width = max(1, high - low)
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    a = left.withColumn("_bin", F.floor(second(left_time) / width)).withColumn("_l", second(left_time))
    reach = F.sequence(F.floor((second(right_time) + low) / width), F.floor((second(right_time) + high) / width))
    b = right.withColumn("_r", second(right_time)).withColumn("_bin", F.explode(reach))
    near = (F.col("_l") - F.col("_r")).between(low, high)
    keys = [*on, "_bin"]
    right_only = [c for c in right.columns if c not in on]
    b = b.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_r", *right_only)
    same = near
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    return a.join(b, same, how).drop("_bin", "_l", "_r", *(f"_k_{k}" for k in keys))


def nearest_value(facts: DataFrame, anchors: DataFrame, keys: list[str], value: str, anchor: str, reach: int) -> DataFrame:
    """Each fact's nearest anchor with equal keys at a distance of at most ``reach``; a tie goes to the later anchor; else null.

    Anchors are whole numbers; distinct ones are a small table, exploded to the values they can serve, which decides
    each (keys, value) once before the facts join.
    """
    served = anchors.select(*keys, anchor).distinct().withColumn(value, F.explode(F.sequence(F.col(anchor) - reach, F.col(anchor) + reach)))
    best = served.groupBy(*keys, value).agg(F.min_by(anchor, F.struct(F.abs(F.col(anchor) - F.col(value)), -F.col(anchor))).alias(anchor))
    return facts.join(small(best, 1_000_000), [*keys, value], "left")


def cascade_mean(facts: DataFrame, history: DataFrame, levels: list[list[str]], value: str) -> DataFrame:
    """Mean of ``history`` at the first level of keys that has one, and the number of that level (the global mean is the last)."""
    out, found, names = facts, [], []
    for i, keys in enumerate(levels):
        mean = history.groupBy(*keys).agg(F.avg(value).alias(f"_m{i}"))
        out = out.join(mean, keys, "left")
        found.append(F.col(f"_m{i}"))
        names.append(f"_m{i}")
    total = history.agg(F.avg(value).alias("_all"))
    out = out.crossJoin(F.broadcast(total))  # one row
    level = F.lit(len(levels))
    for i in reversed(range(len(levels))):
        level = F.when(found[i].isNotNull(), i).otherwise(level)
    return out.withColumns({"mean": F.coalesce(*found, F.col("_all")), "level": level}).drop("_all", *names)


def asof(facts: DataFrame, probes: DataFrame, keys: list[str], fact_day: str, probe_day: str, values: list[str]) -> DataFrame:
    """Each probe with ``values`` of the last fact of its keys on or before its day. Null keys match null keys.

    Facts and probes are put on one line by key and day and the last fact is carried forward: one shuffle, no range join.
    """
    value = F.struct(*values)
    a = facts.select(*keys, F.col(fact_day).alias("_day"), F.lit(0).alias("_tag"), value.alias("_value"), F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType).alias("_row"))
    b = probes.select(*keys, F.col(probe_day).alias("_day"), F.lit(1).alias("_tag"), F.lit(None).cast(a.schema["_value"].dataType).alias("_value"), F.struct(*probes.columns).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_day", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("_value", F.last("_value", ignorenulls=True).over(w)).where("_tag = 1")
    return carried.select("_row.*", *(F.col(f"_value.{v}").alias(v) for v in values))


def missing_rows(have: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``wanted`` that ``have`` lacks."""
    return wanted.join(have.select(*keys).distinct(), keys, "left_anti")


def completed(vintages: DataFrame, wanted: DataFrame, keys: list[str], year: str) -> DataFrame:
    """``vintages`` plus, for absent (keys, year), a copy of the keys' first vintage; ``synthetic`` tells them apart."""
    first = vintages.groupBy(*keys).agg(F.min_by(F.struct(*vintages.columns), year).alias("_f")).select("_f.*").drop(year)
    extra = missing_rows(vintages, wanted, [*keys, year]).join(first, keys)
    return vintages.withColumn("synthetic", F.lit(False)).unionByName(extra.withColumn("synthetic", F.lit(True)))


class Guard:
    """What a guarded lookup saw while its rows were computed: rows in and out, the most rows of a dimension key, unmatched rows."""

    def __init__(self):
        self._facts, self._dim, self._out = (Observation() for _ in range(3))

    def seen(self) -> dict[str, int]:
        """The counts; waits for the action that computes the rows."""
        return {k: v or 0 for o in (self._facts, self._dim, self._out) for k, v in o.get.items()}

    def check(self, unmatched: float = 1.0) -> dict[str, int]:
        """The counts, or an error if a key was not unique, rows were lost or doubled, or a larger share than ``unmatched`` met nothing."""
        seen = self.seen()
        if seen["most"] > 1:
            raise ValueError(f"a key of the dimension has {seen['most']} rows")
        if seen["rows_out"] != seen["rows_in"]:
            raise ValueError(f"{seen['rows_in']} rows became {seen['rows_out']}")
        if seen["unmatched"] > unmatched * seen["rows_out"]:
            raise ValueError(f"{seen['unmatched']} of {seen['rows_out']} rows met no row of the dimension")
        return seen


def guarded_lookup(facts: DataFrame, dim: DataFrame, on: list[str]) -> tuple[DataFrame, Guard]:
    """(facts with the columns of ``dim``, guard): a left lookup whose guards are counted in the job that computes it.

    The dimension is grouped by key, which keeps one row and tells how many there were, so a doubled key never doubles
    facts; ``guard.check()`` after the action raises what an extra job for each lookup would have found before.
    """
    guard = Guard()
    others = [c for c in dim.columns if c not in on]
    once = dim.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*others)).alias("_d") if others else F.lit(True).alias("_d")).observe(guard._dim, F.max("_n").alias("most"))
    out = facts.observe(guard._facts, F.count(F.lit(1)).alias("rows_in")).join(once, on, "left")
    out = out.observe(guard._out, F.count(F.lit(1)).alias("rows_out"), F.count_if(F.col("_n").isNull()).alias("unmatched"))
    return out.select(*facts.columns, *(F.col(f"_d.{c}").alias(c) for c in others)), guard


def dealt(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """``rows`` shuffled by ``keys`` into as many parts as hold ``DEALT`` of ``count`` rows each (as they are if Spark's own number of parts does), so that what a task sorts or groups afterwards does not grow with the table.

    Groupings and windows whose keys begin with these need no other shuffle.
    """
    parts = -(-count // DEALT)
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
