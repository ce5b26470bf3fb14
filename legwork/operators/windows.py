"""Window operators over ordered observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored
from .aggregates import running
from .sweeps import components
from .joins import asof, small


def legs(stops: DataFrame, trip: list[str], time: str, carry: list[str]) -> DataFrame:
    """Each stop with the next one of its trip by time (a stop without time is the last); ``next_`` columns for ``carry``."""
    w = Window.partitionBy(*trip).orderBy(F.col(time).asc_nulls_last())
    return stops.withColumns({f"next_{c}": F.lead(c).over(w) for c in carry}).where(F.col(f"next_{carry[0]}").isNotNull())


def headway(rows: DataFrame, keys: list[str], time: str, ids: str | None = None) -> DataFrame:
    """Minutes to the previous and next departure of the same keys, first/last flags, neighbours' ids."""
    w = Window.partitionBy(*keys).orderBy(time)
    minutes = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) / 6e7
    out = {"before_min": minutes(F.lag(time).over(w), F.col(time)), "after_min": minutes(F.col(time), F.lead(time).over(w))}
    out |= {"is_first": F.lag(time).over(w).isNull(), "is_last": F.lead(time).over(w).isNull()}
    if ids:
        out |= {"before_id": F.lag(ids).over(w), "after_id": F.lead(ids).over(w)}
    return rows.withColumns(out)


STATS = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}


def rolling(rows: DataFrame, keys: list[str], order: list[str], value: str, n: int, stats: tuple[str, ...] = ("mean",), least: int = 1, lag: int = 0) -> DataFrame:
    """Statistics of the last ``n`` occurrences of the same keys, ``lag`` back; null with fewer than ``least`` values."""
    if unknown := set(stats) - set(STATS):
        raise ValueError(f"unknown statistics: {sorted(unknown)}")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n + 1 - lag, -lag)
    return rows.withColumns({f"{value}_{s}{n}": F.when(F.count(value).over(w) >= least, STATS[s](value).over(w)) for s in stats})


def rolling_ratio(rows: DataFrame, keys: list[str], order: list[str], part: str, whole: str, n: int, lag: int = 0) -> Column:
    """Ratio of two rolling sums; null where the denominator is 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n + 1 - lag, -lag)
    return F.sum(part).over(w) / F.nullif(F.sum(whole).over(w), F.lit(0))


def publication_cutoff(day: Column) -> Column:
    """Last published day when deciding the day before: the end of the month before, or two before until the 4th."""
    decided = F.date_sub(day, 1)
    return F.last_day(F.add_months(decided, F.when(F.dayofmonth(decided) >= 4, -1).otherwise(-2)))


def publication_history(rows: DataFrame, keys: list[str], day: str, value: str, threshold: float, n: int = 7) -> DataFrame:
    """Rows with statistics of the ``n`` daily means that end with the last one published before the row's day.

    Statistics are looked up once for every (keys, last published day) that occurs, a small table; the rows then meet it
    in an equi join. A single value has a standard deviation of 0. Null keys are a group of their own.
    """
    daily = rows.groupBy(*keys, day).agg(F.avg(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-n + 1, 0)
    daily = daily.select(
        *keys, day, F.col("_v").alias("h_last"), F.avg("_v").over(w).alias("h_mean"), F.percentile("_v", F.lit(0.5)).over(w).alias("h_median"), F.max("_v").over(w).alias("h_max"),
        F.coalesce(F.stddev_samp("_v").over(w), F.lit(0.0)).alias("h_std"), F.count_if(F.col("_v") > threshold).over(w).alias("h_over"),
    )
    rows = rows.withColumn("_cut", publication_cutoff(F.col(day)))
    cuts = rows.select(*keys, "_cut").distinct()
    looked = asof(daily, cuts, keys, day, "_cut", ["h_last", "h_mean", "h_median", "h_max", "h_std", "h_over"])
    names = [*keys, "_cut"]
    return null_safe_join(rows, small(looked), names, "left").drop("_cut")


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which nulls equal nulls; the columns of ``on`` come from the left."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on))
    return left.join(other, same, how).drop(*(f"_r_{c}" for c in on))


def carried_forward(rows: DataFrame, keys: list[str], order: str, value: str, gaps: list) -> Column:
    """The last known value, only where ``order`` is one of ``gaps`` and the value is null; never from later rows."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.col(value).isNull() & F.col(order).isin(gaps), F.last(value, ignorenulls=True).over(w)).otherwise(F.col(value))


def rank_share(rows: DataFrame, keys: list[str], value: str, name: str = "pct") -> DataFrame:
    """``rows`` with the average rank of ties over the number of rows as ``name``.

    Distinct values are counted and their ranks run over cells of their range; rows only join the result.
    """
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counts, value, ["_c"], by=keys)
    size = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = null_safe_join(ranked, size, keys)
    # from below: rows with a larger value are cum - c
    share = (F.col("_n") - F.col("cum__c") + (F.col("_c") + 1) / 2) / F.col("_n")
    return null_safe_join(rows, ranked.select(*keys, value, share.alias(name)), [*keys, value])


def ranked_cut(rows: DataFrame, keys: list[str], order: list[str], parts: int = 4, name: str = "part") -> DataFrame:
    """``rows`` with the number (from 1) of the part when ranks 1..n are cut at 1 + (n - 1) k / parts, the lower part holding its edge.

    The first column of ``order`` is counted value by value; only rows that share it are sorted together.
    """
    first = order[0]
    counts = rows.groupBy(*keys, first).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counts, first, ["_c"], by=keys)
    before = null_safe_join(ranked, counts.groupBy(*keys).agg(F.sum("_c").alias("_n")), keys).select(*keys, first, "_n", (F.col("_n") - F.col("cum__c")).alias("_before"))
    r = F.row_number().over(Window.partitionBy(*keys, first).orderBy(*order[1:])) + F.col("_before")
    placed = null_safe_join(rows, before, [*keys, first]).withColumn("_r", r)
    return placed.withColumn(name, F.when(F.col("_r") == 1, 1).otherwise(F.ceil((F.col("_r") - 1) * parts / (F.col("_n") - 1)).cast("int"))).drop("_r", "_n", "_before")


def top(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group by a total order, with their place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def islands(rows: DataFrame, keys: list[str], order: list, same: list[str]) -> DataFrame:
    """Rows with ``island``: a number that grows by one whenever a column of ``same`` differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.lit(False)
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    rows = rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(new.cast("int")))
    return rows.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged(pairs: DataFrame, group: str, member: str) -> DataFrame:
    """group, label: groups that share members, directly or over others, get the least label.

    Every group is linked to the least group of each of its members; ``sweeps.components`` then contracts these links to
    stars in rounds by the logarithm of the longest chain.
    """
    pairs = stored(pairs.select(group, member).where(F.col(group).isNotNull()).distinct())
    least = pairs.where(F.col(member).isNotNull()).groupBy(member).agg(F.min(group).alias("_least"))
    links = pairs.join(least, member, "left").select(F.col(group), F.coalesce("_least", group).alias("_least"))
    return components(links, group, "_least")[0]


def conservation(rows: DataFrame, trip: list[str], order: list, load: str, on: str, off: str) -> DataFrame:
    """Residual next load - load - boardings + alightings along a trip (of the next stop)."""
    w = Window.partitionBy(*trip).orderBy(*order)
    return rows.withColumn("residual", F.lead(load).over(w) - F.col(load) - F.lead(on).over(w) + F.lead(off).over(w))


def service_id(first: Column, number: Column, prefix: str = "") -> Column:
    """``number_HHhMM`` of a service's first departure; ``_NA`` without one."""
    return F.concat(F.lit(prefix), number.cast("string"), F.coalesce(F.date_format(first, "'_'HH'h'mm"), F.lit("_NA")))
