"""Guards: each gives rows of (guard, violations); ``enforce`` raises if any is broken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

one = "*"


def guard(df: DataFrame, name: str, violations: Column) -> DataFrame:
    return df.agg(F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations")).select(F.lit(name).alias("guard"), "violations")


def covers(data: DataFrame, day: str, dim: DataFrame, dim_day: str) -> DataFrame:
    """A dimension must reach the latest year of the data."""
    both = data.agg(F.max(F.year(day)).alias("a")).crossJoin(dim.agg(F.max(F.year(dim_day)).alias("b")))  # two single rows
    return guard(both, "coverage", F.count_if(F.coalesce(F.col("b") < F.col("a"), F.lit(True))))


def carried_equal(vintages: DataFrame, keys: list[str], year: str, source: dict[int, int], values: list[str]) -> DataFrame:
    """Values of carried years must equal their source year's exactly; a missing source is a violation."""
    spark = vintages.sparkSession
    pairs = spark.createDataFrame(list(source.items()), f"{year} int, _from int")
    carried = vintages.join(F.broadcast(pairs), year)
    old = vintages.select(*keys, F.col(year).alias("_from"), *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_there"))
    same = reduce(lambda a, b: a & b, (F.col(v).eqNullSafe(F.col(f"_{v}")) for v in values)) & F.col("_there").isNotNull()
    return guard(carried.join(old, [*keys, "_from"], "left"), "carried_equal", F.count_if(~same))


def varies(df: DataFrame, keys: list[str], value: str, least: float, part: str | None = None) -> DataFrame:
    """More than a share of the groups must hold different values (null is one); with ``part`` (a leg) only groups of several parts count."""
    several = F.min(part) < F.max(part) if part else F.lit(True)
    different = ~F.min(value).eqNullSafe(F.max(value)) | (F.count(value).between(1, F.count(one) - 1))
    groups = df.groupBy(*keys).agg(several.alias("_several"), different.alias("_d")).where("_several")
    return guard(groups, "varies", F.when(F.coalesce(F.avg(F.col("_d").cast("double")), F.lit(0.0)) > least, 0).otherwise(1))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return guard(df.groupBy(*keys).agg(F.count(one).alias("_n")), "unique", F.count_if(F.col("_n") > 1))


def one_value(df: DataFrame, key: str, value: str) -> DataFrame:
    return guard(df.groupBy(key).agg(F.count_distinct(value).alias("_d")), "one_value", F.count_if(F.col("_d") > 1))


def contiguous(days: DataFrame, day: str, flag: str) -> DataFrame:
    """Days with the flag must form one stretch (``days`` is a date dimension)."""
    w = Window.partitionBy(F.lit(0)).orderBy(day)
    marked = days.withColumn("_start", F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False)))
    return guard(marked, "contiguous", F.greatest(F.count_if("_start") - 1, F.lit(0)))


def holds(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """Rows for which a condition is false (null passes)."""
    return guard(df, name, F.count_if(~F.coalesce(condition, F.lit(True))))


def anchored(df: DataFrame, counts: dict[str, tuple[Column, int]]) -> DataFrame:
    """Counts that must be met exactly."""
    return reduce(lambda a, b: a.unionByName(b), (guard(df, f"anchor_{k}", F.abs(F.count_if(c) - n)) for k, (c, n) in counts.items()))


def missing_rates(df: DataFrame, columns: list[str], most: float) -> DataFrame:
    """column, rate of the columns with more nulls than allowed."""
    rates = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns)).unpivot([], columns, "column", "rate")
    return rates.where(F.col("rate") > most)


def first_gap(df: DataFrame, keys: list[str], day: str, history: str, least: int) -> DataFrame:
    """The median number of days from a group's first row to its first row with a history must be at least ``least``.

    Groups without any history are left out. One aggregate by group; the gaps are counted before their median is taken.
    """
    first = df.groupBy(*keys).agg(F.datediff(F.min(F.when(F.col(history).isNotNull(), F.col(day))), F.min(day)).alias("_gap"))
    gaps = first.where(F.col("_gap").isNotNull()).groupBy("_gap").agg(F.count(one).alias("_n"))
    return guard(gaps, "first_gap", F.when(F.percentile("_gap", F.lit(0.5), F.col("_n")) >= least, 0).otherwise(1))


def in_range(df: DataFrame, name: str, value: str, low: float, high: float, closed: bool = False) -> DataFrame:
    """Values outside [low, high), or [low, high] if ``closed``; null passes."""
    v = F.col(value)
    return guard(df, name, F.count_if((v < low) | ((v > high) if closed else (v >= high))))


def null_iff(df: DataFrame, name: str, value: str, flag: str) -> DataFrame:
    """A value must be null exactly where the flag says so."""
    return guard(df, name, F.count_if(F.col(value).isNull() != F.col(flag)))


def orphans(facts: DataFrame, keys: DataFrame, on: list[str], by: str, most: float) -> DataFrame:
    """Groups (years) in which more than a share of the facts has no key in ``keys`` (distinct)."""
    rates = facts.join(keys.withColumn("_there", F.lit(True)), on, "left").groupBy(by).agg(F.avg(F.col("_there").isNull().cast("double")).alias("_rate"))
    return guard(rates, "orphans", F.count_if(F.col("_rate") > most))


def first_is_null(df: DataFrame, keys: list[str], order: list[str], history: str) -> DataFrame:
    """A group's first row has no history."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct(F.col(history).alias("h")), F.struct(*order)).alias("_f"))
    return guard(first, "first_is_null", F.count_if(F.col("_f.h").isNotNull()))


def enforce(*guards: DataFrame) -> None:
    broken = [tuple(r) for g in guards for r in g.where("violations > 0").collect()]
    if broken:
        raise ValueError(f"guards broken: {broken}")
