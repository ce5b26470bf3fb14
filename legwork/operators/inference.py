"""Intervals by resampling and tests from counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper ends of the Poisson(1) distribution function: fixed values e^-1 (1, 2, 2.5, ...).
POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def poisson_weight(seed: int, *keys: Column) -> Column:
    """A Poisson(1) number that depends on the keys alone, so a lost task draws the same again."""
    u = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))
    out = F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        out = F.when(u < POISSON[k], k).otherwise(out)
    return out


def replicates(blocks: DataFrame, block: list[str], sums: list[str], n: int, seed: int = 42) -> DataFrame:
    """replicate and weighted sums: every block of rows drawn Poisson(1) times in every replicate.

    ``blocks`` holds one row of sums for each block; collapse rows first, so that blocks, not rows, are multiplied.
    """
    long = blocks.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    long = long.withColumn("_w", poisson_weight(seed, F.col("replicate"), *(F.col(c) for c in block))).where("_w > 0")
    return long.groupBy("replicate").agg(*(F.sum(F.col(c) * F.col("_w")).alias(c) for c in sums))


def error_sums(y: Column, p: Column) -> list[Column]:
    """Sums from which R2 and RMSE follow."""
    return [F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum((p - y) * (p - y)).alias("sse")]


def r2() -> Column:
    return 1 - F.col("sse") / (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))


def interval(reps: DataFrame, value: Column, level: float = 0.95) -> DataFrame:
    """low, high, sd of a statistic over replicates."""
    tail = (1 - level) / 2
    v = reps.select(value.alias("_v"))
    return v.agg(F.percentile("_v", F.lit(tail)).alias("low"), F.percentile("_v", F.lit(1 - tail)).alias("high"), F.stddev_samp("_v").alias("sd"))


def metric_intervals(blocks: DataFrame, block: list[str], sums: list[str], metrics: dict[str, Column], n: int, level: float = 0.95, seed: int = 42) -> DataFrame:
    """metric, value, low, high, sd of ratios of sums, such as precision and recall or a difference of two rules' (paired: both
    rules of a replicate see the same blocks). ``blocks`` holds one row of sums for each block; with rows as blocks and with
    days as blocks, the ratio of the two sd shows how much blocks widen the limits."""
    point = blocks.agg(*(F.sum(c).alias(c) for c in sums))
    reps = replicates(blocks, block, sums, n, seed)
    tail = (1 - level) / 2
    long = lambda df: df.select(F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("_v")) for k, v in metrics.items()))))
    limits = long(reps).groupBy("metric").agg(F.percentile("_v", F.lit(tail)).alias("low"), F.percentile("_v", F.lit(1 - tail)).alias("high"), F.stddev_samp("_v").alias("sd"))
    return long(point).withColumnRenamed("_v", "value").join(limits, "metric")


def ap_interval(points: DataFrame, block: list[str], score: str, hits: str, rows: str, n: int, level: float = 0.95, seed: int = 42) -> DataFrame:
    """metric (``ap``), value, low, high, sd of average precision. ``points`` holds counts by block and score; a replicate's
    curve runs over the distinct scores, a bounded number for rounded ones."""

    def ap(counts: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*(by or [F.lit(0)]))
        down = w.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
        cum = counts.withColumns({"_h": F.sum(hits).over(down), "_n": F.sum(rows).over(down), "_all": F.sum(hits).over(w)})
        return cum.groupBy(*by).agg(F.sum(F.col("_h") / F.col("_n") * F.col(hits) / F.col("_all")).alias("_v"))

    long = points.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    long = long.withColumn("_w", poisson_weight(seed, F.col("replicate"), *(F.col(c) for c in block))).where("_w > 0")
    reps = ap(long.groupBy("replicate", score).agg(F.sum(F.col(hits) * F.col("_w")).alias(hits), F.sum(F.col(rows) * F.col("_w")).alias(rows)), ["replicate"])
    point = ap(points.groupBy(score).agg(F.sum(hits).alias(hits), F.sum(rows).alias(rows)), [])
    return point.select(F.lit("ap").alias("metric"), F.col("_v").alias("value")).crossJoin(F.broadcast(interval(reps, F.col("_v"), level)))  # one row


def mcnemar(b: Column, c: Column) -> Column:
    """Chi-square of McNemar's test with continuity correction from the discordant counts."""
    return F.when(b + c > 0, F.pow(F.greatest(F.abs(b - c) - 1, F.lit(0)).cast("double"), 2) / (b + c))


def two_proportions(x1: Column, n1: Column, x2: Column, n2: Column) -> tuple[Column, Column]:
    """(z with pooled variance, Cohen's h)."""
    p1, p2, p = x1 / n1, x2 / n2, (x1 + x2) / (n1 + n2)
    z = (p1 - p2) / F.sqrt(p * (1 - p) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    return z, 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def chi2_tail(x: float) -> float:
    """p-value of a chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(x / 2))
