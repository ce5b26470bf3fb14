"""Aggregations and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import discard, stored

one = "*"


def running(df: DataFrame, order: str, sums: list[str], by: list[str] | None = None, cells: int | None = None) -> DataFrame:
    """``df`` (one row for each value of ``order`` within ``by``) with running sums over descending ``order`` as ``cum_`` columns.

    Rows are stored, as the range partitioning reads them twice, dealt by it, so skewed values make no large cell, and
    stored by cell: sums run inside a cell, and the cells' totals, a small table, are added. No single task sorts all rows. ``cells`` is the session's number
    of shuffle partitions.
    """
    by = by or []
    cells = cells or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = stored(df)
    df = stored(counted.repartitionByRange(cells, *by, F.desc(order)).withColumn("_cell", F.spark_partition_id()))
    discard(counted)
    totals = df.groupBy(*by, "_cell").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    totals = totals.select(*by, "_cell", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums))
    inside = Window.partitionBy(*by, "_cell").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"cum_{c}": F.sum(c).over(inside) for c in sums})
    other = totals.select(*(F.col(c).alias(f"_k_{c}") for c in [*by, "_cell"]), *(f"_b_{c}" for c in sums))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_cell"]))
    out = df.join(F.broadcast(other) if not by else other, same).withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_b_{c}") for c in sums})
    return out.drop("_cell", *(f"_b_{c}" for c in sums), *(f"_k_{c}" for c in [*by, "_cell"]))


def confusion(reco: Column, label: Column) -> list[Column]:
    """tp, fp, fn, tn, precision, recall; ratios are null without a denominator."""
    tp, fp, fn, tn = (F.count_if(reco & label), F.count_if(reco & ~label), F.count_if(~reco & label), F.count_if(~reco & ~label))
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.try_divide(tp.cast("double"), tp + fp).alias("precision"), F.try_divide(tp.cast("double"), tp + fn).alias("recall")]


def regression(y: Column, p: Column, threshold: float) -> list[Column]:
    """n, r2 (1 - SSE / SST), mae, rmse, mae and bias above a threshold, prevalence: sums only, so partial aggregation works."""
    e = p - y
    sse, sst = F.sum(e * e), F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(one)
    above = y > threshold
    return [
        F.count(one).alias("n"), (1 - sse / F.nullif(sst, F.lit(0.0))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.when(above, F.abs(e))).alias("mae_above"), F.avg(F.when(above, e)).alias("bias_above"), F.avg(above.cast("double")).alias("prevalence"),
    ]


def pr_curve(scored: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """score, hits and rows from the top down to each distinct score, precision, recall. Equal scores are one point."""
    points = scored.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label)).alias("hits"), F.count(one).alias("rows"))
    curve = running(points, "score", ["hits", "rows"])
    curve = curve.crossJoin(F.broadcast(curve.agg(F.max("cum_hits").alias("_all"))))  # one row
    return curve.select("score", F.col("cum_hits").alias("hits"), F.col("cum_rows").alias("rows"), (F.col("cum_hits") / F.col("cum_rows")).alias("precision"), (F.col("cum_hits") / F.nullif("_all", F.lit(0))).alias("recall"), (F.col("hits") / F.nullif("_all", F.lit(0))).alias("step"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Sum of precision times the gain in recall at each point."""
    return curve.agg(F.sum(F.col("precision") * F.col("step")).alias("ap"))


def percentiles(value: str, at: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> list[Column]:
    """Exact interpolated percentiles as columns p50, p90, ..."""
    return [F.percentile(value, F.lit(q)).alias(f"p{round(q * 100)}") for q in at]


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """keys and interpolated percentiles p50, p90, ... from counts of distinct values and their ranks: no group's values meet in one buffer."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(one).alias("_c"))
    ranked = running(counts, "_v", ["_c"], by=keys)
    size = ranked.groupBy(*(F.col(k).alias(f"_n_{k}") for k in keys)).agg(F.max("cum__c").alias("_n"))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys))
    ranked = ranked.join(size, same)
    last = F.col("_n") - F.col("cum__c") + F.col("_c") - 1  # ranks from 0 upwards: this value has those from first to last
    first = F.col("_n") - F.col("cum__c")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col("_v")))

    out = []
    for q in at:
        place = F.lit(float(q)) * (F.col("_n") - 1)
        low = value_at(F.floor(place))
        part = F.max(place - F.floor(place))
        out.append((low + part * (value_at(F.ceil(place)) - low)).alias(f"p{round(q * 100)}"))
    return ranked.groupBy(*keys).agg(*out)


def matrix(rows: DataFrame, row: str, column: str, values: list, agg: Column) -> DataFrame:
    return rows.groupBy(row).pivot(column, values).agg(agg)


def weighted_corr(x: Column, y: Column, w: Column) -> Column:
    """Weighted Pearson correlation from sums."""
    s = F.sum(w)
    cov = F.sum(w * x * y) / s - F.sum(w * x) / s * (F.sum(w * y) / s)
    vx = F.sum(w * x * x) / s - F.pow(F.sum(w * x) / s, 2)
    vy = F.sum(w * y * y) / s - F.pow(F.sum(w * y) / s, 2)
    return cov / F.sqrt(vx * vy)


def ks(rows: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of a value between two groups."""
    points = rows.where(F.col(group).isin(a, b)).groupBy(F.col(value).cast("double").alias("v")).agg(F.count_if(F.col(group) == a).alias("a"), F.count_if(F.col(group) == b).alias("b"))
    curve = running(points, "v", ["a", "b"])
    total = curve.agg(F.max("cum_a").alias("ta"), F.max("cum_b").alias("tb"))
    return curve.crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.col("cum_a") / F.col("ta") - F.col("cum_b") / F.col("tb"))).alias("ks"))


def concentration(rows: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Peak share, share of the top three, normalised entropy and Gini of the counts over cells."""
    n = rows.groupBy(*keys, cell).agg(F.count(one).alias("n"))
    w = Window.partitionBy(*keys)
    total, cells = F.sum("n").over(w), F.count(one).over(w)
    ranked = n.withColumns({"p": F.col("n") / total, "k": cells, "up": F.row_number().over(w.orderBy("n", cell)), "down": F.row_number().over(w.orderBy(F.desc("n"), cell))})
    entropy = F.sum(-F.col("p") * F.ln("p")) / F.ln(F.max("k"))
    gini = F.sum((F.col("up") * 2 - F.col("k") - 1) * F.col("p")) / F.max("k")
    return ranked.groupBy(*keys).agg(F.max("p").alias("peak"), F.sum(F.when(F.col("down") <= 3, F.col("p"))).alias("top3"), entropy.alias("entropy"), gini.alias("gini"))


def agreement(a: Column, b: Column) -> list[Column]:
    """Counts of the 2 x 2 table, discordance, Cohen's kappa and Jaccard."""
    n11, n10, n01, n00 = F.count_if(a & b), F.count_if(a & ~b), F.count_if(~a & b), F.count_if(~a & ~b)
    n = (n11 + n10 + n01 + n00).cast("double")
    po = (n11 + n00) / n
    pe = ((n11 + n10) / n) * ((n11 + n01) / n) + ((n01 + n00) / n) * ((n10 + n00) / n)
    return [n11.alias("n11"), n10.alias("n10"), n01.alias("n01"), n00.alias("n00"), ((n10 + n01) / n).alias("discordance"), F.try_divide(po - pe, 1 - pe).alias("kappa"), F.try_divide(n11.cast("double"), n11 + n10 + n01).alias("jaccard")]


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, digest, schema: a content check that doesn't depend on order."""
    return df.agg(F.count(one).alias("rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest")).withColumn("schema", F.lit(df.schema.simpleString()))


def portable_fingerprint(df: DataFrame) -> DataFrame:
    """rows, digest: sum of the leading 32 bits of each row's MD5 over its columns as text."""
    part = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in df.columns)).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(one).alias("rows"), F.sum(part).alias("digest"))


def coverage(run: DataFrame, measured: DataFrame, key: str, by: list[str]) -> DataFrame:
    """by, run, measured and their ratio; ``measured`` holds distinct keys."""
    out = run.join(measured.withColumn("_m", F.lit(1)), key, "left").groupBy(*by).agg(F.count(one).alias("run"), F.count("_m").alias("measured"))
    return out.withColumn("coverage", F.round(F.col("measured") / F.col("run"), 6))


def monthly_mass(rows: DataFrame, keys: list[str], families: list[str], whole: str, tolerance: float) -> DataFrame:
    """keys, family, mean signed and absolute contribution, and whether the families of a group add up to its whole."""
    sums = rows.groupBy(*keys).agg(*(F.avg(f).alias(f) for f in families), *(F.avg(F.abs(f)).alias(f"_m_{f}") for f in families), (F.abs(sum((F.sum(f) for f in families[1:]), F.sum(families[0])) - F.sum(whole)) < tolerance).alias("additive"))
    cells = F.array(*(F.struct(F.lit(f).alias("family"), F.col(f).alias("signed"), F.col(f"_m_{f}").alias("mass")) for f in families))
    return sums.select(*keys, F.inline(cells), "additive")


def gaps(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """keys, gap_from, gap_to, missing: stretches of days without a row between the first and last of each group."""
    w = Window.partitionBy(*keys).orderBy(day)
    seen = days.select(*keys, day).distinct().withColumn("_next", F.lead(day).over(w))
    return seen.where(F.datediff("_next", day) > 1).select(*keys, F.date_add(day, 1).alias("gap_from"), F.date_sub("_next", 1).alias("gap_to"), (F.datediff("_next", day) - 1).alias("missing"))


def weighted_mean(x: Column, w: Column) -> Column:
    """Mean weighted by w; rows without value or weight are left out."""
    w = F.when(x.isNotNull() & (w > 0), w)
    return F.sum(x * w) / F.sum(w)


def unioned(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
