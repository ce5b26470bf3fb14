"""From scores to decisions: thresholds, rules, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored
from .aggregates import confusion, pr_curve, unioned

one = "*"


def trips(legs: DataFrame, trip: list[str], pred: str, load: str, booked: str | None = None, threshold: float = 63.0) -> DataFrame:
    """Trips from legs: score (max prediction), load (max), legs, label (any load over the threshold), booked (max)."""
    more = [F.max(booked).alias("booked")] if booked else []
    return legs.groupBy(*trip).agg(F.max(pred).alias("score"), F.max(load).alias("load"), F.count(one).alias("legs"), F.coalesce(F.bool_or(F.col(load) > threshold), F.lit(False)).alias("label"), *more)


def at_volume(curve: DataFrame, k: int | Column) -> DataFrame:
    """threshold: the k-th largest score of a precision-recall curve's rows; the least score if there are fewer."""
    return curve.agg(F.coalesce(F.max(F.when(F.col("rows") >= k, F.col("score"))), F.min("score")).alias("threshold"))


def at_fbeta(curve: DataFrame, beta: float) -> DataFrame:
    """threshold, f: the score with the highest F-beta on a curve, the least of equals."""
    b = beta * beta
    p, r = F.col("precision"), F.col("recall")
    f = (1 + b) * p * r / (b * p + r + 1e-12)
    return curve.withColumn("f", F.round(f, 12)).agg(F.max_by("score", F.struct(F.col("f"), -F.col("score"))).alias("threshold"), F.max("f").alias("f"))


def volume_threshold(scored: DataFrame, score: str, k: int) -> DataFrame:
    """threshold: the k-th largest score, found from counts of distinct scores."""
    return at_volume(pr_curve(scored.withColumn("_l", F.lit(False)), score, "_l"), k)


def fbeta_threshold(scored: DataFrame, score: str, label: str, beta: float) -> DataFrame:
    """threshold, f: the score with the highest F-beta, the least of equals."""
    return at_fbeta(pr_curve(scored, score, label), beta)


def same_share(curve: DataFrame, share: Column) -> DataFrame:
    """threshold: the score down to which a share of all rows of a curve lies (``share`` may be a column of a one-row join)."""
    total = curve.agg(F.max("rows").alias("_n"))
    wanted = F.greatest(F.round(share * F.col("_n")), F.lit(1))
    return curve.crossJoin(F.broadcast(total)).where(F.col("rows") >= wanted).agg(F.max("score").alias("threshold"))  # one row


def candidate_lists(rows: DataFrame, reco: Column, label: Column, orders: dict[str, list[Column]], n: int) -> DataFrame:
    """The first ``n`` rows of each confusion cell (tp, fp, fn, tn) by the cell's own order, with cell and place."""
    cell = F.when(reco & label, "tp").when(reco, "fp").when(label, "fn").otherwise("tn")
    rows = stored(rows)  # each list reads it
    lists = [rows.where(cell == name).orderBy(*order).limit(n).withColumn("cell", F.lit(name)) for name, order in orders.items()]  # top-k, no sort of a whole cell
    out = []
    for one_list, order in zip(lists, orders.values(), strict=True):
        out.append(one_list.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy(*order))))  # n rows
    return unioned(out)


def evaluated(rows: DataFrame, recos: dict[str, Column], label: str, sets: list[list[str]]) -> DataFrame:
    """rule, slices, counts, precision and recall of each rule over grouping sets: rows are expanded once per rule."""
    long = rows.withColumn("_r", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.coalesce(c, F.lit(False)).alias("reco")) for k, c in recos.items())))).select(*rows.columns, "_r.rule", "_r.reco")
    keys = sorted({c for s in sets for c in s})
    return long.groupingSets([[F.col("rule"), *(F.col(c) for c in s)] for s in sets], F.col("rule"), *(F.col(c) for c in keys)).agg(*confusion(F.col("reco"), F.col(label)))


def overlap(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Counts of rows with rule a only, b only, both, neither."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return rows.agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither"))


def daily_load(rows: DataFrame, day: str, reco: Column, keys: list[str]) -> DataFrame:
    """Mean, 95th percentile and maximum of alerts a day; days without an alert count as 0."""
    days = rows.groupBy(*keys, day).agg(F.count_if(reco).alias("_n"))
    return days.groupBy(*keys).agg(F.count(one).alias("days"), F.avg("_n").alias("mean"), F.percentile("_n", F.lit(0.95)).alias("p95"), F.max("_n").alias("most"))


def block_evaluation(rows: DataFrame, block: list[str], active: str, label: str) -> DataFrame:
    """Precision by trip, by trip with inherited justification, and by block of active trips."""
    w = Window.partitionBy(*block)
    on = rows.where(F.col(active)).withColumn("_any", F.max(F.col(label).cast("int")).over(w))
    first = F.row_number().over(w.orderBy(*[F.col(c) for c in block]))
    on = on.withColumn("_first", first == 1)
    return on.agg(
        F.count(one).alias("trips"), F.count_if(F.col(label)).alias("justified"), F.sum("_any").alias("inherited"), F.count_if("_first").alias("blocks"), F.count_if(F.col("_first") & (F.col("_any") == 1)).alias("justified_blocks"),
        F.avg(F.col(label).cast("double")).alias("precision"), F.avg("_any").alias("precision_inherited"), (F.count_if(F.col("_first") & (F.col("_any") == 1)) / F.count_if("_first")).alias("precision_blocks"),
    )


def false_positive_cost(reco: Column, label: Column, distance: str, tare: float, tariff: float) -> list[Column]:
    """Aggregates false_positives and cost: tare times distance times tariff for each, over whatever rows are grouped."""
    wrong = reco & ~label
    return [F.count_if(wrong).alias("false_positives"), F.sum(F.when(wrong, F.col(distance) * tare * tariff).otherwise(0.0)).alias("cost")]


def day_table(legs: DataFrame, day: str, trip: str, vehicle: str, pred: str, load: str, booked: str, threshold: float, floor: float, capacity: float) -> DataFrame:
    """Trips of a day as a planner sees them the day before: score, legs over the threshold, flags, and the trips that share a vehicle."""
    trips_ = legs.groupBy(day, trip).agg(
        F.max(pred).alias("score"), F.count_if(F.col(pred) > threshold).alias("legs_over"), F.coalesce(F.max(pred) > threshold, F.lit(False)).alias("by_score"), F.coalesce(F.max(booked) > floor, F.lit(False)).alias("by_floor"),
        F.coalesce(F.max(load) > capacity, F.lit(False)).alias("beyond_capacity"),
    )
    tours = legs.groupBy(day, vehicle).agg(F.collect_set(trip).alias("_trips"))  # a vehicle's trips of one day
    chained = legs.select(day, vehicle, trip).distinct().join(tours, [day, vehicle]).groupBy(day, trip).agg(F.array_distinct(F.flatten(F.collect_list("_trips"))).alias("_all"))
    others = F.array_sort(F.filter("_all", lambda x: x != F.col(trip)))
    return trips_.join(chained, [day, trip]).withColumn("chained", F.array_join(F.transform(others, lambda x: x.cast("string")), ",")).drop("_all")
