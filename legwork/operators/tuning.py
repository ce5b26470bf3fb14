"""Sweeps and searches over models: all penalties from one pass, settings in parallel by successive halving, all arms of an attribution in one job."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import stored
from . import boosting, models
from .aggregates import unioned

#: Levels that a text feature may have in a linear model; more would make the normal equations grow with the data.
LEVELS = 1000


class Linear:
    """Penalised linear models of all penalties: columns of the design, their means and scales, coefficients on scaled columns."""

    def __init__(self, numeric: list[str], text: dict[str, list[str]], medians: np.ndarray, means: np.ndarray, scales: np.ndarray, offset: float, weights: dict[float, np.ndarray]):
        self.numeric, self.text, self.medians = numeric, text, medians
        self.means, self.scales, self.offset, self.weights = means, scales, offset, weights

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *(f"{c}={v}" for c, vs in self.text.items() for v in vs)]

    def intercept(self, penalty: float) -> float:
        return self.offset - float(self.weights[penalty] @ (self.means / self.scales))


def _design(batch: pa.RecordBatch, numeric: list[str], text: dict[str, list[str]], medians: np.ndarray) -> np.ndarray:
    """Numbers with medians for missing values, then a column of 0 and 1 for each level; unknown levels are 0 in all."""
    out = np.zeros((batch.num_rows, len(numeric) + sum(map(len, text.values()))))
    for i, c in enumerate(numeric):
        x = pc.cast(batch.column(c), pa.float64()).to_numpy(zero_copy_only=False)
        out[:, i] = np.where(np.isnan(x), medians[i], x)
    at = len(numeric)
    for c, levels in text.items():
        place = pc.index_in(batch.column(c), pa.array(levels, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(place >= 0)
        out[rows, at + place[rows]] = 1.0
        at += len(levels)
    return out


def ridge_sweep(train: DataFrame, features: list[str], target: str, penalties: list[float]) -> Linear:
    """Linear models with penalty * |w|^2 beside the squared error, for all penalties.

    Numbers are imputed by their median and scaled, text features are one-hot with nulls as their most frequent level. One pass finds medians and
    levels, one adds up the products of all columns (less their medians, which keeps the digits); each penalty is then a
    small system of equations on the driver, as large as the columns squared, whatever the rows.
    """
    text, numeric = models.columns_of(train, features)
    train = train.where(F.col(target).isNotNull())
    first = train.agg(*(F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(f"m_{i}") for i, c in enumerate(numeric)), *(F.mode(c).alias(f"t_{i}") for i, c in enumerate(text)), F.avg(target).alias("_y")).first()
    medians = np.array([0.0 if first[f"m_{i}"] is None else first[f"m_{i}"] for i in range(len(numeric))])
    levels: dict[str, list[str]] = {}
    for c in text:
        found = sorted(r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct().limit(LEVELS + 1).collect())
        if len(found) > LEVELS:
            raise ValueError(f"{c} has more than {LEVELS} levels: group them first")
        levels[c] = found
    center, middle = np.concatenate([medians, np.zeros(sum(map(len, levels.values())))]), float(first["_y"] or 0.0)

    def products(batches):
        size = len(center) + 2
        total = np.zeros((size, size))
        for batch in batches:
            x = _design(batch, numeric, levels, medians) - center
            y = pc.cast(batch.column("_y"), pa.float64()).to_numpy(zero_copy_only=False) - middle
            z = np.column_stack([np.ones(len(y)), x, y])
            total += z.T @ z
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "p": pa.array(total.tolist(), pa.list_(pa.float64()))})

    filled = train.select(*numeric, *(F.coalesce(c, F.lit(first[f"t_{i}"])).alias(c) for i, c in enumerate(text)), F.col(target).alias("_y"))
    sums = filled.mapInArrow(products, "i int, p array<double>").select("i", F.posexplode("p").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # columns squared
    size = len(center) + 2
    total = np.zeros((size, size))
    for r in sums:
        total[r["i"], r["j"]] = r["v"]
    n = max(total[0, 0], 1.0)
    shift = total[0, 1:] / n
    moments = total[1:, 1:] - n * np.outer(shift, shift)
    spread = np.sqrt(np.maximum(np.diag(moments)[:-1], 0) / n)
    scales = np.where((spread > 0) & (np.arange(len(spread)) < len(numeric)), spread, 1.0)
    a, b = moments[:-1, :-1] / np.outer(scales, scales), moments[:-1, -1] / scales
    weights = {p: np.linalg.lstsq(a + p * np.eye(len(a)), b, rcond=None)[0] for p in penalties}
    return Linear(numeric, levels, medians, center + shift[:-1], scales, float(middle + shift[-1]), weights)


def ridge_scores(model: Linear, rows: DataFrame, name: str = "preds") -> DataFrame:
    """``rows`` with an array of predictions, one for each penalty in their order; nulls of text features count as no level."""
    penalties = list(model.weights)
    used, kept = [*model.numeric, *model.text], rows.columns

    def run(batches):
        w = np.column_stack([model.weights[p] for p in penalties])
        for batch in batches:
            x = (_design(batch, model.numeric, model.text, model.medians) - model.means) / model.scales
            preds = pa.array((x @ w + model.offset).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), preds], [*kept, name])

    missing = [c for c in used if c not in kept]
    if missing:
        raise ValueError(f"features are missing: {missing}")
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in rows.dtypes), f"{name} array<double>"]))


def ridge_metrics(model: Linear, rows: DataFrame, target: str) -> DataFrame:
    """penalty, n, r2, rmse, mae on ``rows`` for every penalty: one pass."""
    each = ridge_scores(model, rows).select(F.col(target).cast("double").alias("_y"), F.posexplode("preds").alias("_i", "_p"))
    e, y = F.col("_p") - F.col("_y"), F.col("_y")
    sse, sst = F.sum(e * e), F.sum(y * y) - F.sum(y) * F.sum(y) / F.count("*")
    out = each.groupBy("_i").agg(F.count("*").alias("n"), (1 - sse / F.nullif(sst, F.lit(0.0))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return out.select(F.array(*(F.lit(float(p)) for p in model.weights))[F.col("_i")].alias("penalty"), "n", "r2", "rmse", "mae")


def successive_halving(df: DataFrame, year: str, years: list[int], features: list[str], target: str, settings: dict[str, Callable[[int], object]], budgets: list[int], workers: int = 4, pool: str = "search") -> DataFrame:
    """rung, budget, params, fold, n, rmse, kept: settings fitted over expanding folds, the better half goes on with a larger budget.

    ``settings`` make an estimator from a budget (a number of trees). The features are prepared once, on the years before
    the first fold, and stored with year and target. Boosted trees of all settings and folds grow together over that
    table (``boosting``), each rung from the trees of the one before; other estimators are fitted side by side in a pool
    of threads, each with its own scheduler pool. A rung is decided by the mean RMSE over all folds, ties by name.
    """
    spark = df.sparkSession
    folds = models.expanding_folds(years)
    _, numeric = models.columns_of(df, features)
    wide = models.as_numbers(df.where(F.col(year).isin(sorted(years))), numeric)
    first = wide.where(F.col(year).isin(folds[0][0]))
    prepared = Pipeline(stages=models.tree_stages(df, features)).fit(first)
    kinds = {name: {boosting.settled(setting(budget)) for budget in budgets} for name, setting in settings.items()}
    bins = {s and s[1][-1] for found in kinds.values() for s in found}
    if None not in bins and len(bins) == 1 and all(len(found) == 1 for found in kinds.values()):
        data = boosting.binned(prepared, wide, first, year, target, bins.pop())
        data.rows = stored(data.rows)
        if not data.rows.where(F.arrays_overlap("lacks", F.array(*map(F.lit, folds[-1][0])))).isEmpty():
            raise ValueError(f"{target} is missing in a training year")
        fits = {(name, now): boosting.Fit(name, *next(iter(kinds[name])), past, now) for name in settings for past, now in folds}

        def rung_of(names: list[str], budget: int) -> list[tuple]:
            chosen = [fits[name, now] for name in names for _, now in folds]
            for f in chosen:
                f.wanted = settings[f.name](budget).getMaxIter()
            boosting.grow(data, chosen)
            return [(f.name, f.now, n, rmse) for f, (n, rmse) in zip(chosen, boosting.errors(data, chosen), strict=True)]

        return _halved(spark, settings, budgets, rung_of)
    table = stored(prepared.transform(wide).select("features", F.col(target).cast("double").alias(target), year))

    def one(name: str, budget: int, past: list[int], now: int) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{pool}-{name}")
        model = settings[name](budget).fit(table.where(F.col(year).isin(past)))
        e = F.pow(F.col("pred") - F.col(target), 2)
        r = model.transform(table.where(F.col(year) == now)).agg(F.count("*").alias("n"), F.sqrt(F.avg(e)).alias("rmse")).first()
        return name, now, r["n"], r["rmse"]

    def fitted(names: list[str], budget: int) -> list[tuple]:
        with ThreadPoolExecutor(workers) as threads:
            jobs = [threads.submit(inheritable_thread_target(spark)(one), name, budget, past, now) for name in names for past, now in folds]
            return [j.result() for j in jobs]

    return _halved(spark, settings, budgets, fitted)


def _halved(spark: SparkSession, settings: dict[str, Callable[[int], object]], budgets: list[int], rung_of: Callable[[list[str], int], list[tuple]]) -> DataFrame:
    alive, rows = sorted(settings), []
    for rung, budget in enumerate(budgets):
        found = rung_of(alive, budget)
        mean = {name: np.mean([r for n, _, _, r in found if n == name]) for name in alive}
        kept = sorted(alive, key=lambda name: (mean[name], name))[: max(1, len(alive) // 2)]
        rows += [(rung, budget, name, now, n, rmse, name in kept) for name, now, n, rmse in found]
        alive = sorted(kept)
    return spark.createDataFrame(rows, "rung int, budget int, params string, fold int, n long, rmse double, kept boolean")  # settings times folds times rungs


def attribution(fitted: dict[str, PipelineModel], df: DataFrame, segment: str, features: list[str], target: str, keys: list[str], seed: int = 7) -> DataFrame:
    """segment (null: all), feature, n, mass, signed, rise, place, share of every feature, by segment and over all rows.

    Each row takes a feature's value from another row of its segment, the next in the order of a hash within a bucket of
    that hash; all features are dealt by one such window, and a row's arms (one feature exchanged in each) are scored by
    its segment's model beside the row's own score: one job for all features and segments. ``mass`` is the mean absolute
    change of the score, ``signed`` its mean, ``rise`` that of the RMSE.
    """
    h = F.xxhash64(F.lit(seed), *keys)
    w = Window.partitionBy(segment, F.pmod(h, F.lit(256))).orderBy(h, *keys)
    other = F.struct(*features)
    first = F.first(other).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    dealt = df.withColumn("_other", F.coalesce(F.lead(other).over(w), first))
    parts = []
    for value, model in fitted.items():
        own = models.score(model, dealt.where(F.col(segment) == value), features).withColumnRenamed("pred", "_own")
        arms = own.withColumn("_arm", F.explode(F.array(*map(F.lit, range(len(features))))))
        arms = arms.withColumns({c: F.when(F.col("_arm") == i, F.col(f"_other.{c}")).otherwise(F.col(c)) for i, c in enumerate(features)})
        parts.append(models.score(model, arms, features).select(segment, "_arm", "pred", "_own", F.col(target).cast("double").alias("_y")))
    e = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("_y"), 2)))
    change = F.col("pred") - F.col("_own")
    every = unioned(parts).groupingSets([[F.col(segment), F.col("_arm")], [F.col("_arm")]], segment, "_arm").agg(F.count("*").alias("n"), F.avg(F.abs(change)).alias("mass"), F.avg(change).alias("signed"), (e("pred") - e("_own")).alias("rise"))
    within = Window.partitionBy(segment)  # a row for each feature
    return every.select(segment, F.array(*map(F.lit, features))[F.col("_arm")].alias("feature"), "n", "mass", "signed", "rise").withColumns({"place": F.row_number().over(within.orderBy(F.desc("mass"), "feature")), "share": F.col("mass") / F.nullif(F.sum("mass").over(within), F.lit(0.0))})


def family_mass(found: DataFrame, segment: str, families: dict[str, str]) -> DataFrame:
    """segment, family, features, mass, share, signed of an attribution, its features added up by family."""
    family = F.coalesce(*(F.when(F.col("feature") == f, name) for f, name in families.items()))
    return found.groupBy(segment, family.alias("family")).agg(F.count("*").alias("features"), F.sum("mass").alias("mass"), F.sum("share").alias("share"), F.sum("signed").alias("signed"))
