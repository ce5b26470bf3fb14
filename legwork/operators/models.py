"""Regression on Spark ML: features, segmented models, baselines, folds, attribution."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import aggregates, decision


def temporal_split(df: DataFrame, year: str, train: Iterable[int], test: Iterable[int], closed: DataFrame | None = None, on: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) by year; training rows that touch a closed station are left out."""
    a, b = df.where(F.col(year).isin(list(train))), df.where(F.col(year).isin(list(test)))
    for key in on or []:
        a = a.join(F.broadcast(closed.select(F.col(closed.columns[0]).alias(key))), key, "left_anti")
    return a, b


def columns_of(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """(text columns, numeric columns) of the features, in their order."""
    kinds = {f.name: f.dataType for f in df.schema}
    return [c for c in features if isinstance(kinds[c], T.StringType)], [c for c in features if not isinstance(kinds[c], T.StringType)]


def as_numbers(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Numeric features as doubles, nulls as NaN with a column that says so: trees here don't route missing values."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in numeric}
    return df.withColumns(flags | {c: F.col(c).cast("double") for c in numeric})


def tree_stages(df: DataFrame, features: list[str]) -> list:
    text, numeric = columns_of(df, features)
    stages = [StringIndexer(inputCols=text, outputCols=[f"{c}_i" for c in text], handleInvalid="keep")] if text else []
    stages += [Imputer(inputCols=numeric, outputCols=[f"{c}_f" for c in numeric], strategy="median")] if numeric else []
    names = [*(f"{c}_i" for c in text), *(f"{c}_f" for c in numeric), *(f"{c}_missing" for c in numeric)]
    return [*stages, VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")]


def gbt(target: str, trees: int = 300, depth: int = 6, rate: float = 0.1, weight: str | None = None, seed: int = 42, bins: int = 64) -> GBTRegressor:
    out = GBTRegressor(labelCol=target, featuresCol="features", predictionCol="pred", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, maxBins=bins)
    return out.setWeightCol(weight) if weight else out


def forest(target: str, trees: int = 50, depth: int = 8, seed: int = 42, bins: int = 64) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=target, featuresCol="features", predictionCol="pred", numTrees=trees, maxDepth=depth, seed=seed, maxBins=bins)


def fit(train: DataFrame, features: list[str], estimator) -> PipelineModel:
    _, numeric = columns_of(train, features)
    return Pipeline(stages=[*tree_stages(train, features), estimator]).fit(as_numbers(train, numeric))


def side_by_side(spark: SparkSession, jobs: list[Callable[[], object]], workers: int = 4) -> list:
    """Results of the jobs, at most ``workers`` at a time: a fit of many trees is a long row of short jobs, which leave cores to other fits."""
    with ThreadPoolExecutor(workers) as threads:
        return [f.result() for f in [threads.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def score(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with pred."""
    _, numeric = columns_of(df, features)
    return model.transform(as_numbers(df, numeric)).select(*df.columns, "pred")


def fit_segments(train: DataFrame, segment: str, values: list[str], features: list[str], estimator) -> dict[str, PipelineModel]:
    jobs = [lambda v=v: fit(train.where(F.col(segment) == v), features, estimator) for v in values]
    return dict(zip(values, side_by_side(train.sparkSession, jobs), strict=True))


def score_segments(models: dict[str, PipelineModel], df: DataFrame, segment: str, features: list[str]) -> DataFrame:
    """Each row scored by its segment's model."""
    return aggregates.unioned([score(m, df.where(F.col(segment) == v), features) for v, m in models.items()])


def ridge(train: DataFrame, features: list[str], target: str, alpha: float) -> PipelineModel:
    """Linear model with median imputation, scaled numbers and one-hot text; ``alpha`` is the penalty."""
    text, numeric = columns_of(train, features)
    stages = [StringIndexer(inputCols=text, outputCols=[f"{c}_i" for c in text], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in text], outputCols=[f"{c}_h" for c in text], handleInvalid="keep")] if text else []
    stages += [Imputer(inputCols=numeric, outputCols=[f"{c}_f" for c in numeric], strategy="median"), VectorAssembler(inputCols=[f"{c}_f" for c in numeric], outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True)]
    stages += [VectorAssembler(inputCols=["_scaled", *(f"{c}_h" for c in text)], outputCol="features", handleInvalid="keep"), LinearRegression(labelCol=target, featuresCol="features", predictionCol="pred", regParam=alpha, elasticNetParam=0.0)]
    return Pipeline(stages=stages).fit(as_numbers(train, numeric))


def metrics(scored: DataFrame, target: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Regression metrics of pred, overall and by each column of ``by``."""
    sets = [[], *([F.col(c)] for c in by or [])]
    return scored.groupingSets(sets, *(F.col(c) for c in by or [])).agg(*aggregates.regression(F.col(target).cast("double"), F.col("pred"), threshold)) if by else scored.agg(*aggregates.regression(F.col(target).cast("double"), F.col("pred"), threshold))


def arms(train: DataFrame, test: DataFrame, target: str, threshold: float, cells: dict[str, tuple[list[str], str | None, object]], values: list[str]) -> DataFrame:
    """arm and metrics for {name: (features, segment column or None, estimator)}: decompositions, ablations, additions."""
    out = []
    for name, (features, segment, estimator) in cells.items():
        if segment:
            scored = score_segments(fit_segments(train, segment, values, features, estimator), test, segment, features)
        else:
            scored = score(fit(train, features, estimator), test, features)
        out.append(metrics(scored, target, threshold).select(F.lit(name).alias("arm"), "*"))
    return aggregates.unioned(out)


def expanding_folds(years: list[int], least: int = 1) -> list[tuple[list[int], int]]:
    """(training years, validation year): all earlier years train."""
    years = sorted(years)
    return [(years[:i], years[i]) for i in range(least, len(years))]


def grid_search(df: DataFrame, year: str, years: list[int], features: list[str], target: str, grid: dict[str, object], threshold: float) -> DataFrame:
    """params, fold and metrics of each estimator of ``grid`` over expanding folds, and the mean over folds (fold null)."""
    rows = []
    for name, estimator in grid.items():
        for past, now in expanding_folds(years):
            scored = score(fit(df.where(F.col(year).isin(past)), features, estimator), df.where(F.col(year) == now), features)
            rows.append(metrics(scored, target, threshold).select(F.lit(name).alias("params"), F.lit(now).alias("fold"), "n", "r2", "rmse", "mae"))
    every = aggregates.unioned(rows)
    return every.groupingSets([[F.col("params"), F.col("fold")], [F.col("params")]], "params", "fold").agg(F.sum("n").alias("n"), F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))


def above_weight(target: str, threshold: float, weight: float) -> Column:
    """Weight of rows above a threshold, 1 for others."""
    return F.when(F.col(target) > threshold, weight).otherwise(1.0)


def counterfactual(model: PipelineModel, df: DataFrame, features: list[str], resets: dict[str, object], when: Column) -> DataFrame:
    """``df`` with pred and pred_without: the score with features reset where ``when`` holds. Each row is scored twice where it is: nothing is joined or shuffled."""
    kept = {c: f"_kept_{c}" for c in resets}
    scored = score(model, df, features).withColumnRenamed("pred", "_pred").withColumns({k: F.col(c) for c, k in kept.items()})
    other = scored.withColumns({c: F.when(when, F.lit(v).cast(dict(df.dtypes)[c])).otherwise(F.col(c)) for c, v in resets.items()})
    both = score(model, other, features)
    return both.select(*(F.col(kept.get(c, c)).alias(c) for c in df.columns), F.col("_pred").alias("pred"), F.col("pred").alias("pred_without"))


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], target: str, keys: list[str], of: list[str] | None = None, seed: int = 7) -> DataFrame:
    """feature, rise in RMSE when the feature's values are dealt anew among rows.

    Values move to the row that follows in the order of a hash within buckets of that hash: no global sort.
    """
    rmse = lambda d: score(model, d, features).agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col(target), 2))).alias("rmse"))
    base = rmse(df)
    out = []
    for f in of or features:
        h = F.xxhash64(F.lit(seed), F.lit(f), *keys)
        w = Window.partitionBy(F.pmod(h, F.lit(64))).orderBy(h, *keys)
        dealt = df.withColumn(f, F.coalesce(F.lead(f).over(w), F.first(f).over(w)))
        out.append(rmse(dealt).select(F.lit(f).alias("feature"), F.col("rmse").alias("_with")))
    return aggregates.unioned(out).crossJoin(F.broadcast(base)).select("feature", (F.col("_with") - F.col("rmse")).alias("rise"))  # one row


def walk_forward(df: DataFrame, year: str, years: list[int], features: list[str], target: str, grid: dict[str, object], threshold: float, beta: float) -> DataFrame:
    """params, fold, cut, precision, recall: each estimator over expanding folds, its cut (F-beta on the fold's past) fitted anew; fold null is the mean."""
    over = F.col(target) > threshold
    runs = [(name, estimator, df.where(F.col(year).isin(past)), now) for name, estimator in grid.items() for past, now in expanding_folds(years)]
    fitted = side_by_side(df.sparkSession, [lambda train=train, estimator=estimator: fit(train, features, estimator) for _, estimator, train, _ in runs])
    rows = []
    for (name, _, train, now), model in zip(runs, fitted, strict=True):
        seen = score(model, train, features).select(F.round("pred", 3).alias("pred"), over.alias("label"))
        cut = decision.at_fbeta(aggregates.pr_curve(seen, "pred", "label"), beta).select(F.col("threshold").alias("cut"))
        later = score(model, df.where(F.col(year) == now), features).select("pred", over.alias("label")).crossJoin(F.broadcast(cut))  # one row
        rows.append(later.agg(F.lit(name).alias("params"), F.lit(now).alias("fold"), F.first("cut").alias("cut"), *aggregates.confusion(F.col("pred") >= F.col("cut"), F.col("label"))))
    every = aggregates.unioned(rows)
    return every.groupingSets([[F.col("params"), F.col("fold")], [F.col("params")]], "params", "fold").agg(F.avg("cut").alias("cut"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def added_family(train: DataFrame, years: dict[str, DataFrame], base: list[str], family: list[str], target: str, threshold: float, trip: list[str], estimator) -> DataFrame:
    """year, grain, without, with_family, gain: average precision by row and by trip, without and with a family of features."""
    fitted = {"without": fit(train, base, estimator), "with_family": fit(train, [*base, *family], estimator)}
    out = []
    for name, rows in years.items():
        for arm, model in fitted.items():
            scored = score(model, rows, base if arm == "without" else [*base, *family]).withColumn("label", F.col(target) > threshold)
            trips = decision.trips(scored, trip, "pred", target, threshold=threshold)
            for grain, frame, value in (("row", scored, "pred"), ("trip", trips, "score")):
                curve = aggregates.pr_curve(frame.withColumn(value, F.round(value, 3)), value, "label")
                out.append(aggregates.average_precision(curve).select(F.lit(name).alias("year"), F.lit(grain).alias("grain"), F.lit(arm).alias("arm"), "ap"))
    wide = aggregates.unioned(out).groupBy("year", "grain").pivot("arm", ["without", "with_family"]).agg(F.first("ap"))
    return wide.withColumn("gain", F.col("with_family") - F.col("without"))
