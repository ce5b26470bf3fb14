"""Queries that train and compare models on order lines. q_model_segmented and q_model_walk_forward grow all trees, the others few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..operators import aggregates, decision, models, tuning
from .registry import query

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "month", "pri"]
TARGET = "y"


def model_rows(t, when: Column) -> DataFrame:
    """Order lines of the years that ``when`` names, with their features, stored: a fit reads its rows in many passes, and each would join both tables anew."""
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("o_orderpriority").alias("pri"), F.col("o_custkey").alias("station"), F.to_date("o_orderdate").alias("day")).where(when)
    lines = t.lineitem.withColumn("l_tax", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_tax")))
    rows = lines.join(o, "l_orderkey").withColumn("y", F.col("l_extendedprice") / 1000)
    return stored(rows.withColumn("segment", F.when(F.col("l_suppkey") % 2 == 0, "low").otherwise("high")).select("l_orderkey", "l_partkey", "l_suppkey", "day", "year", "segment", "station", *FEATURES, "y"))


def halves(t) -> tuple[DataFrame, DataFrame]:
    closed = t.spark.createDataFrame([(1,), (2,)], "station long")
    return models.temporal_split(model_rows(t, F.col("year").isin(1995, 1996, 1997, 1998)), "year", [1995, 1996, 1997], [1998], closed, ["station"])


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c, k in df.dtypes if k == "double"})


SMALL = {"trees": 4, "depth": 3}


@query()
def q_model_segmented(t):
    """Two boosted models of 300 trees by segment, routed at scoring, metrics by segment."""
    train, test = halves(t)
    fitted = models.fit_segments(train, "segment", ["low", "high"], FEATURES, models.gbt(TARGET))
    return rounded(models.metrics(models.score_segments(fitted, test, "segment", FEATURES), TARGET, 63.0, ["segment"]))


@query()
def q_model_ridge(t):
    """Penalised linear models over a sweep of penalties, compared on a later year."""
    train, test = halves(t)
    out = [models.metrics(models.score(models.ridge(train, FEATURES, TARGET, a), test, FEATURES), TARGET, 63.0).select(F.lit(a).alias("alpha"), "*") for a in (0.0, 1.0, 10.0)]
    return rounded(aggregates.unioned(out))


@query()
def q_model_decomposition(t):
    """Few or all features, one model or one for each segment; a forest; without one family."""
    train, test = halves(t)
    tree, few = models.gbt(TARGET, **SMALL), ["l_quantity", "month"]
    cells = {"few_global": (few, None, tree), "few_segmented": (few, "segment", tree), "all_global": (FEATURES, None, tree), "all_segmented": (FEATURES, "segment", tree)}
    cells |= {"forest": (FEATURES, None, models.forest(TARGET, 5, 4)), "no_quantity": ([c for c in FEATURES if c != "l_quantity"], None, tree)}
    return rounded(models.arms(train, test, TARGET, 63.0, cells, ["low", "high"]))


@query()
def q_model_folds(t):
    """Two settings over expanding yearly folds."""
    grid = {"shallow": models.gbt(TARGET, 3, 2), "deeper": models.gbt(TARGET, 3, 4)}
    return rounded(models.grid_search(model_rows(t, F.col("year").isin(1995, 1996, 1997)), "year", [1995, 1996, 1997], FEATURES, TARGET, grid, 63.0))


@query()
def q_model_weighted(t):
    """Training weights above a threshold; average precision at line and order grain."""
    train, test = halves(t)
    out = []
    for w in (1.0, 5.0):
        weighted = train.withColumn("w", models.above_weight(TARGET, 63.0, w))
        scored = models.score(models.fit(weighted, FEATURES, models.gbt(TARGET, **SMALL, weight="w")), test, FEATURES).withColumn("label", F.col(TARGET) > 63)
        trips = decision.trips(scored, ["l_orderkey"], "pred", TARGET, threshold=63.0)
        line = aggregates.average_precision(aggregates.pr_curve(scored.withColumn("pred", F.round("pred", 3)), "pred", "label")).select(F.lit("line").alias("grain"), "ap")
        trip = aggregates.average_precision(aggregates.pr_curve(trips.withColumn("score", F.round("score", 3)), "score", "label")).select(F.lit("order").alias("grain"), "ap")
        out.append(line.unionByName(trip).select(F.lit(w).alias("weight"), "*"))
    return rounded(aggregates.unioned(out))


@query()
def q_model_counterfactual(t):
    """Recall with and without the effect of a feature in one period."""
    train, test = halves(t)
    model = models.fit(train, FEATURES, models.gbt(TARGET, **SMALL))
    both = models.counterfactual(model, test, FEATURES, {"l_quantity": 10.0}, F.col("month") == 5)
    over = F.col(TARGET) > 63
    return rounded(both.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.count_if(over & (F.col("pred") > 50)).alias("caught"), F.count_if(over & (F.col("pred_without") > 50)).alias("caught_without"), F.avg(F.col("pred") - F.col("pred_without")).alias("effect")))


@query()
def q_model_importance(t):
    """Permutation importance of each feature."""
    train, test = halves(t)
    model = models.fit(train, FEATURES, models.gbt(TARGET, **SMALL))
    return rounded(models.permutation_importance(model, test, FEATURES, TARGET, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]))


#: Families of the features in the attribution.
FAMILIES = {"l_quantity": "load", "l_discount": "price", "l_tax": "price", "l_linenumber": "place", "l_returnflag": "state", "month": "calendar", "pri": "state"}


@query()
def q_model_attribution(t):
    """All features by segment and over all rows: the arms of every feature in one job."""
    train, test = halves(t)
    fitted = models.fit_segments(train, "segment", ["low", "high"], FEATURES, models.gbt(TARGET, **SMALL))
    return rounded(tuning.attribution(fitted, test, "segment", FEATURES, TARGET, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]))


@query()
def q_model_families(t):
    """The same attribution added up by family of features."""
    train, test = halves(t)
    fitted = models.fit_segments(train, "segment", ["low", "high"], FEATURES, models.gbt(TARGET, **SMALL))
    found = tuning.attribution(fitted, test, "segment", FEATURES, TARGET, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    return rounded(tuning.family_mass(found, "segment", FAMILIES))


@query()
def q_model_halving(t):
    """Eight settings over three folds, the better half of each rung with twice the trees."""
    settings = {f"depth{d}_rate{r}": (lambda trees, d=d, r=r: models.gbt(TARGET, trees, d, r)) for d in (2, 3, 4, 5) for r in (0.1, 0.3)}
    return rounded(tuning.successive_halving(model_rows(t, F.col("year").isin(1995, 1996, 1997, 1998)), "year", [1995, 1996, 1997, 1998], FEATURES, TARGET, settings, [1, 2, 4]))
