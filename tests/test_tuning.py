"""Penalty sweeps, successive halving and attribution on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from legwork.operators import models, quality, tuning
from legwork.plans import all_queries, model_queries

SF = "/root/testdata/sf0.001"


def test_penalties_equal_the_closed_form(spark):
    draw = random.Random(1)
    rows = []
    for i in range(300):
        a, b, c = draw.gauss(1e6, 3), draw.gauss(0, 1), draw.choice(["x", "y", "z", None])
        rows.append((a if i % 7 else None, b, c, 2 * a + b - 5 * (c == "y") + draw.gauss(0, 1) if i % 50 else None))
    df = spark.createDataFrame(rows, "a double, b double, c string, y double").repartition(3)
    model = tuning.ridge_sweep(df, ["a", "b", "c"], "y", [0.0, 3.0, 500.0])
    assert model.columns == ["a", "b", "c=x", "c=y", "c=z"]
    known = [r for r in rows if r[3] is not None]
    texts = [r[2] for r in known if r[2]]
    mode = max(sorted(set(texts)), key=texts.count)
    x = np.array([[model.medians[0] if r[0] is None else r[0], r[1], *((r[2] or mode) == v for v in "xyz")] for r in known], float)
    y = np.array([r[3] for r in known])
    assert abs(model.medians[0] - np.median([r[0] for r in known if r[0] is not None])) < 0.1
    z = (x - x.mean(0)) / np.where(np.arange(5) < 2, x.std(0), 1.0)
    for p in (3.0, 500.0):
        want = np.linalg.solve(z.T @ z + p * np.eye(5), z.T @ (y - y.mean()))
        assert np.allclose(model.weights[p], want, rtol=1e-5, atol=1e-6)
    got = {r["penalty"]: r for r in tuning.ridge_metrics(model, df.where("y is not null"), "y").collect()}
    pred = z @ model.weights[3.0] + y.mean()
    seen = np.array([r[2] is not None for r in known])  # a null text counts as no level when scored
    assert got[3.0]["n"] == len(known) and got[0.0]["r2"] >= got[500.0]["r2"]
    own = {(r["a"], r["b"]): r["preds"][1] for r in tuning.ridge_scores(model, df).collect()}
    assert all(abs(own[r[0], r[1]] - p) < 1e-4 for r, p, s in zip(known, pred, seen, strict=True) if s)


def test_too_many_levels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(tuning, "LEVELS", 2)
    with pytest.raises(ValueError, match="more than 2 levels"):
        tuning.ridge_sweep(spark.createDataFrame([(c, 1.0) for c in "abc"], "c string, y double"), ["c"], "y", [1.0])


def table(spark, n=400):
    draw = random.Random(5)
    rows = [(i, 2020 + i % 3, "s" if i % 2 else "t", draw.random(), draw.random(), draw.choice("pq")) for i in range(n)]
    return spark.createDataFrame(rows, "k int, year int, seg string, a double, b double, c string").withColumn("y", F.col("a") * 10 + F.when(F.col("seg") == "s", F.col("b") * 5).otherwise(0.0))


def test_halving_keeps_the_better_half(spark):
    settings = {f"d{d}": (lambda trees, d=d: models.gbt("y", trees, d, 0.5)) for d in (1, 2, 3, 4)}
    got = tuning.successive_halving(table(spark), "year", [2020, 2021, 2022], ["a", "b", "c"], "y", settings, [1, 2, 3]).collect()
    by = [{r["params"] for r in got if r["rung"] == k} for k in range(3)]
    assert [len(b) for b in by] == [4, 2, 1]
    for k in range(2):
        mean = {p: np.mean([r["rmse"] for r in got if r["rung"] == k and r["params"] == p]) for p in by[k]}
        assert by[k + 1] == set(sorted(mean, key=lambda p: (mean[p], p))[: len(by[k + 1])])
        assert {r["params"] for r in got if r["rung"] == k and r["kept"]} == by[k + 1]
    assert {r["fold"] for r in got} == {2021, 2022}


def test_attribution_by_segment(spark):
    df = table(spark)
    fitted = models.fit_segments(df, "seg", ["s", "t"], ["a", "b", "c"], models.gbt("y", 5, 3, 0.5))
    found = tuning.attribution(fitted, df, "seg", ["a", "b", "c"], "y", ["k"]).cache()
    got = {(r["seg"], r["feature"]): r for r in found.collect()}
    assert len(got) == 9
    assert [got[s, "a"]["place"] for s in ("s", "t", None)] == [1, 1, 1]
    assert got["s", "b"]["mass"] > 5 * got["t", "b"]["mass"]
    for s, n in (("s", 200), ("t", 200), (None, 400)):
        assert abs(sum(got[s, f]["share"] for f in "abc") - 1) < 1e-9 and got[s, "a"]["n"] == n
    for f in "abc":
        assert abs(got[None, f]["mass"] - (got["s", f]["mass"] + got["t", f]["mass"]) / 2) < 1e-9
    families = {(r["seg"], r["family"]): r for r in tuning.family_mass(found, "seg", {"a": "one", "b": "one", "c": "two"}).collect()}
    assert abs(families["s", "one"]["mass"] - got["s", "a"]["mass"] - got["s", "b"]["mass"]) < 1e-9


def test_counterfactual_scores_each_row_twice(spark):
    df = table(spark, 100)
    model = models.fit(df, ["a", "b", "c"], models.gbt("y", 3, 3))
    both = models.counterfactual(model, df.repartition(4), ["a", "b", "c"], {"a": 0.0, "c": "p"}, F.col("k") < 50).collect()
    plain = {r["k"]: r["pred"] for r in models.score(model, df, ["a", "b", "c"]).collect()}
    reset = {r["k"]: r["pred"] for r in models.score(model, df.withColumns({"a": F.lit(0.0), "c": F.lit("p")}), ["a", "b", "c"]).collect()}
    rows = {r["k"]: r for r in df.collect()}
    for r in both:
        assert r["pred"] == plain[r["k"]] and r["pred_without"] == (reset if r["k"] < 50 else plain)[r["k"]]
        assert (r["a"], r["c"]) == (rows[r["k"]]["a"], rows[r["k"]]["c"])


def test_guards_of_histories(spark):
    df = spark.createDataFrame([("a", 1, 0, None), ("a", 2, 5, None), ("a", 1, 20, 1.0), ("b", 1, 0, None), ("b", 1, 30, 2.0), ("c", 1, 0, None), ("d", 1, 3, 1.0), ("d", 2, 3, None)], "g string, leg int, k int, h double")
    df = df.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")))
    broken = lambda g: g.first()["violations"]
    assert broken(quality.first_gap(df, ["g"], "day", "h", 20)) == 0  # gaps 20, 30 and 0
    assert broken(quality.first_gap(df, ["g"], "day", "h", 21)) == 1
    assert broken(quality.varies(df, ["g"], "h", 0.9, "leg")) == 0  # a and d have two legs and vary, null beside a value
    assert broken(quality.varies(df, ["g"], "h", 0.9)) == 1  # c does not


def test_importance_query_takes_all_features(spark):
    got = all_queries()["q_model_importance"](spark, SF).collect()
    assert sorted(r["feature"] for r in got) == sorted(model_queries.FEATURES)


def grown(monkeypatch):
    """Trees and depth of every estimator that is fitted from now on, while one tree stands for all."""
    seen, plain = [], models.fit

    def fit(train, features, estimator):
        seen.append((estimator.getMaxIter(), estimator.getMaxDepth()))
        return plain(train, features, estimator.copy({estimator.maxIter: 1}))

    monkeypatch.setattr(models, "fit", fit)
    return seen


def test_segmented_query_grows_all_trees(spark, monkeypatch):
    seen = grown(monkeypatch)
    got = all_queries()["q_model_segmented"](spark, SF).collect()
    assert seen == [(300, 6)] * 2 and {r["segment"] for r in got} == {"low", "high", None}


def test_walk_forward_query_grows_all_trees(spark, monkeypatch):
    seen = grown(monkeypatch)
    got = all_queries()["q_model_walk_forward"](spark, SF).collect()
    assert sorted(seen) == [(300, 4)] * 2 + [(300, 6)] * 2
    assert {(r["params"], r["fold"]) for r in got} == {(p, f) for p in ("shallow", "deeper") for f in (1996, 1997, None)}
