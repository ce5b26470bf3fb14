"""Work that must not grow faster than the tables: counts of rows, passes and values at the places that once did."""

import re

import pytest
from pyspark.sql import functions as F

from legwork.operators import joins, models, topology, tuning, wide
from legwork.plans import aggregates_and_decisions, wide_tables_and_services
from legwork.plans.model_queries import model_rows
from legwork.plans.registry import Tables


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.fixture
def pairs(monkeypatch):
    """Numbers of pairs that each call of within_radius makes."""
    made, real = [], topology.within_radius

    def counted(*args, **kwargs):
        out = real(*args, **kwargs)
        made.append(out.count())
        return out

    monkeypatch.setattr(topology, "within_radius", counted)
    return made


def copies(spark):
    """300 points and 200 stations at two places 77 metres apart, one of each far off, a point without a place."""
    points = spark.range(300).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 6.841).otherwise(6.84).alias("lon"), F.lit(46.46).alias("lat"))
    points = points.unionByName(spark.createDataFrame([(300, 7.5, 46.0), (301, None, 46.46)], "k long, lon double, lat double"))
    stations = spark.range(200).select(F.col("id"), F.when(F.col("id") % 2 == 0, 6.84).otherwise(6.841).alias("s_lon"), F.lit(46.46).alias("s_lat"))
    return points, stations.unionByName(spark.createDataFrame([(200, 8.0, 46.0)], "id long, s_lon double, s_lat double"))


def test_radius_counts_pair_places_once(spark, pairs):
    points, stations = copies(spark)
    got = {r["id"]: (r["near"], r["far"], r["nearest"]) for r in topology.radius_counts(points, stations, {"near": 10.0, "far": 100.0}).collect()}
    assert got == {i: (200 if i % 2 == 0 else 100, 300, 0.0) for i in range(200)}
    assert pairs == [4]


def test_nearest_station_pairs_places_once(spark, pairs):
    points, stations = copies(spark)
    points = points.withColumn("y", (F.col("k") % 2).cast("int"))
    stations = stations.crossJoin(spark.range(2).select(F.col("id").cast("int").alias("y"))).where("id + y > 1")
    got = values(topology.nearest_station(points, stations, ["k", "y"], 100.0, on=["y"]), "k", "y", "id", "metres")
    least = {(0, True): 2, (0, False): 3, (1, True): 2, (1, False): 1}  # by year and place
    assert sorted(got) == [(k, k % 2, least[k % 2, k % 3 != 0], 0.0) for k in range(300)]
    assert pairs == [8]


def test_model_rows_join_once(spark):
    rows = model_rows(Tables(spark, "/root/testdata/sf0.001"), F.col("year") == 1997)
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("year(o_orderdate) = 1997")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert rows.count() == lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).count() > 0


def test_constant_wide_deals_source_columns(spark):
    plan = wide_tables_and_services.q_constant_wide(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(k#" not in plan


def test_human_baseline_keeps_no_sets_of_trips(spark):
    plan = aggregates_and_decisions.q_human_baseline(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[veh#\d+L?, day#\d+, trip#", plan)


def plain_boosting(trees, depth, rate):
    return models.gbt("y", trees, depth, rate).setSubsamplingRate(1.0).setFeatureSubsetStrategy("all")


def halving_rows(spark):
    h = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000.0
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3 + 2020).cast("int").alias("year"), F.round(h(1), 1).alias("a"), F.when(F.col("id") % 5 > 0, F.round(h(2) * 20)).alias("b"), F.element_at(F.array(*map(F.lit, "pqrs")), (F.col("id") % 4 + 1).cast("int")).alias("c"), h(3).alias("e"))
    return df.select("k", "year", "a", "b", "c", (F.col("a") * 10 + F.coalesce("b", F.lit(3.0)) + F.when(F.col("c").isin("q", "s"), F.col("a") * 7).otherwise(2.0) + F.col("e")).alias("y"))


def test_halving_gives_the_errors_of_single_fits_in_few_jobs(spark):
    settings = {f"d{d}_r{r}": (lambda trees, d=d, r=r: plain_boosting(trees, d, r)) for d in (1, 2, 4) for r in (0.1, 0.4)}
    rows, features = halving_rows(spark).cache(), ["a", "b", "c"]
    rows.count()
    spark.sparkContext.setJobGroup("halving", "halving")
    got = tuning.successive_halving(rows, "year", [2020, 2021, 2022], features, "y", settings, [1, 3])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("halving"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = {(r["budget"], r["params"], r["fold"]): r["rmse"] for r in got.collect()}
    assert len(found) == 18 and jobs < 70
    for (budget, name, fold), rmse in found.items():
        if budget == 3 or name == "d4_r0.1":
            past = rows.where(F.col("year") < fold)
            model = models.fit(past, features, settings[name](budget))
            want = models.score(model, rows.where(F.col("year") == fold), features).agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("y"), 2)))).first()[0]
            assert rmse == pytest.approx(want, rel=1e-9)


def test_halving_does_not_depend_on_the_layout(spark):
    settings = {f"d{d}": (lambda trees, d=d: models.gbt("y", trees, d, 0.3)) for d in (2, 3)}
    search = lambda rows: tuning.successive_halving(rows, "year", [2020, 2021, 2022], ["a", "b", "c"], "y", settings, [1, 2]).orderBy("rung", "params", "fold").collect()
    a, b = search(halving_rows(spark).repartition(2)), search(halving_rows(spark).repartition(7, "k"))
    assert [r["params"] for r in a] == [r["params"] for r in b] and [r["n"] for r in a] == [r["n"] for r in b]
    assert [r["rmse"] for r in a] == pytest.approx([r["rmse"] for r in b], rel=1e-9)


def test_codebook_blocks_are_compiled(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = t.lineitem.selectExpr(*(f"{e} as w{i}" for i, e in enumerate(wide_tables_and_services.WIDE)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows no code before it ran
    try:
        shown = wide.codebook(rows)._jdf.queryExecution().debug().codegenToSeq()
        longest = [shown.apply(i)._3().maxMethodCodeSize() for i in range(shown.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert longest and max(longest) < 8000  # the JVM leaves longer methods uncompiled


def test_block_grain_deals_bounded_parts(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    want = aggregates_and_decisions.q_block_grain(t).collect()
    monkeypatch.setattr(joins, "DEALT", 500)
    got = aggregates_and_decisions.q_block_grain(t)
    parts = re.findall(r"hashpartitioning\((\w+)#.*?, (\d+)\), REPARTITION_BY_NUM", got._jdf.queryExecution().executedPlan().toString())
    count = str(-(-t.lineitem.count() // 500))
    assert set(parts) == {("trip", count), ("veh", count)} and got.collect() == want
