"""Operators on small fixtures: semantics that the queries' SQL doesn't pin down."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legwork.functions import casts, daycal, text
from legwork.operators import aggregates, decision, inference, joins, models, quality, topology, wide, windows
from legwork.sources import files

D = dt.date


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_publication_history_lags(spark):
    rows = [(D(2024, m, 15), "a", float(m * 10)) for m in range(1, 5)] + [(D(2024, 3, 15), "b", 99.0)]
    out = windows.publication_history(spark.createDataFrame(rows, "day date, leg string, v double"), ["leg"], "day", "v", 15.0)
    got = dict(values(out.where("leg = 'a'"), "day", "h_last"))
    assert got == {D(2024, 1, 15): None, D(2024, 2, 15): 10.0, D(2024, 3, 15): 20.0, D(2024, 4, 15): 30.0}
    assert values(out.where("leg = 'b'"), "h_last") == [(None,)]
    assert out.count() == 5
    assert all(m is None or m >= a for m, a in values(out, "h_max", "h_mean"))


def test_publication_cutoff(spark):
    days = spark.createDataFrame([(D(2024, 3, 15),), (D(2024, 3, 4),), (D(2024, 3, 5),)], "d date")
    assert [r[0] for r in days.select(windows.publication_cutoff(F.col("d"))).collect()] == [D(2024, 2, 29), D(2024, 1, 31), D(2024, 2, 29)]


def test_null_groups_share_a_history(spark):
    rows = [(D(2024, 1, 15), None, 1.0), (D(2024, 2, 15), None, 2.0)]
    out = windows.publication_history(spark.createDataFrame(rows, "day date, leg string, v double"), ["leg"], "day", "v", 0.0)
    assert dict(values(out, "day", "h_last"))[D(2024, 2, 15)] == 1.0


def test_headway(spark):
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = spark.createDataFrame([(100, t(7, 0), "a"), (200, t(7, 15), "a"), (300, t(7, 45), "a"), (1421, t(7, 20), "b")], "id int, t timestamp_ntz, dir string")
    out = windows.headway(rows, ["dir"], "t", "id").orderBy("id")
    assert values(out, "before_min", "after_min", "is_first", "is_last") == [(None, 15.0, True, False), (15.0, 30.0, False, False), (30.0, None, False, True), (None, None, True, True)]


def test_rolling_by_type(spark):
    rows = spark.createDataFrame([(D(2023, 1, i), "x", float(i)) for i in range(2, 8)] + [(D(2023, 1, 8), "y", 100.0)], "day date, kind string, v double")
    out = dict(values(windows.rolling(rows, ["kind"], ["day"], "v", 3, ("mean",), least=2, lag=1), "day", "v_mean3"))
    assert out[D(2023, 1, 2)] is None and out[D(2023, 1, 3)] is None and out[D(2023, 1, 5)] == 3.0 and out[D(2023, 1, 8)] is None
    with pytest.raises(ValueError, match="unknown statistics"):
        windows.rolling(rows, ["kind"], ["day"], "v", 3, ("mode",))


def test_legs_put_stops_without_time_last(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 7), "A"), (1, None, "C"), (1, dt.datetime(2024, 1, 1, 8), "B")], "trip int, t timestamp_ntz, stop string")
    assert sorted(values(windows.legs(rows, ["trip"], "t", ["stop"]), "stop", "next_stop")) == [("A", "B"), ("B", "C")]


def test_carried_forward_never_reads_later_rows(spark):
    rows = spark.createDataFrame([("s", 2020, None), ("s", 2021, 5), ("s", 2022, None), ("s", 2023, 7)], "k string, y int, v int")
    out = rows.select("y", windows.carried_forward(rows, ["k"], "y", "v", [2020, 2022]).alias("v"))
    assert dict(values(out, "y", "v")) == {2020: None, 2021: 5, 2022: 5, 2023: 7}


def test_merged_groups(spark):
    pairs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (9, "z")], "g int, m string")
    assert dict(values(windows.merged(pairs, "g", "m"), "g", "label")) == {1: 1, 2: 1, 3: 1, 9: 9}


def test_lagged_join_keeps_rows(spark):
    left = spark.createDataFrame([(D(2024, 1, 3), 1), (D(2024, 1, 4), 1)], "day date, train int")
    right = spark.createDataFrame([(D(2024, 1, 1), 1, 7.0)], "day date, train int, v double")
    assert dict(values(joins.lagged_join(left, right, "day", ["train"]), "day", "v")) == {D(2024, 1, 3): 7.0, D(2024, 1, 4): None}


def test_band_join_bounds(spark):
    t = lambda m, s=0: dt.datetime(2024, 1, 1, 8, m, s)
    trains = spark.createDataFrame([(1, D(2024, 1, 1), t(10))], "id int, day date, dep timestamp_ntz")
    feeders = spark.createDataFrame([(D(2024, 1, 1), t(10 - m)) for m in range(8)], "day date, arr timestamp_ntz")
    got = joins.band_join(trains, feeders, ["day"], "dep", "arr", 60, 300)
    assert sorted(10 - r["arr"].minute for r in got.collect()) == [1, 2, 3, 4, 5]


def test_nearest_value_ties_go_later(spark):
    facts = spark.createDataFrame([("x", 100), ("x", 135), ("x", 500), (None, 100)], "k string, minute int")
    anchors = spark.createDataFrame([("x", 90), ("x", 110), ("x", 160)], "k string, anchor int")
    got = {(r["k"], r["minute"]): r["anchor"] for r in joins.nearest_value(facts, anchors, ["k"], "minute", "anchor", 30).collect()}
    assert got == {("x", 100): 110, ("x", 135): 160, ("x", 500): None, (None, 100): None}


def test_utc_hours_around_the_changes(spark):
    at = [dt.datetime(2023, 1, 15, 8), dt.datetime(2023, 7, 15, 8), dt.datetime(2023, 3, 26, 1, 30), dt.datetime(2023, 3, 26, 2, 30), dt.datetime(2023, 10, 29, 2, 30)]
    got = [r[0] for r in spark.createDataFrame([(a,) for a in at], "t timestamp_ntz").select(joins.utc_hour(F.col("t"), "Europe/Zurich")).collect()]
    assert got == [dt.datetime(2023, 1, 15, 7), dt.datetime(2023, 7, 15, 6), dt.datetime(2023, 3, 26, 0), dt.datetime(2023, 3, 26, 1), None]


def test_lookup_guards(spark):
    facts = spark.createDataFrame([(1,), (2,)], "k int")
    dim = spark.createDataFrame([(1, "a")], "k int, v string")
    assert sorted(values(joins.lookup(facts, dim, ["k"], {"v": "none"}), "k", "v")) == [(1, "a"), (2, "none")]
    with pytest.raises(ValueError, match="without a match"):
        joins.lookup(facts, dim, ["k"], required=True)
    with pytest.raises(ValueError, match="not unique"):
        joins.lookup(facts, dim.union(dim), ["k"])


def test_calendar(spark):
    years = spark.createDataFrame([(y,) for y in (1999, 2000, 2008, 2024, 2025)], "year int")
    assert [r[0] for r in daycal.with_easter(years).select("easter").collect()] == [D(1999, 4, 4), D(2000, 4, 23), D(2008, 3, 23), D(2024, 3, 31), D(2025, 4, 20)]
    assert years.where("year = 2024").select(daycal.fast_monday(F.col("year"))).first()[0] == D(2024, 9, 16)
    first, last = daycal.season(F.col("year"))
    assert tuple(years.where("year = 2024").select(first, last).first()) == (D(2024, 12, 14), D(2025, 3, 9))
    dim = daycal.dimension(spark, 2024, 2024)
    assert dim.count() == 366
    bridge = {r["day"] for r in dim.where("bridge").collect()}
    assert D(2024, 5, 10) in bridge  # the Friday after Ascension
    month = spark.createDataFrame([(D(2023, 12, 20), 2024), (D(2024, 12, 3), 2024), (D(2024, 1, 5), 2024)], "d date, y int")
    assert [r[0] for r in month.select(daycal.period_month(F.col("d"), F.col("y"))).collect()] == [1, 13, 2]


def test_strict_casts(spark):
    good = spark.createDataFrame([(" 12 ", "1.5"), ("", None), ("7.0", "2")], "a string, b string")
    assert values(casts.strict(good, {"a": "int", "b": "double"}), "a", "b") == [(12, 1.5), (None, None), (7, 2.0)]
    bad = spark.createDataFrame([("12.5", "x")], "a string, b string")
    with pytest.raises(ValueError, match="a: 1 values"):
        casts.strict(bad, {"a": "int"})


def test_totals_and_shares(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (1.0, 2.0)], "a double, b double")
    assert values(df, casts.total_zero(F.col("a"), F.col("b")), casts.total_null(F.col("a"), F.col("b"))) == [(0.0, None), (1.0, 1.0), (3.0, 3.0)]
    parts = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in parts.select(casts.share(F.col("a"), F.col("b"))).collect()] == [None, 1.0, 0.5]


def test_conform_and_rename(spark):
    df = spark.createDataFrame([(1, "A")], "x int, code string")
    out = casts.conform(casts.renamed(df, {"x": "y"}, codes={"code": {"A": "a"}}), T.StructType([T.StructField("y", T.LongType()), T.StructField("code", T.StringType()), T.StructField("z", T.DoubleType())]))
    assert out.dtypes == [("y", "bigint"), ("code", "string"), ("z", "double")] and values(out, "*") == [(1, "a", None)]
    assert dict(casts.narrowed(spark.range(100)).dtypes)["id"] == "tinyint"


def test_text_rules(spark):
    lines = spark.createDataFrame([("3.7.2023 - 5.7.2023 Jazz, Montreux",), ("1.8.2023 Fête (reportée), Vevey",), ("30.12.2023 - 2.1.2023 Foire, Blonay",)], "line string")
    got = {r["name"]: (r["start"], r["end"], r["place"]) for r in text.event_lines(lines).collect()}
    assert got["Jazz"] == (D(2023, 7, 3), D(2023, 7, 5), "Montreux") and len(got) == 2
    z = spark.createDataFrame([("vevey", "near", 1), ("geneve", "far", 2)], "name string, zone string, priority int")
    rows = spark.createDataFrame([(1, "Genève / Vevey)"), (2, "Nowhere"), (3, "Vevey (quai)")], "k int, place string")
    assert values(text.zones(rows, "k", "place", z), "k", "zone") == [(1, "near")]
    notes = spark.createDataFrame([(1, "runs 24.12 - 26.12 and 3.1.", D(2023, 12, 10), D(2024, 12, 14))], "note int, text string, start date, end date")
    assert sorted(r["day"] for r in text.note_days(notes).collect()) == [D(2023, 12, 24), D(2023, 12, 25), D(2023, 12, 26), D(2024, 1, 3)]


def test_paths_and_places(spark):
    lines = spark.createDataFrame([("H23", ["A", "B", "C", "D"]), ("H24", ["A", "B", "D"])], "year string, stations array<string>")
    rows = spark.createDataFrame([(1, "H23", "A", "C"), (2, "H23", "D", "B"), (3, "H24", "A", "C"), (4, "H23", "B", "B"), (5, "H25", "A", "B")], "id int, year string, o string, t string")
    legs, orphans = topology.path_legs(rows, lines, "year", "o", "t")
    assert sorted(values(legs, "id", "seq", "leg_from", "leg_to")) == [(1, 1, "A", "B"), (1, 2, "B", "C"), (2, 1, "D", "C"), (2, 2, "C", "B")]
    assert sorted(values(orphans, "id", "reason")) == [(3, "target not on line"), (5, "no line")]
    p = spark.createDataFrame([(1, 6.84, 46.46), (2, 6.85, 46.46)], "k int, lon double, lat double")
    s = spark.createDataFrame([(7, 6.841, 46.46), (8, 6.86, 46.5)], "id int, s_lon double, s_lat double")
    near = topology.nearest_station(p, s, ["k"], 200.0).collect()
    assert [(r["k"], r["id"]) for r in near] == [(1, 7)] and 70 < near[0]["metres"] < 85


def test_decisions(spark):
    legs = spark.createDataFrame([(1, 10.0, 63.0), (1, 50.0, 60.0), (2, 5.0, 63.5)], "trip int, p double, y double")
    assert sorted(values(decision.trips(legs, ["trip"], "p", "y"), "trip", "score", "label")) == [(1, 50.0, False), (2, 5.0, True)]
    rows = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "s double, l boolean")
    assert decision.volume_threshold(rows, "s", 2).first()[0] == 0.8
    curve = {r["score"]: (r["hits"], r["rows"]) for r in aggregates.pr_curve(rows, "s", "l").collect()}
    assert curve == {0.9: (1, 1), 0.8: (2, 3), 0.1: (2, 4)}
    assert abs(aggregates.average_precision(aggregates.pr_curve(rows, "s", "l")).first()[0] - (0.5 + 0.5 * 2 / 3)) < 1e-12
    none = rows.where("s > 2").agg(*aggregates.confusion(F.col("l"), F.col("l"))).first()
    assert none["precision"] is None and none["recall"] is None


def test_guards(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    assert quality.unique(df, ["k"]).first()["violations"] == 1
    assert quality.one_value(df, "k", "v").first()["violations"] == 1
    quality.enforce(quality.unique(df, ["k", "v"]))
    with pytest.raises(ValueError, match="guards broken"):
        quality.enforce(quality.unique(df, ["k"]))
    assert values(quality.missing_rates(df.withColumn("n", F.lit(None).cast("int")), ["v", "n"], 0.02), "column", "rate") == [("n", 1.0)]
    vintages = spark.createDataFrame([("a", 2020, 1.0), ("a", 2021, 1.0), ("b", 2020, 1.0), ("b", 2021, 2.0), ("c", 2021, 1.0)], "s string, year int, v double")
    assert quality.carried_equal(vintages, ["s"], "year", {2021: 2020}, ["v"]).first()["violations"] == 2


def test_bootstrap_weights(spark):
    w = spark.range(4000).select(inference.poisson_weight(1, F.col("id")).alias("w"))
    mean, var = w.agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(mean - 1) < 0.06 and abs(var - 1) < 0.1
    assert abs(inference.chi2_tail(3.841) - 0.05) < 1e-3


def test_folds_and_split(spark):
    assert models.expanding_folds([2021, 2019, 2020]) == [([2019], 2020), ([2019, 2020], 2021)]
    df = spark.createDataFrame([(2019, 1), (2019, 2), (2020, 1)], "y int, s int")
    a, b = models.temporal_split(df, "y", [2019], [2020], spark.createDataFrame([(2,)], "s int"), ["s"])
    assert values(a, "y", "s") == [(2019, 1)] and values(b, "y", "s") == [(2020, 1)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id;name\n1;Zürich\n".encode())
    (tmp_path / "b.csv").write_bytes("id;name\n2;Gen\xe8ve\n".encode("latin-1"))
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    files.check_headers(spark, paths[:1], ["id", "name"])
    with pytest.raises(ValueError, match="headers differ"):
        files.check_headers(spark, paths[:1], ["id", "nom"])
    assert values(files.read_delimited(spark, paths[1:], schema), "id", "name", "source_file") == [(2, "Genève", "b.csv")]
    stage = str(tmp_path / "stage.parquet")
    files.write_stage(spark.range(3), stage, str(tmp_path / "twin"))
    files.write_stage(spark.range(5), stage)
    assert files.read_stage(spark, stage).count() == 5
    with pytest.raises(FileNotFoundError):
        files.read_stage(spark, str(tmp_path / "none"))
    (tmp_path / "y23.csv").write_text("E;B23BTOT\n1;5\n9;7\n")
    (tmp_path / "y24.csv").write_text("E,B24BTOT,B24X\n2,6,1\n")
    kinds = T.StructType([T.StructField("E", T.IntegerType()), T.StructField("BBTOT", T.LongType()), T.StructField("BX", T.DoubleType())])
    (tmp_path / "y23.csv").rename(tmp_path / "grid_2023.csv")
    (tmp_path / "y24.csv").rename(tmp_path / "grid_2024.csv")
    yearly = files.read_yearly(spark, [str(tmp_path / f"grid_{y}.csv") for y in (2023, 2024)], kinds, {"E": (0, 5)})
    assert sorted(values(yearly, "year", "E", "BBTOT")) == [(2023, 1, 5), (2024, 2, 6)]
    with pytest.raises(ValueError, match="schemas differ"):
        files.union_checked([spark.range(1), spark.range(1).withColumn("x", F.lit(1))])
    final = files.final_table(spark.createDataFrame([(True, 1, 2)], "f boolean, a int, b int"), ["b"], ["a"])
    assert final.dtypes == [("a", "int"), ("f", "tinyint")]
    clean, report = files.cleaned_series(spark.createDataFrame([("s", 1, 2.0, None)], "st string, t int, x double, y double"), {"x": "temp"}, "t", "st")
    assert clean.columns == ["st", "t", "temp"] and report.count() == 2
    with pytest.raises(ValueError, match="unknown codes"):
        files.only_known(spark.createDataFrame([("q",)], "c string"), "c", spark.createDataFrame([("r",)], "c string"))


def test_similarity_profiles(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 5.0, "x"), (2, 7.0, "y")], "a int, b double, g string")
    book = {r["column"]: r for r in wide.codebook(df).collect()}
    assert book["b"]["nulls"] == 1 and book["a"]["distinct"] == 2 and book["g"]["high"] == "y"
    same = aggregates.fingerprint(df).first()["digest"] == aggregates.fingerprint(df.orderBy(F.desc("b"))).first()["digest"]
    assert same
    shares = {r["column"]: r for r in wide.constant_shares(df, ["a"], ["b", "g"]).collect()}
    assert shares["b"]["constant"] == 1 and shares["b"]["constant_known"] == 1


def test_places_near_the_poles_and_the_date_line(spark):
    import math

    rng = [(i * 7919 % 1000) / 1000 for i in range(400)]
    spots = [(179.999 + 0.002 * a if i % 4 == 0 else 10 + 0.02 * a, (89.99 if i % 4 == 1 else 78.0 if i % 4 == 2 else -3.0) + 0.005 * b) for i, (a, b) in enumerate(zip(rng, rng[::-1], strict=True))]
    spots = [(x - 360 if x > 180 else x, y) for x, y in spots]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots[:200])], "k int, lon double, lat double")
    stations = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots[200:])], "id int, s_lon double, s_lat double")

    def metres(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    want = {(i, j) for i, a in enumerate(spots[:200]) for j, b in enumerate(spots[200:]) if metres(a, b) <= 150}
    got = [(r["k"], r["id"]) for r in topology.within_radius(points, stations, 150.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
