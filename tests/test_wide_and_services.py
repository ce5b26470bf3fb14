"""Wide tables, service rules, sweeps, components, stages and guarded lookups on small fixtures."""

import datetime as dt
import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legwork.functions import daycal
from legwork.operators import joins, services, sweeps, wide, windows
from legwork.sources import files

D = dt.date
NAN = float("nan")


def pearson(x, y):
    both = [(a, b) for a, b in zip(x, y, strict=True) if a is not None and b is not None and not math.isnan(a) and not math.isnan(b)]
    if len(both) < 2 or len({a for a, _ in both}) < 2 or len({b for _, b in both}) < 2:
        return len(both), None
    return len(both), float(np.corrcoef(*zip(*both, strict=True))[0, 1])


def test_158_columns_in_one_pass(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(120, 158)) * 10.0 ** draw.integers(-3, 9, 158) + 10.0 ** draw.integers(-3, 9, 158)
    rows = [[None if (i * 7 + j) % 11 == 0 and j % 3 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(base)]
    for r in rows:
        r[150], r[151] = r[30], r[31]  # exact duplicates, with and without gaps
        r[152] = 5.0  # constant
        r[153] = None
        r[154] = NAN if r[3] is None else r[3]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(158))).repartition(5)
    got = {(r["one"], r["two"]): r for r in wide.correlations(df, df.columns).collect()}
    assert len(got) == 158 * 157 // 2
    columns = list(zip(*rows, strict=True))
    for i in range(0, 158, 5):
        for j in range(i + 1, 158, 3):
            n, r = pearson(columns[i], columns[j])
            g = got[f"c{i}", f"c{j}"]
            assert g["n"] == n
            assert (g["r"] is None) == (r is None)
            assert r is None or abs(g["r"] - r) < 1e-6
    assert {k for k, r in got.items() if r["duplicate"]} == {("c30", "c150"), ("c31", "c151"), ("c3", "c154")}


def test_equal_rows_and_repeated_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (1.0, 1.0, None), (2.0, 3.0, None), (None, None, 1.0)], "a double, b double, c double")
    got = {(r["one"], r["two"]): (r["n"], r["same"], r["duplicate"]) for r in wide.correlations(df, ["a", "b", "c"], equal=True).collect()}
    assert got == {("a", "b"): (3, 3, False), ("a", "c"): (0, 0, False), ("b", "c"): (0, 0, False)}
    empty = wide.correlations(df.limit(0), ["a", "b"]).collect()
    assert [(r["n"], r["r"]) for r in empty] == [(0, None)]


def test_codebook_of_many_kinds(spark, monkeypatch):
    monkeypatch.setattr(wide, "KEPT", 3)
    monkeypatch.setattr(wide, "BLOCK", 2)
    schema = "i int, d double, s string, t timestamp, x binary, b boolean, m decimal(9,2), g date"
    rows = [(k % 9, -0.0 if k % 2 else 0.0, None if k % 4 == 0 else f"v{k % 13}", dt.datetime(2024, 1, 1 + k % 5), bytes([k % 3, 255]), k % 2 == 0, None, D(2024, 1, 1 + k % 7)) for k in range(60)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    book = {r["column"]: r for r in wide.codebook(df, sketched=["g"]).collect()}
    assert {c: r["distinct"] for c, r in book.items()} == {"i": 9, "d": 1, "s": 13, "t": 5, "x": 3, "b": 2, "m": 0, "g": 7}
    assert book["s"]["nulls"] == 15 and book["m"]["nulls"] == 60 and book["i"]["rows"] == 60
    assert (book["i"]["low"], book["i"]["high"]) == ("0", "8")
    assert book["m"]["kind"] == "decimal(9,2)"


def test_constant_columns_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(wide, "BLOCK", 2)
    rows = [(1, "a", None, 1), (1, "a", 5, 2), (2, "b", None, 3), (2, "b", None, 3)]
    got = {r["column"]: tuple(r)[1:] for r in wide.constant_shares(spark.createDataFrame(rows, "k int, a string, b int, c int"), ["k"], ["a", "b", "c"]).collect()}
    assert got == {"a": (2, 2, 2), "b": (2, 1, 2), "c": (2, 1, 1)}


START, END = D(2023, 12, 15), D(2024, 12, 14)
NOTES = [
    # label, text, kind, weekdays, holidays, include, exclude, required
    ("5", "sauf 22.9. et 24.12.", "working", [1, 2, 3, 4, 5], "exclude", [], [D(2024, 9, 22), D(2023, 12, 24)], None),
    ("5", "ainsi que 22.9.", "weekend", [6, 7], "include", [D(2024, 9, 22)], [], None),
    ("17", "Ainsi que 1.5.", "also", [5, 6], None, [D(2024, 5, 1)], [], None),
    ("99", "ainsi que 1.5.", "also", None, None, [D(2024, 5, 1)], [], None),
    ("10", "", "empty", [1, 2, 3, 4, 5], None, [], [], None),
    ("99", " – ", "empty", None, None, [], [], None),
    ("18", "du 30.12. - 2.1. et 5.2.", "period", [5, 6], None, [D(2024, 2, 5)], [], [D(2023, 12, 30), D(2023, 12, 31), D(2024, 1, 1), D(2024, 1, 2)]),
    ("18", "du 24.12. – 24.12.", "period", [2, 3], None, [], [], [D(2023, 12, 24)]),
    ("1", "du 3.7. – 3.7.", "period", [1, 2, 3, 4, 5, 6, 7], None, [], [], [D(2024, 7, 3)]),
    ("16", "sauf fêtes générales, 3.3.", "not_holidays", [5, 6], "exclude", [D(2024, 3, 3)], [], None),
    ("12", "sauf 4.3. – 5.3. 9/9", "except", [1, 2, 3, 4, 5], "exclude", [], [D(2024, 3, 4), D(2024, 3, 5)], None),
    ("1", "sauf 4.3.", "except", None, None, [], [D(2024, 3, 4)], None),
    ("20", "nuit 6.6.", "days", [6, 7], None, [D(2024, 6, 6)], [], None),
    ("1", "6.6. – 7.6.", "days", None, None, [], [], [D(2024, 6, 6), D(2024, 6, 7)]),
    ("1", "sur demande", "unread", None, None, [], [], None),
    ("1", "30.2.", "unread", None, None, [], [], None),
    ("1", None, "empty", None, None, [], [], None),
]


def test_notes_are_read_as_rules(spark):
    df = spark.createDataFrame([(i, n[0], n[1], START, END) for i, n in enumerate(NOTES)], "i int, label string, text string, start date, end date")
    for r in services.note_rules(df).collect():
        _, _, kind, weekdays, holidays, include, exclude, required = NOTES[r["i"]]
        assert (r["kind"], r["weekdays"], r["holidays"], sorted(r["include"]), sorted(r["exclude"]), r["required"] and sorted(r["required"])) == (kind, weekdays, holidays, sorted(include), sorted(exclude), required), NOTES[r["i"]]
        assert r["parsed"] == (kind != "unread" and not (kind == "empty" and weekdays is None))


def expected_days(rule, calendar):
    """Set algebra on days, rule by rule."""
    weekdays, holidays, include, exclude, required = rule
    out = set()
    for day, dow, off in calendar:
        good = (weekdays is None or dow in weekdays) and (required is None or day in required)
        if holidays == "exclude":
            good = good and not off
        if holidays == "include":
            good = good or off
        if (good or day in include) and day not in exclude:
            out.add(day)
    return out


def test_rules_and_trips_as_bitmaps(spark):
    calendar = daycal.dimension(spark, 2023, 2024).where(F.col("day").between(START, END)).withColumn("period", F.lit(1))
    days = [(r["day"], r["dow"], r["is_holiday"]) for r in calendar.collect()]
    masks = services.period_masks(calendar.select("period", "day", "dow", "is_holiday"), "period")
    assert masks.first()["words"] == 6
    df = spark.createDataFrame([(str(i), n[0], n[1], START, END, 1) for i, n in enumerate(NOTES)], "rule string, label string, text string, start date, end date, period int")
    rules = services.rule_bitmaps(services.note_rules(df), masks, "period")
    got = {r["rule"]: set(r["d"]) for r in rules.join(masks.select("period", "first"), "period").select("rule", services.days_of(F.col("bits"), F.col("first")).alias("d")).collect()}
    want = {str(i): expected_days(n[3:], days) for i, n in enumerate(NOTES)}
    assert got == want
    trips = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "trip string, period int")
    markers = spark.createDataFrame([("a", "0"), ("a", "8"), ("a", "nothing"), ("b", "4")], "trip string, rule string")
    out = {r["trip"]: r for r in services.trip_bitmaps(trips, markers, rules, masks, ["trip"], ["rule"], "period").withColumn("d", services.days_of(F.col("bits"), F.col("first"))).collect()}
    assert set(out["a"]["d"]) == want["0"] & want["8"] and (out["a"]["n_rules"], out["a"]["n_missing"]) == (2, 1)
    assert set(out["b"]["d"]) == want["4"]
    assert set(out["c"]["d"]) == {d for d, _, _ in days} and out["c"]["n_rules"] == 0


def test_symbols_markers_and_midnight(spark):
    stops = spark.createDataFrame([("t", 2, "n2|n1", None), ("t", 1, "n1", "A"), ("t", 3, None, "R | A"), ("u", 1, None, "")], "trip string, place int, refs string, sym string")
    got = {r["trip"]: r for r in services.service_markers(stops, ["trip"], "refs", "sym").collect()}
    assert (got["t"]["note_refs"], got["t"]["symbols"], got["t"]["validity"]) == (["n1", "n2"], ["A", "R"], "marked")
    assert (got["u"]["note_refs"], got["u"]["symbols"], got["u"]["validity"]) == ([], [], "daily")
    signs = services.symbol_rules(spark.createDataFrame([("A",), ("C",), ("Sa",), ("Di",), ("Z",)], "s string"), "s").collect()
    assert [(r["s"], r["weekdays"], r["holidays"]) for r in signs] == [("A", [1, 2, 3, 4, 5], "exclude"), ("C", [6, 7], "include"), ("Sa", [6], None), ("Di", [7], None), ("Z", [1, 2, 3, 4, 5, 6, 7], None)]
    trips = spark.createDataFrame([("t", D(2024, 1, 1), [-(1 << 63) | 1, 1])], "trip string, first date, bits array<long>")
    legs = spark.createDataFrame([("t", 1430, 5), ("t", 10, 20)], "trip string, dep int, arr int")
    rows = sorted((r["day"], r["departure"], r["arrival"], r["day_offset"]) for r in services.dated_legs(legs, trips, ["trip"], "dep", "arr").collect())
    assert [r[0] for r in rows] == [D(2024, 1, 1)] * 2 + [D(2024, 3, 4)] * 2 + [D(2024, 3, 5)] * 2
    assert rows[1] == (D(2024, 1, 1), dt.datetime(2024, 1, 1, 23, 50), dt.datetime(2024, 1, 2, 0, 5), 1)
    assert rows[0][1:] == (dt.datetime(2024, 1, 1, 0, 10), dt.datetime(2024, 1, 1, 0, 20), 0)


@pytest.mark.parametrize("width", [7, 3600])
def test_band_counts_and_next_event_equal_brute_force(spark, width):
    draw = random.Random(6)
    base = dt.datetime(2024, 1, 1)
    ev = [(i, draw.choice(["x", "y", None]), base + dt.timedelta(seconds=draw.randrange(400)), draw.choice("abc")) for i in range(150)]
    df = spark.createDataFrame(ev, "id int, line string, ts timestamp, kind string")
    got = {r["id"]: (r["n_0"], r["n_1"]) for r in sweeps.band_counts(df, df, "id", ["line"], "ts", "ts", -20, 60, "kind", ["a", "b"], width).collect()}
    for i, line, ts, _ in ev:
        near = [k for _, o, u, k in ev if o == line and -20 <= (u - ts).total_seconds() <= 60]
        assert got[i] == (near.count("a"), near.count("b"))
    later = {r["id"]: r["wait"] for r in sweeps.next_later(df, ["line"], "ts", "wait", width).collect()}
    for i, line, ts, _ in ev:
        after = [(u - ts).total_seconds() for _, o, u, _ in ev if o == line and u > ts]
        assert later[i] == (round(min(after) * 1e6) if after else None)


def test_spans_are_merged_and_subtracted(spark):
    draw = random.Random(8)
    day = lambda k: D(2024, 1, 1) + dt.timedelta(days=k)
    spans = [(r, n, day(a), day(a + draw.randrange(40))) for n in range(20) for r in ("u", None, "v") for a in [draw.randrange(200)]]
    others = [(r, day(a), day(a + draw.randrange(-3, 12))) for _ in range(25) for r in ("u", None) for a in [draw.randrange(220)]]
    s = spark.createDataFrame(spans, "r string, n int, start date, end date")
    o = spark.createDataFrame(others, "r string, start date, end date")
    dates = lambda a, b: {a + dt.timedelta(days=k) for k in range((b - a).days + 1)}
    covered = {r: set().union(*(dates(a, b) for q, a, b in others if q == r), set()) for r in ("u", None, "v")}
    got = {}
    for r in sweeps.subtracted(s, o, ["r"]).collect():
        new = dates(r["start"], r["end"])
        assert new and not new & got.setdefault((r["r"], r["n"]), set())
        got[r["r"], r["n"]] |= new
    assert got == {(r, n): left for r, n, a, b in spans if (left := dates(a, b) - covered[r])}
    merged = sweeps.merged_spans(o, ["r"]).collect()
    for key in ("u", None):
        own = sorted((r["start"], r["end"]) for r in merged if r["r"] == key)
        assert set().union(*(dates(a, b) for a, b in own)) == covered[key]
        assert all((b[0] - a[1]).days > 1 for a, b in zip(own, own[1:], strict=False))


def test_a_chain_of_10000_groups_takes_at_most_20_rounds(spark):
    ids = list(range(10_000))
    random.Random(2).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (20_000, 20_000), (20_002, 20_001)], "a long, b long")
    found, rounds = sweeps.components(edges, "a", "b")
    labels = {r["a"]: r["label"] for r in found.collect()}
    assert rounds <= 20
    assert {labels[i] for i in ids} == {0}
    assert (labels[20_000], labels[20_001], labels[20_002]) == (20_000, 20_001, 20_001)
    assert len(labels) == 10_003


def test_groups_without_members_and_hot_members(spark):
    pairs = spark.createDataFrame([("g1", "m"), ("g2", "m"), ("g3", None), (None, "m"), ("g4", "x"), ("g4", "x"), ("g5", "y"), ("g2", "y")], "g string, m string")
    assert {r["g"]: r["label"] for r in windows.merged(pairs, "g", "m").collect()} == {"g1": "g1", "g2": "g1", "g5": "g1", "g3": "g3", "g4": "g4"}


def test_a_reader_never_fails_while_stages_are_swapped(spark, tmp_path):
    stage = str(tmp_path / "stage")
    files.write_stage(spark.range(10), stage)
    seen, failed, stop = [], [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.append(files.read_stage(spark, stage).count())
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(11, 19):
        files.write_stage(spark.range(k), stage)
    stop.set()
    reader.join()
    assert not failed, [repr(str(e))[:700] for e in failed]
    assert set(seen) <= set(range(10, 19)) and seen == sorted(seen)
    assert files.read_stage(spark, stage).count() == 18
    assert len(files.versions(spark, stage)) == 9
    files.write_stage(spark.range(3), stage, keep=4, grace=0)
    assert len(files.versions(spark, stage)) == 4 and files.read_stage(spark, stage).count() == 3


def test_only_new_months_are_landed(spark, tmp_path):
    path = str(tmp_path / "landed")
    first = spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], "month string, v int")
    assert files.land(first, path, F.lit(True), "month").count() == 2
    more = spark.createDataFrame([("2024-02", 99), ("2024-03", 3), ("2024-04", 4)], "month string, v int")
    got = files.land(more, path, F.col("v") != 4, "month")
    assert sorted((r["month"], r["v"]) for r in got.collect()) == [("2024-01", 1), ("2024-02", 2), ("2024-03", 3)]
    assert files.partitions(spark, path, "month") == ["2024-01", "2024-02", "2024-03"]


def test_yearly_values_that_do_not_cast_are_an_error(spark, tmp_path):
    path = tmp_path / "hectares2023.csv"
    path.write_text("E;B23BTOT\n1;5\n2;many\n3;\n")
    schema = T.StructType([T.StructField("E", T.LongType()), T.StructField("BBTOT", T.LongType())])
    with pytest.raises(ValueError, match="many"):
        files.read_yearly(spark, [str(path)], schema)
    path.write_text("E;B23BTOT\n1;5\n3;\n")
    assert sorted(tuple(r) for r in files.read_yearly(spark, [str(path)], schema).collect()) == [(1, 5, 2023), (3, None, 2023)]


def test_guards_are_counted_in_the_same_job(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None)], "id int, k string")
    dim = spark.createDataFrame([("a", 10), ("b", 20)], "k string, v int")
    out, guard = joins.guarded_lookup(facts, dim, ["k"])
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(1, 10), (2, 20), (3, None), (4, None)]
    assert guard.check() == {"rows_in": 4, "most": 1, "rows_out": 4, "unmatched": 2}
    with pytest.raises(ValueError, match="met no row"):
        guard.check(unmatched=0.25)
    out, guard = joins.guarded_lookup(facts, dim.union(dim), ["k"])
    assert out.count() == 4
    with pytest.raises(ValueError, match="has 2 rows"):
        guard.check()


def test_literal_dimensions_and_metric_reports(spark, tmp_path):
    dim = files.literal(spark, [(1, "one"), (2, None)], "k int, name string")
    assert dim.dtypes == [("k", "int"), ("name", "string")] and dim.count() == 2
    files.write_metrics(spark.createDataFrame([("r2", 0.5)], "metric string, value double"), str(tmp_path / "m"))
    files.write_metrics(spark.createDataFrame([("r2", 0.6)], "metric string, value double"), str(tmp_path / "m"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "m")).select("metric", "value").collect()] == [("r2", 0.6)]


def test_discarded_tables_are_gone_and_others_stay(spark):
    from legwork.functions import storage

    kept, gone = storage.stored(spark.range(3)), storage.stored(spark.range(4))
    storage.discard(gone, spark.range(1))
    assert kept.count() == 3
    assert not files.exists(spark, gone._stored_in) and files.exists(spark, kept._stored_in)
