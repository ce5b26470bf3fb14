"""Queries over school calendars, leg templates, candidate lists, guards and intervals of metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import daycal, text
from ..functions.storage import new_folder, stored
from ..operators import aggregates as agg
from ..operators import decision, inference, joins, models, quality, topology, tuning, windows
from ..sources import files
from .aggregates_and_decisions import TRIPS, trip_rows
from .calendar_and_joins import dated_orders
from .model_queries import FEATURES, SMALL, TARGET, halves, model_rows, rounded
from .registry import query


def n():
    return F.count(F.lit(1)).alias("n")


@query("""
with y as (select year(o_orderdate)::int as year, min(o_orderdate::date) filter (month(o_orderdate) = 7) as su, min(o_orderdate::date) filter (month(o_orderdate) = 10) as au, min(o_orderdate::date) filter (month(o_orderdate) = 12) as wi, min(o_orderdate::date) filter (month(o_orderdate) = 4) as sp from orders group by 1),
f as (select year, 'summer' as kind, su as d, 6 + year % 2 as w from y union all select year, 'autumn', au, 2 from y union all select year, 'winter', wi, 2 from y union all select year, 'spring', sp, 2 from y
  union all select year, 'february', make_date(year(sp), 2, 1) + ((8 - isodow(make_date(year(sp), 2, 1))) % 7)::int, 1 from y),
k as (select year, kind, d - ((isodow(d) + 1) % 7)::int as first_day, w from f where d is not null)
select year, kind, first_day, (first_day + (w * 7 + 1)::int) as last_day, count(*) as n from k join orders on o_orderdate::date between first_day and first_day + (w * 7 + 1)::int group by all
""")
def q_school_leave(t):
    """Leave of each year from its parameters (first days and lengths), and the orders that fall into it."""
    o = dated_orders(t).withColumn("year", F.year("day"))
    first = lambda m: F.min(F.when(F.month("day") == m, F.col("day")))
    years = o.groupBy("year").agg(first(7).alias("summer_first"), first(10).alias("autumn_first"), first(12).alias("winter_first"), first(4).alias("spring_first"))
    years = years.withColumns({"summer_weeks": F.col("year") % 2 + 6, "autumn_weeks": F.lit(2), "winter_weeks": F.lit(2), "spring_weeks": F.lit(2)})
    leave = daycal.school_leave(years).withColumns({"first_day": F.col("start"), "last_day": F.col("end")}).where("start is not null")
    return joins.interval_join(o.select("day"), leave, "day", how="inner").groupBy("year", "kind", "first_day", "last_day").agg(n())


@query("""
with d as (select d::date as day from range(timestamp '1995-01-01', timestamp '2004-01-01', interval 1 day) r(d)),
m as (select min(o_orderdate::date) as first_order, arg_min(o_orderdate::date, (-o_totalprice, o_orderdate)) as dearest from orders), o as (select o_orderdate::date as day, count(*) as n from orders group by 1)
select (year(day) - (month(day) < 8)::int)::varchar || '/' || lpad(((year(day) - (month(day) < 8)::int + 1) % 100)::varchar, 2, '0') as school_year, count(*) as days, count(*) filter (day = first_order) as first_order, count(*) filter (day = dearest) as dearest, coalesce(sum(n), 0)::bigint as orders
from d left join o using (day), m group by 1
""")
def q_school_year(t):
    """Date dimension with school year and marker days."""
    o = dated_orders(t)
    marks = o.agg(F.min("day").alias("first_order"), F.min_by("day", F.struct(-F.col("o_totalprice"), "o_orderdate")).alias("dearest")).unpivot([], ["first_order", "dearest"], "marker", "day")
    dim = daycal.marked(daycal.days(t.spark, "1995-01-01", "2003-12-31"), marks).join(o.groupBy("day").agg(n()), "day", "left")
    return dim.groupBy(daycal.school_year(F.col("day")).alias("school_year")).agg(F.count(F.lit(1)).alias("days"), F.count_if("first_order").alias("first_order"), F.count_if("dearest").alias("dearest"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))


@query("""
with s as (select c_nationkey as region, year(o_orderdate) as y, min(o_orderdate::date) filter (month(o_orderdate) = 7) as l, min(o_orderdate::date) filter (month(o_orderdate) = 12) as h from orders join customer on o_custkey = c_custkey group by all),
a as (select distinct region, unnest(generate_series(l, l + (6 + region % 5)::int, interval 1 day))::date as day, 'leave' as kind from s where l is not null union select region, h, 'holiday' from s where h is not null),
d as (select distinct o_orderdate::date as day from orders)
select day, count(*) filter (kind = 'leave') as n_leave, count(*) filter (kind = 'holiday') as n_holiday, count(*) filter (kind = 'leave') > 0 as any_leave, count(*) filter (kind = 'holiday') > 0 as any_holiday from d left join a using (day) group by day
""")
def q_regional_flags(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region"))
    first = lambda m: F.min(F.when(F.month("day") == m, F.col("day")))
    s = dated_orders(t).join(c, "o_custkey").groupBy("region", F.year("day").alias("y")).agg(first(7).alias("l"), first(12).alias("h"))
    leave = s.where("l is not null").select("region", F.lit("leave").alias("kind"), F.col("l").alias("start"), F.date_add("l", (F.col("region") % 5 + 6).cast("int")).alias("end"))
    spans = leave.unionByName(s.where("h is not null").select("region", F.lit("holiday").alias("kind"), F.col("h").alias("start"), F.col("h").alias("end")))
    return daycal.regional_flags(dated_orders(t).select("day").distinct(), spans)


@query("""
with s as (select user_id, ts::date as d, ts, event_type as st from events), k as (select * from s qualify st is distinct from lag(st) over (partition by user_id, d order by ts)),
l as (select user_id, row_number() over w as seq, st as leg_from, lead(st) over w as leg_to from k window w as (partition by user_id, d order by ts)),
u as (select distinct user_id, seq, leg_from, leg_to, case when ascii(leg_to) > ascii(leg_from) then 'up' else 'down' end as direction from l where leg_to is not null)
select seq::int as seq, leg_from, leg_to, direction, count(*) as services from u group by all
""")
def q_leg_templates(t):
    stops = t.events.select(F.col("user_id").alias("service"), F.to_date("ts").alias("day"), "ts", F.col("event_type").alias("station"), F.ascii("event_type").alias("place"))
    out = topology.leg_templates(stops, ["service"], ["day"], "ts", "station", "place")
    return out.groupBy("seq", "leg_from", "leg_to", "direction").agg(F.count(F.lit(1)).alias("services"))


@query("select year(o_orderdate)::int as year, count(*) as n, sum(o_custkey)::bigint as customers, count(distinct o_orderpriority) as priorities, 1::bigint as sources from orders group by 1")
def q_union_checked(t):
    """Orders written as one delimited file set a year, headers checked file by file, read with one schema and stacked."""
    folder = new_folder(t.spark, "yearly")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("year"))
    o.repartition("year").write.partitionBy("year").option("header", True).option("sep", ";").csv(folder)
    years = sorted(r[0] for r in o.select("year").distinct().collect())
    paths = {y: f"{folder}/year={y}" for y in years}
    files.check_headers(t.spark, list(paths.values()), ["o_orderkey", "o_custkey", "o_orderpriority"])
    parts = [files.read_delimited(t.spark, p, o.drop("year").schema).withColumn("year", F.lit(y)) for y, p in paths.items()]
    return files.union_checked(parts).groupBy("year").agg(n(), F.sum("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities"), F.count_distinct("source_file").alias("sources"))


@query(f"""
with {TRIPS}, r as (select floor(score) as s, label, year(day) as y from trips), c7 as (select s, sum(count(*)) over (order by s desc) as n from r where y = 1997 group by s), c8 as (select s, sum(count(*)) over (order by s desc) as n from r where y = 1998 group by s),
th as (select 'value' as convention, (select max(s) from c7 where n >= 100) as threshold union all
  select 'share', (select max(s) from c8 where n >= greatest(1, round((select min(n) from c7 where s = (select max(s) from c7 where n >= 100)) / (select max(n) from c7)::double * (select max(n) from c8)))))
select convention, threshold::double as threshold, count(*) filter (s >= threshold) as volume, count(*) filter (s >= threshold and label) as hits from th, r where y = 1998 group by all
""")
def q_frozen_share(t):
    """A threshold frozen on one year, carried to the next as a value and as the same share of rows."""
    rows = trip_rows(t).select(F.floor("score").alias("score"), "label", F.year("day").alias("y"))
    old, new = (agg.pr_curve(rows.where(F.col("y") == y), "score", "label") for y in (1997, 1998))
    value = decision.at_volume(old, 100)
    share = old.join(F.broadcast(value), F.col("score") == F.col("threshold")).select(F.col("rows").alias("_k")).crossJoin(F.broadcast(old.agg(F.max("rows").alias("_all")))).select((F.col("_k") / F.col("_all")).alias("_share"))
    same = decision.same_share(new.crossJoin(F.broadcast(share)), F.col("_share"))  # one row
    menu = value.select(F.lit("value").alias("convention"), "threshold").unionByName(same.select(F.lit("share").alias("convention"), "threshold"))
    over = F.col("score") >= F.col("threshold")
    return rows.where("y = 1998").crossJoin(F.broadcast(menu)).groupBy("convention", "threshold").agg(F.count_if(over).alias("volume"), F.count_if(over & F.col("label")).alias("hits"))  # two thresholds


@query(f"""
with {TRIPS}, c as (select *, case when score > 80 and label then 'tp' when score > 80 then 'fp' when label then 'fn' else 'tn' end as cell from trips),
p as (select *, row_number() over (partition by cell order by case cell when 'tp' then score when 'fp' then score when 'fn' then load else booked end desc, day, trip) as place from c)
select cell, place::int as place, trip, day, score, load from p where place <= 5
""")
def q_candidates(t):
    """Cases to talk about: five of each confusion cell, each cell in its own order."""
    tie = [F.col("day"), F.col("trip")]
    orders = {"tp": [F.desc("score"), *tie], "fp": [F.desc("score"), *tie], "fn": [F.desc("load"), *tie], "tn": [F.desc("booked"), *tie]}
    return decision.candidate_lists(trip_rows(t), F.col("score") > 80, F.col("label"), orders, 5).select("cell", "place", "trip", "day", "score", "load")


@query("""
with m as (select distinct l_orderkey from lineitem where l_returnflag = 'A') select year(o_orderdate)::int as y, o_orderstatus as st, count(*) as run, count(m.l_orderkey) as measured, round(count(m.l_orderkey) / count(*)::double, 6) as coverage from orders left join m on o_orderkey = l_orderkey group by all
""")
def q_measured(t):
    """Trips run against trips measured."""
    m = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return agg.coverage(t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("st")), m, "o_orderkey", ["y", "st"])


@query("""
with c as (select o_orderstatus as seg, month(o_orderdate)::int as month, o_totalprice - 250000 as c from orders), f as (select seg, month, c, unnest(['calendar', 'weather', 'history']) as family, unnest([0.5 * c, 0.3 * c, c - 0.5 * c - 0.3 * c]) as part from c)
select seg, month, family, round(avg(part), 3) as signed, round(avg(abs(part)), 3) as mass, (abs((select sum(part) from f g where g.seg = f.seg and g.month = f.month) - (select sum(c) from c h where h.seg = f.seg and h.month = f.month)) < 1e-3) as additive from f group by seg, month, family
""")
def q_monthly_mass(t):
    """Mean signed contribution by family and month; the families must add up to the whole."""
    c = F.col("o_totalprice") - 250000
    rows = t.orders.select(F.col("o_orderstatus").alias("seg"), F.month("o_orderdate").alias("month"), (0.5 * c).alias("calendar"), (0.3 * c).alias("weather"), (c - 0.5 * c - 0.3 * c).alias("history"), c.alias("whole"))
    out = agg.monthly_mass(rows, ["seg", "month"], ["calendar", "weather", "history"], "whole", 1e-3)
    return out.withColumns({k: F.round(k, 3) for k in ("signed", "mass")})


@query("""
with g as (select o_custkey, o_orderdate::date as d, row_number() over w as r, avg(o_totalprice) over (w rows between 3 preceding and 1 preceding) as h from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
gap as (select min(d) filter (h is not null) - min(d) as k from g group by o_custkey),
v as (select l_orderkey, min(l_linenumber) < max(l_linenumber) as several, count(distinct case when l_linenumber % 4 > 0 then l_quantity end) + max((l_linenumber % 4 = 0)::int) > 1 as differs from lineitem group by 1),
h as (select date_diff('microsecond', lag(ts) over w, ts) / 6e7 as before_min, row_number() over w = 1 as is_first from events window w as (partition by event_type, ts::date order by ts)),
o as (select year(o_orderdate) as y, avg((l.k is null)::int) as rate from orders left join (select distinct l_orderkey as k from lineitem) l on l.k = o_orderkey group by 1)
select 'first_gap' as guard, (case when median(k) >= 10 then 0 else 1 end)::bigint as violations from gap
union all select 'headway_range', count(*) filter (before_min < 0 or before_min >= 1440)::bigint from h union all select 'headway_null_iff_first', count(*) filter ((before_min is null) <> is_first)::bigint from h
union all select 'share_range', count(*) filter (l_discount < 0 or l_discount > 1)::bigint from lineitem union all select 'orphans', count(*) filter (rate > 0.1)::bigint from o
union all select 'first_is_null', count(*) filter (r = 1 and h is not null)::bigint from g union all select 'varies', (case when avg(differs::int) > 0.5 then 0 else 1 end)::bigint from v where several
""")
def q_range_guards(t):
    o = dated_orders(t)
    head = windows.headway(t.events.withColumn("day", F.to_date("ts")), ["event_type", "day"], "ts", "event_id")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    legs = t.lineitem.withColumn("h", F.when(F.col("l_linenumber") % 4 > 0, F.col("l_quantity")))
    history = windows.rolling(o.select("o_custkey", "day", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 3, lag=1)
    return agg.unioned([
        quality.first_gap(history, ["o_custkey"], "day", "o_totalprice_mean3", 10), quality.varies(legs, ["l_orderkey"], "h", 0.5, "l_linenumber"), quality.in_range(head, "headway_range", "before_min", 0, 1440), quality.null_iff(head, "headway_null_iff_first", "before_min", "is_first"),
        quality.in_range(t.lineitem, "share_range", "l_discount", 0, 1, closed=True), quality.orphans(o.withColumn("y", F.year("day")), lines, ["o_orderkey"], "y", 0.1), quality.first_is_null(history, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice_mean3"),
    ])


@query(f"""
with {TRIPS}, r as (select *, score > 80 as a, booked > 90 as b from trips), m as (select count(*) filter (a and label) / count(*) filter (a)::double as pa, count(*) filter (b and label) / count(*) filter (b)::double as pb, count(*) filter (a and label) / count(*) filter (label)::double as ra from r),
p as (select floor(score) as s, count(*) filter (label) as h, count(*) as r from trips group by 1), c as (select h, sum(h) over (order by s desc) as hits, sum(r) over (order by s desc) as n, (select count(*) from trips where label) as total from p)
select 'precision' as metric, round(pa, 6) as value, true as inside from m union all select 'recall', round(ra, 6), true from m union all select 'precision_difference', round(pa - pb, 6), true from m union all select 'ap', (select round(sum(hits / n::double * h / total::double), 6) from c), true
""")
def q_metric_intervals(t):
    """Precision, recall, average precision and a paired difference with limits from day blocks; the limits hold the estimates."""
    rows = trip_rows(t).withColumns({"a": F.col("score") > 80, "b": F.col("booked") > 90, "bin": F.floor("score")})
    count = lambda c, k: F.count_if(c).alias(k)
    l = F.col("label")  # noqa: E741
    blocks = stored(rows.groupBy("day").agg(count(F.col("a") & l, "a_tp"), count("a", "a_all"), count(F.col("b") & l, "b_tp"), count("b", "b_all"), count(l, "labels")))
    sums = ["a_tp", "a_all", "b_tp", "b_all", "labels"]
    metrics = {"precision": F.col("a_tp") / F.col("a_all"), "recall": F.col("a_tp") / F.col("labels"), "precision_difference": F.col("a_tp") / F.col("a_all") - F.col("b_tp") / F.col("b_all")}
    out = inference.metric_intervals(blocks, ["day"], sums, metrics, 100, 0.999)
    points = stored(rows.groupBy("day", "bin").agg(count(l, "hits"), n()))
    ap = inference.ap_interval(points, ["day"], "bin", "hits", "n", 50, 0.999)
    return out.unionByName(ap).select("metric", F.round("value", 6).alias("value"), F.col("value").between(F.col("low"), F.col("high")).alias("inside"))


NAMED = ["tion", "reeux", "ciones", "und", "the"]


@query(f"""
with f as (select lower(strip_accents(text)) as t from documents where text is not null), g as (select regexp_replace(t, '[()]', '', 'g') as t from f)
select coalesce({" ".join(f"case when contains(t, '{w}') then '{w}' end," for w in NAMED)} 'elsewhere') as place, count(*) as n from g group by 1
""")
def q_locality(t):
    """Place of a text by the first name, in order, that it holds."""
    return t.documents.where("text is not null").groupBy(F.coalesce(text.locality(F.col("text"), NAMED), F.lit("elsewhere")).alias("place")).agg(n())


@query("select count(*) as rows, sum(('0x' || substr(md5(concat_ws('|', o_orderkey::varchar, o_custkey::varchar, o_orderstatus, o_orderpriority)), 1, 8))::bigint)::bigint as digest from orders")
def q_fingerprint_md5(t):
    """A content check that other engines can repeat."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return agg.portable_fingerprint(o)


@query()
def q_model_walk_forward(t):
    """Two settings of 300 trees over expanding years; the threshold is fitted anew on each fold's past."""
    grid = {"shallow": models.gbt(TARGET, depth=4), "deeper": models.gbt(TARGET)}
    return rounded(models.walk_forward(model_rows(t, F.col("year").isin(1995, 1996, 1997)), "year", [1995, 1996, 1997], FEATURES, TARGET, grid, 63.0, 0.5))


@query()
def q_model_added_family(t):
    """What a family of features adds, by line and by order, in the year of validation and the one after."""
    rows = model_rows(t, F.col("year") <= 1998)
    base = [c for c in FEATURES if c not in ("l_tax", "pri")]
    years = {"validation": rows.where("year = 1997"), "confirmation": rows.where("year = 1998")}
    return rounded(models.added_family(rows.where("year <= 1996"), years, base, ["l_tax", "pri"], TARGET, 63.0, ["l_orderkey"], models.gbt(TARGET, **SMALL)))



MODEL = """
m as (select l_orderkey, l_suppkey % 2 = 0 as low, year(o_orderdate)::int as year, month(o_orderdate)::int as month, o_custkey, l_quantity, case when l_linenumber % 5 <> 0 then l_tax end as l_tax, l_extendedprice / 1000 as y from lineitem join orders on l_orderkey = o_orderkey),
tr as (select * from m where year in (1995, 1996, 1997) and o_custkey not in (1, 2))
"""


@query(f"""
with {MODEL} select 'train' as part, (case when low then 'low' else 'high' end) as segment, year, count(*) as n, count(l_tax) as taxed, round(avg((y > 63)::int), 6) as prevalence, count(*) filter (y > 63) * 4 + count(*) as weight from tr group by all
union all select 'test', (case when low then 'low' else 'high' end), year, count(*), count(l_tax), round(avg((y > 63)::int), 6), count(*) filter (y > 63) * 4 + count(*) from m where year = 1998 group by all
""")
def q_model_split(t):
    """What the models learn from and are tested on: rows, missing values, prevalence and weights by segment and year."""
    train, test = halves(t)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.withColumn("w", models.above_weight(TARGET, 63.0, 5.0)).groupBy("part", "segment", "year").agg(
        n(), F.count("l_tax").alias("taxed"), F.round(F.avg((F.col(TARGET) > 63).cast("double")), 6).alias("prevalence"), F.sum("w").cast("bigint").alias("weight")
    )


@query(f"""
with {MODEL}, f as (select low, regr_slope(y, l_quantity) as b, regr_intercept(y, l_quantity) as a from tr group by low), p as (select low, y, a + b * l_quantity as p from m join f using (low) where year = 1998)
select case when low then 'low' else 'high' end as segment, count(*) as n, round(1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) as r2, round(avg(abs(p - y)), 5) as mae from p group by low
""")
def q_model_linear(t):
    """An unpenalised linear model of one feature for each segment, routed at scoring: least squares have a closed form."""
    train, test = halves(t)
    fitted = {s: models.ridge(train.where(F.col("segment") == s), ["l_quantity"], TARGET, 0.0) for s in ("low", "high")}
    scored = models.score_segments(fitted, test, "segment", ["l_quantity"])
    return scored.groupBy("segment").agg(*agg.regression(F.col(TARGET), F.col("pred"), 63.0)).select("segment", "n", F.round("r2", 6).alias("r2"), F.round("mae", 5).alias("mae"))


@query(f"""
with {MODEL}, tr2 as (select *, coalesce(l_tax, 0.04) as l_tax2 from tr), s as (select count(*) as n, avg(l_quantity) as m1, avg(l_tax2) as m2, avg(y) as my, stddev_pop(l_quantity) as s1, stddev_pop(l_tax2) as s2, covar_pop(l_quantity, l_tax2) as c12, covar_pop(l_quantity, y) as c1, covar_pop(l_tax2, y) as c2 from tr2),
a as (select *, n + penalty as d, n * c12 / (s1 * s2) as o, n * c1 / s1 as b1, n * c2 / s2 as b2 from s, (values (0.1::double), (10.0), (1000.0), (100000.0)) v(penalty)),
w as (select *, (d * b1 - o * b2) / (d * d - o * o) as w1, (d * b2 - o * b1) / (d * d - o * o) as w2 from a),
p as (select penalty, w1, w2, my - w1 * m1 / s1 - w2 * m2 / s2 as w0, y, my + w1 * (l_quantity - m1) / s1 + w2 * (l_tax2 - m2) / s2 as p from (select *, coalesce(l_tax, 0.04) as l_tax2 from m) m, w where year = 1998)
select penalty, round(w1, 5) as w1, round(w2, 5) as w2, round(w0, 5) as w0, count(*) as n, round(1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) as r2, round(avg(abs(p - y)), 5) as mae from p group by all
""")
def q_model_penalties(t):
    """A sweep of penalties from one pass: two scaled features have a closed form."""
    filled = lambda df: df.withColumn("l_tax2", F.coalesce("l_tax", F.lit(0.04)))
    train, test = map(filled, halves(t))
    model = tuning.ridge_sweep(train, ["l_quantity", "l_tax2"], TARGET, [0.1, 10.0, 1000.0, 100000.0])
    weights = t.spark.createDataFrame([(p, round(float(w[0]), 5), round(float(w[1]), 5), round(model.intercept(p), 5)) for p, w in model.weights.items()], "penalty double, w1 double, w2 double, w0 double")
    found = tuning.ridge_metrics(model, test.select("l_quantity", "l_tax2", TARGET), TARGET)
    return weights.join(found, "penalty").select("penalty", "w1", "w2", "w0", "n", F.round("r2", 6).alias("r2"), F.round("mae", 5).alias("mae"))
