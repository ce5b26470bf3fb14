"""Queries over aggregates, decisions, tests and guards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import casts
from ..functions.storage import stored
from ..operators import aggregates as agg
from ..operators import decision, inference, joins, quality, wide, windows
from .calendar_and_joins import dated_orders
from .registry import query

def n():
    return F.count("*").alias("n")

TRIPS = """
legs as (select o_orderdate::date as day, l_orderkey as trip, o_orderpriority as pri, o_orderstatus as st, l_extendedprice / 1000 as pred, l_quantity * 2 as load, l_discount * 1000 as booked from lineitem join orders on l_orderkey = o_orderkey),
trips as (select day, trip, pri, st, round(max(pred), 6) as score, max(load) as load, count(*) as legs, bool_or(load > 90) as label, max(booked) as booked from legs group by all)
"""


def leg_rows(t):
    o = t.orders.select(F.col("o_orderkey").alias("trip"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("pri"), F.col("o_orderstatus").alias("st"), "o_custkey")
    lines = t.lineitem.select(F.col("l_orderkey").alias("trip"), (F.col("l_extendedprice") / 1000).alias("pred"), (F.col("l_quantity") * 2).alias("load"), (F.col("l_discount") * 1000).alias("booked"), "l_suppkey", "l_linenumber")
    count = t.lineitem.count()  # from the files' footers
    return joins.dealt(lines, ["trip"], count).join(joins.dealt(o, ["trip"], count), "trip")


def trip_rows(t):
    return decision.trips(leg_rows(t), ["day", "trip", "pri", "st"], "pred", "load", "booked", 90.0).withColumn("score", F.round("score", 6))


@query(f"""with {TRIPS} select case when load >= 166 then 'high' when load >= 94 then 'mid' when load >= 63 then 'low' end as band, label, count(*) as n, sum(legs)::bigint as legs, round(avg(score), 4) as score from trips group by all""")
def q_trip_agg(t):
    band = casts.band(F.col("load"), [63, 94, 166], ["low", "mid", "high"])
    return trip_rows(t).groupBy(band.alias("band"), "label").agg(n(), F.sum("legs").alias("legs"), F.round(F.avg("score"), 4).alias("score"))


@query("""
with d as (select l_orderkey, l_returnflag as rf, date_diff('day', o_orderdate, l_shipdate) as d, l_returnflag = 'R' as cancelled, l_linestatus = 'O' as extra, year(o_orderdate)::int as y from lineitem join orders on l_orderkey = o_orderkey),
o as (select y, l_orderkey, bool_and(cancelled) as gone, bool_or(extra) as extra from d group by all),
a as (select y, count(*) as trips, count(*) filter (gone) as cancelled, count(*) filter (extra) as extra from o group by y),
b as (select y, round(avg((abs(d) <= 60)::int), 6) as two_60, round(avg((d <= 60)::int), 6) as one_60, round(avg((abs(d) <= 300)::int), 6) as two_300, round(avg((d <= 300)::int), 6) as one_300 from d where not cancelled group by y)
select y, trips, cancelled, extra, round((trips - cancelled) / trips::double, 6) as realised, two_60, one_60, two_300, one_300 from a full join b using (y)
""")
def q_punctual(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", F.year("o_orderdate").alias("y"))
    d = t.lineitem.select("l_orderkey", "l_shipdate", (F.col("l_returnflag") == "R").alias("cancelled"), (F.col("l_linestatus") == "O").alias("extra")).join(o, "l_orderkey").withColumn("d", F.datediff("l_shipdate", "o_orderdate"))
    trips = d.groupBy("y", "l_orderkey").agg(F.bool_and("cancelled").alias("gone"), F.bool_or("extra").alias("extra"))
    a = trips.groupBy("y").agg(F.count(F.lit(1)).alias("trips"), F.count_if("gone").alias("cancelled"), F.count_if("extra").alias("extra"))
    part = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    b = d.where("not cancelled").groupBy("y").agg(*(part(c <= s).alias(f"{k}_{s}") for s in (60, 300) for k, c in (("two", F.abs("d")), ("one", F.col("d")))))
    return a.join(b, "y", "full").withColumn("realised", F.round((F.col("trips") - F.col("cancelled")) / F.col("trips"), 6))


@query("""
select l_suppkey, round(sum(l_quantity), 2) as total, round(coalesce(sum(l_quantity) filter (l_returnflag = 'A'), 0) / sum(l_quantity), 6) as share_a, round(coalesce(sum(l_quantity) filter (l_returnflag = 'N'), 0) / sum(l_quantity), 6) as share_n,
  round(coalesce(sum(l_quantity) filter (l_returnflag = 'R'), 0) / sum(l_quantity), 6) as share_r, round(coalesce(sum(l_quantity) filter (l_linenumber = 1), 0) / sum(l_quantity), 6) as share_first from lineitem group by l_suppkey
""")
def q_share_pivot(t):
    q = F.col("l_quantity")
    part = lambda c: F.round(casts.share(F.coalesce(F.sum(F.when(c, q)), F.lit(0.0)), F.sum(q)), 6)
    flags = [part(F.col("l_returnflag") == f).alias(f"share_{f.lower()}") for f in "ANR"]
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum(q), 2).alias("total"), *flags, part(F.col("l_linenumber") == 1).alias("share_first"))


@query("""
with b as (select o_orderdate::date as day, o_orderpriority as pri, round(sum(o_totalprice), 2) as total, max(o_totalprice) as most, count(distinct o_custkey) as customers, count(distinct o_custkey % 7) as countries, round(avg((o_custkey % 11 = 0)::int), 6) as school
  from orders where o_totalprice > 200000 group by all), g as (select distinct o_orderdate::date as day, o_orderpriority as pri from orders)
select day, pri, coalesce(total, 0) as total, coalesce(most, 0) as most, coalesce(customers, 0) as customers, coalesce(countries, 0) as countries, coalesce(school, 0) as school, total is not null as booked from g left join b using (day, pri)
""")
def q_booking_grain(t):
    o = dated_orders(t).withColumnRenamed("o_orderpriority", "pri")
    b = o.where("o_totalprice > 200000").groupBy("day", "pri").agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_totalprice").alias("most"), F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.col("o_custkey") % 7).alias("countries"),
        F.round(F.avg((F.col("o_custkey") % 11 == 0).cast("double")), 6).alias("school"), F.lit(True).alias("booked"),
    )
    return o.select("day", "pri").distinct().join(b, ["day", "pri"], "left").fillna({"total": 0.0, "most": 0.0, "customers": 0, "countries": 0, "school": 0.0, "booked": False})


@query("""
with c as (select l_orderkey, list_sort(list_distinct(list(l_suppkey) filter (l_quantity > 25))) as units, count(*) filter (l_quantity > 25) as every from lineitem group by 1),
x as (select l_orderkey, coalesce(len(units), 0) as k, units, coalesce(len(units), 0) <> every as twice from c), v as (select unnest(units) as veh, k >= 2 as coupled, l_orderkey from x)
select veh, count(*) as trips, count(*) filter (coupled) as coupled, bool_or(coupled) as any_coupled, (select count(*) from x where twice) as orders_with_twins, (select count(*) from x where k = 0) as empty_sets from v group by veh
""")
def q_set_composition(t):
    unit = F.when(F.col("l_quantity") > 25, F.col("l_suppkey"))
    c = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(unit)).alias("units"), F.count(unit).alias("every"))
    c = c.withColumn("coupled", F.size("units") >= 2)
    totals = c.agg(F.count_if(F.size("units") != F.col("every")).alias("orders_with_twins"), F.count_if(F.size("units") == 0).alias("empty_sets"))
    tours = c.select("coupled", F.explode("units").alias("veh")).groupBy("veh").agg(F.count(F.lit(1)).alias("trips"), F.count_if("coupled").alias("coupled"), F.bool_or("coupled").alias("any_coupled"))
    return tours.crossJoin(F.broadcast(totals))  # one row


@query(f"""
with {TRIPS}, r as (select *, case rule when 'score' then score > 80 when 'floor' then booked > 90 else score > 80 or booked > 90 end as reco from trips, (values ('score'), ('floor'), ('either')) v(rule))
select rule, pri, st, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0)::double, 6) as precision, round(tp / nullif(tp + fn, 0)::double, 6) as recall from (
  select rule, pri, st, count(*) filter (reco and label) as tp, count(*) filter (reco and not label) as fp, count(*) filter (not reco and label) as fn, count(*) filter (not reco and not label) as tn from r group by grouping sets ((rule), (rule, pri), (rule, st), (rule, pri, st)))
""")
def q_confusion_slices(t):
    rules = {"score": F.col("score") > 80, "floor": F.col("booked") > 90, "either": (F.col("score") > 80) | (F.col("booked") > 90)}
    out = decision.evaluated(trip_rows(t), rules, "label", [[], ["pri"], ["st"], ["pri", "st"]])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(f"""
with {TRIPS}, s as (select st, pri, load as y, score as p from trips)
select st, pri, n, round(1 - sse / nullif(syy - sy * sy / n, 0), 5) as r2, round(mae, 5) as mae, round(rmse, 5) as rmse, round(mae_above, 5) as mae_above, round(bias_above, 5) as bias_above, round(prevalence, 6) as prevalence from (
 select st, pri, count(*) as n, sum((p - y) * (p - y)) as sse, sum(y * y) as syy, sum(y) as sy, avg(abs(p - y)) as mae, sqrt(avg((p - y) * (p - y))) as rmse, avg(abs(p - y)) filter (y > 63) as mae_above, avg(p - y) filter (y > 63) as bias_above, avg((y > 63)::int) as prevalence
 from s group by grouping sets ((), (st), (pri)))
""")
def q_regression_slices(t):
    s = trip_rows(t).withColumnsRenamed({"load": "y", "score": "p"})
    out = s.groupingSets([[], [F.col("st")], [F.col("pri")]], F.col("st"), F.col("pri")).agg(*agg.regression(F.col("y"), F.col("p"), 63.0))
    return out.withColumns({c: F.round(c, 5) for c in ("r2", "mae", "rmse", "mae_above", "bias_above")} | {"prevalence": F.round("prevalence", 6)})


CURVE = """
pts as (select floor(score) as s, count(*) filter (label) as h, count(*) as r from trips group by 1),
cur as (select s, h, sum(h) over (order by s desc) as hits, sum(r) over (order by s desc) as n, (select count(*) from trips where label) as total from pts)
"""


@query(f"with {TRIPS}, {CURVE} select s::double as score, hits::bigint as hits, n::bigint as n, round(hits / n::double, 8) as precision, round(hits / total::double, 8) as recall from cur")
def q_pr_curve(t):
    c = agg.pr_curve(trip_rows(t).withColumn("score", F.floor("score")), "score", "label")
    return c.select("score", "hits", F.col("rows").alias("n"), F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


@query(f"with {TRIPS}, {CURVE} select round(sum(hits / n::double * h / total::double), 8) as ap from cur")
def q_ap(t):
    c = agg.pr_curve(trip_rows(t).withColumn("score", F.floor("score")), "score", "label")
    return agg.average_precision(c).select(F.round("ap", 8).alias("ap"))


@query(f"""
with {TRIPS}, cal as (select floor(score) as score, label from trips where year(day) = 1997), tst as (select *, floor(score) as fs from trips where year(day) = 1998),
pts as (select score as s, count(*) filter (label) as h, count(*) as r from cal group by 1), cur as (select s, sum(h) over (order by s desc) as hits, sum(r) over (order by s desc) as n, (select count(*) from cal where label) as total from pts),
pr as (select s, hits / n::double as p, hits / total::double as r, n from cur),
th as (select 'iso' as rule, max(s) as threshold from cur where n >= 100
  union all select 'f2', arg_max(s, (round(5 * p * r / (4 * p + r + 1e-12), 12), -s)) from pr union all select 'f05', arg_max(s, (round(1.25 * p * r / (0.25 * p + r + 1e-12), 12), -s)) from pr)
select rule, threshold::double as threshold, count(*) filter (fs >= threshold) as volume, count(*) filter (fs >= threshold and label) as hits, count(*) filter (fs >= threshold or booked > 95) as with_floor, count(*) filter (fs >= threshold and booked > 95) as both from th, tst group by all
""")
def q_threshold_menu(t):
    """Thresholds from one year's curve, a row each, applied to the next year."""
    rows = trip_rows(t).withColumn("score", F.floor("score")).withColumn("y", F.year("day"))
    curve, test = agg.pr_curve(rows.where("y = 1997"), "score", "label"), rows.where("y = 1998")
    menu = decision.at_volume(curve, 100).select(F.lit("iso").alias("rule"), "threshold")
    for name, beta in (("f2", 2.0), ("f05", 0.5)):
        menu = menu.unionByName(decision.at_fbeta(curve, beta).select(F.lit(name).alias("rule"), "threshold"))
    over = F.col("score") >= F.col("threshold")
    return test.crossJoin(F.broadcast(menu)).groupBy("rule", "threshold").agg(  # three thresholds
        F.count_if(over).alias("volume"), F.count_if(over & F.col("label")).alias("hits"), F.count_if(over | (F.col("booked") > 95)).alias("with_floor"), F.count_if(over & (F.col("booked") > 95)).alias("both")
    )


@query(f"""
with {TRIPS}, th as (select pri, max(s) as threshold from (select pri, floor(score) as s, sum(count(*)) over (partition by pri order by floor(score) desc) as n from trips where year(day) = 1997 group by 1, 2) where n >= 30 group by pri),
j as (select trips.*, floor(score) >= threshold as reco, floor(score) >= 85 as uniform from trips join th using (pri) where year(day) = 1998)
select pri, count(*) as n, count(*) filter (reco) as policy, count(*) filter (uniform) as uniform, count(*) filter (reco and label) as hits, count(*) filter (reco and not uniform) as only_policy, count(*) filter (reco and uniform) as both from j group by pri
""")
def q_policy_by_type(t):
    """A threshold for each class, joined as a small table."""
    rows = trip_rows(t).withColumn("s", F.floor("score"))
    cal = rows.where(F.year("day") == 1997).groupBy("pri", "s").agg(n())
    down = Window.partitionBy("pri").orderBy(F.desc("s"))
    th = cal.withColumn("n", F.sum("n").over(down)).where("n >= 30").groupBy("pri").agg(F.max("s").alias("threshold"))
    j = rows.where(F.year("day") == 1998).join(joins.small(th), "pri").withColumns({"reco": F.col("s") >= F.col("threshold"), "uniform": F.col("s") >= 85})
    return j.groupBy("pri").agg(n(), F.count_if("reco").alias("policy"), F.count_if("uniform").alias("uniform"), F.count_if(F.col("reco") & F.col("label")).alias("hits"), F.count_if(F.col("reco") & ~F.col("uniform")).alias("only_policy"), F.count_if(F.col("reco") & F.col("uniform")).alias("both"))


@query("""
select l_linenumber, count(*) as n, round(avg(l_quantity), 5) as mean, round(stddev_pop(l_extendedprice), 3) as std, round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.9), 4) as p90, round(quantile_cont(l_extendedprice, 0.95), 4) as p95, round(quantile_cont(l_extendedprice, 0.99), 4) as p99, max(l_extendedprice) as most
from lineitem group by l_linenumber
""")
def q_profile_percentiles(t):
    p = agg.exact_percentiles(t.lineitem.select("l_linenumber", "l_extendedprice"), ["l_linenumber"], "l_extendedprice")
    rest = t.lineitem.groupBy("l_linenumber").agg(n(), F.round(F.avg("l_quantity"), 5).alias("mean"), F.round(F.stddev_pop("l_extendedprice"), 3).alias("std"), F.max("l_extendedprice").alias("most"))
    return rest.join(p.select("l_linenumber", *(F.round(c, 4).alias(c) for c in ("p50", "p90", "p95", "p99"))), "l_linenumber")


@query("""
select month(o_orderdate)::int as month, round(avg(o_totalprice) filter (year(o_orderdate) = 1995), 3) as y1995, round(avg(o_totalprice) filter (year(o_orderdate) = 1996), 3) as y1996, round(avg(o_totalprice) filter (year(o_orderdate) = 1997), 3) as y1997, round(avg(o_totalprice) filter (year(o_orderdate) = 1998), 3) as y1998, round(avg(o_totalprice) filter (year(o_orderdate) = 1999), 3) as y1999, round(avg(o_totalprice) filter (year(o_orderdate) = 2000), 3) as y2000, round(avg(o_totalprice) filter (year(o_orderdate) = 2001), 3) as y2001 from orders group by 1
""")
def q_month_matrix(t):
    rows = t.orders.select(F.month("o_orderdate").alias("month"), F.concat(F.lit("y"), F.year("o_orderdate").cast("string")).alias("y"), "o_totalprice")
    return agg.matrix(rows, "month", "y", [f"y{y}" for y in range(1995, 2002)], F.round(F.avg("o_totalprice"), 3))


@query("""
with d as (select l_quantity as a, l_extendedprice as b, case when l_linenumber > 2 then l_discount end as c, l_quantity as d from lineitem),
p as (select 'a' as one, 'b' as two, corr(a, b) as r, count(*) filter (a is not null and b is not null) as n, count(*) filter (a is not distinct from b) as same from d union all select 'a', 'c', corr(a, c), count(*) filter (a is not null and c is not null), count(*) filter (a is not distinct from c) from d
 union all select 'a', 'd', corr(a, d), count(*), count(*) filter (a is not distinct from d) from d union all select 'b', 'c', corr(b, c), count(*) filter (c is not null), count(*) filter (b is not distinct from c) from d
 union all select 'b', 'd', corr(b, d), count(*), count(*) filter (b is not distinct from d) from d union all select 'c', 'd', corr(c, d), count(*) filter (c is not null), count(*) filter (c is not distinct from d) from d)
select one, two, round(r, 6) as r, n, same from p
""")
def q_corr(t):
    d = t.lineitem.select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), F.when(F.col("l_linenumber") > 2, F.col("l_discount")).alias("c"), F.col("l_quantity").alias("d"))
    return wide.correlations(d, ["a", "b", "c", "d"], equal=True).drop("duplicate").withColumn("r", F.round("r", 6))


@query("""
with p as (select p_partkey as k, sum(round(l_discount * 100)::bigint) filter (year(l_shipdate) <= 1997)::bigint as a, sum(round(l_discount * 100)::bigint) filter (year(l_shipdate) > 1997)::bigint as b, count(*) as w from lineitem join part on l_partkey = p_partkey group by 1 having count(*) filter (year(l_shipdate) <= 1997) > 0 and count(*) filter (year(l_shipdate) > 1997) > 0),
r as (select *, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from p)
select count(*) as n, round(corr(ra, rb), 6) as spearman, round(avg(abs(a - b)), 6) as mae,
 round((sum(w * a * b) / sum(w) - sum(w * a) / sum(w) * sum(w * b) / sum(w)) / sqrt((sum(w * a * a) / sum(w) - pow(sum(w * a) / sum(w), 2)) * (sum(w * b * b) / sum(w) - pow(sum(w * b) / sum(w), 2))), 5) as weighted from r
""")
def q_vintage_corr(t):
    """Ranks over a profile of one row for each part, by counts of its values: no window over all parts."""
    y = F.year("l_shipdate")
    total = lambda c: F.sum(F.when(c, F.round(F.col("l_discount") * 100).cast("bigint")))
    p = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey").groupBy("l_partkey").agg(total(y <= 1997).alias("a"), total(y > 1997).alias("b"), F.count(F.lit(1)).alias("w")).where("a is not null and b is not null")
    r = stored(p.withColumn("g", F.lit(0)))
    r = windows.rank_share(windows.rank_share(r, ["g"], "a", "ra"), ["g"], "b", "rb")  # ranks over the number of rows: the same correlation
    return r.agg(n(), F.round(F.corr("ra", "rb"), 6).alias("spearman"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mae"), F.round(agg.weighted_corr(F.col("a"), F.col("b"), F.col("w")), 5).alias("weighted"))


@query("""
with p as (select round(value, 1) as v, count(*) filter (event_type = 'click') as a, count(*) filter (event_type = 'purchase') as b from events where event_type in ('click', 'purchase') group by 1),
c as (select sum(a) over (order by v) / (sum(a) over ())::double as fa, sum(b) over (order by v) / (sum(b) over ())::double as fb from p) select round(max(abs(fa - fb)), 8) as ks from c
""")
def q_ks(t):
    """Both directions of accumulation give the same largest difference."""
    return agg.ks(t.events.withColumn("v", F.round("value", 1)), "v", "event_type", "click", "purchase").select(F.round("ks", 8).alias("ks"))


@query("""
with c as (select event_type, hour(ts)::int as h, count(*) as n from events group by all), s as (select *, n / sum(n) over (partition by event_type)::double as p, count(*) over (partition by event_type) as k, row_number() over (partition by event_type order by n, h) as up, row_number() over (partition by event_type order by n desc, h) as down from c)
select event_type, round(max(p), 6) as peak, round(sum(p) filter (down <= 3), 6) as top3, round(sum(-p * ln(p)) / ln(max(k)), 6) as entropy, round(sum((2 * up - k - 1) * p) / max(k), 6) as gini from s group by event_type
""")
def q_concentration(t):
    out = agg.concentration(t.events.withColumn("h", F.hour("ts")), ["event_type"], "h")
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("peak", "top3", "entropy", "gini")))


@query("""
with c as (select o_orderpriority as pri, count(*) filter (a and b) as n11, count(*) filter (a and not b) as n10, count(*) filter (not a and b) as n01, count(*) filter (not a and not b) as n00 from (select *, o_totalprice > 250000 as a, o_custkey % 3 = 0 as b from orders) group by 1),
d as (select *, (n11 + n10 + n01 + n00)::double as n from c), e as (select *, (n11 + n00) / n as po, (n11 + n10) / n * ((n11 + n01) / n) + (n01 + n00) / n * ((n10 + n00) / n) as pe from d)
select pri, n11, n10, n01, n00, round((n10 + n01) / n, 6) as discordance, round((po - pe) / (1 - pe), 6) as kappa, round(n11 / (n11 + n10 + n01)::double, 6) as jaccard from e
""")
def q_kappa(t):
    out = t.orders.groupBy(F.col("o_orderpriority").alias("pri")).agg(*agg.agreement(F.col("o_totalprice") > 250000, F.col("o_custkey") % 3 == 0))
    return out.withColumns({c: F.round(c, 6) for c in ("discordance", "kappa", "jaccard")})


@query("""
with c as (select count(*) filter (a and not b) as b_, count(*) filter (not a and b) as c_, count(*) filter (a) as x1, count(*) filter (b) as x2, count(*) as n from (select o_totalprice > 250000 as a, o_custkey % 3 <> 0 as b from orders))
select round(pow(greatest(abs(b_ - c_) - 1, 0), 2) / (b_ + c_), 4) as mcnemar, round((x1 / n::double - x2 / n::double) / sqrt((x1 + x2) / (2.0 * n) * (1 - (x1 + x2) / (2.0 * n)) * (2.0 / n)), 5) as z, round(2 * asin(sqrt(x1 / n::double)) - 2 * asin(sqrt(x2 / n::double)), 6) as h from c
""")
def q_mcnemar(t):
    a, b = F.col("o_totalprice") > 250000, F.col("o_custkey") % 3 != 0
    c = t.orders.agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"), F.count_if(a).alias("x1"), F.count_if(b).alias("x2"), n())
    z, h = inference.two_proportions(F.col("x1"), F.col("n"), F.col("x2"), F.col("n"))
    return c.select(F.round(inference.mcnemar(F.col("b"), F.col("c")), 4).alias("mcnemar"), F.round(z, 5).alias("z"), F.round(h, 6).alias("h"))


@query("""
with o as (select o_orderkey::varchar as o_orderkey, o_orderstatus, case when o_custkey % 5 > 0 then o_orderpriority end as pri, o_custkey from orders)
select 'o_orderkey' as "column", count(*) as rows, count(*) - count(o_orderkey) as nulls, count(distinct o_orderkey) as "distinct", min(o_orderkey) as low, max(o_orderkey) as high from o
union all select 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(distinct o_orderstatus), min(o_orderstatus), max(o_orderstatus) from o
union all select 'pri', count(*), count(*) - count(pri), count(distinct pri), min(pri), max(pri) from o union all select 'o_custkey', count(*), count(*) - count(o_custkey), count(distinct o_custkey), min(o_custkey)::varchar, max(o_custkey)::varchar from o
""")
def q_codebook(t):
    o = t.orders.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus", F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderpriority")).alias("pri"), "o_custkey")
    return wide.codebook(o).drop("kind")


@query("""
with g as (select l_orderkey, count(distinct l_linestatus) as a, max((l_linestatus is null)::int) as an, count(distinct case when l_linenumber > 1 then l_returnflag end) as b, max((not (l_linenumber > 1))::int) as bn from lineitem group by 1)
select 'l_linestatus' as "column", count(*) as groups, count(*) filter (a + an <= 1) as constant, count(*) filter (a <= 1) as constant_known from g union all select 'rf', count(*), count(*) filter (b + bn <= 1), count(*) filter (b <= 1) from g
""")
def q_constant_cols(t):
    l = t.lineitem.withColumn("rf", F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")))  # noqa: E741
    return wide.constant_shares(l, ["l_orderkey"], ["l_linestatus", "rf"])


@query()
def q_fingerprint(t):
    return agg.fingerprint(t.lineitem).unionByName(agg.fingerprint(t.orders))


@query("""
with r as (select month(o_orderdate)::int as month, o_orderstatus as st, count(*) as n, avg((o_totalprice > 400000)::int) as rate, avg(case when o_totalprice > 400000 then o_totalprice - 400000 end) as excess from orders group by all)
select month, st, n, round(rate, 6) as rate, round(rate / (sum(rate * n) over () / sum(n) over ()), 5) as lift, round(excess, 3) as excess from r
""")
def q_rate_lift(t):
    over = F.col("o_totalprice") > 400000
    r = t.orders.groupBy(F.month("o_orderdate").alias("month"), F.col("o_orderstatus").alias("st")).agg(n(), F.avg(over.cast("double")).alias("rate"), F.round(F.avg(F.when(over, F.col("o_totalprice") - 400000)), 3).alias("excess"))
    total = t.orders.agg(F.avg(over.cast("double")).alias("all"))
    return r.crossJoin(F.broadcast(total)).select("month", "st", "n", F.round("rate", 6).alias("rate"), F.round(F.col("rate") / F.col("all"), 5).alias("lift"), "excess")  # one row


@query(f"""
with {TRIPS}, b as (select (case when load >= 94 then '94' when load >= 80 then '80' when load >= 63 then '63' end) as band, year(day)::int as y, load - 63 as ex, booked > 90 as bk, score - load as res from trips where load >= 63)
select band, y, count(*) as n, round(quantile_cont(ex, 0.5), 4) as p50, round(quantile_cont(ex, 0.9), 4) as p90, round(avg(bk::int), 6) as booked, round(avg(res), 4) as bias, round(avg(abs(res)), 4) as mae from b group by all
""")
def q_severity(t):
    b = trip_rows(t).where("load >= 63").select(casts.band(F.col("load"), [63, 80, 94], ["63", "80", "94"]).alias("band"), F.year("day").alias("y"), (F.col("load") - 63).alias("ex"), (F.col("booked") > 90).alias("bk"), (F.col("score") - F.col("load")).alias("res"))
    p = agg.exact_percentiles(b, ["band", "y"], "ex", (0.5, 0.9)).select("band", "y", F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"))
    rest = b.groupBy("band", "y").agg(n(), F.round(F.avg(F.col("bk").cast("double")), 6).alias("booked"), F.round(F.avg("res"), 4).alias("bias"), F.round(F.avg(F.abs("res")), 4).alias("mae"))
    return rest.join(p, ["band", "y"])


@query("""
with d as (select ts::date as day, hour(ts)::int as h, count(distinct user_id) as u from events group by all) select h, count(*) as days, round(avg(u), 6) as mean_users, round(max(u), 6)::bigint as most from d group by h
""")
def q_supply_rate(t):
    d = t.events.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("h")).agg(F.count_distinct("user_id").alias("u"))
    return d.groupBy("h").agg(F.count(F.lit(1)).alias("days"), F.round(F.avg("u"), 6).alias("mean_users"), F.max("u").alias("most"))


@query("""
select l_suppkey, round(sum(l_discount * w) / sum(w), 7) as weighted, count(w) as used from (select l_suppkey, l_discount, case when l_discount is not null and l_quantity > 10 then l_quantity - 10 end as w from lineitem) group by 1
""")
def q_weighted_share(t):
    w = F.col("l_quantity") - 10
    return t.lineitem.groupBy("l_suppkey").agg(F.round(agg.weighted_mean(F.col("l_discount"), w), 7).alias("weighted"), F.count(F.when(w > 0, 1)).alias("used"))


@query("""
with d as (select distinct c_mktsegment as seg, o_orderdate::date as day from orders join customer on o_custkey = c_custkey), l as (select *, lead(day) over (partition by seg order by day) as nxt from d)
select seg, day + 1 as gap_from, nxt - 1 as gap_to, (nxt - day - 1)::int as missing from l where nxt - day > 1
""")
def q_coverage_gaps(t):
    seg = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg"))
    return agg.gaps(dated_orders(t).select("o_custkey", "day").join(seg, "o_custkey"), ["seg"], "day")


@query("""
with d as (select ts::date as day, count(*) filter (event_type = 'error') % 2 = 0 as a, count(*) filter (event_type = 'signup') % 3 > 0 as b, isodow(ts::date) < 6 as wk from events group by 1, 4)
select 'all' as days, round(corr(a::int, b::int), 6) as phi, round(count(*) filter (a and b) / count(*) filter (a or b)::double, 6) as jaccard, count(*) as n from d
union all select 'weekdays', round(corr(a::int, b::int), 6), round(count(*) filter (a and b) / count(*) filter (a or b)::double, 6), count(*) from d where wk
""")
def q_calendar_similarity(t):
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg((count("error") % 2 == 0).alias("a"), (count("signup") % 3 > 0).alias("b"))
    d = d.withColumn("days", F.explode(F.when(F.weekday("day") < 5, F.array(F.lit("all"), F.lit("weekdays"))).otherwise(F.array(F.lit("all")))))
    jac = F.try_divide(F.count_if(F.col("a") & F.col("b")).cast("double"), F.count_if(F.col("a") | F.col("b")))
    return d.groupBy("days").agg(F.round(F.corr(F.col("a").cast("double"), F.col("b").cast("double")), 6).alias("phi"), F.round(jac, 6).alias("jaccard"), n())


@query("""
with m as (select o_custkey % 5 as seed, o_orderstatus as seg, round(avg(o_totalprice) filter (o_orderkey % 2 = 0), 4) as a, round(avg(o_totalprice) filter (o_orderkey % 2 = 1), 4) as b from orders group by all)
select seg, count(*) as seeds, round(avg(a - b), 3) as mean_delta, round(stddev_samp(a - b), 3) as sd, round(min(a - b), 3) as least, round(max(a - b), 3) as most, bool_and(a > b) as always from m group by seg
""")
def q_paired_delta(t):
    part = lambda k: F.round(F.avg(F.when(F.col("o_orderkey") % 2 == k, F.col("o_totalprice"))), 4)
    m = t.orders.groupBy((F.col("o_custkey") % 5).alias("seed"), F.col("o_orderstatus").alias("seg")).agg(part(0).alias("a"), part(1).alias("b")).withColumn("d", F.col("a") - F.col("b"))
    return m.groupBy("seg").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("d"), 3).alias("mean_delta"), F.round(F.stddev_samp("d"), 3).alias("sd"), F.round(F.min("d"), 3).alias("least"), F.round(F.max("d"), 3).alias("most"), F.bool_and(F.col("a") > F.col("b")).alias("always"))


@query("""
with d as (select l_suppkey as s, l_shipdate::date as day, count(distinct l_orderkey) as runs from lineitem group by all), f as (select s, round(avg(runs), 1) as freq, count(*) as days from d group by s),
p as (select l_suppkey as s, min(l_quantity) as nearest, count(*) filter (l_quantity < 5) as near_hub, string_agg(distinct l_returnflag, '|' order by l_returnflag) as names, count(*) filter (l_tax > 0.06) as odd, count(*) as n, round(avg(l_extendedprice) filter (l_discount > 0.02), 4) as centre from lineitem group by 1)
select p.s, nearest, near_hub, names, n, freq, days, centre, odd / n::double > 0.2 as doubtful from p join f using (s)
""")
def q_line_profile(t):
    runs = t.lineitem.groupBy(F.col("l_suppkey").alias("s"), F.to_date("l_shipdate").alias("day")).agg(F.count_distinct("l_orderkey").alias("runs"))
    freq = runs.groupBy("s").agg(F.round(F.avg("runs"), 1).alias("freq"), F.count(F.lit(1)).alias("days"))
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("s")).agg(
        F.min("l_quantity").alias("nearest"), F.count_if(F.col("l_quantity") < 5).alias("near_hub"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("names"), n(), F.round(F.avg(F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice"))), 4).alias("centre"), (F.count_if(F.col("l_tax") > 0.06) / F.count(F.lit(1)) > 0.2).alias("doubtful")
    )
    return p.join(freq, "s")


@query(f"""
with {TRIPS}, s as (select st, year(day)::int as y, sum(load) as v, sum(case when score > 80 and not label then legs * 13.2::double * 0.4::double else 0 end) as cost, count(*) filter (score > 80 and not label) as fp from trips group by grouping sets ((), (st), (y), (st, y)))
select st, y, round(v / (select sum(load) from trips), 6) as share, fp, round(cost, 3) as cost from s
""")
def q_share_slices(t):
    rows = trip_rows(t).withColumn("y", F.year("day"))
    total = rows.agg(F.sum("load").alias("all"))
    cost = decision.false_positive_cost(F.col("score") > 80, F.col("label"), "legs", 13.2, 0.4)
    s = rows.groupingSets([[], [F.col("st")], [F.col("y")], [F.col("st"), F.col("y")]], F.col("st"), F.col("y")).agg(F.sum("load").alias("v"), *cost).withColumnRenamed("false_positives", "fp")
    return s.crossJoin(F.broadcast(total)).select("st", "y", F.round(F.col("v") / F.col("all"), 6).alias("share"), "fp", F.round("cost", 3).alias("cost"))


@query("""
with m as (select o_custkey % 9 as feature, case when o_custkey % 9 < 4 then 'calendar' when o_custkey % 9 < 7 then 'weather' else 'history' end as family, month(o_orderdate)::int as month, o_totalprice - 250000 as c from orders),
f as (select family, feature, avg(abs(c)) as m, avg(c) as signed from m group by all)
select family, count(*) as features, round(sum(m), 3) as mass, round(sum(m) / (select sum(m) from f), 6) as share, row_number() over (order by sum(m) desc)::int as place, round(sum(signed), 3) as signed from f group by family
""")
def q_attribution_mass(t):
    k = F.col("o_custkey") % 9
    m = t.orders.select(k.alias("feature"), F.when(k < 4, "calendar").when(k < 7, "weather").otherwise("history").alias("family"), (F.col("o_totalprice") - 250000).alias("c"))
    fam = m.groupBy("family", "feature").agg(F.avg(F.abs("c")).alias("m"), F.avg("c").alias("signed")).groupBy("family").agg(F.count(F.lit(1)).alias("features"), F.sum("m").alias("m"), F.sum("signed").alias("s"))
    w = Window.partitionBy(F.lit(0))  # one row for each family
    return fam.select("family", "features", F.round("m", 3).alias("mass"), F.round(F.col("m") / F.sum("m").over(w), 6).alias("share"), F.row_number().over(w.orderBy(F.desc("m"))).alias("place"), F.round("s", 3).alias("signed"))


@query("""
with c as (select o_custkey, count(*) as n, round(median(o_totalprice), 3) as med, round(quantile_cont(o_totalprice, 0.9), 3) as p90, round(avg((o_totalprice > 300000)::int), 6) as over_a, round(avg((o_totalprice > 400000)::int), 6) as over_b from orders group by 1)
select * from c order by n desc, o_custkey limit 10
""")
def q_top_services(t):
    c = t.orders.groupBy("o_custkey").agg(n()).orderBy(F.desc("n"), "o_custkey").limit(10)  # the report's ten, then their profile
    p = t.orders.join(F.broadcast(c.select("o_custkey")), "o_custkey").groupBy("o_custkey").agg(
        n(), F.round(F.percentile("o_totalprice", F.lit(0.5)), 3).alias("med"), F.round(F.percentile("o_totalprice", F.lit(0.9)), 3).alias("p90"), *(F.round(F.avg((F.col("o_totalprice") > v).cast("double")), 6).alias(k) for v, k in ((300000, "over_a"), (400000, "over_b")))
    )
    return p


@query("""
with d as (select distinct o_orderdate::date as day, o_orderdate::date between date '1997-03-01' and date '1997-03-20' as out from orders)
select 'coverage' as guard, (case when max(year(l_shipdate)) > (select max(year(o_orderdate)) from orders) then 1 else 0 end)::bigint as violations from lineitem
union all select 'unique', count(*)::bigint from (select l_orderkey, l_linenumber from lineitem group by all having count(*) > 1)
union all select 'one_value', count(*)::bigint from (select o_custkey from orders group by 1 having count(distinct o_orderpriority) > 1)
union all select 'varies', (select case when avg((k > 1)::int) > 0.5 then 0 else 1 end from (select count(distinct l_quantity) as k from lineitem group by l_orderkey))::bigint
union all select 'contiguous', (select greatest(count(*) - 1, 0) from (select out, lag(out) over (order by day) as b from d) where out and not coalesce(b, false))::bigint
union all select 'max_not_below_mean', (select count(*) from (select max(l_tax) as m, avg(l_tax) as a from lineitem group by l_orderkey) where m < a - 1e-9)::bigint
union all select 'anchor_status_f', abs(count(*) filter (o_orderstatus = 'F') - 5000)::bigint from orders
union all select 'carried_equal', (select count(*) from (select n_nationkey as k, (n_nationkey * 3 + 2000) % 7 as v from nation) a join (select n_nationkey as k, (n_nationkey * 3 + 2000) % 7 + (n_regionkey = 1)::int as v from nation) b using (k) where a.v is distinct from b.v)::bigint
""")
def q_guards(t):
    days = dated_orders(t).select("day").distinct().withColumn("out", F.col("day").between("1997-03-01", "1997-03-20"))
    v = (F.col("n_nationkey") * 3 + 2000) % 7
    old = t.nation.select("n_nationkey", F.lit(2020).alias("year"), v.alias("v"))
    new = t.nation.select("n_nationkey", F.lit(2021).alias("year"), (v + F.when(F.col("n_regionkey") == 1, 1).otherwise(0)).alias("v"))
    means = t.lineitem.groupBy("l_orderkey").agg(F.max("l_tax").alias("m"), F.avg("l_tax").alias("a"))
    return agg.unioned([
        quality.covers(t.lineitem, "l_shipdate", t.orders, "o_orderdate"), quality.unique(t.lineitem, ["l_orderkey", "l_linenumber"]), quality.one_value(t.orders, "o_custkey", "o_orderpriority"), quality.varies(t.lineitem, ["l_orderkey"], "l_quantity", 0.5),
        quality.contiguous(days, "day", "out"), quality.holds(means, "max_not_below_mean", F.col("m") >= F.col("a") - 1e-9), quality.anchored(t.orders, {"status_f": (F.col("o_orderstatus") == "F", 5000)}), quality.carried_equal(old.unionByName(new), ["n_nationkey"], "year", {2021: 2020}, ["v"]),
    ])


@query(f"""
with {TRIPS}, r as (select *, case when load >= 96 then '96' when load >= 90 then '90' else 'less' end as band, score > 80 as a, booked > 90 as b from trips)
select band, count(*) as n, count(*) filter (label) as labels, count(*) filter (label and a) as by_score, count(*) filter (label and b) as by_floor, count(*) filter (label and a and b) as by_both, count(*) filter (label and not a and not b) as missed, round(count(*) filter (label and (a or b)) / nullif(count(*) filter (label), 0)::double, 6) as recall from r group by band
""")
def q_bands_recall(t):
    a, b, l = F.col("score") > 80, F.col("booked") > 90, F.col("label")  # noqa: E741
    band = F.coalesce(casts.band(F.col("load"), [90, 96], ["90", "96"]), F.lit("less"))
    out = trip_rows(t).groupBy(band.alias("band")).agg(n(), F.count_if(l).alias("labels"), F.count_if(l & a).alias("by_score"), F.count_if(l & b).alias("by_floor"), F.count_if(l & a & b).alias("by_both"), F.count_if(l & ~a & ~b).alias("missed"), F.round(F.try_divide(F.count_if(l & (a | b)).cast("double"), F.count_if(l)), 6).alias("recall"))
    return out


@query(f"""
with {TRIPS}, d as (select date_trunc('quarter', day)::date as q, day, count(*) filter (score > 80) as k from trips group by all) select q, count(*) as days, round(avg(k), 6) as mean, round(quantile_cont(k, 0.95), 6) as p95, max(k) as most from d group by q
""")
def q_daily_load(t):
    rows = trip_rows(t).withColumn("q", F.to_date(F.date_trunc("quarter", "day")))
    return decision.daily_load(rows, "day", F.col("score") > 80, ["q"]).withColumns({c: F.round(c, 6) for c in ("mean", "p95")})


@query("""
with l as (select l_suppkey as veh, o_orderdate::date as day, l_orderkey as trip, bool_or(l_quantity > 25) as coupled, bool_or(l_quantity > 45) as label from lineitem join orders on l_orderkey = o_orderkey group by all),
a as (select *, case when coupled is distinct from lag(coupled) over w then 1 else 0 end as nw from l window w as (partition by veh, day order by trip)), b as (select *, sum(nw) over (partition by veh, day order by trip rows unbounded preceding) as blk from a),
c as (select *, bool_or(label) over (partition by veh, day, blk) as lab from b where coupled)
select count(*) as trips, count(*) filter (label) as justified, count(*) filter (lab) as inherited, count(distinct (veh, day, blk)) as blocks, count(distinct case when lab then (veh, day, blk) end) as justified_blocks, round(avg(label::int), 6) as precision, round(avg(lab::int), 6) as precision_inherited,
  round(count(distinct case when lab then (veh, day, blk) end) / count(distinct (veh, day, blk))::double, 6) as precision_blocks from c
""")
def q_block_grain(t):
    legs = joins.dealt(leg_rows(t).select(F.col("l_suppkey").alias("veh"), "day", "trip", "load"), ["veh", "day"], t.lineitem.count())
    l = legs.groupBy("veh", "day", "trip").agg(F.bool_or(F.col("load") > 50).alias("coupled"), F.bool_or(F.col("load") > 90).alias("label"))  # noqa: E741
    b = windows.islands(l, ["veh", "day"], ["trip"], ["coupled"])
    out = decision.block_evaluation(b, ["veh", "day", "island"], "coupled", "label")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "precision_inherited", "precision_blocks")})


@query("""
with l as (select l_suppkey as veh, o_orderdate::date as day, l_orderkey as trip, max(l_quantity) as q from lineitem join orders on l_orderkey = o_orderkey group by all),
tr as (select trip, day, bool_or(q > 25) as human, bool_or(q > 45) as label from l group by all), veh as (select veh, day, bool_or(q > 25) as human, bool_or(q > 45) as label, string_agg(trip::varchar, ',' order by trip) as trips from l group by all)
select 'trip' as grain, year(day)::int as y, count(*) filter (human) as chosen, count(*) filter (human and label) as hits, count(*) filter (label) as labels, 0::bigint as chained from tr group by y
union all select 'tour', year(day)::int, count(*) filter (human), count(*) filter (human and label), count(*) filter (label), count(*) filter (trips like '%,%') from veh group by 2
""")
def q_human_baseline(t):
    l = leg_rows(t).select(F.col("l_suppkey").alias("veh"), "day", "trip", (F.col("load") > 50).alias("human"), (F.col("load") > 90).alias("label"))  # noqa: E741
    flags = [F.bool_or("human").alias("human"), F.bool_or("label").alias("label")]
    counts = [F.count_if("human").alias("chosen"), F.count_if(F.col("human") & F.col("label")).alias("hits"), F.count_if("label").alias("labels")]
    a = l.groupBy("trip", "day").agg(*flags).groupBy(F.lit("trip").alias("grain"), F.year("day").alias("y")).agg(*counts, F.lit(0).cast("bigint").alias("chained"))
    b = l.groupBy("veh", "day").agg(*flags, (F.min("trip") < F.max("trip")).alias("several")).groupBy(F.lit("tour").alias("grain"), F.year("day").alias("y")).agg(*counts, F.count_if("several").alias("chained"))
    return a.unionByName(b)


@query("""
with y as (select distinct o_custkey as c, year(o_orderdate)::int as y from orders), p as (select coalesce(a.y + 1, b.y)::int as year, a.c as old, b.c as new from (select * from y where y < 2001) a full join (select * from y where y > 1995) b on a.c = b.c and a.y + 1 = b.y)
select year, count(*) filter (old is not null and new is not null) as kept, count(*) filter (new is null) as vanished, count(*) filter (old is null) as fresh, count(*) as every, round(count(*) filter (old is not null and new is not null) / count(*)::double, 6) as stability from p group by year
""")
def q_roster(t):
    y = t.orders.select(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("year")).distinct()
    old = y.where("year < 2001").select("c", (F.col("year") + 1).alias("year"), F.lit(True).alias("old"))
    new = y.where("year > 1995").withColumn("new", F.lit(True))
    both = old.join(new, ["c", "year"], "full")
    a, b = F.col("old").isNotNull(), F.col("new").isNotNull()
    return both.groupBy("year").agg(F.count_if(a & b).alias("kept"), F.count_if(a & ~b).alias("vanished"), F.count_if(~a & b).alias("fresh"), F.count(F.lit(1)).alias("every"), F.round(F.count_if(a & b) / F.count(F.lit(1)), 6).alias("stability"))


@query("""
with tr as (select distinct o_custkey from orders where year(o_orderdate) <= 1996 and o_totalprice > 300000)
select year(o_orderdate)::int as y, count(*) as n, count(tr.o_custkey) as known, count(*) - count(tr.o_custkey) as renumbered, round(avg(o_totalprice) filter (tr.o_custkey is not null), 3) as mean_known from orders left join tr using (o_custkey) where year(o_orderdate) > 1996 group by 1
""")
def q_known_strata(t):
    o = t.orders.select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    known = o.where("y <= 1996 and o_totalprice > 300000").select("o_custkey").distinct().withColumn("known", F.lit(1))
    return o.where("y > 1996").join(known, "o_custkey", "left").groupBy("y").agg(n(), F.count("known").alias("known"), F.count_if(F.col("known").isNull()).alias("renumbered"), F.round(F.avg(F.when(F.col("known") == 1, F.col("o_totalprice"))), 3).alias("mean_known"))


@query()
def q_bootstrap(t):
    """R2 of a score with block-bootstrap limits: sums by (day) block, then Poisson weights for 200 replicates."""
    rows = trip_rows(t).where("score is not null")
    sums = inference.error_sums(F.col("load"), F.col("score"))
    blocks = rows.groupBy("day").agg(*sums)
    reps = inference.replicates(blocks, ["day"], ["n", "sy", "syy", "sse"], 200)
    point = rows.agg(*sums).select(inference.r2().alias("r2"))
    return inference.interval(reps, inference.r2()).crossJoin(F.broadcast(point)).select("r2", "low", "high", "sd")


@query(f"""with {TRIPS} select count(*) as n, round(1 - sum((score - load) * (score - load)) / (sum(load * load) - sum(load) * sum(load) / count(*)), 6) as r2, true as inside from trips""")
def q_bootstrap_point(t):
    """The point estimate of q_bootstrap, and whether its limits hold it."""
    rows = trip_rows(t)
    sums = inference.error_sums(F.col("load"), F.col("score"))
    reps = inference.replicates(rows.groupBy("day").agg(*sums), ["day"], ["n", "sy", "syy", "sse"], 100)
    point = rows.agg(*sums).select("n", inference.r2().alias("r2"))
    out = inference.interval(reps, inference.r2(), 0.99).crossJoin(F.broadcast(point))
    return out.select("n", F.round("r2", 6).alias("r2"), F.col("r2").between(F.col("low"), F.col("high")).alias("inside"))


@query("select year(o_orderdate)::int as year, count(*) as n, round(sum(o_totalprice), 2) as total, count(distinct o_orderkey) as keys, 1::bigint as sources from orders group by 1")
def q_scan_union(t):
    """Orders landed by year in the shared folder and read once, with lineage."""
    from ..functions.storage import new_folder
    from ..sources.files import land

    folder = new_folder(t.spark, "landed")
    landed = land(t.orders.withColumn("year", F.year("o_orderdate")), folder, F.col("o_orderkey").isNotNull(), "year")
    lineage = landed.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"year=(\d+)", 1))
    return lineage.groupBy("year").agg(n(), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_orderkey").alias("keys"), F.count_distinct("file").alias("sources"))
