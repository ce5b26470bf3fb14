"""Queries that give tables for planners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import casts
from ..operators import aggregates as agg
from ..operators import decision, topology, windows
from .aggregates_and_decisions import TRIPS, leg_rows, trip_rows
from .registry import query


@query("""
with l as (select o_orderdate::date as day, l_orderkey as trip, l_suppkey as veh, l_extendedprice / 1000 as pred, l_quantity * 2 as load, l_discount * 1000 as booked from lineitem join orders on l_orderkey = o_orderkey),
c as (select a.day, a.trip, array_to_string(list_sort(list(distinct b.trip)), ',') as chained from l a join l b on a.day = b.day and a.veh = b.veh and a.trip <> b.trip group by all)
select day, trip, round(max(pred), 6) as score, count(*) filter (pred > 80) as legs_over, max(pred) > 80 as by_score, max(booked) > 90 as by_floor, max(load) > 94 as beyond_capacity, coalesce(any_value(chained), '') as chained from l left join c using (day, trip) group by day, trip
""")
def q_day_before(t):
    return decision.day_table(leg_rows(t), "day", "trip", "l_suppkey", "pred", "load", "booked", 80.0, 90.0, 94.0).withColumn("score", F.round("score", 6))


@query("""
with o as (select o_custkey % 50 as svc, date_trunc('month', o_orderdate)::date as mon, o_totalprice as v from orders), m as (select svc, mon, max(v) as top from o group by all),
r as (select svc, mon, (rank() over (partition by mon order by top) + (count(*) over (partition by mon, top) - 1) / 2.0) / count(*) over (partition by mon) as pct from m), b as (select svc, count(*) filter (pct >= 0.9) as months_top from r group by svc)
select svc, round(median(v), 3) as med, round(quantile_cont(v, 0.9), 3) as p90, round(avg((v > 300000)::int), 6) as over_a, round(avg((v > 400000)::int), 6) as over_b, any_value(months_top) as months_top from o join b using (svc) group by svc
""")
def q_service_profile(t):
    o = t.orders.select((F.col("o_custkey") % 50).alias("svc"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("mon"), F.col("o_totalprice").alias("v"))
    m = o.groupBy("svc", "mon").agg(F.max("v").alias("top"))
    best = windows.rank_share(m, ["mon"], "top").groupBy("svc").agg(F.count_if(F.col("pct") >= 0.9).alias("months_top"))
    middle = agg.exact_percentiles(o, ["svc"], "v", (0.5, 0.9)).select("svc", F.round("p50", 3).alias("med"), F.round("p90", 3).alias("p90"))
    profile = o.groupBy("svc").agg(*(F.round(F.avg((F.col("v") > x).cast("double")), 6).alias(k) for x, k in ((300000, "over_a"), (400000, "over_b"))))
    return profile.join(middle, "svc").join(best, "svc")


@query(f"""
with {TRIPS}, r as (select *, score > 80 as m, trip % 5 = 0 as h, case when load >= 80 then '80' when load >= 63 then '63' else 'less' end as band from trips)
select band, label, count(*) filter (m and not h) as only_a, count(*) filter (not m and h) as only_b, count(*) filter (m and h) as both, count(*) filter (not m and not h) as neither from r group by all
""")
def q_overlap(t):
    """Overlap of the model's and people's choices by load band and label: the false positives' bands are the rows without label."""
    band = F.coalesce(casts.band(F.col("load"), [63, 80], ["63", "80"]), F.lit("less"))
    m, h = F.col("score") > 80, F.col("trip") % 5 == 0
    return trip_rows(t).groupBy(band.alias("band"), "label").agg(F.count_if(m & ~h).alias("only_a"), F.count_if(~m & h).alias("only_b"), F.count_if(m & h).alias("both"), F.count_if(~m & ~h).alias("neither"))


@query("""
with p as (select c_custkey as k, 2000 + c_custkey % 3 as y, 6.8 + (c_custkey * 37 % 1000) / 10000.0 as lon, 46.4 + (c_custkey * 91 % 1000) / 10000.0 as lat, c_acctbal as v from customer),
s as (select s_suppkey as id, y, 6.8 + (s_suppkey * 53 % 1000) / 10000.0 as slon, 46.4 + (s_suppkey * 29 % 1000) / 10000.0 as slat from supplier, (values (2000), (2001), (2002)) a(y) where (s_suppkey + y) % 4 > 0),
d as (select k, y, v, id, 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) as m from (select k, p.y, v, id, pow(sin((radians(slat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2) as h from p join s on p.y = s.y)),
n as (select k, y, any_value(v) as v, arg_min(id, (m, id)) as id from d where m <= 500 group by k, y)
select y::int as y, id, count(*) as points, round(sum(v), 2) as total, count(*) filter (v > 5000) as rich from n group by all
""")
def q_zone_vintages(t):
    """Points summed by the nearest station that is active in their year, all years in one job."""
    at = lambda c, a, b, base: F.lit(base) + F.col(c) * a % b / 10000
    p = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 3 + 2000).cast("int").alias("y"), at("c_custkey", 37, 1000, 6.8).alias("lon"), at("c_custkey", 91, 1000, 46.4).alias("lat"), F.col("c_acctbal").alias("v"))
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.explode(F.array(*(F.lit(y) for y in (2000, 2001, 2002)))).alias("y"), at("s_suppkey", 53, 1000, 6.8).alias("s_lon"), at("s_suppkey", 29, 1000, 46.4).alias("s_lat")).where("(id + y) % 4 > 0")
    near = topology.nearest_station(p, s, ["k", "y", "v"], 500.0, on=["y"])
    return near.groupBy("y", "id").agg(F.count("*").alias("points"), F.round(F.sum("v"), 2).alias("total"), F.count_if(F.col("v") > 5000).alias("rich"))
