"""Queries over windows, paths, places and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import daycal, geo, text
from ..operators import joins, topology, windows
from .calendar_and_joins import DAYS, calendar, dated_orders
from .registry import query

def n():
    return F.count("*").alias("n")


@query("""
with l as (select event_type as a, lead(event_type) over (partition by user_id, ts::date order by ts) as b, event_id % 2 as par from events)
select a as leg_from, b as leg_to, case when par = 0 then 'down' else 'up' end as direction, count(*) as n from l where b is not null group by all
""")
def q_legs(t):
    from ..functions.casts import direction

    e = t.events.withColumn("day", F.to_date("ts"))
    out = windows.legs(e, ["user_id", "day"], "ts", ["event_type"])
    return out.groupBy(F.col("event_type").alias("leg_from"), F.col("next_event_type").alias("leg_to"), direction(F.col("event_id")).alias("direction")).agg(n())


@query("""
select event_id, floor(date_diff('microsecond', lag(ts) over w, ts) / 6e7 * 1e4)::bigint as before_min, floor(date_diff('microsecond', ts, lead(ts) over w) / 6e7 * 1e4)::bigint as after_min, lag(ts) over w is null as is_first, lead(ts) over w is null as is_last,
  lag(event_id) over w as before_id, lead(event_id) over w as after_id from events window w as (partition by event_type, ts::date order by ts)
""")
def q_headway(t):
    out = windows.headway(t.events.withColumn("day", F.to_date("ts")), ["event_type", "day"], "ts", "event_id")
    return out.select("event_id", *(F.floor(F.col(c) * 1e4).alias(c) for c in ("before_min", "after_min")), "is_first", "is_last", "before_id", "after_id")


@query(f"""
with {DAYS}, f as (select c_mktsegment as seg, o_orderdate::date as day, case when kind in ('holiday','sunday') then 'sunday_holiday' when kind = 'saturday' then 'saturday' else 'working' end as class3, round(max(o_totalprice) * 100)::bigint as v
  from orders join customer on o_custkey = c_custkey join kinds on day = o_orderdate::date group by all)
select seg, day, class3, case when count(v) over w >= 2 then round(avg(v) over w, 1) end as v_mean, case when count(v) over w >= 2 then (sum(v) over w)::bigint end as v_sum, case when count(v) over w >= 2 then round(stddev_samp(v) over w, 1) end as v_std
from f window w as (partition by seg, class3 order by day rows between 6 preceding and 2 preceding)
""")
def q_rolling_stratum(t):
    kinds = calendar(t).select("day", daycal.three_classes(F.col("kind")).alias("class3"))
    seg = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg"))
    daily = dated_orders(t).select("o_custkey", "day", "o_totalprice").join(seg, "o_custkey").join(joins.small(kinds), "day").groupBy("seg", "day", "class3").agg(F.round(F.max("o_totalprice") * 100).cast("bigint").alias("v"))
    out = windows.rolling(daily, ["seg", "class3"], ["day"], "v", 5, ("mean", "sum", "std"), least=2, lag=2)
    return out.select("seg", "day", "class3", F.round("v_mean5", 1).alias("v_mean"), F.col("v_sum5").alias("v_sum"), F.round("v_std5", 1).alias("v_std"))


@query("""
with d as (select user_id, ts::date as day, count(*) filter (event_type = 'error') as bad, count(*) filter (event_type <> 'view') as every from events group by all)
select user_id, day, round(sum(bad) over w / nullif(sum(every) over w, 0), 6)::double as ratio from d window w as (partition by user_id order by day rows between 4 preceding and current row)
""")
def q_rolling_ratio(t):
    d = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.count_if(F.col("event_type") != "view").alias("every"))
    return d.select("user_id", "day", F.round(windows.rolling_ratio(d, ["user_id"], ["day"], "bad", "every", 5), 6).alias("ratio"))


@query("""
with d as (select o_orderpriority as p, o_orderstatus as s, o_orderdate::date as day, avg(o_totalprice) as v from orders group by all),
h as (select p, s, day, v as h_last, avg(v) over w as h_mean, median(v) over w as h_median, max(v) over w as h_max, coalesce(stddev_samp(v) over w, 0) as h_std, count(*) filter (v > 150000) over w as h_over
  from d window w as (partition by p, s order by day rows between 6 preceding and current row)),
q as (select o_orderkey, o_orderpriority as p, o_orderstatus as s, o_orderdate::date as day, last_day((o_orderdate::date - 1) - case when day(o_orderdate::date - 1) >= 4 then interval 1 month else interval 2 month end)::date as cut from orders)
select o_orderkey, q.day, round(h_last, 4) as h_last, round(h_mean, 4) as h_mean, round(h_median, 4) as h_median, round(h_max, 4) as h_max, round(h_std, 3) as h_std, h_over
from q asof left join h on q.p = h.p and q.s = h.s and q.cut >= h.day
""")
def q_history_asof(t):
    rows = dated_orders(t).select("o_orderkey", "o_orderpriority", "o_orderstatus", "day", "o_totalprice")
    out = windows.publication_history(rows, ["o_orderpriority", "o_orderstatus"], "day", "o_totalprice", 150_000.0)
    return out.select("o_orderkey", "day", *(F.round(c, 3 if c == "h_std" else 4).alias(c) for c in ("h_last", "h_mean", "h_median", "h_max", "h_std")), "h_over")


@query("""
with m as (select c_nationkey as k, (year(o_orderdate) * 12 + month(o_orderdate))::int as mon, max(o_totalprice) as v from orders join customer on o_custkey = c_custkey group by all),
g as (select k, mon, case when (k + mon) % 4 = 0 then null else v end as v from m)
select k, mon, case when v is null and mon % 12 in (2, 4, 6, 8) then last_value(v ignore nulls) over (partition by k order by mon rows between unbounded preceding and current row) else v end as v from g
""")
def q_locf(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k"))
    m = t.orders.join(c, "o_custkey").groupBy("k", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("mon")).agg(F.max("o_totalprice").alias("v"))
    m = m.withColumn("v", F.when((F.col("k") + F.col("mon")) % 4 != 0, F.col("v")))
    months = [y * 12 + i for y in range(1990, 2010) for i in (2, 4, 6, 8)]
    return m.select("k", "mon", windows.carried_forward(m, ["k"], "mon", "v", months).alias("v"))


@query("""
with o as (select o_orderkey, date_trunc('month', o_orderdate)::date as mon, floor(o_totalprice / 5000) as s from orders)
select o_orderkey, mon, round((rank() over (partition by mon order by s) + (count(*) over (partition by mon, s) - 1) / 2.0) / count(*) over (partition by mon), 8)::double as pct from o
""")
def q_rank_pct(t):
    o = t.orders.select("o_orderkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("mon"), F.floor(F.col("o_totalprice") / 5000).alias("s"))
    return windows.rank_share(o, ["mon"], "s").select("o_orderkey", "mon", F.round("pct", 8).alias("pct"))


@query("""
with r as (select o_orderkey, o_orderpriority as p, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as r, count(*) over (partition by o_orderpriority) as c from orders)
select o_orderkey, p, (case when r = 1 then 1 else ceil((r - 1) * 4.0 / (c - 1)) end)::int as part from r
""")
def q_quartile_time(t):
    return windows.ranked_cut(t.orders.select("o_orderkey", F.col("o_orderpriority").alias("p"), "o_orderdate"), ["p"], ["o_orderdate", "o_orderkey"], 4).select("o_orderkey", "p", "part")


@query("""
select o_orderstatus, place::int as place, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderdate, o_orderkey) as place from orders) where place <= 20
""")
def q_topn_tiebreak(t):
    return windows.top(t.orders, ["o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderdate"), F.col("o_orderkey")], 20).select("o_orderstatus", "place", "o_orderkey", "o_totalprice")


@query("""
with a as (select *, case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then 1 else 0 end as nw from (select user_id, ts::date as day, ts, event_type from events) window w as (partition by user_id, day order by ts)),
b as (select *, sum(nw) over (partition by user_id, day order by ts rows unbounded preceding) as island from a)
select user_id, day, island::bigint as island, event_type, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from b group by all
""")
def q_blocks(t):
    e = t.events.select("user_id", F.to_date("ts").alias("day"), "ts", "event_type")
    marked = windows.islands(e, ["user_id", "day"], ["ts"], ["event_type"])
    return marked.groupBy("user_id", "day", "island", "event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), n())


@query("""
with recursive p as (select distinct l_suppkey as g, l_orderkey as m from lineitem),
e as (select distinct a.g as a, b.g as b from p a join p b using (m)), r(g, x) as (select g, g from (select distinct g from p) union select e.b, r.x from r join e on r.g = e.a)
select g, min(x) as label from r group by g
""")
def q_blocks_merged(t):
    p = t.lineitem.select(F.col("l_suppkey").alias("g"), F.col("l_orderkey").alias("m"))
    return windows.merged(p, "g", "m")


@query("""
select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_key, min(o_orderdate)::date as first_day, (min(case when o_totalprice > 300000 then o_orderdate end)::date - min(o_orderdate)::date)::int as gap_days from orders group by o_custkey
""")
def q_first_row(t):
    o = dated_orders(t)
    big = F.min(F.when(F.col("o_totalprice") > 300000, F.col("day")))
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_key"), F.min("day").alias("first_day"), F.datediff(big, F.min("day")).alias("gap_days"))


@query("""
select o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as max_key, max(o_totalprice) as top, arg_max(o_orderpriority, (o_totalprice, -o_orderkey)) as priority from orders group by o_custkey
""")
def q_argmax(t):
    row = F.max_by(F.struct("o_orderkey", "o_totalprice", "o_orderpriority"), F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("m")
    return t.orders.groupBy("o_custkey").agg(row).select("o_custkey", F.col("m.o_orderkey").alias("max_key"), F.col("m.o_totalprice").alias("top"), F.col("m.o_orderpriority").alias("priority"))


@query("""
with l as (select l_orderkey, l_linenumber, min(l_partkey) as s, sum(l_quantity) as load, sum(case when l_partkey % 3 = 0 then l_quantity else 0 end) as ons, sum(case when l_partkey % 3 = 1 then l_quantity else 0 end) as offs from lineitem group by all),
r as (select lead(load) over w - load - lead(ons) over w + lead(offs) over w as residual from l window w as (partition by l_orderkey order by l_linenumber))
select count(residual) as legs, count(*) filter (residual <> 0) as broken, round(sum(residual), 2) as total from r
""")
def q_conservation(t):
    q = F.col("l_quantity")
    l = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.sum(q).alias("load"), F.sum(F.when(F.col("l_partkey") % 3 == 0, q).otherwise(0)).alias("ons"), F.sum(F.when(F.col("l_partkey") % 3 == 1, q).otherwise(0)).alias("offs"))  # noqa: E741
    out = windows.conservation(l, ["l_orderkey"], ["l_linenumber"], "load", "ons", "offs")
    return out.agg(F.count("residual").alias("legs"), F.count_if(F.col("residual") != 0).alias("broken"), F.round(F.sum("residual"), 2).alias("total"))


@query("""
select event_id, user_id || '_' || strftime(min(ts) over (partition by user_id, ts::date), '%Hh%M') as service, (row_number() over (partition by user_id, ts::date order by ts))::int as position from events
""")
def q_service_id(t):
    e = t.events.withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("user_id", "day")
    return e.select("event_id", windows.service_id(F.min("ts").over(w), F.col("user_id")).alias("service"), F.row_number().over(w.orderBy("ts")).alias("position"))


@query("""
with p as (select c_nationkey as a, s_nationkey as b, l_quantity as q from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)
select leg::int as leg, count(*) as n, round(sum(q), 2) as volume from p, unnest(generate_series(least(a, b), greatest(a, b) - 1)) u(leg) where a <> b group by leg
""")
def q_od_legs(t):
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    lines = lines.join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").join(joins.small(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")), "l_suppkey")
    grouped = lines.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("q"))  # before the rows multiply
    return topology.ordered_legs(grouped, "c_nationkey", "s_nationkey").groupBy("leg").agg(F.sum("rows").alias("n"), F.round(F.sum("q"), 2).alias("volume"))


@query("""
with line as (select y, list(s order by s) as st from (select y::int as y, s::int as s from range(1995, 2001) a(y), range(0, 20) b(s) where y <> 1998 and not (y = 1996 and s = 7)) group by y),
p as (select o_orderkey, year(o_orderdate)::int as y, (o_custkey % 22)::int as a, (o_orderkey % 20)::int as b from orders),
j as (select p.*, st, list_position(st, a) as ia, list_position(st, b) as ib from p left join line using (y)),
legs as (select y, unnest(case when ia < ib then generate_series(ia, ib - 1) else generate_series(ib, ia - 1) end) as i, st, ia < ib as up from j where ia is not null and ib is not null and ia <> ib)
select 'leg' as kind, y, (case when up then st[i] else st[i + 1] end)::varchar as a, (case when up then st[i + 1] else st[i] end)::varchar as b, count(*) as n from legs group by all
union all select case when st is null then 'no line' when ia is null then 'origin not on line' else 'target not on line' end, y, null, null, count(*) from j where st is null or ia is null or ib is null group by all
""")
def q_path_explode(t):
    grid = t.spark.range(1995, 2001).select(F.col("id").cast("int").alias("y")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(19)))).where("y <> 1998 and not (y = 1996 and s = 7)")
    lines = grid.groupBy("y").agg(F.array_sort(F.collect_list("s")).alias("stations"))  # at most 20 stations each
    p = t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"), (F.col("o_custkey") % 22).cast("int").alias("a"), (F.col("o_orderkey") % 20).cast("int").alias("b"))
    legs, orphans = topology.path_legs(p, lines, "y", "a", "b")
    good = legs.groupBy(F.lit("leg").alias("kind"), "y", F.col("leg_from").cast("string").alias("la"), F.col("leg_to").cast("string").alias("lb")).agg(n()).withColumnsRenamed({"la": "a", "lb": "b"})
    bad = orphans.groupBy(F.col("reason").alias("kind"), "y").agg(n()).withColumns({"a": F.lit(None).cast("string"), "b": F.lit(None).cast("string")})
    return good.unionByName(bad)


GEO = """
p as (select c_custkey as k, 6.8 + (c_custkey * 37 % 1000) / 10000.0 as lon, 46.4 + (c_custkey * 91 % 1000) / 10000.0 as lat from customer),
s as (select s_suppkey as id, 6.8 + (s_suppkey * 53 % 1000) / 10000.0 as slon, 46.4 + (s_suppkey * 29 % 1000) / 10000.0 as slat from supplier),
d as (select k, id, 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) as m from (select k, id, pow(sin((radians(slat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2) as h from p, s))
"""


def places(t):
    p = t.customer.select(F.col("c_custkey").alias("k"), (F.lit(6.8) + F.col("c_custkey") * 37 % 1000 / 10000).alias("lon"), (F.lit(46.4) + F.col("c_custkey") * 91 % 1000 / 10000).alias("lat"))
    s = t.supplier.select(F.col("s_suppkey").alias("id"), (F.lit(6.8) + F.col("s_suppkey") * 53 % 1000 / 10000).alias("s_lon"), (F.lit(46.4) + F.col("s_suppkey") * 29 % 1000 / 10000).alias("s_lat"))
    return p, s


@query(f"with {GEO} select k, arg_min(id, (m, id)) as id, round(min(m), 3) as metres, round(min(m) * 1.4 / 83.3, 4) as walk_min from d where m <= 500 group by k")
def q_nearest_point(t):
    p, s = places(t)
    out = topology.nearest_station(p, s, ["k"], 500.0)
    return out.select("k", "id", F.round("metres", 3).alias("metres"), F.round(geo.walking_minutes(F.col("metres")), 4).alias("walk_min"))


@query(f"with {GEO} select id, count(*) filter (m <= 200) as within_200, count(*) as within_400, round(min(m), 3) as nearest from d where m <= 400 group by id")
def q_radius(t):
    p, s = places(t)
    return topology.radius_counts(p, s, {"within_200": 200.0, "within_400": 400.0}).withColumn("nearest", F.round("nearest", 3))


@query("""
select lang, count(*) as n, count(*) filter (regexp_matches(lower(text), 'license|token|mail')) as flagged,
  count(*) filter (fam = 'secret') as secret, count(*) filter (fam = 'licence') as licence, count(*) filter (fam = 'mail') as mail, count(*) filter (fam = 'other') as other
from (select *, case when text like '%@%' then 'mail' when regexp_matches(text, '(?i)token') then 'secret' when regexp_matches(text, '(?i)licen[sc]e') then 'licence' else 'other' end as fam from documents) group by lang
""")
def q_text_flags(t):
    fam = text.last_rule(F.col("text"), [("(?i)licen[sc]e", "licence"), ("(?i)token", "secret"), ("@", "mail")], "other")
    d = t.documents.select("lang", "text", fam.alias("fam"))
    return d.groupBy("lang").agg(n(), F.count_if(text.has_any(["license", "token", "mail"], F.col("text"))).alias("flagged"), *(F.count_if(F.col("fam") == f).alias(f) for f in ("secret", "licence", "mail", "other")))


@query("""
with w as (select doc_id, trim(regexp_replace(lower(strip_accents(unnest(string_split_regex(text, '[/,]| et | - ')))), '[()]', '', 'g')) as name from documents),
z as (select * from (values ('la', 'near', 1), ('the', 'far', 2), ('de', 'edge', 3), ('of', 'hub', 1), ('und', 'edge', 3), ('tre', 'near', 2)) v(name, zone, priority))
select doc_id, arg_min(zone, (priority, zone)) as zone from w join z using (name) group by doc_id
""")
def q_text_zone(t):
    z = t.spark.createDataFrame([("la", "near", 1), ("the", "far", 2), ("de", "edge", 3), ("of", "hub", 1), ("und", "edge", 3), ("tre", "near", 2)], "name string, zone string, priority int")
    return text.zones(t.documents.select("doc_id", F.col("text").alias("place")), "doc_id", "place", z)


@query("""
with l as (select o_orderkey, case when o_orderkey % 17 = 0 then 'annulé ' else '' end || strftime(o_orderdate, '%-d.%-m.%Y') || ' - ' || strftime(o_orderdate + (o_custkey % 5)::int * interval 1 day, '%-d.%-m.%Y') || ' Fair ' || (o_custkey % 7) || ', Town ' || (o_custkey % 3) as line, o_orderdate::date as s, (o_orderdate + (o_custkey % 5)::int * interval 1 day)::date as e, o_custkey from orders)
select 'Fair ' || (o_custkey % 7) as name, 'Town ' || (o_custkey % 3) as place, count(*) as n, min(s) as first_start, max(e) as last_end, sum(e - s)::bigint as extra_days from l where o_orderkey % 17 <> 0 group by all
""")
def q_event_lines(t):
    end = F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 5).cast("int"))
    line = F.concat(F.when(F.col("o_orderkey") % 17 == 0, "annulé ").otherwise(""), F.date_format("o_orderdate", "d.M.yyyy"), F.lit(" - "), F.date_format(end, "d.M.yyyy"), F.lit(" Fair "), (F.col("o_custkey") % 7).cast("string"), F.lit(", Town "), (F.col("o_custkey") % 3).cast("string"))
    out = text.event_lines(t.orders.select(line.alias("line")))
    return out.groupBy("name", "place").agg(n(), F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.sum(F.datediff("end", "start")).alias("extra_days"))


@query("""
with k as (select o_orderkey, make_date((1995 + o_orderkey % 5)::int, 12, 15) as s, make_date((1996 + o_orderkey % 5)::int, 12, 14) as e, o_orderdate::date as d from orders),
r as (select o_orderkey, s, e, unnest([make_date(year(s)::int, month(d), day(d)), make_date(year(e)::int, month(d), day(d))]) as c from k where not (month(d) = 2 and day(d) = 29)),
m as (select o_orderkey, min(c) as c from r where c between s and e group by o_orderkey), k2 as (select o_orderkey, c as day from m union all select o_orderkey, c + 1 from m join k using (o_orderkey) where o_orderkey % 3 = 0 and day(d + 1) <> 1 and not (month(d) = 12 and day(d) = 14) and not (month(d) = 2 and day(d) = 28))
select day, count(*) as n from k2 group by day
""")
def q_note_dates(t):
    """Each order carries a note with one day, or a range of two days, without a year."""
    d = F.to_date("o_orderdate")
    y = (F.col("o_orderkey") % 5).cast("int")
    start, end = F.make_date(y + 1995, F.lit(12), F.lit(15)), F.make_date(y + 1996, F.lit(12), F.lit(14))
    nxt = F.date_add(d, 1)
    span = (F.col("o_orderkey") % 3 == 0) & (F.dayofmonth(nxt) != 1) & ~((F.month(d) == 12) & (F.dayofmonth(d) == 14)) & ~((F.month(d) == 2) & (F.dayofmonth(d) == 28))
    note = F.concat(F.lit("runs "), F.date_format(d, "d.M"), F.when(span, F.concat(F.lit(" - "), F.date_format(nxt, "d.M"))).otherwise(""), F.lit(" only"))
    k = t.orders.where(~((F.month(d) == 2) & (F.dayofmonth(d) == 29))).select("o_orderkey", start.alias("start"), end.alias("end"), note.alias("text"))
    return text.note_days(k, "o_orderkey").groupBy("day").agg(n())


@query("""
with o as (select o_orderkey, o_orderdate, o_totalprice, o_orderstatus as s, o_custkey, lag(o_orderkey) over w as prev_key, lead(o_orderkey) over w as next_key from orders window w as (partition by o_orderstatus order by o_orderdate, o_orderkey)),
r as (select *, row_number() over (partition by s order by (o_custkey % 10 = 0) desc, abs(o_totalprice - 250000), o_orderdate, o_orderkey) as r from o where o_totalprice > 200000)
select s, o_orderkey, o_totalprice, prev_key, next_key from r where r = 1
""")
def q_nearest_case(t):
    """The case first (an aggregate), then its neighbours by two more aggregates: no window over all orders of a status."""
    o = t.orders.select(F.col("o_orderstatus").alias("s"), "o_orderkey", "o_totalprice", "o_orderdate", "o_custkey")
    order = F.struct((F.col("o_custkey") % 10 != 0).alias("a"), F.abs(F.col("o_totalprice") - 250000).alias("b"), "o_orderdate", "o_orderkey")
    best = o.where("o_totalprice > 200000").groupBy("s").agg(F.min_by(F.struct("o_orderdate", "o_orderkey", "o_totalprice"), order).alias("c"))
    place, case = F.struct("o_orderdate", "o_orderkey"), F.struct(F.col("c.o_orderdate"), F.col("c.o_orderkey"))
    near = o.join(joins.small(best), "s").groupBy("s").agg(F.any_value("c").alias("c"), F.max(F.when(place < case, place)).alias("before"), F.min(F.when(place > case, place)).alias("after"))
    return near.select("s", F.col("c.o_orderkey").alias("o_orderkey"), F.col("c.o_totalprice").alias("o_totalprice"), F.col("before.o_orderkey").alias("prev_key"), F.col("after.o_orderkey").alias("next_key"))
