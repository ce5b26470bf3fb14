"""Queries over calendars, casts and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import casts, daycal
from ..operators import joins, sweeps
from .registry import query

YEARS = "(select 'H' || lpad(((y) % 100)::varchar, 2, '0') as code, y, make_date(y - 1, 12, 15) as s, make_date(y, 12, 14) as e from range(1995, 2004) t(y))"


def fiscal_years(spark):
    y = F.col("id").cast("int")
    return spark.range(1995, 2004).select(
        F.concat(F.lit("H"), F.lpad((y % 100).cast("string"), 2, "0")).alias("code"), y.alias("y"), F.make_date(y - 1, F.lit(12), F.lit(15)).alias("start"), F.make_date(y, F.lit(12), F.lit(14)).alias("end")
    )


def dated_orders(t):
    return t.orders.withColumn("day", F.to_date("o_orderdate"))


@query(f"""
select code as year_code, count(*) as n, round(sum(o_totalprice), 2) as total
from orders join {YEARS} y on o_orderdate::date between s and e where code between 'H95' and 'H99' group by code
""")
def q_interval_year(t):
    joined = joins.interval_join(dated_orders(t).select("day", "o_totalprice"), fiscal_years(t.spark), "day", how="inner")
    return joined.where(F.col("code").between("H95", "H99")).groupBy(F.col("code").alias("year_code")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
with m as (select o_custkey % 7 as k, min(o_orderdate)::date as s, max(o_orderdate)::date as e from orders group by o_custkey % 50, o_custkey % 7),
     w as (select s, e, lead(s) over (order by s, e) as nxt from (select distinct s, e from m)),
     c as (select count(*) filter (e < s) as inverted, count(*) filter (nxt <= e) as overlap, count(*) filter (nxt > e + 1) as gap from w)
select 'inverted' as "check", inverted as violations from c union all select 'overlap', overlap from c union all select 'gap', gap from c
""")
def q_interval_validate(t):
    spans = dated_orders(t).groupBy(F.col("o_custkey") % 50, F.col("o_custkey") % 7).agg(F.min("day").alias("start"), F.max("day").alias("end")).select("start", "end").distinct()
    return joins.interval_checks(spans.withColumn("start", F.col("start")))


DAYS = """
years as (select y::int as year from range(1995, 2004) t(y)),
easter as (select year, year % 19 as g, year // 100 as c from years),
e2 as (select year, g, c, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 as h from easter),
e3 as (select year, c, h - (h // 28) * (1 - (29 // (h + 1)) * ((21 - g) // 11)) as i from e2),
e4 as (select year, i - ((year + year // 4 + i + 2 - c + c // 4) % 7) as l from e3),
e5 as (select year, make_date(year, 3 + (l + 40) // 44, l + 28 - 31 * ((3 + (l + 40) // 44) // 4)) as es from e4),
held as (select distinct d from (
  select make_date(year, 1, 1) as d from years union all select make_date(year, 1, 2) from years union all select make_date(year, 8, 1) from years union all select make_date(year, 12, 25) from years
  union all select es - 2 from e5 union all select es + 1 from e5 union all select es + 39 from e5 union all select es + 50 from e5
  union all select make_date(year, 9, 15) + ((7 - isodow(make_date(year, 9, 15)))::int % 7) + 1 from years)),
alld as (select d::date as day, isodow(d)::int as dow, d::date in (select d from held) as is_holiday from range(timestamp '1995-01-01', timestamp '2004-01-01', interval 1 day) r(d)),
offd as (select *, is_holiday or dow >= 6 as off from alld),
near as (select *, coalesce(lag(off) over (order by day), true) as ob, coalesce(lead(off) over (order by day), true) as oa from offd),
flags as (select *, (not off and ob and oa) as bridge, (not off and oa) as eve, month(day) in (7, 8) as vacation from near),
kinds as (select *, case when is_holiday then 'holiday' when dow = 7 then 'sunday' when dow = 6 then 'saturday' when bridge then 'bridge' when vacation and dow = 5 then 'vacation_friday'
  when vacation then 'vacation' when eve and dow < 5 then 'eve' when dow = 5 then 'friday' else 'weekday' end as kind from flags)
"""


def calendar(t):
    dim = daycal.dimension(t.spark, 1995, 2003).withColumn("vacation", F.month("day").isin(7, 8))
    return dim.withColumn("kind", daycal.day_type(F.col("dow"), F.col("is_holiday"), F.col("bridge"), F.col("eve"), F.col("vacation")))


@query(f"""
with {DAYS}
select kind, case when kind in ('holiday', 'sunday') then 'sunday_holiday' when kind = 'saturday' then 'saturday' else 'working' end as class3,
  count(*) as n, count(distinct day) as days, round(avg(o_totalprice), 2) as mean_price
from orders join kinds on o_orderdate::date = day group by 1, 2
""")
def q_day_type(t):
    facts = joins.lookup(dated_orders(t).select("day", "o_totalprice"), calendar(t).select("day", "kind"), ["day"], required=True)
    return facts.groupBy("kind", daycal.three_classes(F.col("kind")).alias("class3")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("day").alias("days"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"))


@query(f"""
select code as year_code, case when month(o_orderdate) = 12 and year(o_orderdate) = y.y then 13 else month(o_orderdate) % 12 + 1 end::int as month13, count(*) as n
from orders join {YEARS} y on o_orderdate::date between s and e group by all
""")
def q_fiscal_month(t):
    joined = joins.interval_join(dated_orders(t).select("day"), fiscal_years(t.spark), "day", how="inner")
    return joined.groupBy(F.col("code").alias("year_code"), daycal.period_month(F.col("day"), F.col("y")).cast("int").alias("month13")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with w as (select event_type, nullif(trim(case event_id % 4 when 0 then '' when 1 then props when 2 then substr(props, 6) else regexp_extract(props, '(\\d+)', 1) end), '') as raw from events)
select event_type, count(*) as n, count(raw) as there, count(*) filter (raw is not null and try_cast(raw as double) is null) as bad, sum(try_cast(raw as double))::bigint as total
from w group by event_type
""")
def q_strict_cast(t):
    kind = F.col("event_id") % 4
    raw = casts.blank_to_null(F.when(kind == 0, "").when(kind == 1, F.col("props")).when(kind == 2, F.expr("substring(props, 6)")).otherwise(F.regexp_extract("props", r"(\d+)", 1)))
    rows = t.events.select("event_type", raw.alias("raw"))
    value = casts.cast_or_null(F.col("raw"), "bigint")
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("raw").alias("there"), F.count_if(F.col("raw").isNotNull() & value.isNull()).alias("bad"), F.sum(value).alias("total")
    )


@query("""
select event_id, try_cast(regexp_extract(props, '(\\d+)', 1) as bigint) as k, try_cast(nullif(split_part(event_type || ':' || event_id::varchar || ':' || user_id::varchar, ':', 3), '') as bigint) as third
from events
""")
def q_json_prop(t):
    third = casts.token(F.concat_ws(":", "event_type", F.col("event_id").cast("string"), F.col("user_id").cast("string")), 3)
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), third.alias("third"))


@query("""
with c as (select *, count(*) over (partition by l_orderkey, l_linenumber) as copies from lineitem)
select copies, count(*) as rows_in, count(distinct (l_orderkey, l_linenumber)) as keys from c group by copies
""")
def q_dedup_audit(t):
    counted = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"))
    return counted.groupBy("copies").agg(F.sum("copies").alias("rows_in"), F.count(F.lit(1)).alias("keys"))


@query("""
with r as (select o_custkey, o_totalprice, o_orderdate, rank() over (partition by o_custkey order by o_orderdate desc) as r from orders)
select o_custkey, max(o_orderdate)::date as last_day, count(*) as n, round(avg(o_totalprice), 4) as mean_price from r where r = 1 group by o_custkey
""")
def q_latest_validity(t):
    """Only the latest rows of a key count: a maximum and a semi-sized join instead of a sort of all rows."""
    o = dated_orders(t).select("o_custkey", "o_orderdate", "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"))
    return o.withColumn("r", F.rank().over(w)).where("r = 1").groupBy("o_custkey").agg(F.to_date(F.max("o_orderdate")).alias("last_day"), F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("""
with d as (select o_orderpriority as p, o_orderdate::date as day, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1, 2)
select a.p as priority, a.day, a.n, b.n as n_lag, b.total as total_lag from d a left join d b on a.p = b.p and a.day = b.day + 2
""")
def q_lagged_join(t):
    daily = dated_orders(t).groupBy(F.col("o_orderpriority").alias("priority"), "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    old = daily.withColumnsRenamed({"n": "n_lag", "total": "total_lag"})
    return joins.lagged_join(daily.drop("total"), old, "day", ["priority"], 2)


@query("""
select (ts - interval 1 hour - (extract(minute from ts) || ' minutes')::interval - (extract(microseconds from ts) || ' microseconds')::interval)::timestamp as hour_utc, count(*) as n from events group by 1
""")
def q_utc_hour(t):
    return t.events.groupBy(joins.utc_hour(F.col("ts"), "Europe/Zurich").alias("hour_utc")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with d as (select event_type, ts::date as day, max(value) as top, round(sum(value), 4) as total from events group by 1, 2 having count(*) % 4 <> 0)
select event_type, day, top, total, case when lag(day) over w = day - 1 then lag(total) over w end as total_before, case when lead(day) over w = day + 1 then lead(total) over w end as total_after
from d window w as (partition by event_type order by day)
""")
def q_neighbour_days(t):
    rows = t.events.withColumn("day", F.to_date("ts"))
    daily = rows.groupBy("event_type", "day").agg(F.max("value").alias("top"), F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n")).where("n % 4 <> 0").drop("n")  # some days are missing
    return joins.neighbour_days(daily, "day", ["event_type"], ["total"])


@query("""
select least(a.n_name, b.n_name) as one, greatest(a.n_name, b.n_name) as two, count(*) as n, round(sum(l_extendedprice), 2) as total
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
join nation a on c_nationkey = a.n_nationkey join nation b on s_nationkey = b.n_nationkey group by 1, 2
""")
def q_role_playing(t):
    nation = t.nation.select("n_nationkey", "n_name")
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    lines = lines.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(joins.small(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")), "l_suppkey")
    lines = joins.lookup(lines, joins.role(nation, "n_nationkey", "c_nationkey", "from_"), ["c_nationkey"])
    lines = joins.lookup(lines, joins.role(nation, "n_nationkey", "s_nationkey", "to_"), ["s_nationkey"])
    one, two = joins.undirected(F.col("from_n_name"), F.col("to_n_name"))
    return lines.groupBy(one.alias("one"), two.alias("two")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""
with c as (select event_id, ts, ts::date as day from events where event_type = 'click'), p as (select ts, ts::date as day, value from events where event_type = 'purchase'),
j as (select c.event_id, count(*) as n, avg(value) as v from c join p on c.day = p.day and date_diff('microsecond', c.ts, p.ts) / 1e6 between 60 and 300 group by 1)
select c.day, count(*) as clicks, count(j.n) as met, coalesce(sum(j.n), 0)::bigint as pairs, round(count(j.n) / count(*)::double, 6) as share, round(avg(j.v), 4) as mean_value from c left join j using (event_id) group by c.day
""")
def q_band_connections(t):
    e = t.events.withColumn("day", F.to_date("ts"))
    clicks = e.where("event_type = 'click'").select("event_id", "ts", "day")
    bought = e.where("event_type = 'purchase'").select(F.col("ts").alias("bought"), "day", "value")
    met = joins.band_join(clicks, bought, ["day"], "ts", "bought", -300, -60).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    out = clicks.join(met, "event_id", "left").groupBy("day").agg(F.count(F.lit(1)).alias("clicks"), F.count("n").alias("met"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.round(F.avg("v"), 4).alias("mean_value"))
    return out.withColumn("share", F.round(F.col("met") / F.col("clicks"), 6))


@query("""
with e as (select event_id, ts, ts::date as day, event_type, user_id from events),
j as (select a.event_id, count(*) as freq, count(distinct b.event_type) as kinds, min(case when b.ts > a.ts then date_diff('microsecond', a.ts, b.ts) end) as wait
  from e a join e b on a.day = b.day and a.user_id % 5 = b.user_id % 5 and abs(date_diff('microsecond', a.ts, b.ts)) <= 1800000000 group by 1)
select event_id, freq, kinds, round(wait / 6e7, 4) as wait_min from j
""")
def q_band_frequency(t):
    """Counts by prefix sums and the next event by a sweep: no pair of events is made."""
    e = t.events.select("event_id", "ts", F.to_date("ts").alias("day"), "event_type", (F.col("user_id") % 5).alias("line"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    met = sweeps.band_counts(e, e, "event_id", ["day", "line"], "ts", "ts", -1800, 1800, "event_type", kinds)
    wait = sweeps.next_later(e, ["day", "line"], "ts", "wait").select("event_id", F.when(F.col("wait") <= 1_800_000_000, F.round(F.col("wait") / 6e7, 4)).alias("wait_min"))
    counts = [F.col(f"n_{i}") for i in range(len(kinds))]
    return met.select("event_id", sum(counts[1:], counts[0]).alias("freq"), sum(((c > 0).cast("bigint") for c in counts[1:]), (counts[0] > 0).cast("bigint")).alias("kinds")).join(wait, "event_id")


@query("""
with m as (select event_id, event_type, day(ts) as d, (hour(ts) * 60 + minute(ts))::int as minute from events), a as (select distinct event_type, minute // 75 * 75 + length(event_type) as anchor from m)
select m.event_id, m.minute, (select arg_min(a.anchor, (abs(a.anchor - m.minute), -a.anchor)) from a where a.event_type = m.event_type and abs(a.anchor - m.minute) <= 30)::int as anchor from m
""")
def q_nearest_anchor(t):
    rows = t.events.select("event_id", "event_type", F.dayofmonth("ts").alias("d"), casts.minute_of_day(F.col("ts")).alias("minute"))
    anchors = rows.select("event_type", (F.floor(F.col("minute") / 75).cast("int") * 75 + F.length("event_type")).alias("anchor")).distinct()
    return joins.nearest_value(rows, anchors, ["event_type"], "minute", "anchor", 30).select("event_id", "minute", "anchor")


@query("""
with h as (select c.c_custkey, c.c_mktsegment as seg, o_orderpriority as pri, o_orderstatus as st, o_totalprice as v, year(o_orderdate) as y from orders join customer c on o_custkey = c_custkey),
tr as (select * from h where y <= 1996), l0 as (select c_custkey, pri, st, avg(v) as m from tr group by all), l1 as (select c_custkey, pri, avg(v) as m from tr group by all), l2 as (select c_custkey, avg(v) as m from tr group by all),
l3 as (select seg, avg(v) as m from tr group by all), g as (select avg(v) as m from tr)
select level, count(*) as n, round(sum(abs(v - mean)), 2) as abs_error from (
  select v, coalesce(l0.m, l1.m, l2.m, l3.m, g.m) as mean, (case when l0.m is not null then 0 when l1.m is not null then 1 when l2.m is not null then 2 when l3.m is not null then 3 else 4 end)::int as level
  from h left join l0 using (c_custkey, pri, st) left join l1 using (c_custkey, pri) left join l2 using (c_custkey) left join l3 using (seg), g where y > 1996) group by level
""")
def q_cascade_mean(t):
    seg = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = t.orders.select("o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("y")).join(seg, "o_custkey")
    levels = [["o_custkey", "o_orderpriority", "o_orderstatus"], ["o_custkey", "o_orderpriority"], ["o_custkey"], ["c_mktsegment"]]
    out = joins.cascade_mean(rows.where("y > 1996"), rows.where("y <= 1996"), levels, "o_totalprice")
    return out.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs(F.col("o_totalprice") - F.col("mean"))), 2).alias("abs_error"))


@query("""
with l as (select distinct l_orderkey from lineitem)
select year(o_orderdate)::int as year, count(*) as n, count(l.l_orderkey) as with_lines, (count(*) - count(l.l_orderkey)) as orphans, round((count(*) - count(l.l_orderkey)) / count(*)::double, 6) as orphan_rate
from orders left join l on o_orderkey = l_orderkey group by 1
""")
def q_semi_anti_full(t):
    o = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("there", F.lit(1))
    joined = o.join(lines, "o_orderkey", "left").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("there").alias("with_lines"))
    return joined.withColumn("orphans", F.col("n") - F.col("with_lines")).withColumn("orphan_rate", F.round(F.col("orphans") / F.col("n"), 6))


@query("""
with o as (select o_custkey, o_totalprice, o_custkey % 40 as k from orders), d as (select s_suppkey as k, s_acctbal as bal from supplier where s_suppkey % 3 > 0)
select (d.k is null) as missing, count(*) as n, round(sum(coalesce(bal, 0)), 2) as bal, (select count(*) from (select l_orderkey, l_linenumber from lineitem group by all having count(*) > 1))::bigint as double_keys
from o left join d using (k) group by 1
""")
def q_lookup_guard(t):
    o = t.orders.select((F.col("o_custkey") % 40).alias("k"))
    dim = t.supplier.where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.lit(False).alias("missing"))
    facts = joins.lookup(o, dim, ["k"], fill={"bal": 0.0, "missing": True})
    double = t.lineitem.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.count(F.lit(1)).alias("double_keys"))
    return facts.groupBy("missing").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("bal"), 2).alias("bal")).crossJoin(F.broadcast(double))


@query("""
with v as (select n_nationkey as k, y::int as y, n_nationkey * 10 + y as val from nation, range(2000, 2004) t(y) where (n_nationkey + y) % 4 <> 0),
     f as (select k, arg_min(val, y) as val from v group by k), w as (select n_nationkey as k, y::int as y from nation, range(2000, 2004) t(y)),
     allv as (select k, y, val, false as synthetic from v union all select w.k, w.y, f.val, true from w join f using (k) anti join v using (k, y))
select y as year, count(*) as n, count(*) filter (synthetic) as synthetic, sum(val)::bigint as total from allv group by y
""")
def q_synthetic_rows(t):
    years = t.spark.range(2000, 2004).select(F.col("id").cast("int").alias("y"))
    wanted = t.nation.select(F.col("n_nationkey").alias("k")).crossJoin(F.broadcast(years))  # four years
    have = wanted.where("(k + y) % 4 <> 0").withColumn("val", (F.col("k") * 10 + F.col("y")).cast("bigint"))
    return joins.completed(have, wanted, ["k"], "y").groupBy(F.col("y").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if("synthetic").alias("synthetic"), F.sum("val").alias("total"))


@query("""
with r as (select c_nationkey as k, year(o_orderdate)::int as y, o_totalprice as v from orders join customer on o_custkey = c_custkey where (c_nationkey + year(o_orderdate)) % 5 <> 0),
m as (select k, y, round(avg(v), 4) as v from r group by all), l as (select k, max(y)::int as year, arg_max(v, y) as v from m group by k)
select l.k as nation, l.year, l.v, n_regionkey as region, round(avg(l.v) over (partition by n_regionkey), 3) as region_mean from l join nation on l.k = n_nationkey
""")
def q_latest_vintage(t):
    from pyspark.sql import Window

    rows = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"), "o_totalprice").join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").where("(c_nationkey + y) % 5 <> 0")
    means = rows.groupBy("c_nationkey", "y").agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    last = means.groupBy(F.col("c_nationkey").alias("nation")).agg(F.max("y").alias("year"), F.max_by("v", "y").alias("v"))
    last = joins.lookup(last, t.nation.select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")), ["nation"])
    return last.withColumn("region_mean", F.round(F.avg("v").over(Window.partitionBy("region")), 3))


@query("""
with f as (select o_orderkey, o_orderdate::date as day, case when o_totalprice > 200000 then 'high' else 'low' end as seg, o_custkey % 2 as dir from orders),
a as (select o_orderdate::date as day, round(avg(o_totalprice), 4) as va from orders where o_orderpriority = '1-URGENT' group by 1), b as (select o_orderdate::date as day, round(avg(o_totalprice), 4) as vb from orders where o_orderpriority = '5-LOW' group by 1)
select seg, (dir = 0)::boolean as down, count(*) as n, round(sum(case when seg = 'low' then va else vb end), 2) as local_sum, round(sum(case when dir = 0 then va else vb end), 2) as target_sum,
  sum(coalesce(case when seg = 'low' then va > 250000 else vb > 260000 end, false)::tinyint)::bigint as flagged
from f left join a using (day) left join b using (day) group by all
""")
def q_pick_source(t):
    o = dated_orders(t)
    series = o.groupBy("day").agg(F.round(F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))), 4).alias("va"), F.round(F.avg(F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice"))), 4).alias("vb"))
    f = o.select("day", F.when(F.col("o_totalprice") > 200000, "high").otherwise("low").alias("seg"), (F.col("o_custkey") % 2 == 0).alias("down")).join(joins.small(series), "day", "left")
    low = F.col("seg") == "low"
    flag = F.coalesce(F.when(low, F.col("va") > 250000).otherwise(F.col("vb") > 260000), F.lit(False))
    return f.groupBy("seg", "down").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(low, F.col("va")).otherwise(F.col("vb"))), 2).alias("local_sum"), F.round(F.sum(F.when(F.col("down"), F.col("va")).otherwise(F.col("vb"))), 2).alias("target_sum"), F.count_if(flag).alias("flagged")
    )


@query("""
select event_id, (ts::date + ((event_id * 7) % 24)::int * interval 1 hour + ((event_id * 13) % 60)::int * interval 1 minute) as dep,
  case when arr < dep then arr + interval 1 day else arr end as arr, (hour(ts) * 60 + minute(ts))::int as minute, (hour(ts) in (7, 8, 17, 18) and isodow(ts) < 6) as peak,
  case when event_type in ('click', 'view') then ts else ts::date::timestamp end as effective
from (select *, ts::date + ((event_id * 7) % 24)::int * interval 1 hour + ((event_id * 13) % 60)::int * interval 1 minute as dep, ts::date + ((event_id * 11) % 24)::int * interval 1 hour + ((event_id * 17) % 60)::int * interval 1 minute as arr from events)
""")
def q_time_roll(t):
    h = lambda k, m: ((F.col("event_id") * k) % m).cast("int")
    e = t.events.withColumn("day", F.to_date("ts"))
    e = e.withColumn("dep", casts.rolled_over(F.col("day"), h(7, 24), h(13, 60)))
    return e.select(
        "event_id", "dep", casts.rolled_over(F.col("day"), h(11, 24), h(17, 60), F.col("dep")).alias("arr"), casts.minute_of_day(F.col("ts")).alias("minute"), daycal.peak(F.col("ts"), [7, 8, 17, 18]).alias("peak"),
        casts.effective(F.col("ts"), F.col("day").cast("timestamp_ntz"), F.col("event_type"), ["click", "view"]).alias("effective"),
    )


@query("""
with j as (select l_linestatus as st, l_returnflag as rf, date_diff('microsecond', o_orderdate, l_shipdate) / 1e6 as d, l_discount as a, case when l_tax > 0.05 then l_tax end as b from lineitem join orders on l_orderkey = o_orderkey),
k as (select st, rf, case when st = 'F' then d end as d0, a, b from j)
select st, rf, count(*) as n, count(d0) as allowed, count(case when d0 >= -8640000 then d0 end) as kept, round(sum(a + coalesce(b, 0)), 4) as total_zero, sum((lower(rf) = 'r')::int)::bigint as returned from k group by all
""")
def q_delay_guard(t):
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    b = F.when(F.col("l_tax") > 0.05, F.col("l_tax"))
    raw = casts.guarded_delay(F.col("l_shipdate"), F.col("o_orderdate"), F.col("l_linestatus"), ["F"], -1e18)
    kept = casts.guarded_delay(F.col("l_shipdate"), F.col("o_orderdate"), F.col("l_linestatus"), ["F"], -8640000)
    flag = casts.is_true(F.when(F.lower("l_returnflag") == "r", "True").otherwise("no"))
    return rows.groupBy(F.col("l_linestatus").alias("st"), F.col("l_returnflag").alias("rf")).agg(
        F.count(F.lit(1)).alias("n"), F.count(raw).alias("allowed"), F.count(kept).alias("kept"), F.round(F.sum(casts.total_zero(F.col("l_discount"), b)), 4).alias("total_zero"), F.count_if(flag).alias("returned")
    )


@query("""
with y as (select 'H' || lpad((z % 100)::varchar, 2, '0') as code, z from range(1995, 2002) t(z))
select code, (case when z % 100 > 50 then 1900 else 2000 end + z % 100 - 1)::int as lagged, case when z - 2 < 1996 then 'imputed' else 'published' end as source, n, low, outage from y join (
  select year(o_orderdate) as z, count(*) as n, count(*) filter (o_custkey % 20 <= 10 and o_orderkey % 20 <= 10) as low, count(*) filter (o_orderdate::date between date '1997-03-01' and date '1997-03-20') as outage from orders group by 1) using (z)
""")
def q_vintage_map(t):
    o = dated_orders(t).withColumn("code", F.concat(F.lit("H"), F.lpad((F.year("day") % 100).cast("string"), 2, "0")))
    two = F.substring("code", 2, 2).cast("int")
    year = F.when(two > 50, 1900).otherwise(2000) + two
    segment = F.when((F.col("o_custkey") % 20 <= 10) & (F.col("o_orderkey") % 20 <= 10), "low").otherwise("high")
    marker = F.when(F.col("day").between("1997-03-01", "1997-03-20"), "outage").otherwise("published")
    return o.groupBy("code", (year - 1).cast("int").alias("lagged"), F.when(year - 2 < 1996, "imputed").otherwise("published").alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(segment == "low").alias("low"), F.count_if(marker == "outage").alias("outage")
    )


@query("""
with y as (select z from range(2005, 2026) t(z)), s as (select z,
  make_date(z, 12, 12) + ((6 - isodow(make_date(z, 12, 12)) + 7) % 7)::int as a, make_date(z + 1, 3, 15) - (isodow(make_date(z + 1, 3, 15)) % 7)::int as b from y),
o as (select (make_date(2005 + (o_custkey % 20)::int, month(o_orderdate), 1) + (day(o_orderdate) - 1)::int) as d, o_custkey % 3 as region from orders)
select z::int as season, a as first_day, b as last_day, count(d) as n, count(d) filter (region = 0) as r0, count(d) filter (region = 1) as r1 from s left join o on d between a and b group by all
""")
def q_season_calendar(t):
    first, last = daycal.season(F.col("season"))
    seasons = t.spark.range(2005, 2026).select(F.col("id").cast("int").alias("season")).withColumns({"first_day": first, "last_day": last}).withColumns({"start": F.col("first_day"), "end": F.col("last_day")})
    o = t.orders.select(F.date_add(F.make_date((F.col("o_custkey") % 20 + 2005).cast("int"), F.month("o_orderdate"), F.lit(1)), F.dayofmonth("o_orderdate") - 1).alias("day"), (F.col("o_custkey") % 3).alias("region"))
    n = joins.interval_join(o, seasons, "day", how="inner").groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("region") == 0).alias("r0"), F.count_if(F.col("region") == 1).alias("r1"))
    return seasons.drop("start", "end").join(n, "season", "left").fillna(0, ["n", "r0", "r1"])


@query(f"""
with {DAYS}, rules as (select * from (values (0, [1,2,3,4,5], false), (1, [6,7], true), (2, [5], false), (3, [1,2,3,4,5,6,7], true)) v(rule, dows, on_holiday)),
ok as (select rule, day from rules, alld where list_contains(dows, dow) and (on_holiday or not is_holiday))
select rule::int as rule, year(day)::int as year, count(distinct day) as days, count(o_orderkey) as orders from ok left join orders on o_orderdate::date = day and o_orderkey % 4 = rule group by all
""")
def q_template_calendar(t):
    """Rules as rows of (rule, weekday): the join with the calendar is an equi join on the weekday."""
    rules = t.spark.createDataFrame([(0, [1, 2, 3, 4, 5], False), (1, [6, 7], True), (2, [5], False), (3, [1, 2, 3, 4, 5, 6, 7], True)], "rule int, dows array<int>, on_holiday boolean")
    days = daycal.dimension(t.spark, 1995, 2003)
    ok = days.join(F.broadcast(rules.withColumn("dow", F.explode("dows"))), "dow").where("on_holiday or not is_holiday").select("rule", "day")
    o = dated_orders(t).select("day", (F.col("o_orderkey") % 4).cast("int").alias("rule"), "o_orderkey")
    return ok.join(o, ["day", "rule"], "left").groupBy("rule", F.year("day").alias("year")).agg(F.count_distinct("day").alias("days"), F.count("o_orderkey").alias("orders"))
