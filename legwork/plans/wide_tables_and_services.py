"""Queries over wide tables, service days, sweeps, stages and guarded lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import daycal
from ..functions.storage import new_folder, stored
from ..operators import joins, services, sweeps, topology, wide
from ..sources import files
from .calendar_and_joins import DAYS
from .registry import query


def n():
    return F.count(F.lit(1)).alias("n")


#: Columns of a wide table over lineitem; both engines read these expressions.
NUMBERS = [
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "cast(l_linenumber as double)", "case when l_linenumber > 2 then l_discount end",
    "cast(l_partkey % 101 as double)", "cast(l_suppkey % 7 as double)", "l_quantity * l_discount", "case when l_linenumber <> 3 then l_quantity end", "l_quantity + 0", "case when l_linenumber <> 3 then l_quantity + 0 end",
]
PAIRS = [(i, j) for i in range(len(NUMBERS)) for j in range(i + 1, len(NUMBERS))]


@query(
    f"with d as (select {', '.join(f'{e} as c{i}' for i, e in enumerate(NUMBERS))} from lineitem), p as ("
    + " union all ".join(f"select 'c{i}' as one, 'c{j}' as two, corr(c{i}, c{j}) filter (c{i} is not null and c{j} is not null) as r, count(*) filter (c{i} is not null and c{j} is not null) as n, count(*) filter (c{i} is distinct from c{j}) = 0 as duplicate from d" for i, j in PAIRS)
    + ") select one, two, round(r, 6) as r, n, duplicate from p"
)
def q_corr_wide(t):
    """Pairwise correlations and exact duplicates of twelve columns in one pass, null wherever a column is."""
    d = t.lineitem.selectExpr(*(f"{e} as c{i}" for i, e in enumerate(NUMBERS)))
    return wide.correlations(d, d.columns).withColumn("r", F.round("r", 6))


#: 209 columns: 36 numbers of growing range with nulls, as many with few values, and so on by their number.
WIDE = [f"case when (l_orderkey + {k}) % {11 + k % 7} > 0 then cast((l_partkey * {k + 1} + l_linenumber) % {2 + k * k % 997} as bigint) end" for k in range(209)]


@query(
    f"with d as (select {', '.join(f'{e} as w{i}' for i, e in enumerate(WIDE))} from lineitem) "
    + " union all ".join(f"select 'w{i}' as \"column\", count(*) as rows, count(*) - count(w{i}) as nulls, count(distinct w{i}) as \"distinct\", min(w{i})::varchar as low, max(w{i})::varchar as high from d" for i in range(len(WIDE)))
)
def q_codebook_wide(t):
    """A codebook of 209 columns: ends by blocks of columns, distinct values counted in two levels."""
    return wide.codebook(t.lineitem.selectExpr(*(f"{e} as w{i}" for i, e in enumerate(WIDE)))).drop("kind")


@query(
    f"with d as (select l_orderkey as k, {', '.join(f'{e} as w{i}' for i, e in enumerate(WIDE))} from lineitem), "
    f"g as (select k, {', '.join(f'count(distinct w{i}) as d{i}, (count(w{i}) < count(*))::int as z{i}' for i in range(0, len(WIDE), 8))} from d group by k) "
    + " union all ".join(f"select 'w{i}' as \"column\", count(*) as groups, count(*) filter (d{i} + z{i} <= 1) as constant, count(*) filter (d{i} <= 1) as constant_known from g" for i in range(0, len(WIDE), 8))
)
def q_constant_wide(t):
    """How many orders have one value only, for every eighth of the wide columns: the few columns they are made of are dealt by order, so ends are never shuffled."""
    chosen = range(0, len(WIDE), 8)
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber").repartition("l_orderkey")
    return wide.constant_shares(lines.selectExpr("l_orderkey as k", *(f"{WIDE[i]} as w{i}" for i in chosen)), ["k"], [f"w{i}" for i in chosen])


@query("select p_partkey as part, ((p_partkey - 1) % 3 + 1) as label from part")
def q_component_chains(t):
    """Three chains as long as a third of all parts, each linked to the part three numbers before: components by contraction."""
    edges = t.part.select(F.col("p_partkey").alias("part"), F.greatest(F.col("p_partkey") - 3, (F.col("p_partkey") - 1) % 3 + 1).alias("before"))
    return sweeps.components(edges, "part", "before")[0]


SERVICES = """
per as (select p::int as period, make_date(1994 + p, 12, 15) as s, make_date(1995 + p, 12, 14) as e from range(1, 6) r(p)),
tr as (select c_custkey as trip, (c_custkey % 7)::int as kind, period, s, e, c_nationkey % 4 = 0 as symbol_a,
  (1 + c_custkey % 12)::int as m, (1 + c_custkey % 28)::int as d, (1 + c_custkey * 5 % 12)::int as m2, (1 + c_custkey * 11 % 28)::int as d2 from customer join per on period = 1 + c_custkey % 5),
da as (select *, case when make_date(year(s), m, d) >= s then make_date(year(s), m, d) else make_date(year(e), m, d) end as c1, case when make_date(year(s), m2, d2) >= s then make_date(year(s), m2, d2) else make_date(year(e), m2, d2) end as c2 from tr),
db as (select * exclude (c1, c2), case when c1 <= e then c1 end as x1, case when c2 <= e then c2 end as x2 from da),
dc as (select *, case when x2 < x1 then x2 + interval 1 year else x2 end::date as z2 from db),
ok as (select trip, kind, day, dow from dc join alld on day between s and e where (not symbol_a or (dow < 6 and not is_holiday)) and case kind
  when 0 then (dow in (5, 6) and not is_holiday) when 1 then (dow < 6 and not is_holiday and day is distinct from x1) when 2 then (dow in (5, 6) or coalesce(day = x1, false))
  when 3 then (dow in (5, 6) and coalesce(day between x1 and z2, false)) when 4 then dow < 6 when 5 then (dow >= 6 or is_holiday) else true end)
"""


def service_trips(t):
    """Customers as trips of five timetable periods: period bounds, note (label, text) and symbols, by their number."""
    key = F.col("c_custkey")
    period = (key % 5 + 1).cast("int")
    day = lambda d, m: F.concat(d.cast("string"), F.lit("."), m.cast("string"), F.lit("."))
    one, two = day(key % 28 + 1, key % 12 + 1), day(key * 11 % 28 + 1, key * 5 % 12 + 1)
    kind = (key % 7).cast("int")
    note = (
        F.when(kind == 0, F.lit("sauf fêtes générales")).when(kind == 1, F.concat(F.lit("sauf "), one)).when(kind == 2, F.concat(F.lit("ainsi que "), one))
        .when(kind == 3, F.concat(F.lit("du "), one, F.lit(" - "), two)).when(kind == 4, F.lit("")).when(kind == 6, F.concat(F.lit("circule aussi "), one))
    )
    label = F.when(kind == 0, "16").when(kind == 1, "12").when(kind == 2, "17").when(kind == 3, "18").when(kind == 4, "10").otherwise("30")
    symbol = F.concat_ws("|", F.when(kind == 5, "C"), F.when(F.col("c_nationkey") % 4 == 0, "A"))
    return t.customer.select(key.alias("trip"), kind.alias("kind"), period.alias("period"), F.make_date(period + 1994, F.lit(12), F.lit(15)).alias("start"), F.make_date(period + 1995, F.lit(12), F.lit(14)).alias("end"), note.alias("text"), label.alias("label"), symbol.alias("symbol"))


def service_days(t):
    """The trips with the bitmap of their days: notes and symbols as rules, rules as bitmaps, and their intersection."""
    trips = service_trips(t)
    spans = trips.select("period", "start", "end").distinct()
    calendar = daycal.dimension(t.spark, 1995, 2001).join(F.broadcast(spans), F.col("day").between(F.col("start"), F.col("end"))).select("period", "day", "dow", "is_holiday")  # five periods
    masks = stored(services.period_masks(calendar, "period"))
    noted = services.note_rules(trips.where("text is not null").select("trip", "period", "start", "end", "label", "text").withColumn("rule", F.lit("note")))
    stops = trips.select("trip", F.lit(1).alias("place"), F.when(F.col("text").isNotNull(), F.lit("note")).alias("refs"), "symbol")
    marked = services.service_markers(stops, ["trip"], "refs", "symbol")
    signs = services.symbol_rules(marked.join(trips.select("trip", "period"), "trip").select("trip", "period", F.explode("symbols").alias("rule")), "rule")
    columns = ["trip", "period", "rule", "kind", "weekdays", "holidays", "include", "exclude", "required", "parsed"]
    rules = services.rule_bitmaps(noted.select(*columns).unionByName(signs.select(*columns)), masks, "period")
    markers = marked.select("trip", F.explode(F.concat("note_refs", "symbols")).alias("rule"))
    return services.trip_bitmaps(trips.select("trip", "kind", "period").join(marked.select("trip", "validity"), "trip"), markers, rules, masks, ["trip"], ["trip", "rule"], "period")


@query(f"with {DAYS}, {SERVICES} select kind, dow, year(day)::int as year, count(*) as days, count(distinct trip) as trips, min(day) as first_day, max(day) as last_day from ok group by all")
def q_service_days(t):
    """Days of service by kind of note: weekdays, holidays and dates; included, excluded and required."""
    days = service_days(t).select("trip", "kind", F.explode(services.days_of(F.col("bits"), F.col("first"))).alias("day"))
    return days.groupBy("kind", (F.weekday("day") + 1).alias("dow"), F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("days"), F.count_distinct("trip").alias("trips"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(f"""
with {DAYS}, {SERVICES}, leg as (select c_custkey as trip, seq::int as seq, ((c_custkey * 37 + seq * 25) % 1440)::int as dep, ((c_custkey * 37 + seq * 25 + 10 + c_custkey % 30) % 1440)::int as arr from customer, range(3) s(seq)),
dated as (select kind, seq, arr < dep as over, day + to_minutes(dep) as departure, day + to_minutes(arr + case when arr < dep then 1440 else 0 end) as arrival from ok join leg using (trip))
select kind, seq, month(arrival)::int as month, count(*) as n, count(*) filter (over) as overnight, min(departure) as first_departure, max(arrival) as last_arrival, round(avg(date_diff('minute', departure, arrival)), 4) as minutes from dated group by all
""")
def q_service_legs(t):
    """Timestamped legs of every trip on its days; those past midnight arrive on the next."""
    legs = t.customer.select(F.col("c_custkey").alias("trip"), F.explode(F.array(*map(F.lit, range(3)))).alias("seq"))
    at = F.col("trip") * 37 + F.col("seq") * 25
    legs = legs.withColumns({"dep": (at % 1440).cast("int"), "arr": ((at + F.col("trip") % 30 + 10) % 1440).cast("int")})
    out = services.dated_legs(legs, service_days(t).select("trip", "kind", "first", "bits"), ["trip"], "dep", "arr").join(service_trips(t).select("trip", "kind"), "trip")
    minutes = F.timestamp_diff("MINUTE", F.col("departure"), F.col("arrival"))
    return out.groupBy("kind", "seq", F.month("arrival").alias("month")).agg(n(), F.sum("day_offset").alias("overnight"), F.min("departure").alias("first_departure"), F.max("arrival").alias("last_arrival"), F.round(F.avg(minutes), 4).alias("minutes"))


@query("""
with y as (select z::int as z from range(1992, 1999) t(z)), r as (select distinct n_regionkey as region from nation),
s as (select region, z, make_date(z, 12, 12) + ((6 - isodow(make_date(z, 12, 12)) + 7) % 7)::int as a, make_date(z + 1, 3, 15) - (isodow(make_date(z + 1, 3, 15)) % 7)::int as b from y, r),
o as (select n_regionkey as region, make_date((1992 + s_suppkey % 7)::int, 12, 1) + (s_suppkey * 7 % 100)::int as a, make_date((1992 + s_suppkey % 7)::int, 12, 1) + (s_suppkey * 7 % 100 + s_suppkey % 9 - 1)::int as b from supplier join nation on s_nationkey = n_nationkey),
od as (select distinct region, unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as day from o where a <= b),
sd as (select region, z, unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as day from s),
d as (select region, null::int as season, 'official' as source, day from od union all select region, z, 'rebuilt', day from sd anti join od using (region, day)),
g as (select *, day - (row_number() over (partition by region, season, source order by day))::int as grp from d)
select region, season, source, min(day) as start, max(day) as "end", count(*) as days from g group by region, season, source, grp
""")
def q_official_seasons(t):
    """Rebuilt winter seasons give way to official periods, which overlap: their union, and what is left of each season."""
    first, last = daycal.season(F.col("season"))
    seasons = t.spark.range(1992, 1999).select(F.col("id").cast("int").alias("season")).crossJoin(F.broadcast(t.nation.select(F.col("n_regionkey").alias("region")).distinct()))  # seven seasons, five regions
    seasons = seasons.select("region", "season", first.alias("start"), last.alias("end"))
    base = F.date_add(F.make_date((F.col("s_suppkey") % 7 + 1992).cast("int"), F.lit(12), F.lit(1)), (F.col("s_suppkey") * 7 % 100).cast("int"))
    nation = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    official = t.supplier.join(F.broadcast(nation), "s_nationkey").select("region", base.alias("start"), F.date_add(base, (F.col("s_suppkey") % 9 - 1).cast("int")).alias("end"))
    out = sweeps.merged_spans(official, ["region"]).select("region", F.lit(None).cast("int").alias("season"), F.lit("official").alias("source"), "start", "end")
    out = out.unionByName(sweeps.subtracted(seasons, official, ["region"]).select("region", "season", F.lit("rebuilt").alias("source"), "start", "end"))
    return out.withColumn("days", F.datediff("end", "start") + 1)


@query("select year(o_orderdate)::int as year, count(*) as n, sum(o_custkey)::bigint as customers, count(*) filter (o_orderstatus = 'F') as finished, 2::bigint as versions from orders group by 1")
def q_stage_versions(t):
    """A stage written three times, each version in place of the one before; what the pointer names is read."""
    stage = new_folder(t.spark, "stage")
    for part in (t.orders.where("o_orderstatus = 'F'"), t.orders.where("o_orderstatus <> 'F'"), t.orders):
        files.write_stage(part, stage, grace=0)
    kept = len(files.versions(t.spark, stage))
    return files.read_stage(t.spark, stage).groupBy(F.year("o_orderdate").alias("year")).agg(n(), F.sum("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("finished")).withColumn("versions", F.lit(kept).cast("long"))


@query("""
with j as (select c_mktsegment as seg, n_name as nation from orders join (select * from customer where c_custkey % 9 > 0) on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey union all
  select null, null from orders where o_custkey % 9 = 0 or o_custkey not in (select c_custkey from customer))
select seg, nation, count(*) as n, (select count(*) from orders) as rows_in, (select count(*) from j) as rows_out, 1::bigint as most, (select count(*) from j where seg is null) as unmatched from j group by all
""")
def q_guarded_lookup(t):
    """Two lookups with their guards counted in the job that writes the rows."""
    customers = t.customer.where("c_custkey % 9 > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("k"))
    rows, first = joins.guarded_lookup(t.orders.select("o_orderkey", "o_custkey"), customers, ["o_custkey"])
    rows, second = joins.guarded_lookup(rows, t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation")), ["k"])
    done = stored(rows)
    seen = first.check()
    second.check()
    return done.groupBy("seg", "nation").agg(n()).withColumns({c: F.lit(seen[c]).cast("long") for c in ("rows_in", "rows_out", "most", "unmatched")})


@query("""
with g as (select o_custkey as k, avg(o_totalprice / 1000) as lon, avg(lat_) as lat, count(*) as platforms from (select *, o_orderkey % 90 as lat_ from orders) where o_orderstatus = 'F' and o_orderkey % 4 > 0 group by 1)
select c_custkey as stop, round(lon, 5) as lon, round(lat, 5) as lat, coalesce(platforms, 0) as platforms, platforms is not null as located from customer left join g on k = c_custkey
""")
def q_platform_centroids(t):
    """Stops at the mean place of their validated platforms; a platform without coordinates doesn't count."""
    lon = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice") / 1000)
    platforms = t.orders.select(F.col("o_custkey").alias("stop"), F.col("o_orderstatus").alias("status"), lon.alias("lon"), (F.col("o_orderkey") % 90).cast("double").alias("lat"))
    out = topology.platform_centroids(t.customer.select(F.col("c_custkey").alias("stop")), platforms, "stop", F.col("status") == "F")
    return out.select("stop", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), "platforms", "located")
