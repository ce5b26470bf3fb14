"""Lines as ordered stations, and places near each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import band, cell, haversine, near_cells
from .joins import small


def path_legs(rows: DataFrame, lines: DataFrame, year: str, origin: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(legs, orphans) of rows that travel from origin to target on their year's line (``year``, stations array).

    Legs run in travel direction with their sequence number; the same station twice gives no leg; a station that the
    line lacks gives an orphan with its reason.
    """
    placed = rows.join(small(lines), year, "left")
    placed = placed.withColumns({"_a": F.array_position("stations", F.col(origin)), "_b": F.array_position("stations", F.col(target))})
    reason = F.when(F.col("stations").isNull(), "no line").when(F.col("_a") == 0, "origin not on line").when(F.col("_b") == 0, "target not on line")
    placed = placed.withColumn("reason", reason)
    up = F.slice("stations", F.col("_a"), F.col("_b") - F.col("_a") + 1)
    down = F.reverse(F.slice("stations", F.col("_b"), F.col("_a") - F.col("_b") + 1))
    path = F.when(F.col("_a") < F.col("_b"), up).otherwise(down)
    pairs = F.transform(F.sequence(F.lit(1), F.size("_path") - 1), lambda i: F.struct(i.alias("seq"), F.element_at("_path", i).alias("leg_from"), F.element_at("_path", i + 1).alias("leg_to")))
    good = placed.where("reason is null and _a <> _b").withColumn("_path", path)
    return good.select(*rows.columns, F.inline(pairs)), placed.where("reason is not null").select(*rows.columns, "reason")


def ordered_legs(rows: DataFrame, order_from: str, order_to: str) -> DataFrame:
    """Rows for each elementary leg between two orders on a line, whatever the direction: leg = order of its lower end."""
    low, high = F.least(order_from, order_to), F.greatest(order_from, order_to)
    return rows.where(F.col(order_from) != F.col(order_to)).withColumn("leg", F.explode(F.sequence(low, high - 1)))


def within_radius(points: DataFrame, stations: DataFrame, radius: float, lon: str = "lon", lat: str = "lat", on: list[str] | None = None) -> DataFrame:
    """Pairs of a point and a station (id, s_lon, s_lat) at most ``radius`` metres apart, with metres; ``on`` columns are equal
    (a year: stations then are those active in it).

    Both are cut into grid cells by bands of latitude, stations go to the cells around, also near the poles and over the
    date line: an equi join however large both sides grow.
    """
    x, y = cell(F.col(lon), F.col(lat), radius)
    near = stations.withColumn("_y", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: band(F.col("s_lat"), radius) + i)))
    near = near.withColumn("_x", F.explode(near_cells(F.col("s_lon"), F.col("_y"), radius)))
    pairs = points.withColumns({"_x": x, "_y": y}).join(small(near), [*(on or []), "_x", "_y"]).drop("_x", "_y")
    return pairs.withColumn("metres", haversine(F.col(lon), F.col(lat), F.col("s_lon"), F.col("s_lat"))).where(F.col("metres") <= radius)


def nearest_station(points: DataFrame, stations: DataFrame, key: list[str], radius: float, on: list[str] | None = None) -> DataFrame:
    """Each point's nearest station within ``radius`` (ties: least id); points without one are left out.

    Distinct places of points meet distinct places of stations, each with its least id; points then look up their place.
    """
    place = [*(on or []), "lon", "lat"]
    heads = stations.groupBy(*(on or []), "s_lon", "s_lat").agg(F.min("id").alias("id"))
    pairs = within_radius(points.select(*place).distinct(), heads, radius, on=on)
    best = pairs.groupBy(*place).agg(F.min_by(F.struct("id", "metres"), F.struct("metres", "id")).alias("_n"))
    return points.join(best, place).groupBy(*key).agg(F.min_by("_n", F.struct("_n.metres", "_n.id")).alias("_n")).select(*key, "_n.id", "_n.metres")


def radius_counts(points: DataFrame, stations: DataFrame, radii: dict[str, float], lon: str = "lon", lat: str = "lat", on: list[str] | None = None) -> DataFrame:
    """id, a count of points within each radius by its name, and nearest (metres), of each station with a point within the largest.

    Points and stations are counted by place first and only distinct places are paired, so copies of a place cost one
    row; each station then takes the sums of its place.
    """
    on, reach = on or [], max(radii.values())
    places = points.groupBy(*on, lon, lat).agg(F.count(F.lit(1)).alias("_points"))
    pairs = within_radius(places, stations.select(*on, "s_lon", "s_lat").distinct(), reach, lon, lat, on)
    within = {name: F.coalesce(F.sum(F.when(F.col("metres") <= radius, F.col("_points"))), F.lit(0)) for name, radius in radii.items()}
    sums = pairs.groupBy(*on, "s_lon", "s_lat").agg(*(c.alias(name) for name, c in within.items()), F.min("metres").alias("nearest"))
    found = stations.join(sums, [*on, "s_lon", "s_lat"])
    return found.groupBy(*on, "id").agg(*(F.sum(name).alias(name) for name in radii), F.min("nearest").alias("nearest"))


def leg_templates(stops: DataFrame, service: list[str], trip: list[str], time: str, station: str, place: str) -> DataFrame:
    """Distinct legs of each service: seq, leg_from, leg_to, direction (by the stations' order ``place`` on the line).

    Stops of a trip that follow each other at one station are one; equal legs of a service's trips give one template.
    """
    w = Window.partitionBy(*service, *trip).orderBy(time)
    kept = stops.withColumn("_last", F.lag(station).over(w)).where(~F.col(station).eqNullSafe(F.col("_last")) | F.col("_last").isNull())
    legs = kept.select(*service, F.row_number().over(w).alias("seq"), F.col(station).alias("leg_from"), F.lead(station).over(w).alias("leg_to"), F.col(place).alias("_a"), F.lead(place).over(w).alias("_b"))
    direction = F.when(F.col("_b") > F.col("_a"), "up").otherwise("down")
    return legs.where("leg_to is not null").select(*service, "seq", "leg_from", "leg_to", direction.alias("direction")).distinct()


def platform_centroids(stops: DataFrame, platforms: DataFrame, key: str, valid: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``stops`` with the mean place of their valid platforms that have one, their number, and ``located``; stops without any keep null and 0.

    A stop's platforms are summed before the join, so a stop with very many of them costs one row.
    """
    good = platforms.where(valid & F.col(lon).isNotNull() & F.col(lat).isNotNull())
    means = good.groupBy(key).agg(F.avg(lon).alias("lon"), F.avg(lat).alias("lat"), F.count(F.lit(1)).alias("platforms"))
    return stops.join(means, key, "left").fillna(0, ["platforms"]).withColumn("located", F.col("platforms") > 0)
