"""Calendar expressions and date dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_easter(years: DataFrame, year: str = "year") -> DataFrame:
    """``years`` with easter: Gregorian Easter Sunday in integer arithmetic, step by step, so that no step's code is copied into the next."""
    i = lambda c: F.floor(c).cast("int")
    y, kept = F.col(year), years.columns
    out = years.withColumns({"_golden": y % 19, "_century": i(y / 100)})
    out = out.withColumn("_moon", (F.col("_century") - i(F.col("_century") / 4) - i((F.col("_century") * 8 + 13) / 25) + F.col("_golden") * 19 + 15) % 30)
    late = i(F.col("_moon") / 28) * (F.lit(1) - i(F.lit(29) / (F.col("_moon") + 1)) * i((F.lit(21) - F.col("_golden")) / 11))
    out = out.withColumn("_full", F.col("_moon") - late)
    out = out.withColumn("_offset", F.col("_full") - (y + i(y / 4) + F.col("_full") + 2 - F.col("_century") + i(F.col("_century") / 4)) % 7)
    out = out.withColumn("_month", i((F.col("_offset") + 40) / 44) + 3)
    return out.select(*kept, F.make_date(y, F.col("_month"), F.col("_offset") + 28 - i(F.col("_month") / 4) * 31).alias("easter"))


def first_weekday_from(day: Column, name: str) -> Column:
    """The first given weekday on or after a day."""
    return F.next_day(F.date_sub(day, 1), name)


def last_weekday_until(day: Column, name: str) -> Column:
    """The last given weekday on or before a day."""
    return F.next_day(F.date_sub(day, 7), name)


def fast_monday(year: Column) -> Column:
    """The Monday after the third Sunday of September."""
    return F.date_add(first_weekday_from(F.make_date(year, F.lit(9), F.lit(15)), "Sun"), 1)


def holidays(years: DataFrame) -> DataFrame:
    """day, holiday for each year of ``years`` (year int)."""
    y, e = F.col("year"), F.col("easter")
    named = [("new_year", F.make_date(y, F.lit(1), F.lit(1))), ("second_january", F.make_date(y, F.lit(1), F.lit(2)))]
    named += [("good_friday", F.date_sub(e, 2)), ("easter_monday", F.date_add(e, 1)), ("ascension", F.date_add(e, 39)), ("whit_monday", F.date_add(e, 50))]
    named += [("national_day", F.make_date(y, F.lit(8), F.lit(1))), ("fast_monday", fast_monday(y)), ("christmas", F.make_date(y, F.lit(12), F.lit(25)))]
    return with_easter(years).select(F.inline(F.array(*(F.struct(d.alias("day"), F.lit(n).alias("holiday")) for n, d in named))))


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row for each day."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def expanded(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row for each day of each [start, end]."""
    return spans.withColumn("day", F.explode(F.sequence(start, end)))


def span_counts(spans: DataFrame, by: str) -> DataFrame:
    """For each day the number of spans, whether any of each class of ``by`` runs, and the sorted names."""
    return expanded(spans).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(by).alias("classes"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))


def school_leave(years: DataFrame) -> DataFrame:
    """kind, start, end of the school leave of each timetable year, from its parameters (one row a year).

    Given are the first days of the summer, autumn, winter and spring leave and their lengths in weeks; a leave runs from
    the Saturday on or before its first day to the Sunday that ends it. The short leave in February is the week after its
    first Monday.
    """
    def leave(kind: str, first: Column, weeks: Column) -> Column:
        start = last_weekday_until(first, "Sat")
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), F.date_add(start, (weeks * 7 + 1).cast("int")).alias("end"))

    kinds = [leave(k, F.col(f"{k}_first"), F.col(f"{k}_weeks")) for k in ("summer", "autumn", "winter", "spring")]
    february = first_weekday_from(F.make_date(F.year("spring_first"), F.lit(2), F.lit(1)), "Mon")
    kinds.append(leave("february", february, F.lit(1)))
    return years.select("year", F.inline(F.array(*kinds)))


def school_year(day: Column, start_month: int = 8) -> Column:
    """School year of a day as ``2023/24``; it opens in ``start_month``."""
    first = F.year(day) - F.when(F.month(day) < start_month, 1).otherwise(0)
    return F.concat(first.cast("string"), F.lit("/"), F.lpad(((first + 1) % 100).cast("string"), 2, "0"))


def marked(dim: DataFrame, marks: DataFrame, day: str = "day") -> DataFrame:
    """``dim`` with one flag for each marker name of ``marks`` (marker, day): a literal handful of markers."""
    names = sorted(r[0] for r in marks.select("marker").distinct().collect())
    flags = marks.groupBy(day).pivot("marker", names).agg(F.lit(True))
    return dim.join(F.broadcast(flags), day, "left").fillna(False, names)


def regional_flags(days_: DataFrame, regions: DataFrame, day: str = "day") -> DataFrame:
    """For each day the number of regions on leave and on holiday, and whether each kind holds anywhere.

    ``regions`` has region, kind (``leave`` or ``holiday``), start, end; a region counts once a day however many spans it has.
    """
    active = expanded(regions).select(day, "region", "kind").distinct()
    count = lambda k: F.count_if(F.col("kind") == k)
    sums = active.groupBy(day).agg(count("leave").alias("n_leave"), count("holiday").alias("n_holiday"))
    out = days_.join(sums, day, "left").fillna(0, ["n_leave", "n_holiday"])
    return out.withColumns({"any_leave": F.col("n_leave") > 0, "any_holiday": F.col("n_holiday") > 0})


def dimension(spark: SparkSession, first_year: int, last_year: int, spans: DataFrame | None = None) -> DataFrame:
    """Date dimension: weekday (1 Monday), holiday name and flag, non-working, bridge, eve and after flags, and running spans."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    held = holidays(years).groupBy("day").agg(F.array_join(F.array_sort(F.collect_set("holiday")), "|").alias("holiday"))
    out = days(spark, f"{first_year}-01-01", f"{last_year}-12-31").join(F.broadcast(held), "day", "left")
    out = out.withColumn("dow", F.weekday("day") + 1).withColumn("is_holiday", F.col("holiday").isNotNull())
    out = out.withColumn("off", F.col("is_holiday") | (F.col("dow") >= 6))
    out = neighbours(out, "off").withColumn("bridge", ~F.col("off") & F.col("off_before") & F.col("off_after"))
    out = out.withColumn("eve", ~F.col("off") & F.col("off_after")).withColumn("after", ~F.col("off") & F.col("off_before"))
    if spans is not None:
        out = out.join(span_counts(spans, "kind"), "day", "left").fillna({"n": 0, "classes": 0, "names": ""})
    return out


def neighbours(dim: DataFrame, flag: str) -> DataFrame:
    """The flag of the day before and after (true beyond the ends). A date dimension has a row for each day, so one window will do."""
    w = Window.partitionBy(F.lit(0)).orderBy("day")
    return dim.withColumns({f"{flag}_before": F.coalesce(F.lag(flag).over(w), F.lit(True)), f"{flag}_after": F.coalesce(F.lead(flag).over(w), F.lit(True))})


def day_type(dow: Column, holiday: Column, bridge: Column, eve: Column, vacation: Column) -> Column:
    """Nine classes, the first that holds."""
    return (
        F.when(holiday, "holiday").when(dow == 7, "sunday").when(dow == 6, "saturday").when(bridge, "bridge").when(vacation & (dow == 5), "vacation_friday").when(vacation, "vacation")
        .when(eve & (dow < 5), "eve").when(dow == 5, "friday").otherwise("weekday")
    )


def three_classes(kind: Column) -> Column:
    """The nine classes collapsed to working, saturday, sunday_holiday."""
    return F.when(kind.isin("holiday", "sunday"), "sunday_holiday").when(kind == "saturday", "saturday").when(kind.isNotNull(), "working")


def plain_day_type(day: Column, holiday: Column) -> Column:
    """Three classes straight from weekday and holiday."""
    dow = F.weekday(day) + 1
    return F.when(F.coalesce(holiday, F.lit(False)) | (dow == 7), "sunday_holiday").when(dow == 6, "saturday").otherwise("working")


def period_month(day: Column, closing_year: Column) -> Column:
    """Month 1 to 13 of a timetable year that opens in mid-December: its first December is 1, its closing one 13."""
    return F.when((F.month(day) == 12) & (F.year(day) == closing_year), 13).otherwise(F.month(day) % 12 + 1)


def peak(t: Column, hours: list[int]) -> Column:
    """Whether a time is in the peak hours of a working weekday."""
    return F.hour(t).isin(hours) & (F.weekday(t) < 5)


def season(year: Column) -> tuple[Column, Column]:
    """Winter season that opens in ``year``: first Saturday from 12 December to last Sunday until 15 March."""
    return first_weekday_from(F.make_date(year, F.lit(12), F.lit(12)), "Sat"), last_weekday_until(F.make_date(year + 1, F.lit(3), F.lit(15)), "Sun")
