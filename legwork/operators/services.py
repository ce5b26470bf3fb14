"""Service days of trips: notes and symbols read as rules, rules as day bitmaps, trips as timestamped legs on their days.

A bitmap is an array of 64-bit words, one bit for each day of a timetable period from its first day on (six words a
year). Rules, their combinations and a trip's days are set algebra on such words, so a trip stays one row until its
days are wanted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain
from .joins import small

WORD = 64

# What the labels of notes mean where their text doesn't say it, by kind of note; weekdays from 1 (Monday).
LABELS = {
    "also": {"17": [5, 6], "20": [6, 7], "21": [6, 7]},
    "empty": {"10": [1, 2, 3, 4, 5], "11": [6, 7], "15": [5, 6], "16": [1, 2, 3, 4, 7]},
    "period": {"15": [1, 2, 3, 4, 7], "16": [5, 6], "17": [1, 2, 3, 4, 7], "18": [5, 6], "20": [1, 2, 3, 4, 7], "21": [5, 6]},
    "not_holidays": {"16": [5, 6], "18": [5, 6], "21": [5, 6], "22": [5, 6]},
    "except": {"12": [1, 2, 3, 4, 5], "13": [1, 2, 3, 4, 5], "19": [1, 2, 3, 4, 5]},
    "night": {"20": [6, 7], "21": [6, 7]},
}
# A period note of this label that names Christmas Eve runs on these days.
CHRISTMAS_EVE = ("18", "24 12", [2, 3])
# The day whose exception (or addition) marks a note as that of working days (or of weekends and holidays).
FAST_MONDAY = ("22 9", "21 9")
WORKING, WEEKEND, ALL = [1, 2, 3, 4, 5], [6, 7], [1, 2, 3, 4, 5, 6, 7]
# Weekdays of symbols; A runs on no holiday, C on every one; other symbols run daily.
SYMBOLS = {"A": WORKING, "C": WEEKEND, "Sa": [6], "Di": [7]}

DATE = r"\b(\d{1,2}\.\d{1,2}\.)"
RANGE = r"\b(\d{1,2}\.\d{1,2}\.\s*[–-]\s*\d{1,2}\.\d{1,2}\.)"
NO_DAYS = "array<date>"


def _days(numbers: list[int]) -> Column:
    return F.array(*map(F.lit, numbers))


def in_period(day: Column, start: Column, end: Column) -> Column:
    """The first day from ``start`` to ``end`` that ``d.m.`` names, null without one."""
    year = lambda y: F.try_to_date(F.concat(day, y.cast("string")), "d.M.yyyy")
    return F.array_min(F.filter(F.transform(F.sequence(F.year(start), F.year(end)), year), lambda d: d.between(start, end)))


def named_days(text: Column, start: Column, end: Column) -> Column:
    """All single days that a text names as ``d.m.``; those of ranges are not among them."""
    single = F.regexp_extract_all(F.regexp_replace(text, RANGE, " "), F.lit(DATE), F.lit(1))
    return F.array_compact(F.transform(single, lambda d: in_period(d, start, end)))


def named_ranges(text: Column, start: Column, end: Column) -> Column:
    """All days of the ranges ``d.m. - d.m.`` in a text; one that would end before it begins ends in the year after."""

    def expand(span: Column) -> Column:
        first, last = (in_period(F.trim(F.element_at(F.split(span, "[–-]"), i)), start, end) for i in (1, 2))
        last = F.when(last < first, F.add_months(last, 12)).otherwise(last)
        return F.when(first.isNotNull() & last.isNotNull(), F.sequence(first, last)).otherwise(F.array().cast(NO_DAYS))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RANGE), F.lit(1)), expand))


def note_rules(notes: DataFrame, label: str = "label", text: str = "text", start: str = "start", end: str = "end") -> DataFrame:
    """``notes`` with the rule that each one states.

    kind, weekdays (null: all), holidays (``include``, ``exclude`` or null), include, exclude, required (arrays of days;
    ``required`` null: no bound), parsed. The kinds, the first that holds: ``working`` and ``weekend`` (told by the fast
    Monday in September), ``also`` (days besides), ``empty`` (the label says all), ``period`` (only within ranges),
    ``not_holidays``, ``except`` (not on days), ``days``, ``unread``.
    """
    first, last = F.col(start), F.col(end)
    whole = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+\d+\s*/\s*\d+\s*$", ""), r"\s+", " "))
    words = F.trim(F.regexp_replace(plain(whole), r"[^a-z0-9]+", " "))
    says = lambda *parts: reduce(lambda a, b: a | b, (words.contains(p) for p in parts))
    out = notes.withColumns({"_days": F.array_distinct(named_days(whole, first, last)), "_spans": F.array_distinct(named_ranges(whole, first, last))})
    but, also = says("sauf"), says("ainsi que")
    some = lambda c: F.size(c) > 0
    kind = (
        F.when(says(*(f"sauf {d}" for d in FAST_MONDAY)), "working")
        .when(says(*(f"ainsi que {d}" for d in FAST_MONDAY)), "weekend")
        .when(also & ~but & ~says("du "), "also")
        .when(whole.rlike(r"^[–,\s/-]*$"), "empty")
        .when(says("du ") & some("_spans") & ~but, "period")
        .when(says("sauf fetes generales"), "not_holidays")
        .when(but, "except")
        .when(some("_days") | some("_spans"), "days")
        .otherwise("unread")
    )
    pairs = [(f"{k}:{name}", days) for k, names in LABELS.items() for name, days in names.items()]
    by_label = F.map_from_arrays(F.array(*(F.lit(p) for p, _ in pairs)), F.array(*(_days(d) for _, d in pairs)))
    told = lambda k: F.try_element_at(by_label, F.concat(k, F.lit(":"), F.col(label)))
    eve = (F.col("kind") == "period") & (F.col(label) == CHRISTMAS_EVE[0]) & says(CHRISTMAS_EVE[1])
    weekdays = (
        F.when(F.col("kind") == "working", _days(WORKING))
        .when(F.col("kind") == "weekend", _days(WEEKEND))
        .when(eve, _days(CHRISTMAS_EVE[2]))
        .otherwise(F.coalesce(told(F.col("kind")), F.when(says("nuit"), told(F.lit("night"))), F.when(F.col("kind") == "period", _days(ALL))))
    )
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    none = F.array().cast(NO_DAYS)
    holidays = F.when(is_("weekend"), "include").when(is_("working", "not_holidays") | is_("except") & told(F.lit("except")).isNotNull(), "exclude")
    include = F.when(is_("period"), F.array_except("_days", "_spans")).when(is_("not_holidays"), F.array_union("_days", "_spans")).when(is_("weekend", "also", "days"), F.col("_days")).otherwise(none)
    exclude = F.when(is_("working"), F.col("_days")).when(is_("except"), F.array_union("_days", "_spans")).otherwise(none)
    required = F.when(is_("period") | is_("days") & some("_spans"), F.col("_spans"))
    parsed = ~(is_("unread") | is_("empty") & weekdays.isNull())
    return out.withColumn("kind", kind).withColumns({"weekdays": weekdays, "holidays": holidays, "include": include, "exclude": exclude, "required": required, "parsed": parsed}).drop("_days", "_spans")


def symbol_rules(rows: DataFrame, symbol: str) -> DataFrame:
    """``rows`` with the rule of their symbol, in the columns of ``note_rules``."""
    weekdays = F.coalesce(*(F.when(F.col(symbol) == s, _days(d)) for s, d in SYMBOLS.items()), _days(ALL))
    holidays = F.when(F.col(symbol) == "A", "exclude").when(F.col(symbol) == "C", "include")
    none = F.array().cast(NO_DAYS)
    return rows.withColumns({"kind": F.col(symbol), "weekdays": weekdays, "holidays": holidays, "include": none, "exclude": none, "required": F.lit(None).cast(NO_DAYS), "parsed": F.lit(True)})


def period_masks(calendar: DataFrame, period: str, day: str = "day", dow: str = "dow", holiday: str = "is_holiday") -> DataFrame:
    """period, first, words, all, off (holidays), d1 to d7: bitmaps of a calendar with a row for each day of each period."""
    first = calendar.groupBy(F.col(period).alias("_p")).agg(F.min(day).alias("first"))
    placed = calendar.join(F.broadcast(first), calendar[period].eqNullSafe(first["_p"])).withColumn("_i", F.datediff(day, "first"))  # a row for each period
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_i") % WORD)
    sets = {"all": F.lit(True), "off": F.col(holiday), **{f"d{k}": F.col(dow) == k for k in range(1, 8)}}
    words = placed.groupBy(period, "first", F.floor(F.col("_i") / WORD).alias("_w")).agg(*(F.bit_or(F.when(c, bit).otherwise(F.lit(0).cast("long"))).alias(n) for n, c in sets.items()))
    rows = words.groupBy(period, "first").agg(F.array_sort(F.collect_list(F.struct("_w", *sets))).alias("_m"))  # six words a year
    return rows.select(period, "first", F.size("_m").alias("words"), *(F.col(f"_m.{n}").alias(n) for n in sets))


def days_mask(days: Column, first: Column, words: Column) -> Column:
    """The bitmap of an array of days; days outside the period have no bit."""
    place = lambda d: F.datediff(d, first)
    word = lambda w: F.aggregate(F.filter(days, lambda d: F.floor(place(d) / WORD) == w), F.lit(0).cast("long"), lambda a, d: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(d), F.lit(WORD)))))
    return F.transform(F.sequence(F.lit(0), words - 1), word)


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def without(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def rule_bitmaps(rules: DataFrame, masks: DataFrame, period: str) -> DataFrame:
    """``rules`` with ``bits``: their weekdays within the required days, then without or with holidays, with the included days, without the excluded ones."""
    r = rules.join(small(masks), period)
    first, words = F.col("first"), F.col("words")
    bits = F.when(F.col("weekdays").isNull(), F.col("all")).otherwise(reduce(either, (F.when(F.array_contains("weekdays", k), F.col(f"d{k}")).otherwise(without(F.col("all"), F.col("all"))) for k in range(1, 8))))
    bits = F.when(F.col("required").isNull(), bits).otherwise(both(bits, days_mask(F.col("required"), first, words)))
    r = r.withColumn("bits", bits)
    r = r.withColumn("bits", F.when(F.col("holidays") == "exclude", without(F.col("bits"), F.col("off"))).when(F.col("holidays") == "include", either(F.col("bits"), F.col("off"))).otherwise(F.col("bits")))
    r = r.withColumn("bits", without(either(F.col("bits"), days_mask(F.col("include"), first, words)), days_mask(F.col("exclude"), first, words)))
    return r.select(*rules.columns, "bits")


def trip_bitmaps(trips: DataFrame, markers: DataFrame, rules: DataFrame, masks: DataFrame, trip: list[str], rule: list[str], period: str) -> DataFrame:
    """``trips`` with first, bits (the days on which every rule of its markers runs; all days without one), n_rules, n_missing.

    ``markers`` names the rules of trips (trip and rule columns); one without a rule is counted as missing and bounds
    nothing. Rules meet a trip word by word, so their number is free.
    """
    found = markers.join(rules.select(*rule, "bits"), rule, "left")
    counts = found.groupBy(*trip).agg(F.count("bits").alias("n_rules"), F.count_if(F.col("bits").isNull()).alias("n_missing"))
    words = found.where(F.col("bits").isNotNull()).select(*trip, F.posexplode("bits").alias("_w", "_b")).groupBy(*trip, "_w").agg(F.bit_and("_b").alias("_b"))
    own = words.groupBy(*trip).agg(F.array_sort(F.collect_list(F.struct("_w", "_b"))).alias("_m"))
    out = trips.join(counts, trip, "left").join(own, trip, "left").join(small(masks.select(period, "first", "all")), period)
    return out.withColumn("bits", F.coalesce(F.col("_m._b"), F.col("all"))).fillna(0, ["n_rules", "n_missing"]).drop("_m", "all")


def days_of(bits: Column, first: Column) -> Column:
    """The days of a bitmap."""
    places = F.sequence(F.lit(0), F.size(bits) * WORD - 1)
    return F.transform(F.filter(places, lambda i: F.call_function("shiftright", bits[F.floor(i / WORD).cast("int")], i % WORD).bitwiseAND(F.lit(1).cast("long")) == 1), lambda i: F.date_add(first, i))


def dated_legs(legs: DataFrame, trips: DataFrame, trip: list[str], departs: str, arrives: str) -> DataFrame:
    """A row for each leg and service day: day, departure, arrival (timestamps without zone), day_offset.

    ``departs`` and ``arrives`` are minutes of the day; a leg that arrives at a smaller minute arrives on the next day.
    Trips and legs meet as bitmaps and are only then spread over their days.
    """
    days = trips.select(*trip, "first", "bits")
    at = lambda offset, minute: F.timestamp_add("MINUTE", (offset * 1440 + F.col(minute)).cast("int"), F.col("day").cast("timestamp_ntz"))
    offset = F.when(F.col(arrives) < F.col(departs), 1).otherwise(0)
    out = legs.join(days, trip).withColumn("day", F.explode(days_of(F.col("bits"), F.col("first")))).drop("first", "bits")
    return out.withColumns({"day_offset": offset, "departure": at(F.lit(0), departs), "arrival": at(offset, arrives)})


def service_markers(stops: DataFrame, trip: list[str], notes: str, symbols: str, sep: str = "|") -> DataFrame:
    """trip, note_refs, symbols (distinct ones of all stops, in the order in which they first stand), validity (``marked`` or ``daily``)."""

    def all_of(c: str, name: str) -> DataFrame:
        each = stops.select(*trip, F.col("place"), F.posexplode(F.split(F.coalesce(c, F.lit("")), r"\s*\%s\s*" % sep)).alias("_i", "_v")).where(F.trim("_v") != "")
        first = each.groupBy(*trip, F.trim("_v").alias("_v")).agg(F.min(F.struct("place", "_i")).alias("_f"))
        return first.groupBy(*trip).agg(F.array_sort(F.collect_list(F.struct("_f", "_v")))["_v"].alias(name))

    none = F.array().cast("array<string>")
    out = stops.select(*trip).distinct().join(all_of(notes, "note_refs"), trip, "left").join(all_of(symbols, "symbols"), trip, "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("note_refs", "symbols")})
    return out.withColumn("validity", F.when(F.size("note_refs") + F.size("symbols") > 0, "marked").otherwise("daily"))
