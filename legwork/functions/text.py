"""Rules on free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters with accents and what they fold to.
ACCENTED = "àáâäãåçèéêëìíîïñòóôöõùúûüýÿÀÁÂÄÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def plain(c: Column) -> Column:
    """Lower case, with letters that carry accents (of any kind) folded to the letters that they carry them on."""
    return F.lower(F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{M}", ""))


def folded(c: Column) -> Column:
    """Lower case without accents, brackets (what stands inside stays) and outer blanks."""
    return F.trim(F.regexp_replace(plain(c), "[()]", ""))


def has_any(words: list[str], *columns: Column) -> Column:
    """Whether any of the words is in the joined lower-case text."""
    return F.coalesce(F.lower(F.concat_ws(" ", *columns)).rlike("|".join(words)), F.lit(False))


def last_rule(c: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """Class of the last rule (pattern, class) that matches: later rules overwrite earlier ones."""
    out = F
    for pattern, label in reversed(rules):
        out = out.when(c.rlike(pattern), label)
    return out.otherwise(other)


# Fixed value: what parts the places of one text.
PLACES = r"[/,]| et | - "


def zones(rows: DataFrame, key: str, place: str, table: DataFrame, sep: str = PLACES) -> DataFrame:
    """key, zone of best (least) priority among the places named in a text; ``table`` has name, zone, priority."""
    names = rows.select(key, F.explode(F.split(place, sep)).alias("_name")).withColumn("name", folded(F.col("_name")))
    return names.join(table, "name").groupBy(key).agg(F.min_by("zone", F.struct("priority", "zone")).alias("zone"))


def locality(c: Column, names: list[str]) -> Column:
    """The first of ``names``, in their order, that the folded text holds; null without any."""
    place = folded(c)
    return F.coalesce(*(F.when(place.contains(n), n) for n in names))


def event_lines(lines: DataFrame, text: str = "line", drop: str = r"(?i)annul|report") -> DataFrame:
    """name, first and last day and place of lines such as ``12.07.2023 - 15.07.2023 Name, Place``; cancelled ones go.

    A last day before the first is taken as a slip in the year.
    """
    day = r"(\d{1,2}\.\d{1,2}\.\d{4})"
    found = F.regexp_extract_all(text, F.lit(day), F.lit(1))
    kept = lines.where(~F.col(text).rlike(drop)).withColumn("_d", found).where(F.size("_d") > 0)
    parse = lambda c: F.try_to_date(c, "d.M.yyyy")
    first, last = parse(F.element_at("_d", 1)), parse(F.element_at("_d", -1))
    rest = F.trim(F.regexp_replace(text, day + r"(\s*-\s*)?", ""))
    last = F.when(last < first, F.make_date(F.year(first), F.month(last), F.dayofmonth(last))).otherwise(last)
    return kept.select(F.trim(F.split_part(rest, F.lit(","), F.lit(1))).alias("name"), first.alias("start"), last.alias("end"), F.nullif(F.trim(F.split_part(rest, F.lit(","), F.lit(-1))), F.trim(F.split_part(rest, F.lit(","), F.lit(1)))).alias("place"))


def note_days(notes: DataFrame, note: str = "note", text: str = "text", start: str = "start", end: str = "end") -> DataFrame:
    """note, kind (``day``, ``from``, ``to``), day for each dd.mm in a note, in the year that lies in the note's period; ranges are dd.mm-dd.mm.

    Both candidate years are tried, the one inside [start, end] stays.
    """
    spans = F.regexp_extract_all(text, F.lit(r"(\d{1,2}\.\d{1,2}\.?(?:\s*-\s*\d{1,2}\.\d{1,2}\.?)?)"), F.lit(1))
    one = notes.select(note, start, end, F.posexplode(spans).alias("_n", "_span"))
    ends = one.withColumn("_ends", F.split("_span", r"\s*-\s*"))
    resolve = lambda c: F.array_min(F.filter(F.transform(F.sequence(F.year(start), F.year(end)), lambda y: F.try_to_date(F.concat_ws(".", F.regexp_replace(c, r"\.$", ""), y.cast("string")), "d.M.yyyy")), lambda d: d.between(F.col(start), F.col(end))))
    first, last = resolve(F.element_at("_ends", 1)), resolve(F.element_at("_ends", -1))
    return ends.select(note, F.col("_n").alias("n"), first.alias("first"), last.alias("last")).where(F.col("first").isNotNull() & (F.col("last") >= F.col("first"))).withColumn("day", F.explode(F.sequence("first", "last")))
