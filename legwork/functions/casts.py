"""Column expressions for cleaning, casting and safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blank_to_null(c: Column) -> Column:
    """Trimmed text; empty text is null."""
    return F.nullif(F.trim(c), F.lit(""))


def violations(df: DataFrame, casts: dict[str, str], examples: int = 5) -> DataFrame:
    """column, violations, examples: values that are there but don't cast (for integers also those with a fraction)."""
    cells = []
    for name, kind in casts.items():
        value = blank_to_null(F.col(name))
        bad = value.isNotNull() & cast_or_null(F.col(name), kind).isNull()
        cells.append(F.struct(F.lit(name).alias("column"), F.when(bad, F.substring(value, 1, 80)).alias("_bad")))
    # one scan for all columns; examples are the least of each of a few groups by hash, so that no set of all bad values is built
    long = df.select(F.inline(F.array(*cells))).groupBy("column", F.pmod(F.xxhash64("_bad"), F.lit(8 * max(1, examples))).alias("_part")).agg(F.count("_bad").alias("_n"), F.min("_bad").alias("_least"))
    out = long.groupBy("column").agg(F.sum("_n").alias("violations"), F.slice(F.array_sort(F.collect_set("_least")), 1, max(1, examples)).alias("examples"))
    return out if examples else out.drop("examples")


def cast_or_null(c: Column, kind: str) -> Column:
    """A value cast from text; null where it doesn't fit. Integers take 12.0 but not 12.5."""
    text = blank_to_null(c)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast(kind))
    return text.try_cast(kind)


def strict(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """``df`` with columns cast; raises with the counts if a value that is there doesn't cast."""
    found = [r for r in violations(df, casts).collect() if r["violations"]]
    if found:
        raise ValueError("; ".join(f"{r['column']}: {r['violations']} values don't cast, such as {r['examples']}" for r in found))
    return df.withColumns({n: cast_or_null(F.col(n), k) for n, k in casts.items()})


def rolled_over(day: Column, hour: Column, minute: Column, after: Column | None = None) -> Column:
    """Time of ``day``; one day later if it is before ``after``."""
    at = F.timestamp_add("MINUTE", hour * 60 + minute, day.cast("timestamp_ntz"))
    return at if after is None else F.when(at < after, at + F.expr("INTERVAL 1 DAY")).otherwise(at)


def direction(number: Column, even: str = "down", odd: str = "up") -> Column:
    """Direction by the parity of a number; null stays null."""
    return F.when(F.pmod(number, F.lit(2)) == 0, even).when(number.isNotNull(), odd)


def token(c: Column, n: int, sep: str = ":") -> Column:
    """The n-th part of a text as a number, or null."""
    return F.split_part(c, F.lit(sep), F.lit(n)).try_cast("bigint")


def seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two times as a double."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def guarded_delay(later: Column, earlier: Column, status: Column, allowed: list[str], least: float) -> Column:
    """Delay in seconds only for the allowed states; null below ``least``."""
    d = F.when(status.isin(allowed), seconds(later, earlier))
    return F.when(d >= least, d)


def is_true(c: Column) -> Column:
    """Boolean of a text flag; null is false."""
    return F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))


def effective(actual: Column, planned: Column, status: Column, real: list[str]) -> Column:
    """The actual time where the status says it is real, else the planned one."""
    return F.when(status.isin(real) & actual.isNotNull(), actual).otherwise(planned)


def minute_of_day(t: Column) -> Column:
    return F.hour(t) * 60 + F.minute(t)


def total_zero(*cs: Column) -> Column:
    """Sum with null as 0."""
    return sum((F.coalesce(c, F.lit(0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0)))


def total_null(*cs: Column) -> Column:
    """Sum with null as 0, null only if all are null."""
    return F.when(F.coalesce(*cs).isNotNull(), total_zero(*cs))


def safe_divide(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def share(a: Column, b: Column) -> Column:
    """Ratio held to [0, 1]; null if the denominator is 0 or null."""
    r = safe_divide(a, b)
    return F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0)))


def band(c: Column, bounds: list[float], labels: list[str]) -> Column:
    """Label of the half-open band [bound i, bound i+1) that holds a value; null below the first."""
    out = F.lit(None).cast("string")
    for low, label in zip(bounds, labels, strict=True):
        out = F.when(c >= low, label).otherwise(out)
    return out


def conform(df: DataFrame, schema: T.StructType, order: list[str] | None = None) -> DataFrame:
    """Exactly the columns of ``schema``: missing ones null, others dropped, all cast; sorted if asked."""
    out = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    return out.orderBy(*order) if order else out


def renamed(df: DataFrame, names: dict[str, str], drop: tuple[str, ...] = (), codes: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Columns renamed and dropped, then codes replaced by literal maps, column by column."""
    out = df.drop(*drop).withColumnsRenamed(names)
    for column, mapping in (codes or {}).items():
        out = out.replace(mapping, subset=[column])
    return out


def narrowed(df: DataFrame) -> DataFrame:
    """Integer columns cast to the smallest type that holds their observed range, doubles to floats."""
    whole = [f.name for f in df.schema if isinstance(f.dataType, (T.ShortType, T.IntegerType, T.LongType))]
    seen = df.agg(*(g(c).alias(f"{c}_{n}") for c in whole for n, g in (("low", F.min), ("high", F.max)))).first() if whole else {}
    kinds = {}
    for c in whole:
        low, high = seen[f"{c}_low"], seen[f"{c}_high"]
        if low is not None:
            kinds[c] = next(k for k, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << bits) <= low and high < 1 << bits)
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()} | {f.name: F.col(f.name).cast("float") for f in df.schema if isinstance(f.dataType, T.DoubleType)})
