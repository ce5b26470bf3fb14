"""Format-preserving pseudonyms for personal numbers, dates and mail names, in DataFrame functions alone.

One regular expression finds candidates; each is validated for its kind (Luhn
digit of cards, mod-97 digits of IBANs, calendar of dates, octets of addresses,
areas of social security numbers, number of digits of telephones). A candidate may
hold more than the value: cards are sought among all runs of 13 to 19 digits between
group borders, IBANs among all beginnings up to a group border. Valid values are
replaced by a keyed permutation of their own format, so the result is valid again
and equal values get equal pseudonyms in all documents, however they are written:
cards and telephones by their digits (country codes by the numbering plan), dates by
their day, mail names whatever their case. Whoever holds the key can undo it. The
rest stays.

The permutations are Feistel networks with SHA-256 as round function: over the
two halves of a string, each character moved within its own alphabet; or over
pairs of numbers [0, a) x [0, b) with modular sums where the format is a range:
days of a 400-year cycle (146097 = 189 * 773), addresses (65536 * 65536), social
security numbers (898 areas * 99 * 9999). Check digits are computed anew, country
codes and mail domains stay. Plans show a digest of the key for each kind, not the
key; that digest alone undoes pseudonyms too, so plans are as secret as the key
(``spark.redaction.string.regex`` hides them).

Nothing is shuffled, no Python runs on the executors; texts without a digit or an @
are passed on after one search, texts without a candidate after two.

Java's matcher calls itself for each repetition of a group that may be of several
lengths; a text with some thousand of them in a row (a table of digits, a dotted
chain after an @) then overflows the stack, which ends the executor and not only the
task. Such groups are possessive here, which Java repeats in a loop, and written so
that they find what the plain ones would. Long runs of digits are searched in steps
of the longest card, so work and memory are linear in them.

Cases: null and empty texts stay as they are; overlapping candidates are taken
from left to right, the longer kind first; a date that reads day first is taken so,
others month first; repeated rows give equal results; null ids are rows like
others; an empty table gives an empty result; extra columns are carried by
``pseudonymise_documents``, whatever their names, and ignored by ``report``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The formats of personal data.
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Labels of a mail domain that can't be its last, as they don't begin with two letters; the last that can be is the domain's end, up to where its letters end.
LABELS = r"(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]+)*+"
FORMATS = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]{{1,64}}@[A-Za-z0-9-]++(?:{LABELS}\.[A-Za-z]{{2}}[A-Za-z0-9-]*+(?={LABELS}\.[A-Za-z]{{2}}))*+{LABELS}\.[A-Za-z]{{2,}}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "iso_date": r"(?<!\d)\d{4}([-/.])(?:0[1-9]|1[0-2])[-/.](?:0[1-9]|[12]\d|3[01])(?!\d)",
    "day_date": r"(?<!\d)(?:0?[1-9]|[12]\d|3[01])[./-](?:0?[1-9]|[12]\d|3[01])[./-](?:1[6-9]|20)\d{2}(?!\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,}+(?!\d)",
}
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"]
#: Country codes of one and two digits in the numbering plan; all others have three.
COUNTRY_1 = "1 7".split()
COUNTRY_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
CARD_DIGITS = (13, 19)
ROUNDS = 8
CYCLE = 146_097  # days in 400 years


def anyof() -> str:
    return "|".join(f.replace("([-/.])", "[-/.]") for f in FORMATS.values())


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digest(key: str, kind: str, turn: Column, other: Column) -> Column:
    """Round function: 64 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(hashlib.sha256(f"{key}|{kind}".encode()).hexdigest()), turn.cast("string"), other), 256)


def char(text: Column, i: Column) -> Column:
    return F.substring(text, i, F.lit(1))


def each(text: Column, f) -> Column:
    """``text`` with f(place) for each of its places."""
    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), f), "")).otherwise(text)


def shifted(half: Column, hexes: Column) -> Column:
    """Each character moved within its alphabet by a byte of ``hexes``; characters of no alphabet stay."""

    def move(c: Column, by: Column) -> Column:
        out = c
        for letters in ALPHABETS:
            at = F.instr(F.lit(letters), c)
            out = F.when(at > 0, F.substring(F.lit(letters), (at - 1 + by) % len(letters) + 1, F.lit(1))).otherwise(out)
        return out

    byte = lambda h, i: F.conv(F.substring(h, (i - 1) % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return let(hexes, lambda h: each(half, lambda i: let(F.struct(char(half, i).alias("c"), byte(h, i).alias("by")), lambda x: move(x["c"], x["by"]))))


def keyed(text: Column, key: str, kind: str) -> Column:
    """Keyed permutation of the strings of one shape."""
    step = lambda s, turn: F.struct(s["r"].alias("l"), shifted(s["l"], digest(key, kind, turn, s["r"])).alias("r"))

    def run(t: Column) -> Column:
        cut = F.floor(F.length(t) / 2).cast("int")
        start = F.struct(F.substring(t, F.lit(1), cut).alias("l"), F.substring(t, cut + 1, F.length(t) - cut).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["l"], s["r"]))

    return let(text, run)


def keyed_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Keyed permutation of [0, a * b)."""

    def step(s: Column, turn: Column) -> Column:
        by = F.conv(F.substring(digest(key, kind, turn, s["r"].cast("string")), 1, 12), 16, 10).cast("long")
        return F.struct(s["r"].alias("l"), ((s["l"] + by) % s["a"]).alias("r"), s["b"].alias("a"), s["a"].alias("b"))

    def run(v: Column) -> Column:
        start = F.struct(F.floor(v / b).cast("long").alias("l"), (v % b).alias("r"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * s["b"] + s["r"])

    return let(value.cast("long"), run)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def is_digit(c: Column) -> Column:
    return c.between("0", "9")


def refilled(shape: Column, numbers: Column) -> Column:
    """``shape`` with its digits replaced by those of ``numbers`` in order."""
    return let(numbers, lambda n: each(shape, lambda i: F.when(is_digit(char(shape, i)), char(n, F.length(digits(F.substring(shape, F.lit(1), i))))).otherwise(char(shape, i))))


def luhn(numbers: Column, doubled: int) -> Column:
    """Luhn sum modulo 10; counted from the right, digits at places of parity ``doubled`` (0: the last) are doubled."""

    def add(turned: Column, total: Column, i: Column) -> Column:
        v = char(turned, i).cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return total + F.when((i - 1) % 2 == doubled, twice).otherwise(v)

    return let(F.reverse(numbers), lambda t: F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), lambda total, i: add(t, total, i))) % 10


def mod97(code: Column) -> Column:
    """An IBAN's remainder: its first four characters go last, letters count as 10 to 35."""

    def add(rest: Column, c: Column) -> Column:
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    return let(turned, lambda t: F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), lambda rest, i: let(F.ascii(char(t, i)), lambda c: add(rest, c))))


def moved_day(day: Column, key: str) -> Column:
    """A date permuted within its 400-year cycle; all kinds of date share the permutation."""

    def run(number: Column) -> Column:
        cycle = F.floor(number / CYCLE)
        return F.date_add(F.lit("1600-01-01").cast("date"), (cycle * CYCLE + keyed_number(number - cycle * CYCLE, 189, 773, key, "date")).cast("int"))

    return let(F.datediff(day, F.lit("1600-01-01").cast("date")), run)


def part(text: Column, first: Column, last: Column) -> Column:
    """Characters from ``first`` to ``last``, both counted from 1."""
    return F.substring(text, first, last - first + 1)


def borders(text: Column, inside, side: int) -> Column:
    """Places of the characters for which ``inside`` holds while it does not for the neighbour before (-1) or after (1)."""
    alone = lambda i: (i == 1) if side < 0 else (i == F.length(text))
    return F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: inside(char(text, i)) & (alone(i) | ~inside(char(text, i + side))))


def card(value: Column, key: str) -> Column:
    """A valid card's pseudonym."""
    payload = lambda n: keyed(F.substring(n, F.lit(1), F.length(n) - 1), key, "card")
    numbers = let(digits(value), lambda n: let(payload(n), lambda p: F.concat(p, ((10 - luhn(p, 0)) % 10).cast("string"))))
    return refilled(value, numbers)


def joined(chars: Column, first: Column, last: Column) -> Column:
    """The characters of an array from ``first`` to ``last``, both counted from 1; places beyond its end are left out."""
    return F.when(last >= first, F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(chars, i - 1)), "")).otherwise("")


def with_cards(found: Column, key: str) -> Column:
    """``found`` with every run of digits between group borders that is a valid card replaced, from left to right, longest first; null without any.

    No run longer than twice the digits of a card is looked at, and characters are read from an array, so the work is linear.
    """
    low, high = CARD_DIGITS
    inside = lambda chars, i: F.coalesce(is_digit(F.get(chars, i - 1)), F.lit(False))

    def valid(run: Column) -> Column:
        return let(digits(run), lambda n: F.length(n).between(low, high) & (luhn(n, 1) == 0))

    def best(chars: Column, first: Column) -> Column:
        ends = lambda ahead: F.filter(F.sequence(F.lit(low), F.lit(2 * high + 1)), lambda k: inside(chars, first + k - 1) & ~inside(chars, first + k) & valid(F.substring(ahead, F.lit(1), k)))
        return F.struct(first.alias("first"), (first - 1 + F.array_max(let(joined(chars, first, first + 2 * high), ends))).alias("last"))

    def keep(state: Column, run: Column) -> Column:
        more = F.struct((run["last"] + 1).alias("at"), F.concat(state["kept"], F.array(run)).alias("kept"))
        return F.when(run["first"] < state["at"], state).otherwise(more)

    def rebuilt(chars: Column, kept: Column) -> Column:
        after = lambda i: F.coalesce(F.get(kept, i - 1)["last"] + 1, F.lit(1))
        pieces = F.transform(kept, lambda run, i: F.concat(joined(chars, after(i), run["first"] - 1), card(joined(chars, run["first"], run["last"]), key)))
        return F.when(F.size(kept) > 0, F.concat(F.array_join(pieces, ""), joined(chars, after(F.size(kept)), F.size(chars))))

    def search(chars: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(1), F.size(chars)), lambda i: inside(chars, i) & ~inside(chars, i - 1))
        runs = F.filter(F.transform(firsts, lambda first: best(chars, first)), lambda r: r["last"].isNotNull())
        start = F.struct(F.lit(1).alias("at"), F.filter(F.array(F.struct(F.lit(0).alias("first"), F.lit(0).cast("int").alias("last"))), lambda r: r["first"] > 0).alias("kept"))
        return let(F.aggregate(runs, start, keep, lambda s: s["kept"]), lambda kept: rebuilt(chars, kept))

    return let(found, lambda text: F.when(F.length(text) >= low, let(F.split(text, ""), search)))


def recased(text: Column, shape: Column) -> Column:
    """``text`` (lower case) with upper case where ``shape`` has it."""
    return let(text, lambda t: each(shape, lambda i: F.when(char(shape, i) != F.lower(char(shape, i)), F.upper(char(t, i))).otherwise(char(t, i))))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, " ", "")


def iban_of(found: Column, key: str) -> Column:
    """The candidate with its longest valid beginning replaced; null without any. Cards in the rest are replaced too."""

    def valid(end: Column) -> Column:
        return let(squeezed(F.substring(found, F.lit(1), end)), lambda code: F.length(code).between(15, 34) & (mod97(code) == 1))

    def whole(code: Column) -> Column:
        def checked(body: Column) -> Column:
            check = 98 - mod97(F.concat(F.substring(code, 1, 2), F.lit("00"), body))
            return F.concat(F.substring(code, 1, 2), F.lpad(check.cast("string"), 2, "0"), body)

        return let(keyed(F.substring(code, F.lit(5), F.length(code)), key, "iban"), checked)

    def spaced(own: Column, plain: Column) -> Column:
        return each(own, lambda i: F.when(char(own, i) == " ", F.lit(" ")).otherwise(char(plain, F.length(squeezed(F.substring(own, F.lit(1), i))))))

    def split(end: Column) -> Column:
        own, after = F.substring(found, F.lit(1), end), F.substring(found, end + 1, F.length(found))
        new = let(own, lambda o: let(let(squeezed(o), whole), lambda plain: spaced(o, plain)))
        return F.when(end.isNotNull(), F.concat(new, let(after, lambda x: F.coalesce(with_cards(x, key), x))))

    return let(F.array_max(F.filter(borders(found, lambda c: c != " ", 1), valid)), split)


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of a candidate; null if it is of no valid kind."""
    whole = {k: found.rlike(f"^(?:{f})$") for k, f in FORMATS.items()}
    at = F.instr(found, "@")
    email = let(F.substring(found, F.lit(1), at - 1), lambda name: F.concat(recased(keyed(F.lower(name), key, "email"), name), F.substring(found, at, F.length(found))))
    iban = iban_of(found, key)

    octet = lambda i: F.split_part(found, F.lit("."), F.lit(i)).cast("long")
    number = keyed_number(octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4), 65536, 65536, key, "ip")
    ip = let(number, lambda n: F.concat_ws(".", *(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255).cast("long")).cast("string") for k in (3, 2, 1, 0))))

    mark = F.regexp_extract(found, r"^\d+([./-])", 1)
    iso = F.try_to_date(F.regexp_replace(found, "[/.]", "-"), "yyyy-MM-dd")
    first, second, year = (F.split(found, "[./-]")[i] for i in range(3))
    read = lambda d, m: F.try_to_date(F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    padded = (F.length(first) == 2) & (F.length(second) == 2)
    two = lambda n: F.when(padded, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    iso_date = let(iso, lambda d: F.when(d.isNotNull(), refilled(found, F.date_format(moved_day(d, key), "yyyyMMdd"))))
    shown = lambda day, a, b: F.when(day.isNotNull(), let(moved_day(day, key), lambda m: F.concat(two(a(m)), mark, two(b(m)), mark, F.lpad(F.year(m).cast("string"), 4, "0"))))
    day_date = F.coalesce(let(read(first, second), lambda d: shown(d, F.dayofmonth, F.month)), let(read(second, first), lambda d: shown(d, F.month, F.dayofmonth)))

    area, group, serial = (F.split_part(found, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
    ssn_number = keyed_number((area - 1 - F.when(area > 666, 1).otherwise(0)) * (99 * 9999) + (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")

    def ssn_form(n: Column) -> Column:
        new_area, rest = F.floor(n / (99 * 9999)) + 1, n % (99 * 9999)
        return F.concat_ws("-", F.lpad(F.when(new_area >= 666, new_area + 1).otherwise(new_area).cast("string"), 3, "0"), F.lpad((F.floor(rest / 9999) + 1).cast("string"), 2, "0"), F.lpad((rest % 9999 + 1).cast("string"), 4, "0"))

    ssn = let(ssn_number, ssn_form)

    def dialled(dial: Column) -> Column:
        country = F.when(~found.startswith("+"), 0).when(F.substring(dial, 1, 1).isin(COUNTRY_1), 1).when(F.substring(dial, 1, 2).isin(COUNTRY_2), 2).otherwise(3)
        new = let(country, lambda c: F.concat(F.substring(dial, F.lit(1), c), keyed(F.substring(dial, c + 1, F.length(dial)), key, "phone")))
        return F.when(F.length(dial).between(7, 15), refilled(found, new))

    phone = let(digits(found), dialled)

    one = (
        F.when(whole["email"], email)
        .when(whole["iban"], iban)
        .when(whole["ip"], ip)
        .when(whole["iso_date"], iso_date)
        .when(whole["day_date"], day_date)
        .when(whole["ssn"], ssn)
        .when(whole["phone"], phone)
    )
    return F.coalesce(one, with_cards(found, key))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (with a column text and none of these) with _new (the text with pseudonyms, null where nothing was replaced) and _n (values replaced)."""
    pattern = F.lit(anyof())
    parts = docs.withColumn("_found", F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", pattern, F.lit(0))))  # no format does without a digit or an @
    parts = parts.withColumn("_gaps", F.when(F.size("_found") > 0, F.split("text", anyof(), -1)))
    parts = parts.withColumn("_as", F.transform("_found", lambda m: pseudonym(m, key)))
    parts = parts.withColumn("_n", F.coalesce(F.size(F.filter("_as", lambda x: x.isNotNull())), F.lit(0)))
    shown = F.zip_with("_found", "_as", lambda m, p: F.coalesce(p, m))
    new = F.array_join(F.zip_with("_gaps", shown, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return parts.withColumn("_new", F.when(F.col("_n") > 0, new)).drop("_found", "_gaps", "_as")


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_private (values replaced) and text with pseudonyms, for every document."""
    return pseudonymised(docs.select("doc_id", "text"), key).select("doc_id", F.greatest("_n", F.lit(0)).alias("n_private"), F.coalesce("_new", "text").alias("text"))


def pseudonymise_documents(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in text, all columns kept; n_chars, where there is one, is counted anew for changed texts."""
    inner = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    done = pseudonymised(docs.toDF(*inner.values()), key)
    new = {"text": F.coalesce("_new", "text")}
    if "n_chars" in docs.columns:
        old = F.col(inner["n_chars"])
        new["n_chars"] = F.when(F.col("_new").isNotNull(), F.length("_new").cast(dict(docs.dtypes)["n_chars"])).otherwise(old)
    return done.select(*(new.get(c, F.col(inner[c])).alias(c) for c in docs.columns))
