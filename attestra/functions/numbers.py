"""Numbers in text, durations and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.text import bound

#: The patterns of numbers in texts. An integer group with an optional unit, between characters that aren't
#: part of a word; billions; ranges of per cents.
PRECISE = r"(?U)(?<!\w)(\d{1,3}(?:,\d{3})*|\d+)(\s*(%|ms|req/s|req\/sec|MB|GB|x|times faster))?(?!\w)"
BILLIONS = r"(?U)\$?(\d+(?:\.\d+)?)\s*[Bb](?:illion)?"
PERCENTS = r"(?U)(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)\s*%"


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def written(c: Column) -> Column:
    """A double of zero or more as plain text: 0.5, 90433955.0; with an exponent from 1e16 on (1e+16) and under 0.0001 (5e-05).

    Of the digits that tell it from its neighbours, the fewest. Some Java versions cast to more; from 2^53 to 1e38 all its digits are
    known, so there they are rounded to 15, 16 and 17.
    """
    return bound(c, lambda v: bound(F.when((v >= 2.0**53) & (v < 1e38), bound(_digits(v), lambda exact: _fewest(v, exact))).otherwise(v.cast("string")), _plain))


def _fewest(c: Column, exact: Column) -> Column:
    """A double in as few digits as tell it, as Java would write it (1.5E16), from all its digits."""
    more = lambda k: F.when(F.substring(exact, k + 1, 1) >= "5", 1).otherwise(0)
    rounded = lambda k: F.concat((F.left(exact, k).try_cast("long") + more(k)).cast("string"), F.lit("E"), (F.length(exact) - k).cast("string"))
    tried = F.transform(F.array(*[F.lit(k) for k in (15, 16, 17)]), rounded)
    first = F.get(F.filter(tried, lambda t: t.try_cast("double") == c), F.lit(0))
    head, power = F.substring_index(first, "E", 1), F.substring_index(first, "E", -1).try_cast("int")
    return F.concat(F.left(head, F.lit(1)), F.lit("."), F.substring(head, F.lit(2), F.length(head)), F.lit("E"), (power + F.length(head) - 1).cast("string"))


def _plain(text: Column) -> Column:
    """A double as Java writes it, as Python would."""
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.replace(F.substring_index(text, "E", 1), F.lit("."), F.lit("")), r"0+$", "")
    size = exponent + 1
    whole = F.concat(F.rpad(F.left(digits, size), size, F.lit("0")), F.lit("."), F.coalesce(F.nullif(F.substring(digits, size + 1, F.length(digits)), F.lit("")), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    rest = F.substring(digits, F.lit(2), F.length(digits))
    short = F.concat(F.left(digits, F.lit(1)), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")))
    return F.when(~text.contains("E"), F.replace(text, F.lit("Infinity"), F.lit("inf"))).when((exponent >= 0) & (exponent < 16), whole).when((exponent < 0) & (exponent >= -4), small).otherwise(short)


def _digits(c: Column) -> Column:
    """A double of zero or more as the nearest whole number, with all its digits; null if these are more than 38.

    A cast gives the shortest digits that tell a double from its neighbours, and zeros after them. From 2^53 on, where every
    double is a whole number, it is taken apart by powers of two, which is exact.
    """
    part = lambda x, k: F.floor(x / float(2**k))
    rest = lambda x, k: x - part(x, k).cast("double") * float(2**k)
    power = F.lit(2**40).cast("decimal(13,0)")
    low = lambda x: part(x, 40).cast("decimal(13,0)") * power + rest(x, 40).cast("decimal(13,0)")
    exact = lambda x: part(x, 80).cast("decimal(14,0)") * power * power + bound(rest(x, 80), low)
    return F.when(c < 2.0**53, c.cast("decimal(38,0)")).when(c < 1e38, exact(c).cast("decimal(38,0)")).cast("string")


def number_set(c: Column) -> Column:
    """The numbers of a text as strings: integers without commas, billions both ways, both ends of per cent ranges.

    Billions of more than 38 digits are there only as they are written.
    """
    plain = F.transform(_all(c, PRECISE), lambda x: F.replace(x, F.lit(","), F.lit("")))
    whole = F.transform(plain, lambda x: F.coalesce(F.nullif(F.regexp_replace(x, r"^0+(?=\d)", ""), F.lit("")), x))
    big = _all(c, BILLIONS)
    billions = F.array_compact(F.transform(F.transform(big, lambda x: x.cast("double") * 1_000_000_000), _digits))
    as_written = F.transform(big, lambda x: F.concat(written(x.cast("double")), F.lit("B")))
    return F.array_distinct(F.concat(whole, plain, billions, as_written, _all(c, PERCENTS, 1), _all(c, PERCENTS, 2)))


def values(c: Column) -> Column:
    """The precise numbers of a text as doubles, in order."""
    return F.transform(_all(c, PRECISE), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def supported(claim: Column, source: Column) -> Column:
    """A claim without numbers is supported; one with numbers needs one of them in the source."""
    own = number_set(claim)
    return (F.size(own) == 0) | F.arrays_overlap(own, number_set(source))


def seconds(c: Column) -> Column:
    """[H:]M:S or a plain number -> seconds; null if it isn't one."""
    parts = F.split(F.trim(c), ":")
    at = lambda k: F.get(parts, F.size(parts) - k).try_cast("double")
    return F.when(F.size(parts) == 1, at(1)).when(F.size(parts) == 2, at(2) * 60 + at(1)).when(F.size(parts) == 3, at(3) * 3600 + at(2) * 60 + at(1))


def clock(c: Column) -> Column:
    """Seconds -> H:MM:SS."""
    s = F.floor(c)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def page_ranges(c: Column) -> Column:
    """1-3,5 -> [1, 2, 3, 5], sorted and distinct."""
    parts = F.filter(F.split(F.regexp_replace(c, r"\s", ""), ","), lambda p: p.rlike(r"^\d+(-\d+)?$"))
    first = lambda p: F.substring_index(p, "-", 1).cast("int")
    last = lambda p: F.substring_index(p, "-", -1).cast("int")
    ranges = F.transform(F.filter(parts, lambda p: first(p) <= last(p)), lambda p: F.sequence(first(p), last(p)))
    return F.sort_array(F.array_distinct(F.flatten(ranges)))
