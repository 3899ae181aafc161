"""Mixed-format date parsing as a single Catalyst expression.

A value is read by a small grammar instead of a list of formats: it is cut once
into its numbers and words, weekday names and joining words are left out, and
what remains (one to three fields) says by its shape which field is the year,
the month and the day.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens.config import DATE_FILLERS, MONTH_NAMES, TWO_DIGIT_YEAR_PIVOT, WEEKDAY_NAMES
from staylens.functions.binding import let
from staylens.functions.text import strip

#: Plain year-month-day, the spelling of most values.
ISO = r"^(?!0000)\d{4}-\d\d?-\d\d?$"
#: What a date may be made of once its time of day is cut off.
DATE_LIKE = r"^['a-z\d][a-z\d\s,./;'\\-]*$"
CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?(?:\s*[ap]m)?"
HOUR = r"(?:0?[1-9]|1[0-2])\s*[ap]m"
ZONE = r"(?:\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2}))?"
#: A time of day before or behind the date, with optional seconds, fraction, AM/PM and zone.
TIME_OF_DAY = rf"(?:t|\s+(?:at\s+)?)(?:{CLOCK}|{HOUR}){ZONE}$|^(?:{CLOCK}|{HOUR})\s+|(?<=^\d{{8}})t(?:[01]\d|2[0-3])[0-5]\d(?:[0-5]\d)?$"
#: Digits that hold a date and a time of day.
DIGITS_WITH_TIME = r"^\d{8}(?:[01]\d|2[0-3])[0-5]\d(?:[0-5]\d)?$"


def _months() -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(MONTH_NAMES.items()) for x in pair])


def _field(token: Column) -> Column:
    """What a token can be: ``n`` its number, ``month`` by name, ``year`` (two digits by the pivot).

    ``full`` tells that it has four digits; ``late`` that it can be neither day
    nor month, so that it must be the year.
    """
    digits, size = token.rlike(r"^\d{1,4}$"), F.length(token)
    n = F.when(digits, token).cast("int")
    short = F.when(size <= 2, n + F.when(n >= TWO_DIGIT_YEAR_PIVOT, F.lit(1900)).otherwise(F.lit(2000)))
    return F.struct(
        token.alias("token"), n.alias("n"), F.try_element_at(_months(), token).alias("month"),
        F.when(size == 4, n).otherwise(short).alias("year"), (digits & (size == 4)).alias("full"), ((size > 2) | (n > 31)).alias("late"),
    )


def _ymd(year: Column, month: Column, day: Column | int) -> Column:
    return F.struct(year.alias("y"), month.alias("m"), (F.lit(day) if isinstance(day, int) else day).alias("d"))


def _date(r: Column) -> Column:
    """The date of year, month and day; null where there is no such day.  The cast raises nothing."""
    text = F.concat(F.lpad(r["y"].cast("string"), 4, "0"), F.lit("-"), r["m"].cast("string"), F.lit("-"), r["d"].cast("string"))
    return F.when((r["y"] > 0) & r["m"].between(1, 12) & r["d"].between(1, 31), text).try_cast("date")


def _three(t: Column) -> Column:
    """Three fields: with a month name the other two are day and year, without one the first number decides."""
    a, b, c = t[0], t[1], t[2]
    first_of_quarter = lambda q: q["n"] * 3 - 2
    return (
        F.when((b["token"] == "q") & a["full"], _ymd(a["n"], first_of_quarter(c), 1))
        .when((b["token"] == "q") & c["full"], _ymd(c["n"], first_of_quarter(a), 1))
        .when(a["month"].isNotNull() & b["late"], _ymd(b["year"], a["month"], c["n"]))
        .when(a["month"].isNotNull(), _ymd(c["year"], a["month"], b["n"]))
        .when(b["month"].isNotNull() & a["late"], _ymd(a["year"], b["month"], c["n"]))
        .when(b["month"].isNotNull(), _ymd(c["year"], b["month"], a["n"]))
        .when(c["month"].isNotNull() & b["late"], _ymd(b["year"], c["month"], a["n"]))
        .when(c["month"].isNotNull(), _ymd(a["year"], c["month"], b["n"]))
        .when(a["late"], _ymd(a["year"], b["n"], c["n"]))
        .when(a["n"] > 12, _ymd(c["year"], b["n"], a["n"]))  # day first only where the month would exceed 12
        .otherwise(_ymd(c["year"], a["n"], b["n"]))
    )


def _two(t: Column) -> Column:
    """Month and year: the first day of the month.  A day without a year is no date."""
    a, b = t[0], t[1]
    return (
        F.when(a["full"], _ymd(a["n"], F.coalesce(b["month"], b["n"]), 1))
        .when(b["full"], _ymd(b["n"], F.coalesce(a["month"], a["n"]), 1))
    )


def _one(t: Column) -> Column:
    """A run of digits: a year, or eight (with a time of day behind them or without)."""
    x = t[0]["token"]
    part = lambda i, n: F.substring(x, i, n).cast("int")
    return (
        F.when(x.rlike(r"^\d{8}$") | x.rlike(DIGITS_WITH_TIME), _ymd(part(1, 4), part(5, 2), part(7, 2)))
        .when(t[0]["full"], _ymd(t[0]["n"], F.lit(1), 1))
    )


def _fields(tokens: Column) -> Column:
    read = lambda t: F.when(F.size(t) == 3, _three(t)).when(F.size(t) == 2, _two(t)).when(F.size(t) == 1, _one(t))
    return let(let(F.transform(tokens, _field), read), _date)


def _spelled(x: Column) -> Column:
    fillers = [*WEEKDAY_NAMES, *DATE_FILLERS]
    paired = F.when(x.rlike(r"^\d{6}$"), F.regexp_replace(x, r"(\d\d)(?=\d)", "$1 ")).otherwise(x)  # six digits are three pairs
    tokens = F.filter(F.regexp_extract_all(paired, F.lit(r"(\d+|[a-z]+)"), F.lit(1)), lambda t: ~t.isin(fillers))
    return F.when(x.rlike(DATE_LIKE), let(tokens, _fields))


def parse_mixed_date(col: Column | str) -> Column:
    """Parse a string column holding dates in mixed spellings to ``DateType``.

    White space at the ends and a time of day are dropped.  Read are numbers
    joined by any of ``- / . , ;`` or blanks (an ambiguous ``02/03/2023`` is
    month-first, ``25/12/2023`` day-first as there is no month 25), eight or
    six digits in a row, month names and their short forms in any place, with
    weekday names, ordinals and joining words (``Friday, 3rd of Feb. 2023``,
    ``03FEB2023``), a month and a year or a year alone (their first day) and
    quarters (``2023Q1``).  Years of two digits lie in 1969 to 2068.  Null for
    anything else and for days that do not exist; nothing is ever raised, which
    matters because ANSI mode is on.

    The value is bound once (``let``), so the expression's size does not
    depend on the number of spellings.
    """
    cut = lambda v: let(F.when(v.rlike("[:mt]"), F.regexp_replace(v, TIME_OF_DAY, "")).otherwise(v), _spelled)
    return let(F.lower(strip(col)), lambda v: F.when(v.rlike(ISO), v.try_cast("date")).otherwise(cut(v)))
