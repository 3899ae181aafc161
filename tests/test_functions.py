import datetime as dt

import pytest
from pyspark.sql import functions as F

from staylens.functions import normalise_segment, null_tokens_to_null, parse_mixed_date, ratio, to_whole_number
from staylens.functions.text import segment_name

D = dt.date


def _one(spark, expr, values, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_parse_mixed_date_formats(spark):
    cases = {
        "2023-02-01": D(2023, 2, 1),
        "2023-2-1": D(2023, 2, 1),
        "  2023-02-01  ": D(2023, 2, 1),
        "2023-02-01 10:30:00": D(2023, 2, 1),   # time of day dropped: joins on the day
        "2023-02-01T10:30:00": D(2023, 2, 1),
        "2023/2/1": D(2023, 2, 1),
        "20230201": D(2023, 2, 1),
        "02/03/2023": D(2023, 2, 3),            # ambiguous: month first
        "25/12/2023": D(2023, 12, 25),          # month > 12: day first
        "12-25-2023": D(2023, 12, 25),
        "25-12-2023": D(2023, 12, 25),
        "1/2/23": D(2023, 1, 2),
        "Feb 3 2023": D(2023, 2, 3),
        "2023-02-30": None,                     # impossible day
        "not-a-date": None,
        "13/13/2023": None,
    }
    got = _one(spark, parse_mixed_date("s"), list(cases))
    assert dict(zip(cases, got)) == cases


def test_parse_mixed_date_null(spark):
    assert _one(spark, parse_mixed_date("s"), [None]) == [None]


def test_null_tokens_exact_match(spark):
    vals = ["", "NA", "N/A", "NULL", "null", "None", "na", " NA", "x", None]
    got = _one(spark, null_tokens_to_null("s"), vals)
    assert got == [None, None, None, None, None, None, "na", " NA", "x", None]


def test_normalise_segment(spark):
    vals = ["TA", " travel agency ", "t/a", "Travel Agency", "DIRECT", "Direct Booking", "Corp", "corporate",
            "GRP", "Groups", "walk_in", "Walk-in", "WALK IN", None, " Kiosk ", "Unknown"]
    got = _one(spark, normalise_segment("s"), vals)
    assert got == ["Travel Agency"] * 4 + ["Direct"] * 2 + ["Corporate"] * 2 + ["Group"] * 2 + ["Walk-in"] * 3 + [
        "Unknown", " Kiosk ", "Unknown"]


def test_segment_name_maps_unmapped_to_unknown(spark):
    got = _one(spark, segment_name("s"), ["Direct", " Kiosk ", "Unknown", "direct"])
    assert got == ["Direct", "Unknown", "Unknown", "Unknown"]


def test_to_whole_number(spark):
    got = _one(spark, to_whole_number("s"), ["3", " 4 ", "3.0", "3.5", "abc", None, "-2"])
    assert got == [3, 4, 3, None, None, None, -2]


def test_ratio_null_on_zero(spark):
    df = spark.createDataFrame([(1, 4), (1, 0), (None, 2)], "a int, b int")
    got = [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [0.25, None, None]


@pytest.mark.parametrize("raw, want", [
    ("2023-02-03 10:00", (2023, 2, 3)), ("2023-02-03T10:00", (2023, 2, 3)), ("2023-02-03 10:00:00.5", (2023, 2, 3)),
    ("2023-02-03T10:00:00Z", (2023, 2, 3)), ("2023-02-03T10:00:00+02:00", (2023, 2, 3)), ("2/3/2023 10:00", (2023, 2, 3)),
    ("2/3/2023 10:00 PM", (2023, 2, 3)), ("3 Feb 2023", (2023, 2, 3)), ("03-Feb-2023", (2023, 2, 3)),
    ("Feb 3, 2023", (2023, 2, 3)), ("February 3, 2023", (2023, 2, 3)), ("3 February 2023", (2023, 2, 3)),
    ("25/12/23", (2023, 12, 25)), ("12-25-23", (2023, 12, 25)), ("12/25/99", (1999, 12, 25)), ("2023.02.03", (2023, 2, 3)),
    ("03.02.2023", (2023, 3, 2)), ("25.02.2023", (2023, 2, 25)), ("\t2023-02-03\u00a0", (2023, 2, 3)),
    ("2023-02-30", None), ("2023-02-03 25:00", None), ("soon", None), ("", None), (None, None),
])
def test_more_date_spellings(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "d string").select(parse_mixed_date("d")).first()[0]
    assert got == (dt.date(*want) if want else None)


def test_unicode_padding_and_wide_money(spark):
    from decimal import Decimal

    from staylens.functions import normalise_segment, to_decimal, to_whole_number

    df = spark.createDataFrame([("Direct\t", "\u00a012345678901.00 "), ("TA\n", "99.995"), ("\u3000corp", "x")], "s string, m string")
    rows = df.select(normalise_segment("s"), to_decimal("m"), to_whole_number("m")).collect()
    assert [r[0] for r in rows] == ["Direct", "Travel Agency", "Corporate"]
    assert [r[1] for r in rows] == [Decimal("12345678901.00"), Decimal("99.995"), None]


@pytest.mark.parametrize("raw, want", [
    ("Friday, February 3, 2023", (2023, 2, 3)), ("Fri Feb 3 2023", (2023, 2, 3)), ("3 Feb 2023 Friday", (2023, 2, 3)),
    ("Feb 2023", (2023, 2, 1)), ("2023 Feb", (2023, 2, 1)), ("2023-02", (2023, 2, 1)), ("02/2023", (2023, 2, 1)), ("2023", (2023, 1, 1)),
    ("3rd Feb 2023", (2023, 2, 3)), ("Feb 3rd, 2023", (2023, 2, 3)), ("21st of May 2023", (2023, 5, 21)),
    ("03FEB2023", (2023, 2, 3)), ("03feb23", (2023, 2, 3)), ("2023 02 03", (2023, 2, 3)), ("Sept 3 2023", (2023, 9, 3)), ("Sept. 3 2023", (2023, 9, 3)),
    ("2023Q3", (2023, 7, 1)), ("3Q2023", (2023, 7, 1)), ("2023-Q3", (2023, 7, 1)), ("2023 3 Feb", (2023, 2, 3)), ("99-12-31", (1999, 12, 31)),
    ("20230203101500", (2023, 2, 3)), ("20230203T101500", (2023, 2, 3)), ("10:30 PM Feb 3 2023", (2023, 2, 3)), ("3 Feb, 2023 at 10:00", (2023, 2, 3)),
    ("2023-034", None), ("1675382400", None), ("2023-W05-5", None), ("Feb 3", None), ("Feb 30 2023", None), ("13/2023", None), ("2023-13", None),
    ("the 3rd Feb 2023", None), ("Q1 2023", None), ("2023_02_03", None), ("0000-01-01", None), ("may", None), ("20230230", None),
])
def test_date_grammar(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "d string").select(parse_mixed_date("d")).first()[0]
    assert got == (dt.date(*want) if want else None)


SPELLINGS = (
    "%Y-%m-%d", "%A, %B %d, %Y", "%a %b %d %Y", "%d%b%Y", "%Y %m %d", "%b %Y", "%Y-%m", "%m/%Y", "%Y", "%B %d, %Y", "%d %B %Y", "%d-%b-%y",
    "%Y%m%d", "%m/%d/%y", "%d/%m/%Y", "%m.%d.%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%m/%d/%Y %I:%M %p", "%Y/%m/%d", "%y%m%d", "%Y %d %b",
    "%H:%M %Y-%m-%d", "%b %d %Y %I %p", "%Y%m%dT%H%M%S", "%Y%m%d%H%M%S", "%Y-%b-%d", "%d/%b/%Y", "%b. %d, %Y", "%d.%m.%y", "%y-%m-%d",
    "%A %d %B %Y at %H:%M", "%d-%m-%Y", "%m-%d-%Y",
)


def test_dates_as_pandas_infers_them(spark):
    import random

    import pandas as pd

    rng = random.Random(7)
    values = sorted({
        dt.datetime(rng.randint(1980, 2060), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59)).strftime(f)
        for f in SPELLINGS for _ in range(20)
    })
    got = _one(spark, parse_mixed_date("s"), values)
    want = [pd.to_datetime(pd.Series([v]), errors="coerce", format="mixed")[0] for v in values]
    assert [(v, g) for v, g, w in zip(values, got, want, strict=True) if g != (None if pd.isna(w) else w.date())] == []


def test_date_expression_stays_small(spark):
    df = spark.range(1).select(F.lit("x").alias("s")).select(parse_mixed_date("s").alias("d"))
    assert len(df._jdf.queryExecution().analyzed().toString()) < 8_000
