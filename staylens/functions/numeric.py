"""Numeric coercion and safe-ratio expressions (ANSI-safe: never raise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from staylens.functions.text import strip

#: Wide enough that no amount in use is rounded or lost.
MONEY = DecimalType(24, 6)


def to_decimal(col: Column | str, dtype: DecimalType = MONEY) -> Column:
    """String -> exact decimal; unparseable text becomes null."""
    return strip(col).try_cast(dtype)


def to_whole_number(col: Column | str) -> Column:
    """String -> int for whole numbers (``"3"``, ``"3.0"``); anything else null."""
    d = strip(col).try_cast("double")
    return F.when(d == F.floor(d), d.try_cast("int"))


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double; null when the denominator is zero or null."""
    return F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0)))
