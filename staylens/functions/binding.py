"""Binding an intermediate value, so that an expression stays small however often it uses the value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is written and computed once.

    Catalyst inlines a column wherever it is used; a value used n times in an
    expression that is itself used n times grows as n squared, until generated
    code no longer compiles.  The variable of a higher-order function is not
    inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
