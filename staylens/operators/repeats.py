"""Rows and keys that occur more than once, found by their hashes first.

Grouping wide rows, or long keys, sends every one of them through an exchange,
although hardly any repeats.  Here only 64-bit hashes are exchanged; the few
that occur more than once pick the candidate rows, which are then compared in
full.  A hash collision only adds a candidate, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.config import DEFAULT_CONFIG, Config
from staylens.plans.materialize import bounded_broadcast, materialize


def row_hash(cols: Sequence[str]) -> Column:
    """A 64-bit hash of several columns, with nulls marked (Spark's hash passes over them)."""
    return F.xxhash64(*map(F.col, cols), *[F.col(c).isNull() for c in cols])


def repeated(df: DataFrame, cols: Sequence[str], cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """``cols`` and ``copies``: the values of these columns that occur more than once; nulls compare equal.

    Runs one job for the hashes (so that their number is known).  Where more
    hashes repeat than may be broadcast, the candidates meet them in a join by
    hash, and partial counts collapse a hot value before any exchange of rows.
    """
    h = row_hash(cols).alias("__h")
    seen, found = materialize(
        df.select(h).groupBy("__h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__h"),
        "repeats", {"n": F.count(F.lit(1))},
    )
    n = int(found["n"] or 0)
    if n <= cfg.broadcast_max_rows:
        candidates = df.select(*cols, h).join(bounded_broadcast(seen, cfg.broadcast_max_rows, n), "__h", "left_semi")
    else:
        counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__c")).withColumn("__h", row_hash(cols))
        return counted.join(seen.hint("merge"), "__h", "left_semi").filter("__c > 1").select(*cols, F.col("__c").alias("copies"))
    return candidates.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def surplus(df: DataFrame, cols: Sequence[str], cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """One row: ``repeats`` (values that occur more than once) and ``extra`` (rows beyond the first of each)."""
    return repeated(df, cols, cfg).agg(
        F.count(F.lit(1)).alias("repeats"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("extra"))
