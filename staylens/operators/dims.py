"""Segment dimension, typed fact projection and the row-count audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.config import DEFAULT_CONFIG, FACT_TYPED_COLUMNS, UNKNOWN, Config
from staylens.operators import views as V


def dim_segment(spark: SparkSession, cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """``(segment_id, segment_name)``; ids 1..n in canonical order, Unknown last.

    Rebuilt identically on every call (idempotent); six literal rows.
    """
    rows = [(i, s) for i, s in enumerate(cfg.dim_segments, start=1)]
    return spark.createDataFrame(rows, "segment_id int, segment_name string")


def fact_typed(fact: DataFrame, dim: DataFrame, cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """The loadable fact — segment label replaced by its dimension id.

    Unmapped labels get Unknown's id.  The dimension is a literal of
    ``len(cfg.dim_segments)`` rows, so broadcasting it is size-safe.
    """
    unknown_id = F.lit(cfg.dim_segments.index(UNKNOWN) + 1)
    d = F.broadcast(dim.select(F.col("segment_name").alias("segment"), "segment_id"))
    typed = fact.join(d, "segment", "left").withColumn("segment_id", F.coalesce("segment_id", unknown_id))
    return typed.select(*FACT_TYPED_COLUMNS)


def row_count_audit(fs: DataFrame, dim: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """``(object_name, object_type, n_rows)`` for the dimension, fact and views."""
    parts = [
        dim.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit("dim_segment").alias("object_name"), F.lit("table").alias("object_type"), "n_rows"),
        fs.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit("fact_bookings_enriched").alias("object_name"), F.lit("table").alias("object_type"), "n_rows"),
    ]
    daily = daily if daily is not None else V.segment_daily(fs)
    for name, fn in V.VIEWS.items():
        parts.append(fn(daily).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("object_name"), F.lit("view").alias("object_type"), "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
