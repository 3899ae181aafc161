"""The seven KPI views, computed from a day-level rollup of the fact.

``segment_daily`` aggregates the fact once to (segment, check-in day, season)
grain: counts, room-night and revenue sums, lead-time sum/count/min/max.
Every view (and every metric built on them) is a further aggregation of
that rollup, which is exact because all of those statistics decompose (sums
of integer and decimal parts, min of mins, max of maxes).  Its size is
bounded by segments × days × seasons — independent of the booking volume —
so the pipeline writes it once and the dashboard queries read a few
thousand rows instead of scanning the fact five times.

Each function accepts either that rollup or a fact frame (it then builds the
rollup lazily), so the operators stay plain DataFrame -> DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.config import DEFAULT_CONFIG, Config
from staylens.functions import ratio, segment_name

DAILY_KEYS = ("segment_name", "date", "season_tag")


def segmented(fact: DataFrame, cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """Attach the dimension name (canonical label, everything else Unknown).

    Equivalent to the inner join with the six-row segment dimension where
    unmapped labels were loaded under Unknown's id, expressed as a projection
    so it costs no join at all.
    """
    return fact.withColumn("segment_name", segment_name("segment", cfg.canonical_segments))


def segment_daily(fs: DataFrame) -> DataFrame:
    """Rollup of the segmented fact to (segment_name, date, season_tag).

    One scan and one shuffle of partial aggregates; a hot day or segment is
    combined map-side.
    """
    active = ~F.col("is_cancelled")
    priced = active & F.col("rate").isNotNull()
    at_risk = F.col("is_cancelled") & F.col("rate").isNotNull()
    revenue = F.col("room_nights") * F.col("rate")
    lead = F.col("lead_time_days")
    return fs.groupBy("segment_name", F.col("check_in_date").alias("date"), "season_tag").agg(
        F.count(F.lit(1)).alias("n_bookings"),
        F.count_if("is_cancelled").alias("n_cancelled"),
        F.sum("room_nights").alias("room_nights"),
        F.count_if(active).alias("n_active"),
        F.sum(F.when(active, F.col("room_nights"))).alias("active_room_nights"),
        F.count_if(priced).alias("n_priced"),
        F.sum(F.when(priced, revenue)).alias("active_revenue"),
        F.count_if(at_risk).alias("n_at_risk"),
        F.sum(F.when(at_risk, revenue)).alias("revenue_at_risk"),
        F.sum(lead).alias("lead_sum"),
        F.count(lead).alias("lead_count"),
        F.min(lead).alias("lead_min"),
        F.max(lead).alias("lead_max"),
    )


def as_daily(df: DataFrame, cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """The rollup itself, or the rollup of a (segmented or not) fact frame."""
    if "n_bookings" in df.columns:
        return df
    return segment_daily(df if "segment_name" in df.columns else segmented(df, cfg))


def chosen_segments(segment: str | Sequence[str] | None) -> Column:
    """Whether a row's segment is the chosen one, or among the chosen ones."""
    if segment is None:
        return F.lit(True)
    return F.col("segment_name").isin([segment] if isinstance(segment, str) else list(segment))


def apply_filters(
    df: DataFrame,
    segment: str | Sequence[str] | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
    seasons: Sequence[str] | None = None,
) -> DataFrame:
    """Optional segments (one or several), inclusive check-in range and season filters.

    All three are rollup keys, so on the written rollup they prune Parquet
    row groups, and on a lazy rollup Catalyst pushes them below the
    aggregate (the date range all the way into the fact scan).
    """
    d = as_daily(df)
    cond: Column = F.lit(True)
    if segment is not None:
        cond = cond & chosen_segments(segment)
    if start_date is not None:
        cond = cond & (F.col("date") >= F.to_date(F.lit(start_date)))
    if end_date is not None:
        cond = cond & (F.col("date") <= F.to_date(F.lit(end_date)))
    if seasons is not None:
        cond = cond & F.col("season_tag").isin(list(seasons))
    return d.filter(cond)


def v_daily_room_nights(df: DataFrame) -> DataFrame:
    """V1: active room nights per segment and check-in day."""
    return (
        as_daily(df).groupBy("segment_name", "date")
        .agg(F.sum("n_active").alias("__n"), F.sum("active_room_nights").alias("booked_room_nights"))
        .filter(F.col("__n") > 0)
        .drop("__n")
    )


def v_cancellation_stats(df: DataFrame) -> DataFrame:
    """V2: bookings, cancellations and their ratio per segment."""
    return (
        as_daily(df).groupBy("segment_name")
        .agg(F.sum("n_bookings").alias("total_bookings"), F.sum("n_cancelled").alias("cancelled_bookings"))
        .withColumn("cancellation_rate", ratio(F.col("cancelled_bookings"), F.col("total_bookings")))
    )


def v_lead_time(df: DataFrame) -> DataFrame:
    """V3: mean/min/max known lead time per segment."""
    return (
        as_daily(df).groupBy("segment_name")
        .agg(
            F.sum("lead_sum").alias("__sum"),
            F.sum("lead_count").alias("__n"),
            F.min("lead_min").alias("min_lead_time_days"),
            F.max("lead_max").alias("max_lead_time_days"),
        )
        .filter(F.col("__n") > 0)
        .select(
            "segment_name",
            ratio(F.col("__sum"), F.col("__n")).alias("avg_lead_time_days"),
            "min_lead_time_days",
            "max_lead_time_days",
        )
    )


def v_bookings_by_season(df: DataFrame) -> DataFrame:
    """V4: bookings (cancelled included) and room nights per segment and season."""
    return (
        as_daily(df).filter(F.col("season_tag").isNotNull())
        .groupBy("segment_name", "season_tag")
        .agg(F.sum("n_bookings").alias("booking_count"), F.sum("room_nights").alias("room_nights"))
    )


def v_revenue_at_risk(df: DataFrame) -> DataFrame:
    """V5: revenue of cancelled bookings with a known rate, per segment."""
    return (
        as_daily(df).groupBy("segment_name")
        .agg(F.sum("n_at_risk").alias("__n"), F.sum("revenue_at_risk").alias("revenue_at_risk"))
        .filter(F.col("__n") > 0)
        .drop("__n")
    )


def v_daily_revenue(df: DataFrame) -> DataFrame:
    """V6: active revenue per segment, booked on the check-in day."""
    return (
        as_daily(df).groupBy("segment_name", "date")
        .agg(F.sum("n_priced").alias("__n"), F.sum("active_revenue").alias("daily_room_revenue"))
        .filter(F.col("__n") > 0)
        .drop("__n")
    )


def v_segment_summary(df: DataFrame) -> DataFrame:
    """V7: all per-segment aggregates in one pass; no risk counts as 0."""
    return (
        as_daily(df).groupBy("segment_name")
        .agg(
            F.sum("n_bookings").alias("total_bookings"),
            F.sum("room_nights").alias("total_room_nights"),
            F.sum("n_cancelled").alias("__cancelled"),
            F.sum("lead_sum").alias("__lead_sum"),
            F.sum("lead_count").alias("__lead_n"),
            F.coalesce(F.sum("revenue_at_risk"), F.lit(0)).alias("revenue_at_risk"),
        )
        .select(
            "segment_name",
            "total_bookings",
            "total_room_nights",
            ratio(F.col("__cancelled"), F.col("total_bookings")).alias("cancellation_rate"),
            ratio(F.col("__lead_sum"), F.col("__lead_n")).alias("avg_lead_time_days"),
            "revenue_at_risk",
        )
    )


VIEWS = {
    "v_daily_room_nights_by_segment": v_daily_room_nights,
    "v_cancellation_stats_by_segment": v_cancellation_stats,
    "v_lead_time_by_segment": v_lead_time,
    "v_bookings_by_segment_season": v_bookings_by_season,
    "v_revenue_at_risk_by_segment": v_revenue_at_risk,
    "v_daily_revenue_by_segment": v_daily_revenue,
    "v_segment_summary": v_segment_summary,
}


def register_views(fs: DataFrame, daily: DataFrame | None = None) -> list[str]:
    """Register the fact and every view as temp views (replacing earlier ones)."""
    fs.createOrReplaceTempView("fact_bookings_enriched")
    d = daily if daily is not None else segment_daily(fs)
    for name, fn in VIEWS.items():
        fn(d).createOrReplaceTempView(name)
    return list(VIEWS)
