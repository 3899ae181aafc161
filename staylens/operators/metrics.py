"""The eight segment metrics, their rolling / per-night variants and the summary.

Metrics take the day-level rollup (``views.segment_daily``) or a segmented
fact (the rollup is then built lazily); only the per-night variant needs the
row-grain fact.  The daily series are aggregates (segments × days), so the
dispersion statistics run on small frames; the only whole-frame window
(``Window.partitionBy()``) is over the per-segment variances, at most one row
per dimension segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.config import DEFAULT_CONFIG, UNKNOWN, Config
from staylens.functions import ratio
from staylens.operators import views as V


def _desc(c: str) -> Column:
    return F.col(c).desc_nulls_last()


def ordered(df: DataFrame, *cols) -> DataFrame:
    """Final ordering of a metric result.

    Results here have at most one row per segment (and day), so they are
    sorted in one task: ``coalesce(1)`` narrows only the last stage (after the
    final exchange, whose input is partial aggregates) and spares the range
    partitioning exchange and its sampling job.
    """
    return df.coalesce(1).orderBy(*cols)


def _cov(values: Column) -> Column:
    """Sample standard deviation over mean (null for one value or zero mean)."""
    return ratio(F.stddev_samp(values), F.avg(values))


# --- M1 / M2 / M2r / M6: occupancy -------------------------------------------

def occupancy_series(
    fs: DataFrame,
    cfg: Config = DEFAULT_CONFIG,
    segment: str | Sequence[str] | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
    seasons: Sequence[str] | None = None,
) -> DataFrame:
    """Daily occupancy per segment: ``(segment_name, date, booked_room_nights, occupancy_rate)``.

    Days without active bookings are absent (not zero), as in the view.
    """
    v = V.v_daily_room_nights(V.apply_filters(fs, segment, start_date, end_date, seasons))
    return v.select(
        "segment_name",
        "date",
        F.col("booked_room_nights").cast("bigint").alias("booked_room_nights"),
        F.round(F.col("booked_room_nights").cast("double") / F.lit(float(cfg.capacity)), 4).alias("occupancy_rate"),
    )


def m1_occupancy(fs: DataFrame, cfg: Config = DEFAULT_CONFIG, **filters) -> DataFrame:
    """M1: daily occupancy rate per segment, ordered by segment and day."""
    return ordered(occupancy_series(fs, cfg, **filters), "segment_name", "date")


def m2_cov(fs: DataFrame, cfg: Config = DEFAULT_CONFIG, **filters) -> DataFrame:
    """M2: whole-period occupancy coefficient of variation per segment."""
    s = occupancy_series(fs, cfg, **filters)
    return ordered(
        s.groupBy("segment_name").agg(F.round(_cov(F.col("occupancy_rate")), 4).alias("cov")),
        _desc("cov"), "segment_name",
    )


def m2_rolling_cov(fs: DataFrame, cfg: Config = DEFAULT_CONFIG, rolling_days: int = 30, **filters) -> DataFrame:
    """M2r: CoV over the trailing ``rolling_days`` calendar days, per segment and day.

    A range frame on the day number, so missing days shrink the window
    instead of shifting it.  Partitioned by segment over the daily series,
    which has at most one row per segment and day.
    """
    s = occupancy_series(fs, cfg, **filters)
    w = Window.partitionBy("segment_name").orderBy(F.unix_date("date")).rangeBetween(-(rolling_days - 1), 0)
    return ordered(s.select(
        "segment_name",
        "date",
        F.round(ratio(F.stddev_samp("occupancy_rate").over(w), F.avg("occupancy_rate").over(w)), 4).alias(
            "rolling_cov"
        ),
        F.count(F.lit(1)).over(w).alias("window_days"),
    ), "segment_name", "date")


def m6_contribution(fs: DataFrame, cfg: Config = DEFAULT_CONFIG, **filters) -> DataFrame:
    """M6 (headline): share of the summed per-segment occupancy variances.

    Null variances (one-day segments) are skipped in the total; when the
    total is zero every segment gets 0.0.
    """
    var = occupancy_series(fs, cfg, **filters).groupBy("segment_name").agg(
        F.var_samp("occupancy_rate").alias("__var")
    )
    if not cfg.include_unknown:
        var = var.filter(F.col("segment_name") != UNKNOWN)
    var = var.coalesce(1)  # at most one row per segment: the window needs no exchange
    total = F.coalesce(F.sum("__var").over(Window.partitionBy()), F.lit(0.0))
    return ordered(
        var.select(
            "segment_name",
            F.round("__var", 6).alias("variance"),
            F.when(total == 0.0, F.lit(0.0))
            .otherwise(F.round(F.try_divide(F.col("__var"), total), 4))
            .alias("volatility_contribution"),
        ),
        _desc("volatility_contribution"), "segment_name",
    )


# --- M3 / M4 / M7: single-pass segment aggregates ---------------------------

def m3_cancel_rate(fs: DataFrame, cfg: Config = DEFAULT_CONFIG, **filters) -> DataFrame:
    """M3: cancellation rate per segment."""
    v = V.v_cancellation_stats(V.apply_filters(fs, **filters))
    return v.select(
        "segment_name",
        "total_bookings",
        "cancelled_bookings",
        F.round("cancellation_rate", 4).alias("cancellation_rate"),
    ).transform(lambda d: ordered(d, _desc("cancellation_rate"), "segment_name"))


def m4_lead_time(fs: DataFrame, cfg: Config = DEFAULT_CONFIG, **filters) -> DataFrame:
    """M4: average (1 decimal), min and max lead time per segment."""
    v = V.v_lead_time(V.apply_filters(fs, **filters))
    return v.select(
        "segment_name",
        F.round("avg_lead_time_days", 1).alias("avg_lead_time_days"),
        "min_lead_time_days",
        "max_lead_time_days",
    ).transform(lambda d: ordered(d, _desc("avg_lead_time_days"), "segment_name"))


def lead_time_distribution(fact: DataFrame, width: int = 30, **filters) -> DataFrame:
    """Bookings per segment and lead-time class of ``width`` days: ``(segment_name, lead_from, n_bookings, share)``.

    Needs the row-grain (segmented) fact.  The class is a group key, so the
    distribution is one partially aggregated pass; shares are taken over its
    few rows.  Bookings without a lead time are left out.
    """
    known = fact.filter(F.col("lead_time_days").isNotNull() & V.chosen_segments(filters.get("segment")))
    if filters.get("start_date") is not None:
        known = known.filter(F.col("check_in_date") >= F.to_date(F.lit(filters["start_date"])))
    if filters.get("end_date") is not None:
        known = known.filter(F.col("check_in_date") <= F.to_date(F.lit(filters["end_date"])))
    if filters.get("seasons") is not None:
        known = known.filter(F.col("season_tag").isin(list(filters["seasons"])))
    bins = known.groupBy("segment_name", (F.floor(F.col("lead_time_days") / width) * width).cast("int").alias("lead_from")).agg(
        F.count(F.lit(1)).alias("n_bookings"))
    share = ratio(F.col("n_bookings"), F.sum("n_bookings").over(Window.partitionBy("segment_name")))
    return ordered(bins.withColumn("share", F.round(share, 4)), "segment_name", "lead_from")


def m7_revenue_at_risk(fs: DataFrame, cfg: Config = DEFAULT_CONFIG, **filters) -> DataFrame:
    """M7: revenue of cancelled bookings per segment (all dates unless a range is given)."""
    v = V.v_revenue_at_risk(V.apply_filters(fs, **filters))
    return v.select(
        "segment_name", F.round("revenue_at_risk", 2).cast("double").alias("revenue_at_risk")
    ).transform(lambda d: ordered(d, _desc("revenue_at_risk"), "segment_name"))


# --- M5 / W1 / W2: seasons ----------------------------------------------------

def season_share(fs: DataFrame, cfg: Config = DEFAULT_CONFIG, **filters) -> DataFrame:
    """Each season's share of a segment's bookings."""
    v = V.v_bookings_by_season(V.apply_filters(fs, **filters)).coalesce(1)  # segments × seasons rows
    total = F.sum("booking_count").over(Window.partitionBy("segment_name"))
    return v.select(
        "segment_name",
        "season_tag",
        "booking_count",
        F.col("room_nights").cast("bigint").alias("room_nights"),
        F.round(ratio(F.col("booking_count"), total), 4).alias("season_share"),
    ).transform(lambda d: ordered(d, "segment_name", _desc("booking_count"), "season_tag"))


def _ranked_seasons(fs: DataFrame, **filters) -> DataFrame:
    v = V.v_bookings_by_season(V.apply_filters(fs, **filters)).coalesce(1)  # segments × seasons rows
    w = Window.partitionBy("segment_name").orderBy(F.col("booking_count").desc(), "season_tag")
    return v.withColumn("season_rank", F.row_number().over(w))


def top2_seasons(fs: DataFrame, cfg: Config = DEFAULT_CONFIG, **filters) -> DataFrame:
    """The two busiest seasons per segment (exactly two; ties by season name)."""
    return (
        _ranked_seasons(fs, **filters)
        .filter(F.col("season_rank") <= 2)
        .select("segment_name", "season_tag", "booking_count", "season_rank")
        .transform(lambda d: ordered(d, "segment_name", "season_rank"))
    )


def m5_seasonal(fs: DataFrame, cfg: Config = DEFAULT_CONFIG, **filters) -> DataFrame:
    """M5: top-2 season share over the even-spread share ``min(2, n) / n``.

    ``n`` counts the seasons the segment actually has; the index uses the
    unrounded shares.
    """
    per_seg = _ranked_seasons(fs, **filters).groupBy("segment_name").agg(
        F.count(F.lit(1)).alias("n_seasons"),
        F.sum("booking_count").alias("__total"),
        F.sum(F.when(F.col("season_rank") <= 2, F.col("booking_count"))).alias("__top2"),
    )
    top2_share = ratio(F.col("__top2"), F.col("__total"))
    even_share = ratio(F.least(F.lit(2), F.col("n_seasons")), F.col("n_seasons"))
    return (
        per_seg.filter(F.col("__total") > 0)
        .select(
            "segment_name",
            "n_seasons",
            F.round(top2_share, 4).alias("top2_share"),
            F.round(even_share, 4).alias("even_share"),
            F.round(F.try_divide(top2_share, even_share), 4).alias("seasonal_concentration_index"),
        )
        .transform(lambda d: ordered(d, _desc("seasonal_concentration_index"), "segment_name"))
    )


# --- M8 / M8n: revenue volatility ----------------------------------------------

def _rvi(series: DataFrame, value: str) -> DataFrame:
    x = F.col(value).cast("double")
    return (
        series.groupBy("segment_name")
        .agg(F.avg(x).alias("__mean"), F.stddev_samp(x).alias("__std"))
        .select(
            "segment_name",
            F.round("__mean", 2).alias("mean_daily_revenue"),
            F.round(ratio(F.col("__std"), F.col("__mean")), 4).alias("rvi"),
        )
        .transform(lambda d: ordered(d, _desc("rvi"), "segment_name"))
    )


def m8_rvi(fs: DataFrame, cfg: Config = DEFAULT_CONFIG, **filters) -> DataFrame:
    """M8: CoV of daily revenue (whole stay booked on the check-in day)."""
    return _rvi(V.v_daily_revenue(V.apply_filters(fs, **filters)), "daily_room_revenue")


def nightly_revenue(fs: DataFrame, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Revenue per segment and *night*: each active stay adds its rate to every night.

    Needs the row-grain (segmented) fact, not the rollup.

    A stay adds its rate on its first night and takes it off after its last one,
    so two rows of changes a stay, whatever its length, are partially aggregated
    in the scan stage and shuffled; a running sum over the days on which
    something changes gives the nights from each such day to the next.  That
    window and the expansion to single nights run over segments x days.  With a
    date range, stays are cut to it, and those outside it are dropped; the
    check-in bound reaches the Parquet scan.
    """
    active = fs.filter(~F.col("is_cancelled") & F.col("rate").isNotNull() & (F.col("room_nights") > 0))
    first, behind = F.col("check_in_date"), F.date_add("check_in_date", F.col("room_nights"))
    if end_date is not None:
        end = F.to_date(F.lit(end_date))
        active = active.filter(first <= end)
        behind = F.least(behind, F.date_add(end, 1))
    if start_date is not None:
        start = F.to_date(F.lit(start_date))
        active = active.filter(behind > start)
        first = F.greatest(first, start)
    change = lambda day, sign: F.struct(day.alias("date"), (F.col("rate") * sign).alias("rate"), F.lit(sign).alias("stays"))
    changes = (
        active.select("segment_name", F.inline(F.array(change(first, 1), change(behind, -1))))
        .groupBy("segment_name", "date").agg(F.sum("rate").alias("rate"), F.sum("stays").alias("stays"))
    )
    by_day = Window.partitionBy("segment_name").orderBy("date")
    runs = changes.select(
        "segment_name", "date", F.date_sub(F.lead("date").over(by_day), 1).alias("last"),
        F.sum("rate").over(by_day).alias("revenue"), F.sum("stays").over(by_day).alias("stays"),
    ).filter("stays > 0")
    return runs.select("segment_name", F.explode(F.sequence("date", "last")).alias("date"), F.col("revenue").alias("nightly_room_revenue"))


def m8_rvi_nightly(fs: DataFrame, cfg: Config = DEFAULT_CONFIG, start_date: str | None = None,
                   end_date: str | None = None, segment: str | Sequence[str] | None = None,
                   seasons: Sequence[str] | None = None) -> DataFrame:
    """M8n: revenue volatility with revenue spread over the nights of each stay."""
    if segment is not None:
        fs = fs.filter(V.chosen_segments(segment))
    if seasons is not None:
        fs = fs.filter(F.col("season_tag").isin(list(seasons)))
    return _rvi(nightly_revenue(fs, start_date, end_date), "nightly_room_revenue")


# --- M9: combined summary -------------------------------------------------------

def segment_profile(
    fs: DataFrame,
    cfg: Config = DEFAULT_CONFIG,
    start_date: str | None = None,
    end_date: str | None = None,
    segment: str | Sequence[str] | None = None,
    seasons: Sequence[str] | None = None,
) -> DataFrame:
    """Per-segment statistics behind M9 and the KPI cards, in one aggregation chain.

    rollup -> (segment, day) -> segment.  The V7 totals use every day; the
    dispersion statistics (occupancy for M2/M6, revenue for M8) use only the
    days inside the optional range, via conditional aggregates, so no branch
    of the plan scans the data twice.  One row per segment.
    """
    daily = V.apply_filters(V.as_daily(fs, cfg), segment, seasons=seasons)
    by_day = daily.groupBy("segment_name", "date").agg(
        F.sum("n_bookings").alias("nb"), F.sum("room_nights").alias("rn"), F.sum("n_cancelled").alias("nc"),
        F.sum("lead_sum").alias("ls"), F.sum("lead_count").alias("lc"), F.sum("revenue_at_risk").alias("rar"),
        F.sum("n_active").alias("na"), F.sum("active_room_nights").alias("arn"),
        F.sum("n_priced").alias("np"), F.sum("active_revenue").alias("ar"),
    )
    in_range = F.lit(True)
    if start_date is not None:
        in_range = in_range & (F.col("date") >= F.to_date(F.lit(start_date)))
    if end_date is not None:
        in_range = in_range & (F.col("date") <= F.to_date(F.lit(end_date)))
    occ_day = in_range & (F.col("na") > 0)
    occ = F.when(occ_day, F.round(F.col("arn").cast("double") / F.lit(float(cfg.capacity)), 4))
    rev = F.when(in_range & (F.col("np") > 0), F.col("ar").cast("double"))
    return by_day.groupBy("segment_name").agg(
        F.sum("nb").alias("total_bookings"),
        F.sum("rn").alias("total_room_nights"),
        F.sum("nc").alias("cancelled_bookings"),
        F.sum("ls").alias("lead_sum"),
        F.sum("lc").alias("lead_count"),
        F.coalesce(F.sum("rar"), F.lit(0)).alias("revenue_at_risk"),
        F.count(occ).alias("occupancy_days"),
        F.sum(occ).alias("occupancy_sum"),
        F.avg(occ).alias("occupancy_mean"),
        F.stddev_samp(occ).alias("occupancy_std"),
        F.var_samp(occ).alias("occupancy_var"),
        F.avg(rev).alias("revenue_mean"),
        F.stddev_samp(rev).alias("revenue_std"),
    )


def _summary_columns(prof: DataFrame, cfg: Config) -> DataFrame:
    has_days = F.col("occupancy_days") > 0
    counted = has_days if cfg.include_unknown else has_days & (F.col("segment_name") != UNKNOWN)
    total = F.coalesce(F.sum(F.when(counted, F.col("occupancy_var"))).over(Window.partitionBy()), F.lit(0.0))
    return prof.coalesce(1).select(
        "segment_name",
        "total_bookings",
        F.col("total_room_nights").cast("bigint").alias("total_room_nights"),
        F.round(ratio(F.col("cancelled_bookings"), F.col("total_bookings")), 4).alias("cancellation_rate"),
        F.round(ratio(F.col("lead_sum"), F.col("lead_count")), 1).alias("avg_lead_time_days"),
        F.round("revenue_at_risk", 2).cast("double").alias("revenue_at_risk"),
        F.round(ratio(F.col("occupancy_std"), F.col("occupancy_mean")), 4).alias("cov"),
        F.when(~counted, F.lit(None).cast("double"))
        .when(total == 0.0, F.lit(0.0))
        .otherwise(F.round(F.try_divide(F.col("occupancy_var"), total), 4))
        .alias("volatility_contribution"),
        F.round(ratio(F.col("revenue_std"), F.col("revenue_mean")), 4).alias("rvi"),
        "occupancy_days",
        "occupancy_sum",
        F.round("revenue_at_risk", 2).alias("revenue_at_risk_exact"),
    )


def segment_summary(
    fs: DataFrame,
    cfg: Config = DEFAULT_CONFIG,
    start_date: str | None = None,
    end_date: str | None = None,
    segment: str | Sequence[str] | None = None,
    seasons: Sequence[str] | None = None,
) -> DataFrame:
    """M9: V7 rounded, plus CoV, contribution, RVI (date-filtered) and the season index.

    The V7 columns and the season index ignore the date range, as in the
    original.  CoV, contribution and RVI come out of the same per-segment
    aggregation as the V7 columns (``segment_profile``); the season index is
    joined in from a frame of at most one row per dimension segment.
    """
    daily = V.apply_filters(V.as_daily(fs, cfg), segment, seasons=seasons)
    cols = _summary_columns(segment_profile(daily, cfg, start_date, end_date), cfg).drop(
        "occupancy_days", "occupancy_sum", "revenue_at_risk_exact")
    m5 = m5_seasonal(daily, cfg).select("segment_name", "seasonal_concentration_index")
    return ordered(cols.join(F.broadcast(m5), "segment_name", "left"), _desc("volatility_contribution"),
                   "segment_name")
