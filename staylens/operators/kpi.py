"""Data behind the dashboard: KPI cards and the date × segment occupancy pivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.config import DEFAULT_CONFIG, Config
from staylens.functions import ratio
from staylens.operators import metrics as M
from staylens.operators import views as V


def kpi_cards(
    fs: DataFrame,
    cfg: Config = DEFAULT_CONFIG,
    start_date: str | None = None,
    end_date: str | None = None,
    segment: str | Sequence[str] | None = None,
    seasons: Sequence[str] | None = None,
) -> DataFrame:
    """K1/O2: one row — mean daily occupancy, total revenue at risk, the segment
    with the largest volatility share and the one with the highest cancellation rate.

    Everything is reduced to one row per segment first (the same profile as
    the summary); a single aggregate then picks the arg-max segments
    (``min_by`` over ``(-value, name)``, so ties go to the alphabetically
    first name).  A selected ``segment`` narrows the occupancy and revenue
    cards to it; the two ranking cards always rank every segment.
    """
    per_seg = M._summary_columns(M.segment_profile(fs, cfg, start_date, end_date, seasons=seasons), cfg)
    contrib, cancel = F.col("volatility_contribution"), F.col("cancellation_rate")
    chosen = V.chosen_segments(segment)
    return per_seg.agg(
        F.round(ratio(F.sum(F.when(chosen, F.col("occupancy_sum"))), F.sum(F.when(chosen, F.col("occupancy_days")))), 4)
        .alias("overall_occupancy_rate"),
        F.coalesce(F.sum(F.when(chosen, F.col("revenue_at_risk_exact"))), F.lit(0)).cast("double")
        .alias("total_revenue_at_risk"),
        F.min_by("segment_name", F.when(contrib.isNotNull(), F.struct(-contrib, F.col("segment_name"))))
        .alias("most_volatile_segment"),
        F.max(contrib).alias("most_volatile_contribution"),
        F.min_by("segment_name", F.when(cancel.isNotNull(), F.struct(-cancel, F.col("segment_name"))))
        .alias("highest_cancel_segment"),
        F.max(cancel).alias("highest_cancellation_rate"),
    )


def occupancy_pivot(
    fs: DataFrame,
    cfg: Config = DEFAULT_CONFIG,
    start_date: str | None = None,
    end_date: str | None = None,
    segment: str | Sequence[str] | None = None,
    seasons: Sequence[str] | None = None,
) -> DataFrame:
    """K2: one row per day, one occupancy column per dimension segment, gaps 0.

    Chosen segments narrow the series before the pivot: only their columns
    are produced, and only days on which one of them had active stays.

    The pivot values are the fixed dimension names, so Spark skips the extra
    distinct-values job it would otherwise run.
    """
    s = M.occupancy_series(fs, cfg, segment, start_date, end_date, seasons)
    wanted = [segment] if isinstance(segment, str) else segment
    columns = [c for c in cfg.dim_segments if wanted is None or c in wanted] or list(wanted)
    return (
        s.groupBy("date")
        .pivot("segment_name", columns)
        .agg(F.avg("occupancy_rate"))
        .na.fill(0.0)
        .transform(lambda d: M.ordered(d, "date"))
    )
