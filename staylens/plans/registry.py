"""Query registry: one Spark query and one DuckDB oracle SQL per operator key.

Spark queries take ``(spark, sf_dir)`` and return a DataFrame; every one
reads the driver tables through the session's ``Pipeline`` (built once per
input folder).  Outputs use plain types on both sides: money is cast from
decimal to double at the very end, counts are bigint, days are dates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from staylens.config import CANONICAL_SEGMENTS, DEFAULT_CONFIG, NULL_THRESHOLDS, UNKNOWN, Config
from staylens.config import MIN_CLEAN_RETENTION, MIN_FACT_RETENTION, MIN_FACT_ROWS, NOT_NULL_COLUMNS
from staylens.operators import clean as C
from staylens.operators import dims as D
from staylens.operators import fact as FT
from staylens.operators import kpi as K
from staylens.operators import metrics as M
from staylens.operators import quality as Q
from staylens.operators import views as V
from staylens.plans import oracle as O
from staylens.plans.materialize import scratch_path
from staylens.plans.pipeline import Pipeline, pipeline
from staylens.sources import sinks

# --- Fixed parameters of the filtered queries ---------------------------------
FILTER_SEGMENT = "Corporate"
FILTER_START = "1996-01-01"
FILTER_END = "1998-12-31"
FILTER_SEASONS = ("Peak", "Holiday")
FILTER_SEGMENTS = ("Corporate", "Group")
NUMERIC_FACT_COLUMNS = ("nights", "room_nights", "rate", "lead_time_days", "base_rate", "occupancy_rate")
DIM = tuple(CANONICAL_SEGMENTS) + (UNKNOWN,)


def plain(df: DataFrame) -> DataFrame:
    """Cast decimal columns to double (output convention shared with the oracle)."""
    return df.select(
        *[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
          else F.col(f"`{f.name}`") for f in df.schema.fields]
    )


QueryFn = Callable[[SparkSession, str], DataFrame]
_SPARK: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(key: str, sql: str | None):
    def deco(fn: Callable[[Pipeline], DataFrame]):
        def run(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT_CONFIG) -> DataFrame:
            return plain(fn(pipeline(spark, sf_dir, cfg)))

        run.__name__ = key
        run.__doc__ = fn.__doc__
        _SPARK[key] = run
        if sql is not None:
            _SQL[key] = sql
        return fn

    return deco


def queries() -> dict[str, QueryFn]:
    return dict(_SPARK)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ============================================================================
# Shared SQL fragments (CTEs appended after the prelude)
# ============================================================================
Q_ = O.q
DIM_LIST = ", ".join(Q_(s) for s in DIM)


def W(*ctes: str, body: str) -> str:
    """``WITH prelude, extra ctes SELECT ...``."""
    extra = "".join(f",\n{c.strip()}" for c in ctes)
    return "WITH " + O.prelude().strip() + extra + "\n" + body.strip()


def occ_cte(name: str = "occ", where: str = "TRUE") -> str:
    return f"""
{name} AS (
  SELECT segment_name, check_in_date AS date, CAST(SUM(room_nights) AS BIGINT) AS booked_room_nights,
         ROUND(CAST(SUM(room_nights) AS DOUBLE) / 100.0, 4) AS occupancy_rate
  FROM fs WHERE NOT is_cancelled AND {where} GROUP BY segment_name, check_in_date
)"""


V2 = """
v2 AS (
  SELECT segment_name, COUNT(*) AS total_bookings, COUNT(*) FILTER (WHERE is_cancelled) AS cancelled_bookings,
         CAST(COUNT(*) FILTER (WHERE is_cancelled) AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0)
           AS cancellation_rate
  FROM fs GROUP BY segment_name
)"""
V3 = """
v3 AS (
  SELECT segment_name, AVG(lead_time_days) AS avg_lead_time_days, MIN(lead_time_days) AS min_lead_time_days,
         MAX(lead_time_days) AS max_lead_time_days
  FROM fs WHERE lead_time_days IS NOT NULL GROUP BY segment_name
)"""
V4 = """
v4 AS (
  SELECT segment_name, season_tag, COUNT(*) AS booking_count, CAST(SUM(room_nights) AS BIGINT) AS room_nights
  FROM fs WHERE season_tag IS NOT NULL GROUP BY segment_name, season_tag
)"""
V5 = """
v5 AS (
  SELECT segment_name, SUM(room_nights * rate) AS revenue_at_risk
  FROM fs WHERE is_cancelled AND rate IS NOT NULL GROUP BY segment_name
)"""


def v6_cte(where: str = "TRUE") -> str:
    return f"""
v6 AS (
  SELECT segment_name, check_in_date AS date, SUM(room_nights * rate) AS daily_room_revenue
  FROM fs WHERE NOT is_cancelled AND rate IS NOT NULL AND {where} GROUP BY segment_name, check_in_date
)"""


V7 = """
v7 AS (
  SELECT segment_name, COUNT(*) AS total_bookings, CAST(SUM(room_nights) AS BIGINT) AS total_room_nights,
         CAST(COUNT(*) FILTER (WHERE is_cancelled) AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0)
           AS cancellation_rate,
         AVG(lead_time_days) AS avg_lead_time_days,
         SUM(CASE WHEN is_cancelled AND rate IS NOT NULL THEN room_nights * rate ELSE 0 END) AS revenue_at_risk
  FROM fs GROUP BY segment_name
)"""
RANKED = """
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY segment_name ORDER BY booking_count DESC, season_tag)
                 AS INTEGER) AS season_rank
  FROM v4
)"""
M2 = """
m2 AS (
  SELECT segment_name, ROUND(stddev_samp(occupancy_rate) / NULLIF(AVG(occupancy_rate), 0), 4) AS cov
  FROM occ GROUP BY segment_name
)"""


def m6_cte(where: str = "TRUE") -> str:
    return f"""
m6v AS (SELECT segment_name, var_samp(occupancy_rate) AS var FROM occ WHERE {where} GROUP BY segment_name),
m6t AS (SELECT COALESCE(SUM(var), 0.0) AS total FROM m6v),
m6 AS (
  SELECT segment_name, ROUND(var, 6) AS variance,
         CASE WHEN m6t.total = 0 THEN 0.0 ELSE ROUND(var / m6t.total, 4) END AS volatility_contribution
  FROM m6v, m6t
)"""


def rvi_select(series: str, value: str) -> str:
    return f"""
SELECT segment_name, ROUND(AVG(x), 2) AS mean_daily_revenue,
       ROUND(stddev_samp(x) / NULLIF(AVG(x), 0), 4) AS rvi
FROM (SELECT segment_name, CAST({value} AS DOUBLE) AS x FROM {series}) GROUP BY segment_name"""


M5 = """
m5s AS (
  SELECT segment_name, COUNT(*) AS n_seasons, SUM(booking_count) AS total,
         SUM(CASE WHEN season_rank <= 2 THEN booking_count END) AS top2
  FROM ranked GROUP BY segment_name
),
m5 AS (
  SELECT segment_name, n_seasons,
         ROUND(CAST(top2 AS DOUBLE) / CAST(total AS DOUBLE), 4) AS top2_share,
         ROUND(CAST(least(2, n_seasons) AS DOUBLE) / CAST(n_seasons AS DOUBLE), 4) AS even_share,
         ROUND((CAST(top2 AS DOUBLE) / CAST(total AS DOUBLE))
               / (CAST(least(2, n_seasons) AS DOUBLE) / CAST(n_seasons AS DOUBLE)), 4)
           AS seasonal_concentration_index
  FROM m5s WHERE total > 0
)"""


def summary_ctes(date_where: str = "TRUE") -> list[str]:
    """CTEs ending in ``summ`` (M9) with the date range applied to M2/M6/M8 only."""
    return [
        V7, occ_cte("occ", date_where), M2, m6_cte(), v6_cte(date_where),
        f"m8 AS ({rvi_select('v6', 'daily_room_revenue')})", V4, RANKED, M5,
        """
summ AS (
  SELECT v7.segment_name, v7.total_bookings, v7.total_room_nights,
         ROUND(v7.cancellation_rate, 4) AS cancellation_rate,
         ROUND(v7.avg_lead_time_days, 1) AS avg_lead_time_days,
         CAST(ROUND(v7.revenue_at_risk, 2) AS DOUBLE) AS revenue_at_risk,
         m2.cov, m6.volatility_contribution, m8.rvi, m5.seasonal_concentration_index
  FROM v7 LEFT JOIN m2 USING (segment_name) LEFT JOIN m6 USING (segment_name)
          LEFT JOIN m8 USING (segment_name) LEFT JOIN m5 USING (segment_name)
)""",
    ]


DATE_RANGE = f"check_in_date BETWEEN DATE {Q_(FILTER_START)} AND DATE {Q_(FILTER_END)}"


# ============================================================================
# Sources and sinks
# ============================================================================
@register("null_tokens", W(body="SELECT * FROM b_tok"))
def _null_tokens(p: Pipeline) -> DataFrame:
    """Raw bookings with exact missing-value tokens turned into nulls."""
    return p.raw_bookings


@register("fact_typed", W(body=f"""
SELECT reservation_id, {O.seg_id('segment')} AS segment_id, room_type, booking_date, check_in_date,
       check_out_date, nights, room_nights, CAST(rate AS DOUBLE) AS rate, is_cancelled, cancellation_date,
       cancellation_reason, refund_status, lead_time_days, season_tag, CAST(base_rate AS DOUBLE) AS base_rate,
       demand_tier
FROM fact"""))
def _fact_typed(p: Pipeline) -> DataFrame:
    """Loadable fact with segment ids (unmapped -> Unknown's id)."""
    return D.fact_typed(p.fact, D.dim_segment(p.spark, p.cfg), p.cfg)


_AUDIT_VIEWS = {
    "v_daily_room_nights_by_segment": "SELECT segment_name, check_in_date FROM fs WHERE NOT is_cancelled "
                                      "GROUP BY 1, 2",
    "v_cancellation_stats_by_segment": "SELECT segment_name FROM fs GROUP BY 1",
    "v_lead_time_by_segment": "SELECT segment_name FROM fs WHERE lead_time_days IS NOT NULL GROUP BY 1",
    "v_bookings_by_segment_season": "SELECT segment_name, season_tag FROM fs WHERE season_tag IS NOT NULL "
                                    "GROUP BY 1, 2",
    "v_revenue_at_risk_by_segment": "SELECT segment_name FROM fs WHERE is_cancelled AND rate IS NOT NULL "
                                    "GROUP BY 1",
    "v_daily_revenue_by_segment": "SELECT segment_name, check_in_date FROM fs WHERE NOT is_cancelled "
                                  "AND rate IS NOT NULL GROUP BY 1, 2",
    "v_segment_summary": "SELECT segment_name FROM fs GROUP BY 1",
}


@register("row_count_audit", W(body=" UNION ALL ".join(
    [f"SELECT 'dim_segment' AS object_name, 'table' AS object_type, CAST({len(DIM)} AS BIGINT) AS n_rows",
     "SELECT 'fact_bookings_enriched', 'table', COUNT(*) FROM fs"]
    + [f"SELECT {Q_(k)}, 'view', COUNT(*) FROM ({v})" for k, v in _AUDIT_VIEWS.items()])))
def _row_count_audit(p: Pipeline) -> DataFrame:
    """Rows per table and view."""
    return D.row_count_audit(p.fact_segmented, D.dim_segment(p.spark, p.cfg), p.segment_daily)


@register("load_roundtrip", W(body="SELECT COUNT(*) AS rows_written, COUNT(*) AS rows_read, TRUE AS matches FROM fact"))
def _load_roundtrip(p: Pipeline) -> DataFrame:
    """Full-replace load of the typed fact into the shared folder, then read back."""
    typed = D.fact_typed(p.fact, D.dim_segment(p.spark, p.cfg), p.cfg)
    return sinks.load_roundtrip(typed, scratch_path(p.spark, "load_fact_bookings_enriched"))


# ============================================================================
# Cleaning
# ============================================================================
@register("drop_exact_dupes", W(body="SELECT DISTINCT * FROM b_tok"))
def _drop_exact_dupes(p: Pipeline) -> DataFrame:
    """Raw bookings without exact duplicate rows."""
    return C.drop_exact_dupes(p.raw_bookings)


@register("dedup_latest", W(body="SELECT * FROM b_dedup"))
def _dedup_latest(p: Pipeline) -> DataFrame:
    """One raw booking per reservation id, latest booking date first."""
    return C.dedup_bookings(p.raw_bookings, p.cfg)


@register("parse_dates", W(body="SELECT reservation_id, booking_date, check_in_date, check_out_date FROM b_parsed"))
def _parse_dates(p: Pipeline) -> DataFrame:
    """Mixed-format booking dates parsed (after key dedup)."""
    return C.dedup_parse_bookings(p.raw_bookings, p.cfg).select("reservation_id", *C.BOOKING_DATES)


@register("invalid_stays", W(body="""
SELECT reservation_id, check_in_date, check_out_date FROM b_parsed
WHERE check_in_date IS NOT NULL AND booking_date IS NOT NULL
  AND NOT (check_out_date IS NULL OR check_out_date > check_in_date)"""))
def _invalid_stays(p: Pipeline) -> DataFrame:
    """Stays rejected because check-out is not after check-in."""
    return C.invalid_stays(p.raw_bookings, p.cfg)


@register("room_nights", W(body="SELECT reservation_id, nights, room_nights FROM bookings_clean"))
def _room_nights(p: Pipeline) -> DataFrame:
    """Room nights from the dates, stated nights as fallback."""
    return p.bookings_clean.select("reservation_id", "nights", "room_nights")


@register("segment_normalise", W(body=f"""
SELECT segment AS raw_segment, {O.seg_norm('segment')} AS segment, COUNT(*) AS n_rows
FROM b_tok GROUP BY 1, 2"""))
def _segment_normalise(p: Pipeline) -> DataFrame:
    """Raw label -> canonical channel, with row counts."""
    from staylens.functions import normalise_segment

    return p.raw_bookings.groupBy(
        F.col("segment").alias("raw_segment"), normalise_segment("segment", p.cfg.segment_variants).alias("segment")
    ).agg(F.count(F.lit(1)).alias("n_rows"))


@register("segment_unmapped", W(body=f"""
SELECT segment, COUNT(*) AS n_rows FROM bookings_clean WHERE segment NOT IN ({DIM_LIST}) GROUP BY segment"""))
def _segment_unmapped(p: Pipeline) -> DataFrame:
    """Labels outside the canonical set after normalisation."""
    return C.segment_unmapped(p.bookings_clean, p.cfg)


@register("orphan_cancellations", W(body="""
SELECT c.* FROM cancellations_clean c
WHERE NOT EXISTS (SELECT 1 FROM bookings_clean b WHERE b.reservation_id = c.reservation_id)"""))
def _orphans(p: Pipeline) -> DataFrame:
    """C11: cancellations without a clean booking (anti-join)."""
    return C.orphan_cancellations(p.cancellations_clean, p.bookings_clean)


@register("pricing_coverage", W(body="""
SELECT b.bookings_min, b.bookings_max, p.pricing_min, p.pricing_max,
       p.pricing_min > b.bookings_min AS starts_late, p.pricing_max < b.bookings_max AS ends_early
FROM (SELECT MIN(check_in_date) AS bookings_min, MAX(check_in_date) AS bookings_max FROM bookings_clean) b,
     (SELECT MIN(date) AS pricing_min, MAX(date) AS pricing_max FROM pricing_clean) p"""))
def _pricing_coverage(p: Pipeline) -> DataFrame:
    """Pricing calendar vs check-in range."""
    return C.pricing_coverage(p.pricing_clean, p.bookings_clean)


@register("nights_mismatch", W(body="""
SELECT reservation_id, nights, CAST(check_out_date - check_in_date AS INTEGER) AS derived_nights
FROM bookings_clean
WHERE check_out_date IS NOT NULL AND nights IS NOT NULL AND nights <> check_out_date - check_in_date"""))
def _nights_mismatch(p: Pipeline) -> DataFrame:
    """Stated nights that disagree with the stay dates."""
    return C.nights_mismatch(p.bookings_clean)


@register("bookings_clean", W(body="""
SELECT reservation_id, segment, room_type, booking_date, check_in_date, check_out_date, nights, room_nights,
       CAST(rate AS DOUBLE) AS rate FROM bookings_clean"""))
def _bookings_clean(p: Pipeline) -> DataFrame:
    """The clean bookings."""
    return p.bookings_clean


@register("cancellations_clean", W(body="SELECT * FROM cancellations_clean"))
def _cancellations_clean(p: Pipeline) -> DataFrame:
    """The clean cancellations (orphans retained)."""
    return p.cancellations_clean


@register("pricing_clean", W(body="""
SELECT date, season_tag, CAST(base_rate AS DOUBLE) AS base_rate, demand_tier FROM pricing_clean"""))
def _pricing_clean(p: Pipeline) -> DataFrame:
    """C17: the clean seasonal pricing."""
    return p.pricing_clean


@register("cleaning_report", W(body="""
SELECT 'bookings' AS source, 'raw' AS step, 0 AS step_no, COUNT(*) AS n_rows FROM b_tok
UNION ALL SELECT 'bookings', 'exact_dedup', 1, COUNT(*) FROM (SELECT DISTINCT * FROM b_tok)
UNION ALL SELECT 'bookings', 'key_dedup', 2, COUNT(*) FROM b_parsed
UNION ALL SELECT 'bookings', 'dates_present', 3, COUNT(*) FROM b_parsed
  WHERE check_in_date IS NOT NULL AND booking_date IS NOT NULL
UNION ALL SELECT 'bookings', 'valid_stay', 4, COUNT(*) FROM bookings_clean
UNION ALL SELECT 'cancellations', 'raw', 0, COUNT(*) FROM c_tok
UNION ALL SELECT 'cancellations', 'exact_dedup', 1, COUNT(*) FROM (SELECT DISTINCT * FROM c_tok)
UNION ALL SELECT 'cancellations', 'key_dedup', 2, COUNT(*) FROM c_dedup
UNION ALL SELECT 'cancellations', 'dates_present', 3, COUNT(*) FROM cancellations_clean
UNION ALL SELECT 'pricing', 'raw', 0, COUNT(*) FROM p_tok
UNION ALL SELECT 'pricing', 'exact_dedup', 1, COUNT(*) FROM (SELECT DISTINCT * FROM p_tok)
UNION ALL SELECT 'pricing', 'dates_present', 3, COUNT(*) FROM pricing_clean"""))
def _cleaning_report(p: Pipeline) -> DataFrame:
    """Rows kept after each cleaning step."""
    return C.cleaning_report(p.raw_bookings, p.raw_cancellations, p.raw_pricing, p.cfg)


# ============================================================================
# Joins and features
# ============================================================================
@register("join_cancellations", W(body="""
SELECT reservation_id, segment, room_type, booking_date, check_in_date, check_out_date, nights, room_nights,
       CAST(rate AS DOUBLE) AS rate, cancellation_date, cancellation_reason, refund_status FROM f1"""))
def _join_cancellations(p: Pipeline) -> DataFrame:
    """Bookings ⟕ cancellations."""
    return FT.join_cancellations(p.bookings_clean, p.cancellations_clean)


@register("join_pricing", W(body="""
SELECT reservation_id, check_in_date, season_tag, CAST(base_rate AS DOUBLE) AS base_rate, demand_tier FROM f2"""))
def _join_pricing(p: Pipeline) -> DataFrame:
    """Bookings ⟕ pricing on the check-in day."""
    small = p.pricing_clean is not None and p.stats["pricing_rows"] <= p.cfg.broadcast_max_rows
    return FT.join_pricing(p.bookings_clean, p.pricing_clean, broadcast=small).select(
        "reservation_id", "check_in_date", "season_tag", "base_rate", "demand_tier")


@register("fact_occupancy_rate", W(body="SELECT reservation_id, check_in_date, occupancy_rate FROM fact"))
def _fact_occupancy_rate(p: Pipeline) -> DataFrame:
    """Day-level occupancy attached to each reservation."""
    return p.fact.select("reservation_id", "check_in_date", "occupancy_rate")


@register("join_fanout_check", W(body="""
SELECT 'cancellations' AS join_name, COUNT(*) FILTER (WHERE c > 1) AS duplicate_keys,
       CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS extra_rows
FROM (SELECT reservation_id, COUNT(*) AS c FROM cancellations_clean GROUP BY 1)
UNION ALL
SELECT 'pricing', COUNT(*) FILTER (WHERE c > 1), CAST(COALESCE(SUM(c - 1), 0) AS BIGINT)
FROM (SELECT date, COUNT(*) AS c FROM pricing_clean GROUP BY 1)"""))
def _join_fanout_check(p: Pipeline) -> DataFrame:
    """Right-side keys that would multiply fact rows."""
    return FT.join_fanout_check(p.cancellations_clean, p.pricing_clean)


@register("lead_time", W(body="SELECT reservation_id, booking_date, check_in_date, lead_time_days FROM fact"))
def _lead_time(p: Pipeline) -> DataFrame:
    """lead time in days, negative spans null."""
    return p.fact.select("reservation_id", "booking_date", "check_in_date", "lead_time_days")


@register("rate_imputed", W(body="""
SELECT f.reservation_id, CAST(f.rate AS DOUBLE) AS rate, CAST(f.base_rate AS DOUBLE) AS base_rate
FROM fact f JOIN bookings_clean b ON f.reservation_id = b.reservation_id WHERE b.rate IS NULL"""))
def _rate_imputed(p: Pipeline) -> DataFrame:
    """bookings whose missing rate was filled from the base rate."""
    small = p.pricing_clean is not None and p.stats["pricing_rows"] <= p.cfg.broadcast_max_rows
    missing = p.bookings_clean.filter(F.col("rate").isNull())
    return FT.join_pricing(missing, p.pricing_clean, broadcast=small).select(
        "reservation_id", FT.impute_rate().alias("rate"), "base_rate")


@register("fact_bookings_enriched", W(body="""
SELECT reservation_id, segment, room_type, booking_date, check_in_date, check_out_date, nights, room_nights,
       CAST(rate AS DOUBLE) AS rate, is_cancelled, cancellation_date, cancellation_reason, refund_status,
       lead_time_days, season_tag, CAST(base_rate AS DOUBLE) AS base_rate, demand_tier, occupancy_rate
FROM fact"""))
def _fact(p: Pipeline) -> DataFrame:
    """the enriched fact table."""
    return p.fact


# ============================================================================
# Views
# ============================================================================
@register("v_daily_room_nights", W(occ_cte(), body="SELECT segment_name, date, booked_room_nights FROM occ"))
def _v1(p: Pipeline) -> DataFrame:
    """V1."""
    return V.v_daily_room_nights(p.segment_daily)


@register("v_cancellation_stats", W(V2, body="SELECT * FROM v2"))
def _v2(p: Pipeline) -> DataFrame:
    """V2."""
    return V.v_cancellation_stats(p.segment_daily)


@register("v_lead_time", W(V3, body="SELECT * FROM v3"))
def _v3(p: Pipeline) -> DataFrame:
    """V3."""
    return V.v_lead_time(p.segment_daily)


@register("v_bookings_by_season", W(V4, body="SELECT * FROM v4"))
def _v4(p: Pipeline) -> DataFrame:
    """V4."""
    return V.v_bookings_by_season(p.segment_daily)


@register("v_revenue_at_risk", W(V5, body="SELECT segment_name, CAST(revenue_at_risk AS DOUBLE) AS revenue_at_risk "
                                           "FROM v5"))
def _v5(p: Pipeline) -> DataFrame:
    """V5."""
    return V.v_revenue_at_risk(p.segment_daily)


@register("v_daily_revenue", W(v6_cte(), body="SELECT segment_name, date, CAST(daily_room_revenue AS DOUBLE) "
                                              "AS daily_room_revenue FROM v6"))
def _v6(p: Pipeline) -> DataFrame:
    """V6."""
    return V.v_daily_revenue(p.segment_daily)


@register("v_segment_summary", W(V7, body="""
SELECT segment_name, total_bookings, total_room_nights, cancellation_rate, avg_lead_time_days,
       CAST(revenue_at_risk AS DOUBLE) AS revenue_at_risk FROM v7"""))
def _v7(p: Pipeline) -> DataFrame:
    """V7."""
    return V.v_segment_summary(p.segment_daily).select(
        "segment_name", "total_bookings", "total_room_nights", "cancellation_rate", "avg_lead_time_days",
        "revenue_at_risk")


# ============================================================================
# Metrics
# ============================================================================
@register("m1_occupancy", W(occ_cte(), body="SELECT * FROM occ ORDER BY segment_name, date"))
def _m1(p: Pipeline) -> DataFrame:
    """M1: daily occupancy rate per segment."""
    return M.m1_occupancy(p.segment_daily, p.cfg)


@register("m2_cov", W(occ_cte(), M2, body="SELECT * FROM m2"))
def _m2(p: Pipeline) -> DataFrame:
    """M2: occupancy CoV per segment."""
    return M.m2_cov(p.segment_daily, p.cfg)


@register("m2_rolling_cov", W(occ_cte(), body="""
SELECT segment_name, date,
       ROUND(stddev_samp(occupancy_rate) OVER w / NULLIF(AVG(occupancy_rate) OVER w, 0), 4) AS rolling_cov,
       COUNT(*) OVER w AS window_days
FROM occ
WINDOW w AS (PARTITION BY segment_name ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)"""))
def _m2r(p: Pipeline) -> DataFrame:
    """M2r: trailing 30-day occupancy CoV."""
    return M.m2_rolling_cov(p.segment_daily, p.cfg, rolling_days=30)


@register("m3_cancel_rate", W(V2, body="""
SELECT segment_name, total_bookings, cancelled_bookings, ROUND(cancellation_rate, 4) AS cancellation_rate FROM v2"""))
def _m3(p: Pipeline) -> DataFrame:
    """M3: cancellation rate per segment."""
    return M.m3_cancel_rate(p.segment_daily, p.cfg)


@register("m4_lead_time", W(V3, body="""
SELECT segment_name, ROUND(avg_lead_time_days, 1) AS avg_lead_time_days, min_lead_time_days, max_lead_time_days
FROM v3"""))
def _m4(p: Pipeline) -> DataFrame:
    """M4: average lead time per segment."""
    return M.m4_lead_time(p.segment_daily, p.cfg)


@register("m5_seasonal", W(V4, RANKED, M5, body="SELECT * FROM m5"))
def _m5(p: Pipeline) -> DataFrame:
    """M5: seasonal concentration index."""
    return M.m5_seasonal(p.segment_daily, p.cfg)


@register("m6_contribution", W(occ_cte(), m6_cte(), body="SELECT * FROM m6"))
def _m6(p: Pipeline) -> DataFrame:
    """M6: segment volatility contribution (headline)."""
    return M.m6_contribution(p.segment_daily, p.cfg)


@register("m6_contribution_known", W(occ_cte(), m6_cte(f"segment_name <> {Q_(UNKNOWN)}"), body="SELECT * FROM m6"))
def _m6k(p: Pipeline) -> DataFrame:
    """M6 with the Unknown segment left out of the variance total (documented intent)."""
    from dataclasses import replace

    return M.m6_contribution(p.segment_daily, replace(p.cfg, include_unknown=False))


@register("m7_revenue_at_risk", W(V5, body="""
SELECT segment_name, CAST(ROUND(revenue_at_risk, 2) AS DOUBLE) AS revenue_at_risk FROM v5"""))
def _m7(p: Pipeline) -> DataFrame:
    """M7: revenue at risk per segment."""
    return M.m7_revenue_at_risk(p.segment_daily, p.cfg)


@register("m8_rvi", W(v6_cte(), body=rvi_select("v6", "daily_room_revenue")))
def _m8(p: Pipeline) -> DataFrame:
    """M8: revenue volatility index (revenue on check-in day)."""
    return M.m8_rvi(p.segment_daily, p.cfg)


@register("m8_rvi_nightly", W("""
nx AS (
  SELECT segment_name, rate, check_in_date, unnest(range(room_nights)) AS i
  FROM fs WHERE NOT is_cancelled AND rate IS NOT NULL AND room_nights > 0
)""", """
nd AS (
  SELECT segment_name, check_in_date + CAST(i AS INTEGER) AS date, SUM(rate) AS nightly_room_revenue
  FROM nx GROUP BY 1, 2
)""", body=rvi_select("nd", "nightly_room_revenue")))
def _m8n(p: Pipeline) -> DataFrame:
    """M8n: revenue volatility with revenue spread over each night of the stay."""
    return M.m8_rvi_nightly(p.fact_segmented, p.cfg)


@register("segment_summary", W(*summary_ctes(), body="SELECT * FROM summ"))
def _m9(p: Pipeline) -> DataFrame:
    """M9: the combined per-segment summary (flagship)."""
    return M.segment_summary(p.segment_daily, p.cfg)


# ============================================================================
# Predicates
# ============================================================================
@register("m1_filtered", W(occ_cte("occ", f"segment_name = {Q_(FILTER_SEGMENT)} AND {DATE_RANGE}"),
                           body="SELECT * FROM occ"))
def _m1_filtered(p: Pipeline) -> DataFrame:
    """M1 for one segment within an inclusive check-in range."""
    return M.m1_occupancy(p.segment_daily, p.cfg, segment=FILTER_SEGMENT, start_date=FILTER_START,
                          end_date=FILTER_END)


@register("summary_date_range", W(*summary_ctes(DATE_RANGE), body="SELECT * FROM summ"))
def _summary_dates(p: Pipeline) -> DataFrame:
    """P2 on M9: dispersion metrics restricted to a check-in range."""
    return M.segment_summary(p.segment_daily, p.cfg, start_date=FILTER_START, end_date=FILTER_END)


SEG_DATES = f"segment_name = {Q_(FILTER_SEGMENT)} AND {DATE_RANGE}"


@register("m2_cov_filtered", W(occ_cte("occ", SEG_DATES), M2, body="SELECT * FROM m2"))
def _m2_filtered(p: Pipeline) -> DataFrame:
    """P1/P2 on M2: the dashboard's CoV cards for one segment and a range."""
    return M.m2_cov(p.segment_daily, p.cfg, segment=FILTER_SEGMENT, start_date=FILTER_START, end_date=FILTER_END)


@register("m7_revenue_at_risk_filtered", W(V5.replace("WHERE is_cancelled", f"WHERE segment_name = {Q_(FILTER_SEGMENT)} AND is_cancelled"),
                                           body="SELECT segment_name, CAST(ROUND(revenue_at_risk, 2) AS DOUBLE) "
                                                "AS revenue_at_risk FROM v5"))
def _m7_filtered(p: Pipeline) -> DataFrame:
    """P1 on M7: revenue at risk for the selected segment (no date filter, as specified)."""
    return M.m7_revenue_at_risk(p.segment_daily, p.cfg, segment=FILTER_SEGMENT)


@register("m8_rvi_filtered", W(v6_cte(SEG_DATES), body=rvi_select("v6", "daily_room_revenue")))
def _m8_filtered(p: Pipeline) -> DataFrame:
    """P1/P2 on M8: revenue volatility for one segment and a range."""
    return M.m8_rvi(p.segment_daily, p.cfg, segment=FILTER_SEGMENT, start_date=FILTER_START, end_date=FILTER_END)


@register("m1_by_season_filter", W(occ_cte("occ", f"season_tag IN ({', '.join(Q_(s) for s in FILTER_SEASONS)})"),
                                   body="SELECT * FROM occ"))
def _m1_seasons(p: Pipeline) -> DataFrame:
    """M1 restricted to chosen seasons."""
    return M.m1_occupancy(p.segment_daily, p.cfg, seasons=FILTER_SEASONS)


# ============================================================================
# Windows, top-k, dashboard data
# ============================================================================
@register("season_share", W(V4, body="""
SELECT segment_name, season_tag, booking_count, room_nights,
       ROUND(CAST(booking_count AS DOUBLE)
             / NULLIF(CAST(SUM(booking_count) OVER (PARTITION BY segment_name) AS DOUBLE), 0), 4) AS season_share
FROM v4"""))
def _season_share(p: Pipeline) -> DataFrame:
    """Season share within each segment."""
    return M.season_share(p.segment_daily, p.cfg)


@register("top2_seasons", W(V4, RANKED, body="""
SELECT segment_name, season_tag, booking_count, season_rank FROM ranked WHERE season_rank <= 2"""))
def _top2(p: Pipeline) -> DataFrame:
    """Two busiest seasons per segment."""
    return M.top2_seasons(p.segment_daily, p.cfg)


@register("kpi_cards", W(*summary_ctes(), body="""
SELECT
  ROUND((SELECT AVG(occupancy_rate) FROM occ), 4) AS overall_occupancy_rate,
  CAST((SELECT COALESCE(SUM(ROUND(revenue_at_risk, 2)), 0)
        FROM (SELECT SUM(room_nights * rate) AS revenue_at_risk FROM fs
              WHERE is_cancelled AND rate IS NOT NULL GROUP BY segment_name)) AS DOUBLE) AS total_revenue_at_risk,
  (SELECT segment_name FROM summ WHERE volatility_contribution IS NOT NULL
   ORDER BY volatility_contribution DESC, segment_name LIMIT 1) AS most_volatile_segment,
  (SELECT MAX(volatility_contribution) FROM summ) AS most_volatile_contribution,
  (SELECT segment_name FROM summ WHERE cancellation_rate IS NOT NULL
   ORDER BY cancellation_rate DESC, segment_name LIMIT 1) AS highest_cancel_segment,
  (SELECT MAX(cancellation_rate) FROM summ) AS highest_cancellation_rate"""))
def _kpi(p: Pipeline) -> DataFrame:
    """K1/O2: the four KPI cards."""
    return K.kpi_cards(p.segment_daily, p.cfg)


@register("kpi_cards_filtered", W(*summary_ctes(DATE_RANGE), body=f"""
SELECT
  ROUND((SELECT AVG(occupancy_rate) FROM occ WHERE segment_name = {Q_(FILTER_SEGMENT)}), 4) AS overall_occupancy_rate,
  CAST((SELECT COALESCE(SUM(ROUND(revenue_at_risk, 2)), 0)
        FROM (SELECT SUM(room_nights * rate) AS revenue_at_risk FROM fs
              WHERE is_cancelled AND rate IS NOT NULL AND segment_name = {Q_(FILTER_SEGMENT)}
              GROUP BY segment_name)) AS DOUBLE) AS total_revenue_at_risk,
  (SELECT segment_name FROM summ WHERE volatility_contribution IS NOT NULL
   ORDER BY volatility_contribution DESC, segment_name LIMIT 1) AS most_volatile_segment,
  (SELECT MAX(volatility_contribution) FROM summ) AS most_volatile_contribution,
  (SELECT segment_name FROM summ WHERE cancellation_rate IS NOT NULL
   ORDER BY cancellation_rate DESC, segment_name LIMIT 1) AS highest_cancel_segment,
  (SELECT MAX(cancellation_rate) FROM summ) AS highest_cancellation_rate"""))
def _kpi_filtered(p: Pipeline) -> DataFrame:
    """K1 with a dashboard selection: one segment, a check-in range."""
    return K.kpi_cards(p.segment_daily, p.cfg, start_date=FILTER_START, end_date=FILTER_END,
                       segment=FILTER_SEGMENT)


@register("occupancy_pivot", W(occ_cte(), body="SELECT date, " + ", ".join(
    f"COALESCE(AVG(CASE WHEN segment_name = {Q_(s)} THEN occupancy_rate END), 0.0) AS \"{s}\"" for s in DIM)
    + " FROM occ GROUP BY date ORDER BY date"))
def _pivot(p: Pipeline) -> DataFrame:
    """K2: date × segment occupancy, gaps 0."""
    return K.occupancy_pivot(p.segment_daily, p.cfg)


TEXT_RAW_COLUMNS = ("reservation_id", "segment", "room_type", "booking_date", "check_in_date", "check_out_date", "nights", "rate")


@register("profile_text", W(body=" UNION ALL ".join(f"""
SELECT {Q_(c)} AS column_name, CAST(SUM(n) AS BIGINT) AS n, COUNT(*) AS "unique",
       (SELECT v FROM (SELECT {c} AS v, COUNT(*) AS m FROM b_tok WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY m DESC, v LIMIT 1) AS top,
       MAX(n) AS freq
FROM (SELECT {c} AS v, COUNT(*) AS n FROM b_tok WHERE {c} IS NOT NULL GROUP BY 1)""" for c in TEXT_RAW_COLUMNS)))
def _profile_text(p: Pipeline) -> DataFrame:
    """D5p: every column of the raw bookings, as text."""
    return Q.profile_text(p.raw_bookings, TEXT_RAW_COLUMNS)


@register("profile_quartiles", W(body=" UNION ALL ".join(f"""
SELECT {Q_(c)} AS column_name, CAST({q} AS DOUBLE) AS q, ROUND(quantile_cont(CAST({c} AS DOUBLE), {q}), 4) AS value FROM fs"""
    for c in ("room_nights", "rate", "lead_time_days") for q in (0.25, 0.5, 0.75))))
def _profile_quartiles(p: Pipeline) -> DataFrame:
    """D5p: exact quartiles of the fact's numeric columns."""
    return Q.profile_quartiles(p.fact_segmented, ("room_nights", "rate", "lead_time_days"))


@register("occupancy_pivot_filtered", W(occ_cte("occ", f"segment_name = {Q_(FILTER_SEGMENT)} AND {DATE_RANGE}"),
                                        body=f"""
SELECT date, AVG(occupancy_rate) AS "{FILTER_SEGMENT}" FROM occ GROUP BY date"""))
def _pivot_filtered(p: Pipeline) -> DataFrame:
    """K2 with a dashboard selection: only the chosen segment's days and column."""
    return K.occupancy_pivot(p.segment_daily, p.cfg, start_date=FILTER_START, end_date=FILTER_END,
                             segment=FILTER_SEGMENT)


# A dashboard selection of several segments, several seasons and a date range.
SELECTED = dict(segment=FILTER_SEGMENTS, seasons=FILTER_SEASONS, start_date=FILTER_START, end_date=FILTER_END)
FSEL = f"""
fsel AS (
  SELECT * FROM fs WHERE segment_name IN ({', '.join(Q_(x) for x in FILTER_SEGMENTS)})
    AND season_tag IN ({', '.join(Q_(x) for x in FILTER_SEASONS)}) AND {DATE_RANGE}
)"""


def sel(cte: str) -> str:
    """A CTE over the selected rows instead of all rows."""
    return cte.replace("FROM fs", "FROM fsel")


@register("m3_cancel_rate_selected", W(FSEL, sel(V2), body="""
SELECT segment_name, total_bookings, cancelled_bookings, ROUND(cancellation_rate, 4) AS cancellation_rate FROM v2"""))
def _m3_selected(p: Pipeline) -> DataFrame:
    """M3 on a selection of segments, seasons and dates."""
    return M.m3_cancel_rate(p.segment_daily, p.cfg, **SELECTED)


@register("m4_lead_time_selected", W(FSEL, sel(V3), body="""
SELECT segment_name, ROUND(avg_lead_time_days, 1) AS avg_lead_time_days, min_lead_time_days, max_lead_time_days
FROM v3"""))
def _m4_selected(p: Pipeline) -> DataFrame:
    """M4 on a selection of segments, seasons and dates."""
    return M.m4_lead_time(p.segment_daily, p.cfg, **SELECTED)


@register("m5_seasonal_selected", W(FSEL, sel(V4), RANKED, M5, body="SELECT * FROM m5"))
def _m5_selected(p: Pipeline) -> DataFrame:
    """M5 on a selection of segments, seasons and dates."""
    return M.m5_seasonal(p.segment_daily, p.cfg, **SELECTED)


@register("m7_revenue_at_risk_selected", W(FSEL, sel(V5), body="""
SELECT segment_name, CAST(ROUND(revenue_at_risk, 2) AS DOUBLE) AS revenue_at_risk FROM v5"""))
def _m7_selected(p: Pipeline) -> DataFrame:
    """M7 on a selection of segments, seasons and dates."""
    return M.m7_revenue_at_risk(p.segment_daily, p.cfg, **SELECTED)


@register("lead_time_distribution", W(body="""
SELECT segment_name, lead_from, n_bookings,
       ROUND(CAST(n_bookings AS DOUBLE) / SUM(n_bookings) OVER (PARTITION BY segment_name), 4) AS share
FROM (SELECT segment_name, CAST(FLOOR(lead_time_days / 30.0) * 30 AS INTEGER) AS lead_from, COUNT(*) AS n_bookings
      FROM fs WHERE lead_time_days IS NOT NULL GROUP BY 1, 2)"""))
def _lead_distribution(p: Pipeline) -> DataFrame:
    """Lead-time distribution per segment in classes of 30 days."""
    return M.lead_time_distribution(p.fact_segmented)


# ============================================================================
# Profiling and data quality
# ============================================================================
_RAW = (("bookings", "b_tok", O.B_COLS), ("cancellations", "c_tok", O.C_COLS), ("pricing", "p_tok", O.P_COLS))


def _raw_frames(p: Pipeline) -> dict[str, DataFrame]:
    return {"bookings": p.raw_bookings, "cancellations": p.raw_cancellations, "pricing": p.raw_pricing}


@register("profile_nulls", W(body=f"""
SELECT source, column_name, n_rows, null_count,
       ROUND(CAST(null_count AS DOUBLE) / NULLIF(CAST(n_rows AS DOUBLE), 0) * 100.0, 2) AS null_pct
FROM ({' UNION ALL '.join(
    f"SELECT {Q_(src)} AS source, {Q_(c)} AS column_name, COUNT(*) AS n_rows, "
    f"COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count FROM {t}"
    for src, t, cols in _RAW for c in cols)})"""))
def _profile_nulls(p: Pipeline) -> DataFrame:
    """D1p: per-column nulls of the raw sources."""
    return Q.profile_nulls(_raw_frames(p))


@register("profile_dupes", W(body=" UNION ALL ".join([
    "SELECT 'bookings' AS source, COUNT(*) AS n_rows, "
    "COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM b_tok)) AS exact_duplicate_rows, "
    "COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT reservation_id FROM b_tok)) AS key_duplicates FROM b_tok",
    "SELECT 'cancellations', COUNT(*), COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM c_tok)), "
    "COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT reservation_id FROM c_tok)) FROM c_tok",
    "SELECT 'pricing', COUNT(*), COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM p_tok)), "
    "CAST(NULL AS BIGINT) FROM p_tok",
])))
def _profile_dupes(p: Pipeline) -> DataFrame:
    """D2p: exact-row and key duplicates per raw source."""
    return Q.profile_dupes({
        "bookings": (p.raw_bookings, "reservation_id"),
        "cancellations": (p.raw_cancellations, "reservation_id"),
        "pricing": (p.raw_pricing, None),
    })


_DATE_COLS = (("bookings", "b_tok", ("booking_date", "check_in_date", "check_out_date")),
              ("cancellations", "c_tok", ("cancellation_date",)), ("pricing", "p_tok", ("date",)))


@register("profile_dates", W(body=" UNION ALL ".join(
    f"SELECT {Q_(src)} AS source, {Q_(c)} AS column_name, COUNT({c}) AS n_values, "
    f"COUNT(*) FILTER (WHERE {c} IS NOT NULL AND {O.parse(c)} IS NULL) AS n_failed, "
    f"MIN({O.parse(c)}) AS min_date, MAX({O.parse(c)}) AS max_date FROM {t}"
    for src, t, cols in _DATE_COLS for c in cols)))
def _profile_dates(p: Pipeline) -> DataFrame:
    """D3p: date parse failures and ranges per raw date column."""
    frames = _raw_frames(p)
    return Q.profile_dates({src: (frames[src], cols) for src, _, cols in _DATE_COLS}, p.cfg)


@register("profile_segments", W(body="SELECT segment, COUNT(*) AS n_rows FROM b_tok GROUP BY segment"))
def _profile_segments(p: Pipeline) -> DataFrame:
    """D4p: raw segment value counts (missing included)."""
    return Q.profile_segments(p.raw_bookings)


@register("profile_segment_kinds", W(body="""
SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE segment IS NULL) AS n_missing, COUNT(DISTINCT segment) AS n_distinct FROM b_tok"""))
def _profile_segment_kinds(p: Pipeline) -> DataFrame:
    """D4p: how many raw segment labels there are."""
    return Q.profile_segment_kinds(p.raw_bookings)


@register("cleaning_fills", W(body="""
, k AS (
  SELECT d.*, p.booking_date AS bd, p.check_in_date AS ci, p.check_out_date AS co,
    p.check_in_date IS NOT NULL AND p.booking_date IS NOT NULL AND (p.check_out_date IS NULL OR p.check_out_date > p.check_in_date) AS kept
  FROM b_dedup d JOIN b_parsed p ON d.reservation_id = p.reservation_id
), b AS (
  SELECT 'booking_date_unreadable' AS counter, COUNT(*) AS n_rows FROM k WHERE booking_date IS NOT NULL AND bd IS NULL
  UNION ALL SELECT 'check_in_date_unreadable', COUNT(*) FROM k WHERE check_in_date IS NOT NULL AND ci IS NULL
  UNION ALL SELECT 'check_out_date_unreadable', COUNT(*) FROM k WHERE check_out_date IS NOT NULL AND co IS NULL
  UNION ALL SELECT 'room_type_filled', COUNT(*) FROM k WHERE kept AND room_type IS NULL
  UNION ALL SELECT 'segment_filled', COUNT(*) FROM k WHERE kept AND segment IS NULL
  UNION ALL SELECT 'segment_unmapped', COUNT(*) FROM bookings_clean WHERE segment NOT IN (""" + ", ".join(Q_(x) for x in DIM) + """)
  UNION ALL SELECT 'room_nights_from_nights', COUNT(*) FROM bookings_clean WHERE check_out_date IS NULL AND room_nights IS NOT NULL
  UNION ALL SELECT 'room_nights_unknown', COUNT(*) FROM bookings_clean WHERE room_nights IS NULL
  UNION ALL SELECT 'rate_missing', COUNT(*) FROM k WHERE kept AND rate IS NULL
  UNION ALL SELECT 'rate_unreadable', COUNT(*) FROM k WHERE kept AND rate IS NOT NULL AND TRY_CAST(trim(rate) AS DECIMAL(24,6)) IS NULL
), c AS (
  SELECT 'cancellation_date_unreadable' AS counter,
    (SELECT COUNT(*) FROM c_dedup WHERE cancellation_date IS NOT NULL) - (SELECT COUNT(*) FROM cancellations_clean) AS n_rows
  UNION ALL SELECT 'reason_filled', COUNT(*) FROM cancellations_clean WHERE reason = 'Unknown'
  UNION ALL SELECT 'refund_status_filled', COUNT(*) FROM cancellations_clean WHERE refund_status = 'Unknown'
)
SELECT 'bookings' AS source, * FROM b UNION ALL SELECT 'cancellations', * FROM c"""))
def _cleaning_fills(p: Pipeline) -> DataFrame:
    """Values that cleaning could not read, filled or took from elsewhere."""
    return C.cleaning_fills(p.raw_bookings, p.raw_cancellations, p.cfg)


@register("profile_numeric", W(body=" UNION ALL ".join(
    f"SELECT {Q_(c)} AS column_name, COUNT({c}) AS n, ROUND(AVG(CAST({c} AS DOUBLE)), 4) AS mean, "
    f"ROUND(stddev_samp(CAST({c} AS DOUBLE)), 4) AS stddev, MIN(CAST({c} AS DOUBLE)) AS min, "
    f"MAX(CAST({c} AS DOUBLE)) AS max FROM fact" for c in NUMERIC_FACT_COLUMNS)))
def _profile_numeric(p: Pipeline) -> DataFrame:
    """D5p: numeric summary of the fact columns."""
    return Q.profile_numeric(p.fact, NUMERIC_FACT_COLUMNS)


def _dq_sql() -> str:
    def r(name: str, observed: str, threshold: float, op: str) -> str:
        return (f"SELECT {Q_(name)} AS rule, CAST({observed} AS DOUBLE) AS observed, "
                f"CAST({float(threshold)} AS DOUBLE) AS threshold, {Q_(op)} AS op")

    rows = [r(f"required_columns_missing_{s}", "0", 0, "<=") for s in ("bookings", "cancellations", "pricing",
                                                                       "fact")]
    rows += [
        r("min_rows_raw_bookings", "(SELECT COUNT(*) FROM b_tok)", 1, ">="),
        r("min_rows_raw_cancellations", "(SELECT COUNT(*) FROM c_tok)", 1, ">="),
        r("min_rows_raw_pricing", "(SELECT COUNT(*) FROM p_tok)", 1, ">="),
        r("min_rows_fact", "(SELECT COUNT(*) FROM fact)", MIN_FACT_ROWS, ">="),
        r("retention_clean_bookings",
          "CAST((SELECT COUNT(*) FROM bookings_clean) AS DOUBLE) / CAST((SELECT COUNT(*) FROM b_tok) AS DOUBLE)",
          MIN_CLEAN_RETENTION, ">="),
        r("retention_fact",
          "CAST((SELECT COUNT(*) FROM fact) AS DOUBLE) / CAST((SELECT COUNT(*) FROM b_tok) AS DOUBLE)",
          MIN_FACT_RETENTION, ">="),
    ]
    rows += [
        r(f"null_fraction_{c}", f"(SELECT CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) "
                                f"/ CAST(COUNT(*) AS DOUBLE) FROM fact)", t, "<=")
        for c, t in NULL_THRESHOLDS.items()
    ]
    rows += [
        r("non_canonical_segment_rows", f"(SELECT COUNT(*) FILTER (WHERE segment NOT IN ({DIM_LIST})) FROM fact)",
          0, "<="),
        r("negative_occupancy_rate_rows", "(SELECT COUNT(*) FILTER (WHERE occupancy_rate < 0) FROM fact)", 0, "<="),
        r("negative_lead_time_rows", "(SELECT COUNT(*) FILTER (WHERE lead_time_days < 0) FROM fact)", 0, "<="),
        r("null_reservation_id_rows", "(SELECT COUNT(*) FILTER (WHERE reservation_id IS NULL) FROM fact)", 0, "<="),
    ]
    rows += [
        r(f"not_null_{c}_violations", f"(SELECT COUNT(*) FILTER (WHERE {c} IS NULL) FROM fact)", 0, "<=")
        for c in NOT_NULL_COLUMNS
    ]
    rows += [
        r("duplicate_reservation_ids",
          "(SELECT COUNT(*) FROM (SELECT reservation_id FROM fact GROUP BY 1 HAVING COUNT(*) > 1))", 0, "<="),
    ]
    return W(body=f"""
SELECT rule, observed, threshold, op,
       COALESCE(CASE WHEN op = '>=' THEN observed >= threshold ELSE observed <= threshold END, FALSE) AS passed
FROM ({' UNION ALL '.join(rows)})""")


@register("dq_expectations", _dq_sql())
def _dq(p: Pipeline) -> DataFrame:
    """Q1–Q7: quality rules as data."""
    return Q.dq_expectations(p.raw_bookings, p.raw_cancellations, p.raw_pricing, p.fact, p.cfg, p.missing,
                             counts=p.row_counts())
