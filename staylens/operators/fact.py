"""Fact build: bookings ⟕ cancellations ⟕ pricing, then feature columns.

Joins
* J1 on ``reservation_id``: on lazy frames both sides are outputs of key-dedup
  aggregates, hence already hash-partitioned on the key, and the sort-merge
  join adds no exchange; the pipeline joins the written clean tables, one
  exchange each.  Keys are unique on both sides after dedup, so no skew.
* J2 on ``check_in_date = date``: pricing is a calendar dimension.  It is
  broadcast only when its row count (observed while it was materialised)
  is under ``Config.broadcast_max_rows``; otherwise a shuffle join with AQE
  skew splitting handles a hot check-in day.
* J4 (daily occupancy) is an aggregate joined back on the day.  Its size is
  bounded by the number of calendar days between the min and max check-in
  dates, which the pipeline observes for free while writing the base fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.config import DEFAULT_CONFIG, FACT_COLUMNS, Config


def join_cancellations(bookings: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Every booking, with its cancellation (if any) attached."""
    c = cancellations.select(
        "reservation_id",
        "cancellation_date",
        F.col("reason").alias("cancellation_reason"),
        "refund_status",
    )
    return bookings.join(c.hint("merge"), "reservation_id", "left")  # never broadcast on a file-size guess


def join_pricing(df: DataFrame, pricing: DataFrame, *, broadcast: bool = False) -> DataFrame:
    """Season, base rate and demand tier of the check-in day.

    ``broadcast`` must come from a size check (the pipeline observes the
    pricing row count); without it the join is a sort-merge join.
    """
    p = pricing.select(
        F.col("date").alias("__pdate"), "season_tag", "base_rate", "demand_tier"
    )
    p = F.broadcast(p) if broadcast else p.hint("merge")
    return df.join(p, F.col("check_in_date") == F.col("__pdate"), "left").drop("__pdate")


def cancel_flag() -> Column:
    """a booking is cancelled when a cancellation matched."""
    return F.col("cancellation_date").isNotNull()


def lead_time() -> Column:
    """days from booking to check-in; negative spans are unknown (null)."""
    d = F.datediff("check_in_date", "booking_date")
    return F.when(d >= 0, d)


def impute_rate() -> Column:
    """missing booking rate falls back to the day's base rate."""
    return F.coalesce(F.col("rate"), F.col("base_rate"))


def fact_base(
    bookings: DataFrame,
    cancellations: DataFrame,
    pricing: DataFrame,
    *,
    broadcast_pricing: bool = False,
) -> DataFrame:
    """J1 → J2 → F4 → F1 → F2: the fact without the day-level occupancy."""
    joined = join_pricing(join_cancellations(bookings, cancellations), pricing, broadcast=broadcast_pricing)
    return joined.withColumns(
        {"rate": impute_rate(), "is_cancelled": cancel_flag(), "lead_time_days": lead_time()}
    )


def daily_booked_room_nights(fact: DataFrame) -> DataFrame:
    """Room nights of non-cancelled bookings per check-in day (J4's right side).

    A day whose active bookings all lack room nights sums to 0, not null
    (pandas' sum of an all-missing group is 0).
    """
    return (
        fact.filter(~F.col("is_cancelled"))
        .groupBy("check_in_date")
        .agg(F.coalesce(F.sum("room_nights"), F.lit(0)).alias("__daily_booked"))
    )


def add_occupancy_rate(
    fact: DataFrame,
    cfg: Config = DEFAULT_CONFIG,
    *,
    daily: DataFrame | None = None,
    broadcast: bool = False,
) -> DataFrame:
    """day-level occupancy (active room nights / capacity) on every row.

    Cancelled rows carry their day's rate too; days with only cancellations
    get null.  Values above 1 are kept.
    """
    d = daily if daily is not None else daily_booked_room_nights(fact)
    d = F.broadcast(d) if broadcast else d.hint("merge")
    return (
        fact.join(d, "check_in_date", "left")
        .withColumn("occupancy_rate", F.col("__daily_booked").cast("double") / F.lit(float(cfg.capacity)))
        .drop("__daily_booked")
    )


def order_fact_columns(df: DataFrame) -> DataFrame:
    """fixed column order, any extra columns appended (never dropped)."""
    known = [c for c in FACT_COLUMNS if c in df.columns]
    return df.select(*known, *[c for c in df.columns if c not in known])


def build_fact(
    bookings: DataFrame,
    cancellations: DataFrame,
    pricing: DataFrame,
    cfg: Config = DEFAULT_CONFIG,
    *,
    broadcast_pricing: bool = False,
    broadcast_daily: bool = False,
) -> DataFrame:
    """the enriched fact table, one row per clean booking (lazy, no actions)."""
    base = fact_base(bookings, cancellations, pricing, broadcast_pricing=broadcast_pricing)
    return order_fact_columns(add_occupancy_rate(base, cfg, broadcast=broadcast_daily))


def join_fanout_check(cancellations: DataFrame, pricing: DataFrame) -> DataFrame:
    """Right-side keys that would multiply fact rows, per join.

    ``(join_name, duplicate_keys, extra_rows)``; both zero means the join
    preserves the booking count.
    """

    def dup(df: DataFrame, key: str, name: str) -> DataFrame:
        per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
        return per_key.agg(
            F.count_if(F.col("c") > 1).alias("duplicate_keys"),
            F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("extra_rows"),
        ).select(F.lit(name).alias("join_name"), "duplicate_keys", F.col("extra_rows").cast("bigint"))

    return dup(cancellations, "reservation_id", "cancellations").unionByName(dup(pricing, "date", "pricing"))
