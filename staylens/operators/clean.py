"""Cleaning operators for the three raw sources.

Order for bookings: key dedup (keep latest booking date, unparseable last)
-> date parsing -> drop rows without check-in or booking date -> drop stays
that end on or before they start -> room nights -> numeric coercion ->
fill room type -> segment normalisation.  Dedup runs before the date filters,
so a bad latest row hides an older good one, as in the original pipeline.

Scale notes
* Key dedup is an aggregate, ``max(struct(order_key, payload...))``: the
  partial aggregate collapses a hot key inside each map task before the
  shuffle, so a key holding a third of all rows never lands in one task.  A
  ``row_number`` window would ship every copy of the key to a single task.
* The struct includes every column, so the pick is a total order and exact
  duplicate rows collapse in the same pass (no separate ``dropDuplicates``
  shuffle on the output path).
* The output is hash-partitioned by ``reservation_id``; the cancellation join
  on the same key reuses that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.config import DEFAULT_CONFIG, UNKNOWN, Config
from staylens.functions import normalise_segment, parse_mixed_date, to_decimal, to_whole_number
from staylens.functions.text import null_tokens_to_null

BOOKING_DATES = ("booking_date", "check_in_date", "check_out_date")


def normalise_headers(df: DataFrame) -> DataFrame:
    """Trim and lower-case column names (CSV exports pad headers)."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def null_tokens(df: DataFrame, cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """Replace exact missing-value tokens with null in every string column."""
    return df.select(
        *[
            null_tokens_to_null(F.col(f.name), cfg.null_tokens).alias(f.name)
            if f.dataType.simpleString() == "string" else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def drop_exact_dupes(df: DataFrame) -> DataFrame:
    """Remove rows identical in every column (nulls compare equal)."""
    return df.dropDuplicates()


def dedup_latest(
    df: DataFrame,
    key: str,
    order_by: Column,
    cfg: Config = DEFAULT_CONFIG,
    *,
    keep_order: str | None = None,
    count_as: str | None = None,
) -> DataFrame:
    """Keep one row per ``key``: greatest ``order_by`` first, nulls last.

    Ties are broken by the remaining columns (greatest first) so the result
    is deterministic.  Rows with a null key form one group, like pandas.
    ``keep_order`` names an output column carrying the winning ``order_by``
    value, so a caller that needs it (a parsed date) does not compute it twice;
    ``count_as`` names a column with the number of input rows per key, so the
    raw row count falls out of the same pass.
    """
    payload = [c for c in df.columns if c != key]
    best = F.max(F.struct(order_by.alias("__order"), *[F.col(c) for c in payload]))
    aggs = [best.alias("__best")] + ([F.count(F.lit(1)).alias(count_as)] if count_as else [])
    extra = [F.col("__best.__order").alias(keep_order)] if keep_order else []
    return (
        df.groupBy(key)
        .agg(*aggs)
        .select(key, *[F.col("__best")[c].alias(c) for c in payload], *extra,
                *([F.col(count_as)] if count_as else []))
    )


def _extras(df: DataFrame, known: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in known]


def dedup_bookings(raw: DataFrame, cfg: Config = DEFAULT_CONFIG, *, keep_order: str | None = None,
                   count_as: str | None = None) -> DataFrame:
    """Bookings deduplicated on ``reservation_id`` keeping the latest booking date."""
    return dedup_latest(raw, "reservation_id", parse_mixed_date("booking_date"), cfg,
                        keep_order=keep_order, count_as=count_as)


def parse_booking_dates(df: DataFrame, cfg: Config = DEFAULT_CONFIG, *, keep_raw: bool = False) -> DataFrame:
    """Parse the three booking dates; a ``__booking_date`` column from the dedup is reused.

    ``keep_raw`` keeps the strings as ``__raw_<column>``, for counting those that are no dates.
    """
    parsed = {c: parse_mixed_date(c) for c in BOOKING_DATES}
    if "__booking_date" in df.columns:
        parsed["booking_date"] = F.col("__booking_date")
    raw = {f"__raw_{c}": F.col(c) for c in BOOKING_DATES} if keep_raw else {}
    return df.withColumns(parsed | raw).drop("__booking_date")


def dedup_parse_bookings(raw: DataFrame, cfg: Config = DEFAULT_CONFIG, *, count_as: str | None = None, keep_raw: bool = False) -> DataFrame:
    """Key dedup then date parsing; the booking date parsed for the dedup is reused."""
    return parse_booking_dates(dedup_bookings(raw, cfg, keep_order="__booking_date", count_as=count_as), cfg, keep_raw=keep_raw)


def booking_fills(cfg: Config = DEFAULT_CONFIG) -> dict[str, Column]:
    """Counters over ``dedup_parse_bookings(keep_raw=True)`` of values that were unreadable, filled or taken from elsewhere.

    Unreadable dates are counted over all deduplicated rows, the rest over the rows that cleaning keeps.
    """
    kept = F.col("check_in_date").isNotNull() & F.col("booking_date").isNotNull() & valid_stay()
    nights, named = to_whole_number("nights"), normalise_segment("segment", cfg.segment_variants)
    no_stay = F.datediff("check_out_date", "check_in_date").isNull()
    return {f"{c}_unreadable": F.count_if(F.col(f"__raw_{c}").isNotNull() & F.col(c).isNull()) for c in BOOKING_DATES} | {
        "room_type_filled": F.count_if(kept & F.col("room_type").isNull()),
        "segment_filled": F.count_if(kept & F.col("segment").isNull()),
        "segment_unmapped": F.count_if(kept & ~named.isin(list(cfg.dim_segments))),
        "room_nights_from_nights": F.count_if(kept & no_stay & nights.isNotNull()),
        "room_nights_unknown": F.count_if(kept & no_stay & nights.isNull()),
        "rate_missing": F.count_if(kept & F.col("rate").isNull()),
        "rate_unreadable": F.count_if(kept & F.col("rate").isNotNull() & to_decimal("rate").isNull()),
    }


def cancellation_fills() -> dict[str, Column]:
    """The same over ``dedup_cancellations``."""
    dated = F.col("__cancellation_date").isNotNull()
    return {
        "cancellation_date_unreadable": F.count_if(F.col("cancellation_date").isNotNull() & ~dated),
        "reason_filled": F.count_if(dated & F.col("reason").isNull()),
        "refund_status_filled": F.count_if(dated & F.col("refund_status").isNull()),
    }


def cleaning_fills(raw_bookings: DataFrame, raw_cancellations: DataFrame, cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """``(source, counter, n_rows)``: values that cleaning could not read, filled or took from elsewhere."""
    def counted(df: DataFrame, source: str, counters: dict[str, Column]) -> DataFrame:
        one = df.agg(*[v.alias(k) for k, v in counters.items()])
        rows = F.array(*[F.struct(F.lit(k).alias("counter"), F.col(k).alias("n_rows")) for k in counters])
        return one.select(F.lit(source).alias("source"), F.inline(rows))

    return counted(dedup_parse_bookings(raw_bookings, cfg, keep_raw=True), "bookings", booking_fills(cfg)).unionByName(
        counted(dedup_cancellations(raw_cancellations, cfg), "cancellations", cancellation_fills()))


def valid_stay(ci: Column | str = "check_in_date", co: Column | str = "check_out_date") -> Column:
    """A stay is valid when check-out is unknown or after check-in."""
    ci, co = F.col(ci) if isinstance(ci, str) else ci, F.col(co) if isinstance(co, str) else co
    return co.isNull() | (co > ci)


def clean_bookings(raw: DataFrame, cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """Typed, deduplicated, validated bookings (one row per reservation)."""
    return finish_bookings(dedup_parse_bookings(raw, cfg), cfg)


def finish_bookings(parsed: DataFrame, cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """Steps after key dedup and date parsing: date filters, room nights, coercion, fills, segments."""
    kept = parsed.filter(
        F.col("check_in_date").isNotNull() & F.col("booking_date").isNotNull() & valid_stay()
    )
    stay = F.datediff("check_out_date", "check_in_date")
    nights = to_whole_number("nights")
    out = kept.select(
        "reservation_id",
        normalise_segment("segment", cfg.segment_variants).alias("segment"),
        F.coalesce(F.col("room_type"), F.lit(UNKNOWN)).alias("room_type"),
        *BOOKING_DATES,
        nights.alias("nights"),
        F.when(stay > 0, stay).otherwise(nights).alias("room_nights"),
        to_decimal("rate").alias("rate"),
        *_extras(kept, ("reservation_id", "segment", "room_type", *BOOKING_DATES, "nights", "rate")),
    )
    return out


def invalid_stays(raw: DataFrame, cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """Bookings rejected because check-out is on or before check-in."""
    parsed = dedup_parse_bookings(raw, cfg)
    return parsed.filter(
        F.col("check_in_date").isNotNull() & F.col("booking_date").isNotNull() & ~valid_stay()
    ).select("reservation_id", "check_in_date", "check_out_date")


def nights_mismatch(bookings_clean: DataFrame) -> DataFrame:
    """Clean bookings whose stated nights disagree with the stay dates."""
    derived = F.datediff("check_out_date", "check_in_date")
    return bookings_clean.filter(
        F.col("check_out_date").isNotNull() & F.col("nights").isNotNull() & (F.col("nights") != derived)
    ).select("reservation_id", "nights", derived.alias("derived_nights"))


def clean_cancellations(raw: DataFrame, cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """One cancellation per reservation (latest date wins), dated, gaps filled."""
    return finish_cancellations(dedup_cancellations(raw, cfg), cfg)


def dedup_cancellations(raw: DataFrame, cfg: Config = DEFAULT_CONFIG, *, count_as: str | None = None) -> DataFrame:
    """Key dedup keeping the latest cancellation date (parsed once, kept as a column)."""
    return dedup_latest(raw, "reservation_id", parse_mixed_date("cancellation_date"), cfg,
                        keep_order="__cancellation_date", count_as=count_as)


def finish_cancellations(dedup: DataFrame, cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """Steps after key dedup: parsed date in place, undated rows dropped, gaps filled."""
    parsed = dedup.withColumn("cancellation_date", F.col("__cancellation_date")).drop("__cancellation_date")
    return parsed.filter(F.col("cancellation_date").isNotNull()).na.fill(
        {"reason": UNKNOWN, "refund_status": UNKNOWN}
    )


def clean_pricing(raw: DataFrame, cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """Seasonal pricing: exact duplicates removed, dated, rates numeric."""
    parsed = drop_exact_dupes(raw).withColumn("date", parse_mixed_date("date"))
    return (
        parsed.filter(F.col("date").isNotNull())
        .withColumn("base_rate", to_decimal("base_rate"))
        .na.fill({"demand_tier": UNKNOWN})
    )


def segment_unmapped(bookings_clean: DataFrame, cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """Segment labels left outside the canonical set after normalisation."""
    allowed = list(cfg.dim_segments)
    return (
        bookings_clean.filter(~F.col("segment").isin(allowed))
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def orphan_cancellations(cancellations_clean: DataFrame, bookings_clean: DataFrame) -> DataFrame:
    """Cancellations whose reservation is not among the clean bookings (anti-join)."""
    return cancellations_clean.join(
        bookings_clean.select("reservation_id"), "reservation_id", "left_anti"
    )


def pricing_coverage(pricing_clean: DataFrame, bookings_clean: DataFrame) -> DataFrame:
    """Does the pricing calendar cover the check-in range?  One row of flags.

    Both sides are reduced to their date column and unioned, so one
    aggregation yields the four bounds without joining one-row frames.
    """
    dates = bookings_clean.select(F.lit("b").alias("src"), F.col("check_in_date").alias("d")).unionByName(
        pricing_clean.select(F.lit("p").alias("src"), F.col("date").alias("d"))
    )
    b = F.col("src") == "b"
    out = dates.agg(
        F.min(F.when(b, F.col("d"))).alias("bookings_min"),
        F.max(F.when(b, F.col("d"))).alias("bookings_max"),
        F.min(F.when(~b, F.col("d"))).alias("pricing_min"),
        F.max(F.when(~b, F.col("d"))).alias("pricing_max"),
    )
    return out.select(
        "*",
        (F.col("pricing_min") > F.col("bookings_min")).alias("starts_late"),
        (F.col("pricing_max") < F.col("bookings_max")).alias("ends_early"),
    )


def cleaning_report(
    raw_bookings: DataFrame,
    raw_cancellations: DataFrame,
    raw_pricing: DataFrame,
    cfg: Config = DEFAULT_CONFIG,
) -> DataFrame:
    """Rows kept after each cleaning step, per source: ``(source, step, step_no, n_rows)``.

    Exact duplicates are found by row hashes (``repeats.surplus``), so 8 bytes
    a row go through that exchange instead of all columns; the key dedup runs
    on the raw rows with every later step counted in one aggregate.
    """
    from staylens.operators.repeats import surplus

    def step(name: str, no: int, col: str) -> Column:
        return F.struct(F.lit(name).alias("step"), F.lit(no).alias("step_no"), F.col(col).alias("n_rows"))

    def steps(df: DataFrame, source: str, *found: Column) -> DataFrame:
        return df.select(F.lit(source).alias("source"), F.explode(F.array(*found)).alias("s"))

    def exact_counts(df: DataFrame, source: str) -> DataFrame:
        both = df.agg(F.count(F.lit(1)).alias("raw")).select("raw", F.lit(0).cast("bigint").alias("extra")).unionByName(
            surplus(df, df.columns, cfg).select(F.lit(0).cast("bigint").alias("raw"), "extra"))
        total = both.agg(F.sum("raw").alias("raw"), (F.sum("raw") - F.sum("extra")).alias("exact_dedup"))
        return steps(total, source, step("raw", 0, "raw"), step("exact_dedup", 1, "exact_dedup"))

    has_dates = F.col("check_in_date").isNotNull() & F.col("booking_date").isNotNull()
    b_steps = steps(
        dedup_parse_bookings(raw_bookings, cfg).agg(
            F.count(F.lit(1)).alias("key_dedup"),
            F.count_if(has_dates).alias("dates_present"),
            F.count_if(has_dates & valid_stay()).alias("valid_stay"),
        ),
        "bookings", step("key_dedup", 2, "key_dedup"), step("dates_present", 3, "dates_present"), step("valid_stay", 4, "valid_stay"))
    c_steps = steps(
        dedup_cancellations(raw_cancellations, cfg).agg(
            F.count(F.lit(1)).alias("key_dedup"),
            F.count_if(F.col("__cancellation_date").isNotNull()).alias("dates_present"),
        ),
        "cancellations", step("key_dedup", 2, "key_dedup"), step("dates_present", 3, "dates_present"))
    p_steps = steps(clean_pricing(raw_pricing, cfg).agg(F.count(F.lit(1)).alias("dates_present")), "pricing",
                    step("dates_present", 3, "dates_present"))
    parts = [
        exact_counts(raw_bookings, "bookings"), b_steps,
        exact_counts(raw_cancellations, "cancellations"), c_steps,
        exact_counts(raw_pricing, "pricing"), p_steps,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("source", "s.step", "s.step_no", F.col("s.n_rows").cast("bigint").alias("n_rows"))
