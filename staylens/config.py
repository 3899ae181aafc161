"""Configuration: fixed values that results depend on, plus tunables.

The fixed values below must stay exactly as written: they define which raw
labels map to which booking channel, which strings count as missing, and the
capacity used as the occupancy denominator.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values (must match the original pipeline exactly) -----------------

#: Rooms assumed available per day (occupancy denominator).
ASSUMED_TOTAL_ROOMS = 100

#: Canonical booking channels, in dimension-id order (ids 1..5; Unknown is 6).
CANONICAL_SEGMENTS = ("Travel Agency", "Direct", "Corporate", "Group", "Walk-in")

#: Label used for missing or unmapped segments.
UNKNOWN = "Unknown"

#: Raw segment variant (lower-cased, trimmed) -> canonical channel.
SEGMENT_VARIANTS = {
    "travel agency": "Travel Agency",
    "travelagency": "Travel Agency",
    "travel_agency": "Travel Agency",
    "ta": "Travel Agency",
    "t/a": "Travel Agency",
    "travel agent": "Travel Agency",
    "direct": "Direct",
    "direct booking": "Direct",
    "direct book": "Direct",
    "corporate": "Corporate",
    "corp": "Corporate",
    "corporate booking": "Corporate",
    "group": "Group",
    "grp": "Group",
    "groups": "Group",
    "walk-in": "Walk-in",
    "walkin": "Walk-in",
    "walk in": "Walk-in",
    "walk_in": "Walk-in",
}

#: Strings read as missing (exact match, case-sensitive).
NULL_TOKENS = ("", "NA", "N/A", "NULL", "null", "None")

#: Required columns per source (schema contracts).
BOOKINGS_COLUMNS = (
    "reservation_id", "segment", "room_type", "booking_date",
    "check_in_date", "check_out_date", "nights", "rate",
)
CANCELLATIONS_COLUMNS = ("reservation_id", "cancellation_date", "reason", "refund_status")
PRICING_COLUMNS = ("date", "season_tag", "base_rate", "demand_tier")

#: Output column order of the enriched fact table.
FACT_COLUMNS = (
    "reservation_id", "segment", "room_type",
    "booking_date", "check_in_date", "check_out_date",
    "nights", "room_nights", "rate",
    "is_cancelled", "cancellation_date", "cancellation_reason", "refund_status",
    "lead_time_days", "season_tag", "base_rate", "demand_tier",
    "occupancy_rate",
)

#: Columns of the typed (loaded) fact table: segment name replaced by its id.
FACT_TYPED_COLUMNS = (
    "reservation_id", "segment_id", "room_type",
    "booking_date", "check_in_date", "check_out_date",
    "nights", "room_nights", "rate",
    "is_cancelled", "cancellation_date", "cancellation_reason", "refund_status",
    "lead_time_days", "season_tag", "base_rate", "demand_tier",
)

#: Data-quality thresholds: maximum null fraction per fact column.
NULL_THRESHOLDS = {
    "reservation_id": 0.0,
    "check_in_date": 0.0,
    "room_nights": 0.0,
    "is_cancelled": 0.0,
    "segment": 0.10,
}
#: Fact columns declared NOT NULL by the loaded table's schema.
NOT_NULL_COLUMNS = ("reservation_id", "booking_date", "check_in_date", "check_out_date", "nights",
                    "room_nights", "is_cancelled")
MIN_FACT_ROWS = 50
MIN_CLEAN_RETENTION = 0.80
MIN_FACT_RETENTION = 0.70

#: Month names and their short forms, as dates spell them.
MONTH_NAMES = {
    "jan": 1, "january": 1,
    "feb": 2, "february": 2,
    "mar": 3, "march": 3,
    "apr": 4, "april": 4,
    "may": 5,
    "jun": 6, "june": 6,
    "jul": 7, "july": 7,
    "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10,
    "nov": 11, "november": 11,
    "dec": 12, "december": 12,
}
#: Weekday names and their short forms; they say nothing that the date does not.
WEEKDAY_NAMES = (
    "mon", "monday", "tue", "tuesday", "wed", "wednesday", "thu", "thursday",
    "fri", "friday", "sat", "saturday", "sun", "sunday",
)
#: Ordinal endings and joining words inside a date.
DATE_FILLERS = ("st", "nd", "rd", "th", "of", "and", "at", "on")
#: Two-digit years from this on lie in the twentieth century.
TWO_DIGIT_YEAR_PIVOT = 69


@dataclass(frozen=True)
class Config:
    """Per-run settings passed to the operators."""

    capacity: int = ASSUMED_TOTAL_ROOMS
    canonical_segments: tuple[str, ...] = CANONICAL_SEGMENTS
    segment_variants: dict[str, str] = field(default_factory=lambda: dict(SEGMENT_VARIANTS))
    null_tokens: tuple[str, ...] = NULL_TOKENS
    #: Largest row count a dimension-like side may have and still be broadcast.
    broadcast_max_rows: int = 2_000_000
    #: Drop the Unknown segment before the variance total (documented intent,
    #: off by default to follow the coded behaviour).
    include_unknown: bool = True
    #: Raise instead of letting a duplicated pricing day multiply fact rows.
    strict_joins: bool = False
    #: Write the pipeline's fact partitioned by check-in month (file pruning for
    #: date-filtered scans at scale; off for small local runs).
    partition_fact_by_month: bool = False

    @property
    def dim_segments(self) -> tuple[str, ...]:
        return tuple(self.canonical_segments) + (UNKNOWN,)


DEFAULT_CONFIG = Config()
