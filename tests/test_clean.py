import datetime as dt
from decimal import Decimal

import pytest

from staylens.operators import clean as C
from staylens.operators import fact as FT
from tests.conftest import BOOKING_SCHEMA, CANCEL_SCHEMA, PRICING_SCHEMA

D = dt.date

RAW_BOOKINGS = [
    ("R1", "TA", "Deluxe", "2023-01-01", "2023-02-01", "2023-02-04", "3", "100.00"),
    ("R1", "TA", "Deluxe", "2023-01-01", "2023-02-01", "2023-02-04", "3", "100.00"),   # exact duplicate
    ("R2", "Corp", "Std", "2022-12-01", "2023-03-01", "2023-03-03", "2", "50.00"),     # older version
    ("R2", "Corp", "Std", "2023-01-05", "2023-03-01", "2023-03-03", "2", "60.00"),     # latest wins
    ("R3", "GRP", "Std", "bad", "2023-04-01", "2023-04-02", "1", "70.00"),             # unparseable sorts last
    ("R3", "GRP", "Std", "2023-01-01", "2023-04-01", "2023-04-03", "2", "80.00"),
    ("R4", "Direct", "Std", "2023-01-01", "2023-05-05", "2023-05-05", "1", "90.00"),   # check-out = check-in
    ("R5", "Direct", "Std", "2023-01-01", None, "2023-05-05", "1", "90.00"),           # no check-in
    ("R6", "walk in", "Std", "2023-01-01", "2023-06-01", None, "2", "55.50"),          # no check-out: nights
    ("R7", "direct booking", "Std", "2023-01-01", "2023-06-10", "2023-06-13", "x", "abc"),
    ("R8", " Kiosk ", "Std", "2023-01-01", "2023-06-10", "2023-06-11", "1", "10.00"),  # unmapped, untrimmed
    ("R9", None, None, "2023-01-01", "2023-06-10", "2023-06-12", "2", "20.00"),
    ("R10", "TA", "Std", "2023-01-09", "not-a-date", "2023-07-02", "1", "30.00"),      # bad latest row hides
    ("R10", "TA", "Std", "2023-01-02", "2023-07-01", "2023-07-02", "1", "30.00"),      # ... the good older one
    (None, "TA", "Std", "2023-01-01", "2023-08-01", "2023-08-02", "1", "30.00"),       # null keys collapse
    (None, "TA", "Std", "2023-01-02", "2023-08-01", "2023-08-02", "1", "30.00"),
]
RAW_CANCELS = [
    ("R1", "2023-01-20", "price", "full"),
    ("R1", "01/25/2023", None, None),     # later date wins; gaps become Unknown
    ("R2", "bad", "x", "y"),              # unparseable date: dropped
    ("X9", "2023-01-01", "plans", "full"),  # orphan
]
RAW_PRICING = [
    ("2023-02-01", "Holiday", "100", "High"),
    ("2023-02-01", "Holiday", "100", "High"),   # exact duplicate
    ("2023-03-01", "Shoulder", "90", None),
    ("2023-06-10", "Peak", "120", "High"),
    ("bad", "Off", "80", "Low"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return (
        spark.createDataFrame(RAW_BOOKINGS, BOOKING_SCHEMA),
        spark.createDataFrame(RAW_CANCELS, CANCEL_SCHEMA),
        spark.createDataFrame(RAW_PRICING, PRICING_SCHEMA),
    )


@pytest.fixture(scope="module")
def clean(raw):
    b, c, p = raw
    return C.clean_bookings(b), C.clean_cancellations(c), C.clean_pricing(p)


def by_id(df):
    return {r["reservation_id"]: r.asDict() for r in df.collect()}


def test_clean_bookings_rows(clean):
    rows = by_id(clean[0])
    assert set(rows) == {"R1", "R2", "R3", "R6", "R7", "R8", "R9", None}
    assert rows["R1"] == dict(reservation_id="R1", segment="Travel Agency", room_type="Deluxe",
                              booking_date=D(2023, 1, 1), check_in_date=D(2023, 2, 1),
                              check_out_date=D(2023, 2, 4), nights=3, room_nights=3, rate=Decimal("100.00"))
    assert rows["R2"]["rate"] == Decimal("60.00") and rows["R2"]["booking_date"] == D(2023, 1, 5)
    assert rows["R3"]["room_nights"] == 2 and rows["R3"]["rate"] == Decimal("80.00")
    assert rows["R6"]["check_out_date"] is None and rows["R6"]["room_nights"] == 2
    assert rows["R6"]["segment"] == "Walk-in"
    assert rows["R7"]["nights"] is None and rows["R7"]["room_nights"] == 3 and rows["R7"]["rate"] is None
    assert rows["R7"]["segment"] == "Direct"
    assert rows["R8"]["segment"] == " Kiosk "
    assert rows["R9"]["segment"] == "Unknown" and rows["R9"]["room_type"] == "Unknown"
    assert rows[None]["booking_date"] == D(2023, 1, 2)


def test_invalid_stays(raw):
    assert [r["reservation_id"] for r in C.invalid_stays(raw[0]).collect()] == ["R4"]


def test_exact_dupes(raw):
    assert C.drop_exact_dupes(raw[0]).count() == len(RAW_BOOKINGS) - 1


def test_dedup_is_one_row_per_key_and_deterministic(raw):
    d = C.dedup_bookings(raw[0])
    assert d.count() == 11
    assert by_id(d) == by_id(C.dedup_bookings(raw[0].repartition(5)))


def test_dedup_hot_key_uses_partial_aggregation(spark):
    """One key holding most rows is reduced map-side before the shuffle."""
    rows = [("HOT", "TA", "Std", f"2023-01-{(i % 28) + 1:02d}", "2023-02-01", "2023-02-02", "1", str(i))
            for i in range(2000)] + [("R1", "TA", "Std", "2023-01-01", "2023-02-01", "2023-02-02", "1", "1")]
    df = spark.createDataFrame(rows, BOOKING_SCHEMA).repartition(8)
    out = C.dedup_bookings(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan
    got = by_id(out)
    # latest booking day wins; ties go to the greatest remaining value (rate text)
    expected_rate = max(str(i) for i in range(2000) if i % 28 == 27)
    assert got["HOT"]["booking_date"] == "2023-01-28" and got["HOT"]["rate"] == expected_rate


def test_clean_cancellations(clean):
    rows = by_id(clean[1])
    assert set(rows) == {"R1", "X9"}
    assert rows["R1"] == dict(reservation_id="R1", cancellation_date=D(2023, 1, 25), reason="Unknown",
                              refund_status="Unknown")


def test_clean_pricing(clean):
    rows = sorted((r["date"], r["season_tag"], r["base_rate"], r["demand_tier"]) for r in clean[2].collect())
    assert rows == [(D(2023, 2, 1), "Holiday", Decimal("100.00"), "High"),
                    (D(2023, 3, 1), "Shoulder", Decimal("90.00"), "Unknown"),
                    (D(2023, 6, 10), "Peak", Decimal("120.00"), "High")]


def test_orphans_and_unmapped(clean):
    b, c, _ = clean
    assert [r["reservation_id"] for r in C.orphan_cancellations(c, b).collect()] == ["X9"]
    assert [(r["segment"], r["n_rows"]) for r in C.segment_unmapped(b).collect()] == [(" Kiosk ", 1)]


def test_nights_mismatch(spark, clean):
    assert C.nights_mismatch(clean[0]).count() == 0
    odd = spark.createDataFrame([("Z", "TA", "Std", "2023-01-01", "2023-02-01", "2023-02-05", "2", "1")],
                                BOOKING_SCHEMA)
    r = C.nights_mismatch(C.clean_bookings(odd)).collect()
    assert [(x["nights"], x["derived_nights"]) for x in r] == [(2, 4)]


def test_pricing_coverage(clean):
    r = C.pricing_coverage(clean[2], clean[0]).collect()[0]
    assert r["bookings_min"] == D(2023, 2, 1) and r["bookings_max"] == D(2023, 8, 1)
    assert r["pricing_min"] == D(2023, 2, 1) and r["pricing_max"] == D(2023, 6, 10)
    assert r["starts_late"] is False and r["ends_early"] is True


def test_cleaning_report(raw):
    rep = {(r["source"], r["step"]): r["n_rows"] for r in C.cleaning_report(*raw).collect()}
    assert rep[("bookings", "raw")] == 16
    assert rep[("bookings", "exact_dedup")] == 15
    assert rep[("bookings", "key_dedup")] == 11
    assert rep[("bookings", "dates_present")] == 9
    assert rep[("bookings", "valid_stay")] == 8
    assert rep[("cancellations", "raw")] == 4 and rep[("cancellations", "key_dedup")] == 3
    assert rep[("cancellations", "dates_present")] == 2
    assert rep[("pricing", "raw")] == 5 and rep[("pricing", "exact_dedup")] == 4
    assert rep[("pricing", "dates_present")] == 3


def test_null_tokens_frame(spark):
    df = spark.createDataFrame([("NA", "x", 1), ("None", "N/A", 2)], "a string, b string, n int")
    assert [tuple(r) for r in C.null_tokens(df).collect()] == [(None, "x", 1), (None, None, 2)]


def test_fact_from_clean(spark, clean):
    b, c, p = clean
    fact = by_id(FT.build_fact(b, c, p))
    assert len(fact) == 8
    r1 = fact["R1"]
    assert r1["is_cancelled"] is True and r1["cancellation_reason"] == "Unknown"
    assert r1["occupancy_rate"] is None                 # its day holds only a cancelled stay
    assert r1["season_tag"] == "Holiday" and r1["lead_time_days"] == 31
    # 2023-06-10: R7 (3) + R8 (1) + R9 (2) active room nights over 100 rooms
    assert {fact[k]["occupancy_rate"] for k in ("R7", "R8", "R9")} == {0.06}
    assert fact["R7"]["rate"] == Decimal("120.00")      # imputed from the day's base rate
    assert fact["R2"]["season_tag"] == "Shoulder" and fact["R2"]["lead_time_days"] == 55
    assert fact["R6"]["season_tag"] is None and fact["R6"]["rate"] == Decimal("55.50")
    assert list(FT.build_fact(b, c, p).columns)[:3] == ["reservation_id", "segment", "room_type"]


def test_negative_lead_time_is_null(spark):
    raw = spark.createDataFrame([("L", "TA", "Std", "2023-09-10", "2023-09-01", "2023-09-03", "2", "5")],
                                BOOKING_SCHEMA)
    b = C.clean_bookings(raw)
    c = C.clean_cancellations(spark.createDataFrame([], CANCEL_SCHEMA))
    p = C.clean_pricing(spark.createDataFrame([], PRICING_SCHEMA))
    r = FT.build_fact(b, c, p).collect()[0]
    assert r["lead_time_days"] is None and r["occupancy_rate"] == 0.02


def test_join_fanout_check(spark, clean):
    dup_pricing = C.clean_pricing(spark.createDataFrame(
        RAW_PRICING + [("2023-03-01", "Shoulder", "95", "Low")], PRICING_SCHEMA))
    rep = {r["join_name"]: (r["duplicate_keys"], r["extra_rows"])
           for r in FT.join_fanout_check(clean[1], dup_pricing).collect()}
    assert rep == {"cancellations": (0, 0), "pricing": (1, 1)}
    # the fan-out is real: R2 checks in on the duplicated day
    fact = FT.build_fact(clean[0], clean[1], dup_pricing)
    assert fact.filter("reservation_id = 'R2'").count() == 2
