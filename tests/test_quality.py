import datetime as dt

from staylens.operators import quality as Q
from tests.conftest import BOOKING_SCHEMA


def test_profiles_on_small_frame(spark):
    raw = spark.createDataFrame([
        ("R1", "TA", None, "2023-01-01", "2023-02-01", None, "1", "5"),
        ("R1", "TA", None, "2023-01-01", "2023-02-01", None, "1", "5"),
        ("R2", None, "S", "bad", "25/12/2023", "2023-12-26", "1", "5"),
        (None, "GRP", "S", "2023-01-01", "2023-03-01", "2023-03-02", "1", "5"),
    ], BOOKING_SCHEMA)
    nulls = {r["column_name"]: (r["null_count"], r["null_pct"]) for r in Q.profile_nulls({"b": raw}).collect()}
    assert nulls["room_type"] == (2, 50.0) and nulls["reservation_id"] == (1, 25.0) and nulls["rate"] == (0, 0.0)
    d = Q.profile_dupes({"b": (raw, "reservation_id")}).collect()[0]
    assert (d["n_rows"], d["exact_duplicate_rows"], d["key_duplicates"]) == (4, 1, 1)
    dates = {r["column_name"]: r for r in Q.profile_dates({"b": (raw, ["booking_date", "check_in_date"])}).collect()}
    assert dates["booking_date"]["n_failed"] == 1 and dates["booking_date"]["n_values"] == 4
    assert dates["check_in_date"]["max_date"] == dt.date(2023, 12, 25)
    segs = {r["segment"]: r["n_rows"] for r in Q.profile_segments(raw).collect()}
    assert segs == {"TA": 2, None: 1, "GRP": 1}


def test_profile_numeric(spark):
    df = spark.createDataFrame([(1, 2.0), (3, None)], "a int, b double")
    got = {r["column_name"]: r for r in Q.profile_numeric(df, ["a", "b"]).collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["a"]["min"], got["a"]["max"]) == (2, 2.0, 1.0, 3.0)
    assert got["a"]["stddev"] == round(2 ** 0.5, 4) and got["b"]["stddev"] is None


def test_dq_expectations_on_driver_tables(spark, small_sf):
    import __spark_entry__ as E

    rules = {r["rule"]: r for r in E.queries()["dq_expectations"](spark, small_sf).collect()}
    assert rules["min_rows_fact"]["passed"] and rules["duplicate_reservation_ids"]["observed"] == 0
    assert rules["retention_clean_bookings"]["passed"] and rules["retention_fact"]["passed"]
    assert rules["null_fraction_reservation_id"]["passed"]
    # the fixture carries one unmappable label on purpose; the rule must catch it
    assert rules["non_canonical_segment_rows"]["observed"] > 0 and not rules["non_canonical_segment_rows"]["passed"]
    assert all(r["passed"] for k, r in rules.items() if k.startswith("required_columns_missing"))


def test_dq_uses_the_scan_contract_report(spark):
    from staylens.operators import quality as Q
    from tests.conftest import BOOKING_SCHEMA, CANCEL_SCHEMA, PRICING_SCHEMA

    b = spark.createDataFrame([("R1", "TA", "S", "2023-01-01", "2023-02-01", "2023-02-02", "1", "5")], BOOKING_SCHEMA)
    c = spark.createDataFrame([], CANCEL_SCHEMA)
    p = spark.createDataFrame([], PRICING_SCHEMA)
    from staylens.plans.pipeline import Pipeline

    pl = Pipeline.from_frames(b, c, p, missing={"cancellations": ["reason"], "seasonal_pricing": []})
    rules = {r["rule"]: r for r in Q.dq_expectations(b, c, p, pl.fact, missing=pl.missing).collect()}
    assert rules["required_columns_missing_cancellations"]["observed"] == 1
    assert not rules["required_columns_missing_cancellations"]["passed"]
    assert rules["required_columns_missing_pricing"]["observed"] == 0
