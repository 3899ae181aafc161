from collections import Counter
from dataclasses import replace

import pytest

from staylens.config import DEFAULT_CONFIG
from staylens.operators import quality as Q
from staylens.operators.repeats import repeated, surplus

ROWS = [("a", 1), ("a", 1), ("a", None), (None, 1), (None, None), (None, None), (None, None), ("b", 2)]


@pytest.mark.parametrize("bound", [1_000, 0])  # candidates broadcast; joined by hash
def test_repeated_rows_and_keys(spark, bound):
    cfg = replace(DEFAULT_CONFIG, broadcast_max_rows=bound)
    df = spark.createDataFrame(ROWS, "x string, y int")
    got = {(r["x"], r["y"]): r["copies"] for r in repeated(df, ["x", "y"], cfg).collect()}
    assert got == {k: n for k, n in Counter(ROWS).items() if n > 1}
    keys = {r["x"]: r["copies"] for r in repeated(df, ["x"], cfg).collect()}
    assert keys == {"a": 3, None: 4}
    assert tuple(surplus(df, ["x"], cfg).first()) == (2, 5) and tuple(surplus(df.limit(0), ["x"], cfg).first()) == (0, 0)


def test_only_hashes_cross_the_exchange(spark, small_sf, monkeypatch):
    from staylens.operators import repeats
    from staylens.plans.pipeline import pipeline

    plans = []

    def spy(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, *args, **kwargs)

    materialize = repeats.materialize
    monkeypatch.setattr(repeats, "materialize", spy)
    raw = pipeline(spark, small_sf).raw_bookings
    repeats.repeated(raw, raw.columns)
    assert len(plans) == 1 and "hashpartitioning(__h" in plans[0] and "hashpartitioning(reservation_id" not in plans[0]


def test_profile_text_of_all_kinds_of_columns(spark):
    rows = [("u1", "x", None, "t"), ("u2", "y", None, "s"), ("u3", "y", None, "t"), ("u0", "x", None, "s"), ("u9", "z", None, None)]
    df = spark.createDataFrame(rows, "u string, v string, w string, t string")
    got = {r["column_name"]: tuple(r)[1:] for r in Q.profile_text(df, df.columns).collect()}
    assert got == {"u": (5, 5, "u0", 1), "v": (5, 3, "x", 2), "t": (4, 2, "s", 2)}  # a column without values has no row


def test_counters_of_a_build_equal_the_report(spark, small_sf):
    from staylens.operators import clean as C
    from staylens.plans.pipeline import pipeline

    p = pipeline(spark, small_sf)
    counts = p.cleaning_counts()
    report = C.cleaning_fills(p.raw_bookings, p.raw_cancellations).collect()
    assert report and all(counts[r["source"]][r["counter"]] == r["n_rows"] for r in report)
    assert {r["counter"]: r["n_rows"] for r in report}["booking_date_unreadable"] > 0


def test_a_build_that_fans_out_warns(spark):
    from staylens.plans.pipeline import Pipeline
    from tests.conftest import BOOKING_SCHEMA, CANCEL_SCHEMA, PRICING_SCHEMA

    bookings = spark.createDataFrame([("R1", "Direct", "x", "2023-01-01", "2023-02-01", "2023-02-03", "2", "100")], BOOKING_SCHEMA)
    cancellations = spark.createDataFrame([], CANCEL_SCHEMA)
    prices = [("2023-02-01", "Peak", "90", "High"), ("2023-02-01", "Peak", "95", "High")]
    with pytest.warns(UserWarning, match="1 more rows"):
        p = Pipeline.from_frames(bookings, cancellations, spark.createDataFrame(prices, PRICING_SCHEMA))
        assert p.fact.count() == 2 and p.stats["fact_fanout_rows"] == 1


def test_row_counts_of_tables_read_no_column(spark, small_sf):
    from pyspark.sql import functions as F

    from staylens.plans.pipeline import pipeline

    p = pipeline(spark, small_sf)
    plan = p.fact_segmented.agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan and "Join" not in plan, plan
