"""The pipeline from CSV files equals the pipeline from the driver-table mapping."""

import os
import uuid

from staylens.operators import fact as FT
from staylens.operators import metrics as M
from staylens.plans.materialize import checkpoint_root
from staylens.plans.pipeline import Pipeline, pipeline
from staylens.sources import csv as S
from staylens.sources import fixtures


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pipeline_from_csv_matches_mapping(spark, small_sf):
    base = checkpoint_root(spark).replace("file:", "") + "/csv-" + uuid.uuid4().hex[:10]
    paths = {}
    for name, fn in (("bookings", fixtures.raw_bookings), ("cancellations", fixtures.raw_cancellations),
                     ("seasonal_pricing", fixtures.raw_pricing)):
        paths[name] = f"{base}/{name}"
        # header padding, as CSV exports do; nulls written as empty fields
        df = fn(spark, small_sf)
        df.toDF(*[f" {c} " for c in df.columns]).coalesce(2).write.option("header", True).csv(paths[name])
    frames, missing, _ = S.read_all(spark, paths)
    assert all(v == [] for v in missing.values())
    from_csv = Pipeline.from_frames(frames["bookings"], frames["cancellations"], frames["seasonal_pricing"])
    ref = pipeline(spark, small_sf)
    assert _rows(from_csv.fact) == _rows(ref.fact)
    assert _rows(M.segment_summary(from_csv.segment_daily)) == _rows(M.segment_summary(ref.segment_daily))
    assert os.path.isdir(base)


def test_pricing_shuffle_join_equals_broadcast(spark, small_sf):
    p = pipeline(spark, small_sf)
    a = FT.fact_base(p.bookings_clean, p.cancellations_clean, p.pricing_clean, broadcast_pricing=True)
    b = FT.fact_base(p.bookings_clean, p.cancellations_clean, p.pricing_clean, broadcast_pricing=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plan = b._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(check_in_date" in plan or "hashpartitioning(__pdate" in plan
        assert _rows(a) == _rows(b)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_daily_occupancy_without_broadcast(spark, small_sf):
    p = pipeline(spark, small_sf)
    a = FT.add_occupancy_rate(p.fact_base, broadcast=True).select("reservation_id", "occupancy_rate")
    b = FT.add_occupancy_rate(p.fact_base, broadcast=False).select("reservation_id", "occupancy_rate")
    assert _rows(a) == _rows(b)


def test_independent_of_session_time_zone_and_timestamp_type(spark, small_sf):
    import __spark_entry__ as E
    from staylens.plans.compare import compare, duck_connection
    from staylens.plans.registry import plain

    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    try:
        p = Pipeline(spark, small_sf)            # fresh build under these settings
        ok, msg = compare(plain(p.fact), duck_connection(small_sf), E.oracle_sql()["fact_bookings_enriched"])
        assert ok, msg
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.unset("spark.sql.parquet.inferTimestampNTZ.enabled")


def test_cleaning_counts_observed_during_build(spark, small_sf):
    p = Pipeline(spark, small_sf)
    counts = p.cleaning_counts()
    report = {(r["source"], r["step"]): r["n_rows"] for r in
              __import__("staylens.operators.clean", fromlist=["x"]).cleaning_report(
                  p.raw_bookings, p.raw_cancellations, p.raw_pricing).collect()}
    for step in ("raw", "key_dedup", "dates_present", "valid_stay"):
        assert counts["bookings"][step] == report[("bookings", step)], step
    assert counts["cancellations"]["raw"] == report[("cancellations", "raw")]
    assert counts["cancellations"]["key_dedup"] == report[("cancellations", "key_dedup")]
    assert counts["cancellations"]["dates_present"] == report[("cancellations", "dates_present")]
    assert counts["bookings"]["valid_stay"] == p.stats["fact_rows"]


def test_cleaning_counts_after_a_partial_action(spark, small_sf):
    want = Pipeline(spark, small_sf).cleaning_counts()
    p = Pipeline(spark, small_sf)
    p.bookings_clean.limit(1).collect()
    assert p.cleaning_counts() == want


def test_strict_joins_refuse_duplicated_pricing_days(spark):
    import pytest

    from staylens.config import Config
    from tests.conftest import BOOKING_SCHEMA, CANCEL_SCHEMA, PRICING_SCHEMA

    b = spark.createDataFrame([("R1", "TA", "S", "2023-01-01", "2023-03-01", "2023-03-02", "1", "5")], BOOKING_SCHEMA)
    c = spark.createDataFrame([], CANCEL_SCHEMA)
    p = spark.createDataFrame([("2023-03-01", "Shoulder", "90", "Low"), ("2023-03-01", "Shoulder", "95", "Low")],
                              PRICING_SCHEMA)
    lenient = Pipeline.from_frames(b, c, p)
    assert lenient.fact.count() == 2                 # the documented fan-out
    with pytest.raises(ValueError, match="fan out"):
        Pipeline.from_frames(b, c, p, Config(strict_joins=True)).fact_base  # noqa: B018


def test_not_null_rules_report_missing_check_outs(spark, small_sf):
    import __spark_entry__ as E

    rules = {r["rule"]: r for r in E.queries()["dq_expectations"](spark, small_sf).collect()}
    n_missing = pipeline(spark, small_sf).fact.filter("check_out_date IS NULL").count()
    assert n_missing > 0
    assert rules["not_null_check_out_date_violations"]["observed"] == n_missing
    assert not rules["not_null_check_out_date_violations"]["passed"]
    assert rules["not_null_check_in_date_violations"]["passed"]


def test_build_diagnostics_observed(spark, small_sf):
    p = pipeline(spark, small_sf)
    f = p.fact
    assert p.stats["fact_rows"] == f.count()
    assert p.stats["fact_cancelled"] == f.filter("is_cancelled").count()
    assert p.stats["fact_no_season"] == f.filter("season_tag IS NULL").count()
    assert p.stats["fact_rate_still_null"] == f.filter("rate IS NULL").count()
    assert p.stats["fact_lead_unknown"] == f.filter("lead_time_days IS NULL").count()


def test_month_partitioned_fact_is_identical(spark, small_sf):
    from staylens.config import Config

    plain_p = pipeline(spark, small_sf)
    parted = Pipeline(spark, small_sf, Config(partition_fact_by_month=True))
    assert parted.fact.columns == plain_p.fact.columns
    assert _rows(parted.fact) == _rows(plain_p.fact)
    df = parted.fact_base.filter("check_in_date >= DATE'1996-01-01' AND check_in_date < DATE'1996-02-01'")
    assert df.count() == plain_p.fact_base.filter(
        "check_in_date >= DATE'1996-01-01' AND check_in_date < DATE'1996-02-01'").count()


def test_nightly_revenue_range_prefilter_is_exact(spark, small_sf):
    from pyspark.sql import functions as F

    p = pipeline(spark, small_sf)
    fs = p.fact_segmented
    lo, hi = "1996-03-01", "1996-08-31"
    pre = M.nightly_revenue(fs, lo, hi).filter(F.col("date").between(lo, hi))
    post = M.nightly_revenue(fs).filter(F.col("date").between(lo, hi))
    assert _rows(pre) == _rows(post)


def test_write_outputs(spark, small_sf):
    p = pipeline(spark, small_sf)
    base = checkpoint_root(spark).replace("file:", "") + "/out-" + uuid.uuid4().hex[:10]
    counts = p.write_outputs(base)
    assert counts["fact_bookings_enriched"] == counts["loaded_fact"] == p.stats["fact_rows"]
    assert counts["bookings_clean"] == p.cleaning_counts()["bookings"]["valid_stay"]
    assert counts["dim_segment"] == 6
    assert spark.read.parquet(f"{base}/processed/fact_bookings_enriched").count() == p.stats["fact_rows"]
    assert any(d.startswith("check_in_month=") for d in os.listdir(f"{base}/processed/fact_bookings_enriched"))


def test_a_later_build_publishes_only_the_months_that_changed(spark, tmp_path):
    import os

    from staylens.operators import metrics as M
    from staylens.plans.pipeline import Pipeline
    from staylens.sources import sinks
    from tests.conftest import BOOKING_SCHEMA, CANCEL_SCHEMA, PRICING_SCHEMA

    base = str(tmp_path / "published")
    rows = [(f"R{i}", ("Direct", "Corp", "TA")[i % 3], "x", "2023-01-01", f"2023-0{2 + i % 4}-{10 + i % 7}", "", str(1 + i % 3), str(100 + i)) for i in range(60)]

    def build(rows):
        return Pipeline.from_frames(
            spark.createDataFrame(rows, BOOKING_SCHEMA),
            spark.createDataFrame([("R1", "2023-01-20", "plans", "full")], CANCEL_SCHEMA),
            spark.createDataFrame([("2023-02-10", "Peak", "90", "High")], PRICING_SCHEMA))

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(f"{base}/data") for f in names if f.endswith(".parquet")}

    build(rows).publish(base)
    before = files()
    rows[2] = (*rows[2][:6], "9", rows[2][7])  # a longer stay in April
    later = build(rows)
    later.publish(base)
    new = files() - before
    assert {f.split("/")[-3] for f in new} == {"fact", "segment_daily"} and all("__month=2023-04" in f for f in new)
    daily = sinks.read_published(spark, base, "segment_daily")
    assert M.m6_contribution(daily).collect() == M.m6_contribution(later.segment_daily).collect()
    assert M.m8_rvi_nightly(sinks.read_published(spark, base)).collect() == M.m8_rvi_nightly(later.fact_segmented).collect()
