"""Physical-plan properties that matter at scale."""

import pytest

import __spark_entry__ as E
from staylens.operators import clean as C
from staylens.operators import fact as FT
from staylens.plans import registry
from staylens.plans.materialize import materialize
from staylens.plans.pipeline import pipeline

#: Physical operators that hand rows to Python workers.
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow", "FlatMapCoGroups", "MapInPandas", "MapInArrow",
                "PythonUDF", "AggregateInPandas", "WindowInPandas")
BAD_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(registry.queries()) - {"load_roundtrip"}))
def test_no_python_and_no_pairwise_joins(spark, small_sf, key):
    """The query's own plan; the plans of the tables that it reads are in ``test_written_tables_...``."""
    plan = plan_of(E.queries()[key](spark, small_sf))
    assert not any(n in plan for n in PYTHON_NODES), plan
    assert not any(n in plan for n in BAD_JOINS), plan


def test_written_tables_need_no_python_and_no_pairwise_joins(spark, small_sf, monkeypatch):
    """Every plan that a fresh build writes: clean tables, prices, fact and rollup."""
    from staylens.plans import pipeline as P

    seen = {}

    def spy(df, name, *args, **kwargs):
        seen[name] = plan_of(df)
        return materialize(df, name, *args, **kwargs)

    monkeypatch.setattr(P, "materialize", spy)
    P.Pipeline(spark, small_sf).segment_daily  # noqa: B018
    assert set(seen) >= {"bookings_clean", "cancellations_clean", "pricing_clean", "fact_base", "segment_daily"}
    for name, plan in seen.items():
        assert not any(n in plan for n in PYTHON_NODES), (name, plan)
        assert not any(n in plan for n in BAD_JOINS), (name, plan)


def _pushed(spark, df) -> list[str]:
    plan = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [line for line in plan.splitlines() if "PushedFilters" in line]


def test_date_and_segment_filters_reach_the_scan(spark, small_sf):
    df = E.queries()["m1_filtered"](spark, small_sf)
    df.collect()
    scan = _pushed(spark, df)
    assert scan and "date" in scan[0] and "Corporate" in scan[0], scan


def test_filters_reach_the_fact_scan_on_a_lazy_rollup(spark, small_sf):
    from staylens.operators import metrics as M

    p = pipeline(spark, small_sf)
    df = M.m1_occupancy(p.fact_segmented, start_date="1996-01-01", end_date="1996-12-31")
    scan = _pushed(spark, df)
    assert scan and "GreaterThanOrEqual(check_in_date,1996-01-01)" in scan[0], scan


def test_metric_scan_is_column_pruned(spark, small_sf):
    plan = plan_of(E.queries()["m3_cancel_rate"](spark, small_sf))
    assert "ReadSchema: struct<segment_name:string,n_bookings:bigint,n_cancelled:bigint>" in plan, plan


def test_rollup_reads_only_needed_fact_columns(spark, small_sf):
    from staylens.operators import views as V

    p = pipeline(spark, small_sf)
    plan = plan_of(V.segment_daily(p.fact_segmented))
    assert "Join" not in plan    # the unused day-occupancy join is eliminated
    read = [line for line in plan.splitlines() if "ReadSchema" in line][0]
    for unused in ("reservation_id", "room_type", "booking_date", "cancellation_reason", "demand_tier"):
        assert unused not in read, read


def test_fact_build_shuffles_each_side_once(spark, small_sf):
    p = pipeline(spark, small_sf)
    # on lazy frames; the pipeline writes the clean tables first
    base = FT.fact_base(C.clean_bookings(p.raw_bookings, p.cfg), C.clean_cancellations(p.raw_cancellations, p.cfg),
                        p.pricing_clean, broadcast_pricing=True)
    plan = base._jdf.queryExecution().executedPlan().toString()
    # key dedup of bookings and of cancellations: one hash exchange each, none added by the join
    assert plan.count("hashpartitioning(reservation_id") == 2, plan
    assert "partial_max" in plan and "SortMergeJoin" in plan


def test_pipeline_broadcasts_are_size_checked(spark, small_sf):
    p = pipeline(spark, small_sf)
    p.fact  # noqa: B018
    assert p.stats["pricing_rows"] <= p.cfg.broadcast_max_rows and p.stats["broadcast_pricing"] is True
    assert p.stats["broadcast_daily"] is True
    lo, hi = p.stats["min_check_in"], p.stats["max_check_in"]
    days = p.fact.select("check_in_date").distinct().count()
    assert days <= (hi - lo).days + 1


def test_row_count_audit_counts_the_fact_from_footers(spark, small_sf):
    """No column of the fact is read; the views are counted from the rollup."""
    plan = plan_of(E.queries()["row_count_audit"](spark, small_sf))
    read = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema: " in line]
    assert sum(r.startswith("struct<>") for r in read) == 1, plan
    rollup = set(pipeline(spark, small_sf).segment_daily.columns)
    named = {c.split(":")[0] for r in read for c in r.strip().removeprefix("struct<").removesuffix(">").split(",") if c}
    assert named and named <= rollup, (named, rollup)


def test_bounded_broadcast_obeys_the_bound(spark):
    from staylens.plans.materialize import bounded_broadcast

    big = spark.range(100_000).withColumnRenamed("id", "k")
    small = spark.range(50).withColumnRenamed("id", "k")
    under = big.join(bounded_broadcast(small, max_rows=100), "k")
    over = big.join(bounded_broadcast(small, max_rows=10), "k")      # counted: 50 > 10
    assert "BroadcastHashJoin" in plan_of(under)
    p = plan_of(over)
    assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p, p
    assert under.count() == over.count() == 50


def test_plan_export_shows_final_plan_with_scan_details(spark, small_sf):
    from staylens.plans.explain import executed_plan

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = executed_plan(E.queries()["m1_filtered"](spark, small_sf))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "isFinalPlan=true" in text
    assert "PushedFilters" in text and "ReadSchema" in text and "Corporate" in text


def test_the_build_compiles(spark, small_sf):
    """No part of the build is too large for code generation (Spark would only log that and go on, slowly)."""
    from staylens.plans.pipeline import Pipeline

    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        p = Pipeline(spark, small_sf)
        assert p.segment_daily.count() > 0 and p.fact.count() == p.stats["fact_rows"]
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
