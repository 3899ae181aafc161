"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from staylens.plans import registry
from staylens.plans.compare import compare, duck_connection

KEYS = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck(small_sf):
    return duck_connection(small_sf)


def test_every_query_has_oracle_sql():
    assert set(registry.oracle_sql()) == set(KEYS)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, small_sf, duck, key):
    df = E.queries()[key](spark, small_sf)
    ok, msg = compare(df, duck, E.oracle_sql()[key])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["segment_name", "total_bookings", "total_room_nights", "cancellation_rate",
                          "avg_lead_time_days", "revenue_at_risk", "cov", "volatility_contribution", "rvi",
                          "seasonal_concentration_index"]
