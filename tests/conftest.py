import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .appName("staylens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def small_sf():
    if not os.path.exists(f"{SMALL_SF}/orders.parquet"):
        pytest.skip("driver test data not present")
    return SMALL_SF


BOOKING_SCHEMA = (
    "reservation_id string, segment string, room_type string, booking_date string, "
    "check_in_date string, check_out_date string, nights string, rate string"
)
CANCEL_SCHEMA = "reservation_id string, cancellation_date string, reason string, refund_status string"
PRICING_SCHEMA = "date string, season_tag string, base_rate string, demand_tier string"
