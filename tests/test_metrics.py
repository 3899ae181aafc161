import datetime as dt
import math
from decimal import Decimal

import pytest

from staylens.config import Config
from staylens.operators import kpi as K
from staylens.operators import metrics as M
from staylens.operators import views as V

D = dt.date
FACT_SCHEMA = ("segment string, check_in_date date, room_nights int, rate decimal(12,2), is_cancelled boolean, "
               "lead_time_days int, season_tag string")

# Direct: active 10/20/30 room nights on three days (occupancy .1/.2/.3), one cancelled stay.
# Corporate: 10 and 10 (variance 0).  Group: a single day (variance undefined).
ROWS = [
    ("Direct", D(2023, 1, 1), 10, Decimal("100.00"), False, 10, "Peak"),
    ("Direct", D(2023, 1, 2), 20, Decimal("100.00"), False, 20, "Peak"),
    ("Direct", D(2023, 2, 15), 30, Decimal("100.00"), False, None, "Off"),
    ("Direct", D(2023, 1, 1), 5, Decimal("100.00"), True, 30, "Holiday"),
    ("corporate", D(2023, 1, 1), 10, Decimal("50.00"), False, 5, "Off"),   # unmapped label -> Unknown
    ("Corporate", D(2023, 1, 1), 10, Decimal("50.00"), False, 5, "Off"),
    ("Corporate", D(2023, 1, 2), 10, None, False, 7, "Off"),
    ("Group", D(2023, 1, 1), 5, Decimal("10.00"), False, 1, None),
]


@pytest.fixture(scope="module")
def fs(spark):
    return V.segmented(spark.createDataFrame(ROWS, FACT_SCHEMA))


def rows(df, key="segment_name"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_m1_occupancy(fs):
    got = [(r["segment_name"], r["date"], r["booked_room_nights"], r["occupancy_rate"])
           for r in M.m1_occupancy(fs).collect()]
    assert got == [
        ("Corporate", D(2023, 1, 1), 10, 0.1), ("Corporate", D(2023, 1, 2), 10, 0.1),
        ("Direct", D(2023, 1, 1), 10, 0.1), ("Direct", D(2023, 1, 2), 20, 0.2), ("Direct", D(2023, 2, 15), 30, 0.3),
        ("Group", D(2023, 1, 1), 5, 0.05), ("Unknown", D(2023, 1, 1), 10, 0.1),
    ]


def test_m1_filters(fs):
    got = M.m1_occupancy(fs, segment="Direct", start_date="2023-01-02", end_date="2023-01-31").collect()
    assert [(r["date"], r["occupancy_rate"]) for r in got] == [(D(2023, 1, 2), 0.2)]
    unk = M.m1_occupancy(fs, segment="Unknown").collect()
    assert [r["booked_room_nights"] for r in unk] == [10]
    peak = M.m1_occupancy(fs, seasons=["Peak"]).collect()
    assert [(r["segment_name"], r["date"]) for r in peak] == [("Direct", D(2023, 1, 1)), ("Direct", D(2023, 1, 2))]


def test_m2_cov(fs):
    got = rows(M.m2_cov(fs))
    assert got["Direct"]["cov"] == 0.5
    assert got["Corporate"]["cov"] == 0.0
    assert got["Group"]["cov"] is None          # one day: sample std undefined
    assert [r["segment_name"] for r in M.m2_cov(fs).collect()][0] == "Direct"


def test_m6_contribution(fs):
    got = rows(M.m6_contribution(fs))
    assert got["Direct"]["variance"] == 0.01 and got["Direct"]["volatility_contribution"] == 1.0
    assert got["Corporate"]["volatility_contribution"] == 0.0
    assert got["Group"]["variance"] is None and got["Group"]["volatility_contribution"] is None


def test_m6_zero_total_gives_zero_everywhere(fs):
    got = rows(M.m6_contribution(fs.filter("segment_name in ('Corporate', 'Group')")))
    assert {k: v["volatility_contribution"] for k, v in got.items()} == {"Corporate": 0.0, "Group": 0.0}


def test_m6_without_unknown(spark):
    data = [("Direct", D(2023, 1, d), n, Decimal("1.00"), False, 1, "Off") for d, n in ((1, 10), (2, 30))] + [
        (None, D(2023, 1, d), n, Decimal("1.00"), False, 1, "Off") for d, n in ((1, 10), (2, 30))]
    fs = V.segmented(spark.createDataFrame(data, FACT_SCHEMA))
    assert rows(M.m6_contribution(fs))["Direct"]["volatility_contribution"] == 0.5
    known = rows(M.m6_contribution(fs, Config(include_unknown=False)))
    assert set(known) == {"Direct"} and known["Direct"]["volatility_contribution"] == 1.0


def test_m3_m4_m7(fs):
    m3 = rows(M.m3_cancel_rate(fs))
    assert (m3["Direct"]["total_bookings"], m3["Direct"]["cancelled_bookings"], m3["Direct"]["cancellation_rate"]) \
        == (4, 1, 0.25)
    assert m3["Corporate"]["cancellation_rate"] == 0.0
    m4 = rows(M.m4_lead_time(fs))
    assert m4["Direct"] == dict(segment_name="Direct", avg_lead_time_days=20.0, min_lead_time_days=10,
                                max_lead_time_days=30)
    m7 = rows(M.m7_revenue_at_risk(fs))
    assert m7 == {"Direct": {"segment_name": "Direct", "revenue_at_risk": 500.0}}


def test_m5_seasonal(fs):
    got = rows(M.m5_seasonal(fs))
    d = got["Direct"]          # Peak 2, Off 1, Holiday 1
    assert (d["n_seasons"], d["top2_share"], d["even_share"], d["seasonal_concentration_index"]) == \
        (3, 0.75, 0.6667, 1.125)
    c = got["Corporate"]       # one season only
    assert (c["n_seasons"], c["top2_share"], c["even_share"], c["seasonal_concentration_index"]) == (1, 1.0, 1.0, 1.0)
    assert "Group" not in got  # no season at all


def test_season_share_and_top2(fs):
    share = {(r["segment_name"], r["season_tag"]): r["season_share"] for r in M.season_share(fs).collect()}
    assert share[("Direct", "Peak")] == 0.5 and share[("Direct", "Off")] == 0.25
    top = [(r["segment_name"], r["season_tag"], r["season_rank"]) for r in M.top2_seasons(fs).collect()]
    assert ("Direct", "Peak", 1) in top and ("Direct", "Holiday", 2) in top  # tie Off/Holiday -> by name
    assert sum(1 for t in top if t[0] == "Direct") == 2


def test_m8_rvi(fs):
    got = rows(M.m8_rvi(fs))
    assert got["Direct"]["mean_daily_revenue"] == 2000.0 and got["Direct"]["rvi"] == 0.5
    assert got["Corporate"]["rvi"] is None     # one priced day


def test_m8_nightly(spark):
    data = [("Direct", D(2023, 1, 1), 2, Decimal("100.00"), False, 1, "Off"),
            ("Direct", D(2023, 1, 2), 1, Decimal("50.00"), False, 1, "Off"),
            ("Direct", D(2023, 1, 5), 3, Decimal("999.00"), True, 1, "Off")]
    fs = V.segmented(spark.createDataFrame(data, FACT_SCHEMA))
    nights = sorted((r["date"], r["nightly_room_revenue"]) for r in M.nightly_revenue(fs).collect())
    assert nights == [(D(2023, 1, 1), Decimal("100.00")), (D(2023, 1, 2), Decimal("150.00"))]
    got = rows(M.m8_rvi_nightly(fs))["Direct"]
    assert got["mean_daily_revenue"] == 125.0 and got["rvi"] == round(math.sqrt(1250) / 125, 4)


def test_m2_rolling(fs):
    got = [(r["date"], r["rolling_cov"], r["window_days"])
           for r in M.m2_rolling_cov(fs, rolling_days=30).collect() if r["segment_name"] == "Direct"]
    expected_jan2 = round(math.sqrt(0.005) / 0.15, 4)
    assert got == [(D(2023, 1, 1), None, 1), (D(2023, 1, 2), expected_jan2, 2), (D(2023, 2, 15), None, 1)]


def test_segment_summary(fs):
    got = rows(M.segment_summary(fs))
    d = got["Direct"]
    assert (d["total_bookings"], d["total_room_nights"], d["cancellation_rate"], d["avg_lead_time_days"],
            d["revenue_at_risk"]) == (4, 65, 0.25, 20.0, 500.0)
    assert (d["cov"], d["volatility_contribution"], d["rvi"], d["seasonal_concentration_index"]) == \
        (0.5, 1.0, 0.5, 1.125)
    assert got["Group"]["revenue_at_risk"] == 0.0 and got["Group"]["seasonal_concentration_index"] is None
    assert [r["segment_name"] for r in M.segment_summary(fs).collect()][0] == "Direct"


def test_kpi_cards(fs):
    r = K.kpi_cards(fs).collect()[0]
    # daily occupancy values: .1 .1 | .1 .2 .3 | .05 | .1  -> mean of 7 days
    assert r["overall_occupancy_rate"] == round((10 + 10 + 10 + 20 + 30 + 5 + 10) / 700, 4)
    assert r["total_revenue_at_risk"] == 500.0
    assert r["most_volatile_segment"] == "Direct" and r["most_volatile_contribution"] == 1.0
    assert r["highest_cancel_segment"] == "Direct" and r["highest_cancellation_rate"] == 0.25


def test_kpi_ties_go_to_first_name(spark):
    data = [(s, D(2023, 1, d), n, Decimal("1.00"), False, 1, "Off")
            for s in ("Group", "Corporate") for d, n in ((1, 10), (2, 30))]
    r = K.kpi_cards(V.segmented(spark.createDataFrame(data, FACT_SCHEMA))).collect()[0]
    assert r["most_volatile_segment"] == "Corporate" and r["most_volatile_contribution"] == 0.5


def test_occupancy_pivot(fs):
    got = {r["date"]: r.asDict() for r in K.occupancy_pivot(fs).collect()}
    assert got[D(2023, 1, 1)]["Direct"] == 0.1 and got[D(2023, 1, 1)]["Group"] == 0.05
    assert got[D(2023, 2, 15)]["Corporate"] == 0.0 and got[D(2023, 2, 15)]["Walk-in"] == 0.0
    assert K.occupancy_pivot(fs).columns == ["date", "Travel Agency", "Direct", "Corporate", "Group", "Walk-in",
                                             "Unknown"]


def test_views_count(fs):
    assert V.v_daily_room_nights(fs).count() == 7
    assert V.v_revenue_at_risk(fs).count() == 1
    assert V.v_daily_revenue(fs).count() == 6     # Corporate 2023-01-02 has no rate
    s = rows(V.v_segment_summary(fs))
    assert s["Unknown"]["revenue_at_risk"] == 0


def test_kpi_cards_segment_selection(fs):
    r = K.kpi_cards(fs, segment="Direct").collect()[0]
    assert r["overall_occupancy_rate"] == 0.2          # Direct days: .1 .2 .3
    assert r["total_revenue_at_risk"] == 500.0
    r = K.kpi_cards(fs, segment="Corporate").collect()[0]
    assert r["overall_occupancy_rate"] == 0.1 and r["total_revenue_at_risk"] == 0.0
    assert r["most_volatile_segment"] == "Direct"     # rankings still cover every segment


def test_occupancy_pivot_segment_selection(fs):
    df = K.occupancy_pivot(fs, segment="Group")
    assert df.columns == ["date", "Group"]
    got = {r["date"]: r["Group"] for r in df.collect()}
    assert got == {D(2023, 1, 1): 0.05}  # days without an active Group stay are absent


def test_several_segments_and_seasons(fs):
    both = M.m1_occupancy(fs, segment=["Group", "Direct"]).collect()
    assert {r["segment_name"] for r in both} == {"Group", "Direct"}
    assert K.occupancy_pivot(fs, segment=["Direct", "Group"]).columns == ["date", "Direct", "Group"]
    for metric in (M.m3_cancel_rate, M.m4_lead_time, M.m5_seasonal, M.m7_revenue_at_risk, M.season_share, M.top2_seasons, M.segment_summary):
        assert {r["segment_name"] for r in metric(fs, segment=["Direct"]).collect()} <= {"Direct"}
        assert metric(fs, seasons=["no such season"]).count() == 0


def test_register_views_as_sql(spark, fs):
    names = V.register_views(fs)
    assert len(names) == 7
    via_sql = {r["segment_name"]: r["total_bookings"] for r in spark.sql("SELECT * FROM v_segment_summary").collect()}
    direct = {r["segment_name"]: r["total_bookings"] for r in V.v_segment_summary(fs).collect()}
    assert via_sql == direct and via_sql["Direct"] == 4
    assert spark.sql("SELECT COUNT(*) AS n FROM fact_bookings_enriched").collect()[0]["n"] == len(ROWS)
