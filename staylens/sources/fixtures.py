"""Hotel raw sources derived deterministically from the driver's TPC-H-like tables.

``k = o_orderkey`` is unique in ``orders`` so it serves as the reservation key.
The rules (see FIXTURES.md §2) inject the mess the cleaning steps exist for:
label variants, mixed date spellings, unparseable and missing dates, missing
rates, exact and near duplicates, and orphan cancellations.

Duplicates are produced with a single ``explode`` over a per-row copy list (a
plain ``CASE`` of literal arrays, inside whole-stage codegen), so the
``orders ⋈ customer`` join is computed once instead of once per copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.config import DEFAULT_CONFIG
from staylens.plans.materialize import bounded_broadcast

# --- Fixed values of the mapping ----------------------------------------------
SENTINEL_DATE = "1990-01-01"
SENTINEL_RATE = "1.00"
BAD_DATE = "not-a-date"
BAD_CANCELLATION = "to be confirmed"
#: Strings that stand for a missing value, dealt out over the text columns by key.
MISSING = {"room_type": "N/A", "rate": "NA", "segment": "None", "reason": "NULL", "refund_status": "null"}
#: A day without check-ins that the price list holds twice, with other prices.
REPEATED_PRICE_DAY = "1985-06-01"


_COUNTS: dict[tuple[str, str], int] = {}


def table_rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Row count of a driver table, counted once per application (footer-only scan)."""
    key = (spark.conf.get("spark.app.id", ""), f"{sf_dir.rstrip('/')}/{name}")
    if key not in _COUNTS:
        _COUNTS[key] = read_table(spark, sf_dir, name).count()
    return _COUNTS[key]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def day_of(df: DataFrame, name: str) -> Column:
    """Calendar day of a naive timestamp column, whatever type the session reads it as.

    The driver files store wall-clock timestamps without a zone.  Read as
    ``timestamp_ntz`` the day is taken as is; read as an instant
    (``timestamp``) the stored value is UTC-based, so the day is taken in UTC
    rather than in the session time zone.
    """
    dtype = dict(df.dtypes)[name]
    if dtype == "timestamp":
        return F.date_from_unix_date(F.floor(F.unix_micros(F.col(name)) / F.lit(86_400_000_000)).cast("int"))
    return F.to_date(F.col(name))


def _k() -> Column:
    return F.col("k")


def _fmt(d: Column) -> Column:
    """Date spelling chosen by the key: three numeric ones by ``k % 20``, seven rarer ones by ``k % 160``, else ISO."""
    r, s = _k() % 20, _k() % 160
    day = F.dayofmonth(d)
    ordinal = (
        F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th")
    )
    return (
        F.when(r == 0, F.date_format(d, "MM/dd/yyyy"))
        .when(r == 1, F.date_format(d, "dd/MM/yyyy"))
        .when(r == 2, F.date_format(d, "MM-dd-yyyy"))
        .when(s == 35, F.date_format(d, "EEEE, MMMM d, yyyy"))
        .when(s == 36, F.concat(day.cast("string"), ordinal, F.date_format(d, " MMM yyyy")))
        .when(s == 37, F.upper(F.date_format(d, "ddMMMyyyy")))
        .when(s == 38, F.date_format(d, "yyyy MM dd"))
        .when(s == 39, F.replace(F.date_format(d, "MMM d yyyy"), F.lit("Sep "), F.lit("Sept ")))
        .when(s == 64, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 14:30:00")))
        .when(s == 67, F.date_format(d, "yyyyMMdd"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )


def _booked(d: Column) -> Column:
    """Booking dates are also given by month alone, in words or numbers."""
    s = _k() % 160
    return F.when(s == 65, F.date_format(d, "MMM yyyy")).when(s == 66, F.date_format(d, "yyyy-MM")).otherwise(_fmt(d))


def _check_in(k: Column, custkey: Column, bd: Column) -> Column:
    return F.date_add(bd, F.when(k % 37 == 0, F.lit(-2)).otherwise(custkey % 120).cast("int"))


def _segment_label() -> Column:
    k, seg = _k(), F.col("c_mktsegment")
    even = k % 2 == 0
    return (
        F.when(k % 29 == 0, F.lit(None).cast("string"))
        .when(k % 97 == 0, MISSING["segment"])
        .when(seg == "AUTOMOBILE",
              F.when(k % 4 == 0, "TA").when(k % 4 == 1, " travel agency ")
              .when(k % 4 == 2, "t/a").otherwise("Travel Agency"))
        .when(seg == "BUILDING", F.when(even, "DIRECT").otherwise("Direct Booking"))
        .when(seg == "FURNITURE", F.when(k % 16 == 6, "\tCorp ").when(even, "Corp").otherwise("corporate"))
        .when(seg == "HOUSEHOLD", F.when(even, "GRP").otherwise("Groups"))
        .when(seg == "MACHINERY",
              F.when(k % 211 == 0, "Kiosk").when(even, "walk_in").otherwise("Walk-in"))
    )


def booking_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the derived stay dates (typed, not yet messy)."""
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus",
        "o_totalprice", "o_orderdate", "o_orderpriority",
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # customer grows with the data: broadcast only under a counted bound
    customer = bounded_broadcast(customer, DEFAULT_CONFIG.broadcast_max_rows,
                                 known_rows=table_rows(spark, sf_dir, "customer"))
    base = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
    bd = day_of(orders, "o_orderdate")
    n = (F.lit(1) + _k() % 7).cast("int")
    return (
        base.select(
            "k", "o_orderstatus", "o_orderpriority", "c_mktsegment",
            bd.alias("bd"),
            _check_in(_k(), F.col("o_custkey"), bd).alias("ci"),
            n.alias("n"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("rt"),
        )
        .withColumn("co", F.date_add("ci", F.when(_k() % 61 == 0, F.lit(0)).otherwise(F.col("n"))))
    )


def raw_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string bookings with variants, mixed dates and duplicate copies."""
    k = _k()
    copies = (
        F.when(k % 50 == 0, F.array(F.lit(0), F.lit(1)))   # exact repeat
        .when(k % 50 == 1, F.array(F.lit(0), F.lit(2)))    # stale repeat: old booking date, token rate
        .otherwise(F.array(F.lit(0)))
    )
    rows = booking_base(spark, sf_dir).select("*", F.explode(copies).alias("copy"))
    stale = F.col("copy") == 2
    return rows.select(
        F.concat(F.lit("R"), k.cast("string")).alias("reservation_id"),
        _segment_label().alias("segment"),
        F.when(k % 43 == 0, F.lit(MISSING["room_type"]))
        .when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("room_type"),
        F.when(stale, F.lit(SENTINEL_DATE))
        .when(k % 89 == 0, F.lit(BAD_DATE))
        .otherwise(_booked(F.col("bd"))).alias("booking_date"),
        F.when(k % 71 != 0, _fmt(F.col("ci"))).alias("check_in_date"),
        F.when(k % 83 != 0, _fmt(F.col("co"))).alias("check_out_date"),
        F.col("n").cast("string").alias("nights"),
        F.when(stale, F.lit(SENTINEL_RATE))
        .when(k % 53 == 0, F.lit(MISSING["rate"]))
        .when(k % 17 != 0, F.col("rt").cast("string")).alias("rate"),
    )


def raw_cancellations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancellations of even-keyed 'P' orders, with re-logged and orphan copies."""
    k = _k()
    relogged, orphan = k % 22 == 0, k % 26 == 0  # logged again with an old date / id with no booking
    copies = (
        F.when(relogged & orphan, F.array(F.lit(0), F.lit(1), F.lit(2)))
        .when(relogged, F.array(F.lit(0), F.lit(1)))
        .when(orphan, F.array(F.lit(0), F.lit(2)))
        .otherwise(F.array(F.lit(0)))
    )
    rows = (
        booking_base(spark, sf_dir)
        .filter((F.col("o_orderstatus") == "P") & (k % 2 == 0))
        .select("k", "ci", F.explode(copies).alias("copy"))
    )
    rid = F.concat(F.lit("R"), k.cast("string"))
    return rows.select(
        F.when(F.col("copy") == 2, F.concat(F.lit("X"), rid)).otherwise(rid).alias("reservation_id"),
        F.when(F.col("copy") == 1, F.lit(SENTINEL_DATE))
        .when(k % 34 == 0, F.lit(BAD_CANCELLATION))
        .when(k % 10 == 0, F.date_format("ci", "MM/dd/yyyy"))
        .otherwise(F.date_format("ci", "yyyy-MM-dd")).alias("cancellation_date"),
        F.when(k % 7 == 0, F.lit(None).cast("string"))
        .when(k % 12 == 0, F.lit(MISSING["reason"]))
        .when(k % 4 == 0, F.lit("price")).otherwise(F.lit("plans")).alias("reason"),
        F.when(k % 38 == 0, F.lit(MISSING["refund_status"])).when(k % 19 != 0, F.lit("full")).alias("refund_status"),
    )


def raw_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct check-in day of all orders, February left out.

    Every tenth day of a month is listed twice, and each 14th of June
    is priced a second time under a day of 1985 without check-ins, so that this
    day has several prices.
    """
    orders = read_table(spark, sf_dir, "orders")
    days = (
        orders.select(_check_in(F.col("o_orderkey"), F.col("o_custkey"), day_of(orders, "o_orderdate")).alias("d"))
        .distinct()
        .filter(F.month("d") != 2)
    )
    m, dom = F.month("d"), F.dayofmonth("d")
    again = F.when(dom % 10 == 0, F.array(F.lit(0), F.lit(0))).when((m == 6) & (dom == 14), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    days = days.select("d", F.explode(again).alias("copy"))
    return days.select(
        F.when(F.col("copy") == 1, F.lit(REPEATED_PRICE_DAY)).otherwise(F.date_format("d", "yyyy-MM-dd")).alias("date"),
        F.when(m.isin(12, 1), "Holiday").when(m.between(3, 5), "Shoulder")
        .when(m.between(6, 8), "Peak").otherwise("Off").alias("season_tag"),
        (F.lit(80) + (dom % 30) * 3 + F.when(F.col("copy") == 1, F.year("d") % 100).otherwise(F.lit(0))).cast("string").alias("base_rate"),
        F.when(dom % 3 == 0, "High").otherwise("Low").alias("demand_tier"),
    )


def raw_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(bookings, cancellations, pricing)`` raw string frames for one input dir."""
    return raw_bookings(spark, sf_dir), raw_cancellations(spark, sf_dir), raw_pricing(spark, sf_dir)
