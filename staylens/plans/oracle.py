"""DuckDB oracle SQL: the whole pipeline re-expressed as one CTE prelude.

``prelude()`` derives the raw sources from ``orders``/``customer`` with the
same fixture rules, cleans them, builds the fact and the segmented fact;
each oracle query is ``WITH <prelude> SELECT ...``.  Its literal lists
(variants, tokens, segments, date formats) are its own.
"""

from __future__ import annotations

# The oracle's own copies of the values that results depend on, so that a change on the Spark side shows.
ASSUMED_TOTAL_ROOMS = 100
CANONICAL_SEGMENTS = ("Travel Agency", "Direct", "Corporate", "Group", "Walk-in")
UNKNOWN = "Unknown"
NULL_TOKENS = ("", "NA", "N/A", "NULL", "null", "None")
#: The label spellings that occur in the derived sources, trimmed and lower-cased.
SEGMENT_VARIANTS = {
    "ta": "Travel Agency", "t/a": "Travel Agency", "travel agency": "Travel Agency",
    "direct": "Direct", "direct booking": "Direct",
    "corp": "Corporate", "corporate": "Corporate",
    "grp": "Group", "groups": "Group",
    "walk_in": "Walk-in", "walk-in": "Walk-in",
}

# DuckDB spellings of the date formats the derived sources hold (month-first first).
DUCK_DATE_FORMATS = (
    "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%m-%Y",
    "%A, %B %d, %Y", "%d %b %Y", "%d%b%Y", "%Y %m %d", "%b %d %Y", "%Y-%m-%d %H:%M:%S", "%Y%m%d", "%b %Y", "%Y-%m",
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def parse(x: str) -> str:
    fmts = ", ".join(q(f) for f in DUCK_DATE_FORMATS)
    plain = f"regexp_replace(regexp_replace(trim({x}), '^([0-9]+)(st|nd|rd|th) ', '\\1 '), '^Sept ', 'Sep ')"
    return f"CAST(try_strptime({plain}, [{fmts}]) AS DATE)"


def tok(x: str) -> str:
    return f"CASE WHEN {x} IN ({', '.join(q(t) for t in NULL_TOKENS)}) THEN NULL ELSE {x} END AS {x}"


def fmt(d: str) -> str:
    suffix = (
        f"CASE WHEN day({d}) IN (1, 21, 31) THEN 'st' WHEN day({d}) IN (2, 22) THEN 'nd' "
        f"WHEN day({d}) IN (3, 23) THEN 'rd' ELSE 'th' END"
    )
    return (
        f"CASE WHEN k % 20 = 0 THEN strftime({d}, '%m/%d/%Y') WHEN k % 20 = 1 THEN strftime({d}, '%d/%m/%Y') "
        f"WHEN k % 20 = 2 THEN strftime({d}, '%m-%d-%Y') WHEN k % 160 = 35 THEN strftime({d}, '%A, %B %-d, %Y') "
        f"WHEN k % 160 = 36 THEN day({d}) || {suffix} || strftime({d}, ' %b %Y') "
        f"WHEN k % 160 = 37 THEN upper(strftime({d}, '%d%b%Y')) WHEN k % 160 = 38 THEN strftime({d}, '%Y %m %d') "
        f"WHEN k % 160 = 39 THEN replace(strftime({d}, '%b %-d %Y'), 'Sep ', 'Sept ') "
        f"WHEN k % 160 = 64 THEN strftime({d}, '%Y-%m-%d 14:30:00') WHEN k % 160 = 67 THEN strftime({d}, '%Y%m%d') "
        f"ELSE strftime({d}, '%Y-%m-%d') END"
    )


def booked(d: str) -> str:
    return f"CASE k % 160 WHEN 65 THEN strftime({d}, '%b %Y') WHEN 66 THEN strftime({d}, '%Y-%m') ELSE {fmt(d)} END"


def seg_norm(x: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in sorted(SEGMENT_VARIANTS.items()))
    return f"COALESCE(CASE lower(trim({x}, ' ' || chr(9))) {whens} END, {x}, {q(UNKNOWN)})"


def seg_name(x: str) -> str:
    return f"CASE WHEN {x} IN ({', '.join(q(s) for s in CANONICAL_SEGMENTS)}) THEN {x} ELSE {q(UNKNOWN)} END"


def seg_id(x: str) -> str:
    whens = " ".join(f"WHEN {q(s)} THEN {i}" for i, s in enumerate(CANONICAL_SEGMENTS, start=1))
    return f"CASE {x} {whens} ELSE {len(CANONICAL_SEGMENTS) + 1} END"


B_COLS = ("reservation_id", "segment", "room_type", "booking_date", "check_in_date", "check_out_date",
          "nights", "rate")
C_COLS = ("reservation_id", "cancellation_date", "reason", "refund_status")
P_COLS = ("date", "season_tag", "base_rate", "demand_tier")


def _order_desc(first: str, cols) -> str:
    return ", ".join([f"{first} DESC NULLS LAST"] + [f"{c} DESC NULLS LAST" for c in cols])


def prelude() -> str:
    b_payload = [c for c in B_COLS if c != "reservation_id"]
    c_payload = [c for c in C_COLS if c != "reservation_id"]
    whole = (
        "CASE WHEN try_cast(trim(nights) AS DOUBLE) = floor(try_cast(trim(nights) AS DOUBLE)) "
        "THEN CAST(try_cast(trim(nights) AS DOUBLE) AS INTEGER) END"
    )
    return f"""
ob AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS ck, o.o_orderstatus AS st, o.o_orderpriority AS pr,
         c.c_mktsegment AS ms, CAST(o.o_totalprice AS DECIMAL(12,2)) AS rt,
         CAST(o.o_orderdate AS DATE) AS bd
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
ob2 AS (
  SELECT *, bd + CAST(CASE WHEN k % 37 = 0 THEN -2 ELSE ck % 120 END AS INTEGER) AS ci,
         CAST(1 + k % 7 AS INTEGER) AS n
  FROM ob
),
ob3 AS (SELECT *, ci + CASE WHEN k % 61 = 0 THEN 0 ELSE n END AS co FROM ob2),
rb0 AS (
  SELECT k, 'R' || CAST(k AS VARCHAR) AS reservation_id,
    CASE WHEN k % 29 = 0 THEN NULL
         WHEN k % 97 = 0 THEN 'None'
         WHEN ms = 'AUTOMOBILE' THEN CASE k % 4 WHEN 0 THEN 'TA' WHEN 1 THEN ' travel agency '
                                                WHEN 2 THEN 't/a' ELSE 'Travel Agency' END
         WHEN ms = 'BUILDING' THEN CASE WHEN k % 2 = 0 THEN 'DIRECT' ELSE 'Direct Booking' END
         WHEN ms = 'FURNITURE' THEN CASE WHEN k % 16 = 6 THEN chr(9) || 'Corp ' WHEN k % 2 = 0 THEN 'Corp' ELSE 'corporate' END
         WHEN ms = 'HOUSEHOLD' THEN CASE WHEN k % 2 = 0 THEN 'GRP' ELSE 'Groups' END
         WHEN ms = 'MACHINERY' THEN CASE WHEN k % 211 = 0 THEN 'Kiosk' WHEN k % 2 = 0 THEN 'walk_in'
                                         ELSE 'Walk-in' END
    END AS segment,
    CASE WHEN k % 43 = 0 THEN 'N/A' WHEN pr = '4-NOT SPECIFIED' THEN NULL ELSE pr END AS room_type,
    CASE WHEN k % 89 = 0 THEN 'not-a-date' ELSE {booked('bd')} END AS booking_date,
    CASE WHEN k % 71 = 0 THEN NULL ELSE {fmt('ci')} END AS check_in_date,
    CASE WHEN k % 83 = 0 THEN NULL ELSE {fmt('co')} END AS check_out_date,
    CAST(n AS VARCHAR) AS nights,
    CASE WHEN k % 53 = 0 THEN 'NA' WHEN k % 17 = 0 THEN NULL ELSE CAST(rt AS VARCHAR) END AS rate
  FROM ob3
),
raw_bookings AS (
  SELECT reservation_id, segment, room_type, booking_date, check_in_date, check_out_date, nights, rate FROM rb0
  UNION ALL
  SELECT reservation_id, segment, room_type, booking_date, check_in_date, check_out_date, nights, rate
  FROM rb0 WHERE k % 50 = 0
  UNION ALL
  SELECT reservation_id, segment, room_type, '1990-01-01', check_in_date, check_out_date, nights, '1.00'
  FROM rb0 WHERE k % 50 = 1
),
rc0 AS (
  SELECT k, 'R' || CAST(k AS VARCHAR) AS reservation_id,
    CASE WHEN k % 34 = 0 THEN 'to be confirmed' WHEN k % 10 = 0 THEN strftime(ci, '%m/%d/%Y') ELSE strftime(ci, '%Y-%m-%d') END AS cancellation_date,
    CASE WHEN k % 7 = 0 THEN NULL WHEN k % 12 = 0 THEN 'NULL' WHEN k % 4 = 0 THEN 'price' ELSE 'plans' END AS reason,
    CASE WHEN k % 38 = 0 THEN 'null' WHEN k % 19 = 0 THEN NULL ELSE 'full' END AS refund_status
  FROM ob3 WHERE st = 'P' AND k % 2 = 0
),
raw_cancellations AS (
  SELECT reservation_id, cancellation_date, reason, refund_status FROM rc0
  UNION ALL SELECT reservation_id, '1990-01-01', reason, refund_status FROM rc0 WHERE k % 22 = 0
  UNION ALL SELECT 'X' || reservation_id, cancellation_date, reason, refund_status FROM rc0 WHERE k % 26 = 0
),
pd0 AS (
  SELECT DISTINCT CAST(o_orderdate AS DATE)
           + CAST(CASE WHEN o_orderkey % 37 = 0 THEN -2 ELSE o_custkey % 120 END AS INTEGER) AS d
  FROM orders
),
pd1 AS (
  SELECT d, false AS second FROM pd0 UNION ALL SELECT d, false FROM pd0 WHERE day(d) % 10 = 0
  UNION ALL SELECT d, true FROM pd0 WHERE month(d) = 6 AND day(d) = 14
),
raw_pricing AS (
  SELECT CASE WHEN second THEN '1985-06-01' ELSE strftime(d, '%Y-%m-%d') END AS date,
    CASE WHEN month(d) IN (12, 1) THEN 'Holiday' WHEN month(d) BETWEEN 3 AND 5 THEN 'Shoulder'
         WHEN month(d) BETWEEN 6 AND 8 THEN 'Peak' ELSE 'Off' END AS season_tag,
    CAST(80 + (day(d) % 30) * 3 + CASE WHEN second THEN year(d) % 100 ELSE 0 END AS VARCHAR) AS base_rate,
    CASE WHEN day(d) % 3 = 0 THEN 'High' ELSE 'Low' END AS demand_tier
  FROM pd1 WHERE month(d) <> 2
),
b_tok AS (SELECT {', '.join(tok(c) for c in B_COLS)} FROM raw_bookings),
c_tok AS (SELECT {', '.join(tok(c) for c in C_COLS)} FROM raw_cancellations),
p_tok AS (SELECT {', '.join(tok(c) for c in P_COLS)} FROM raw_pricing),
b_dedup AS (
  SELECT {', '.join(B_COLS)} FROM (
    SELECT *, row_number() OVER (PARTITION BY reservation_id
                                 ORDER BY {_order_desc(parse('booking_date'), b_payload)}) AS rn_
    FROM b_tok) WHERE rn_ = 1
),
b_parsed AS (
  SELECT reservation_id, segment, room_type, {parse('booking_date')} AS booking_date,
         {parse('check_in_date')} AS check_in_date, {parse('check_out_date')} AS check_out_date, nights, rate
  FROM b_dedup
),
bookings_clean AS (
  SELECT reservation_id, {seg_norm('segment')} AS segment, COALESCE(room_type, 'Unknown') AS room_type,
         booking_date, check_in_date, check_out_date,
         {whole} AS nights,
         CASE WHEN check_out_date - check_in_date > 0 THEN CAST(check_out_date - check_in_date AS INTEGER)
              ELSE {whole} END AS room_nights,
         TRY_CAST(trim(rate) AS DECIMAL(12,2)) AS rate
  FROM b_parsed
  WHERE check_in_date IS NOT NULL AND booking_date IS NOT NULL
    AND (check_out_date IS NULL OR check_out_date > check_in_date)
),
c_dedup AS (
  SELECT {', '.join(C_COLS)} FROM (
    SELECT *, row_number() OVER (PARTITION BY reservation_id
                                 ORDER BY {_order_desc(parse('cancellation_date'), c_payload)}) AS rn_
    FROM c_tok) WHERE rn_ = 1
),
cancellations_clean AS (
  SELECT reservation_id, {parse('cancellation_date')} AS cancellation_date,
         COALESCE(reason, 'Unknown') AS reason, COALESCE(refund_status, 'Unknown') AS refund_status
  FROM c_dedup WHERE {parse('cancellation_date')} IS NOT NULL
),
pricing_clean AS (
  SELECT {parse('date')} AS date, season_tag, TRY_CAST(trim(base_rate) AS DECIMAL(12,2)) AS base_rate,
         COALESCE(demand_tier, 'Unknown') AS demand_tier
  FROM (SELECT DISTINCT * FROM p_tok) WHERE {parse('date')} IS NOT NULL
),
f1 AS (
  SELECT b.*, c.cancellation_date, c.reason AS cancellation_reason, c.refund_status
  FROM bookings_clean b LEFT JOIN cancellations_clean c ON b.reservation_id = c.reservation_id
),
f2 AS (
  SELECT f1.*, p.season_tag, p.base_rate, p.demand_tier
  FROM f1 LEFT JOIN pricing_clean p ON f1.check_in_date = p.date
),
f3 AS (
  SELECT reservation_id, segment, room_type, booking_date, check_in_date, check_out_date, nights, room_nights,
         COALESCE(rate, base_rate) AS rate, cancellation_date IS NOT NULL AS is_cancelled,
         cancellation_date, cancellation_reason, refund_status,
         CASE WHEN check_in_date - booking_date >= 0 THEN CAST(check_in_date - booking_date AS INTEGER)
         END AS lead_time_days,
         season_tag, base_rate, demand_tier
  FROM f2
),
daily AS (
  SELECT check_in_date, COALESCE(SUM(room_nights), 0) AS booked FROM f3 WHERE NOT is_cancelled
  GROUP BY check_in_date
),
fact AS (
  SELECT f3.*, CAST(d.booked AS DOUBLE) / {float(ASSUMED_TOTAL_ROOMS)} AS occupancy_rate
  FROM f3 LEFT JOIN daily d ON f3.check_in_date = d.check_in_date
),
fs AS (SELECT *, {seg_name('segment')} AS segment_name FROM fact)
"""


def with_prelude(body: str) -> str:
    return "WITH " + prelude().strip() + "\n" + body.strip()
