import os
import uuid

import pytest

from staylens.operators import clean as C
from staylens.plans.materialize import checkpoint_root, materialize
from staylens.sources import csv as S
from staylens.sources import sinks


@pytest.fixture()
def tmp(spark):
    # tests only: a fresh folder under the session's checkpoint root
    return checkpoint_root(spark).replace("file:", "") + "/tests-" + uuid.uuid4().hex[:10]


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_csv_scan_strings_headers_tokens(spark, tmp):
    p = f"{tmp}/bookings.csv"
    write(p, " reservation_id , Segment ,room_type,booking_date,check_in_date,check_out_date,nights,rate\n"
             "007,TA,NA,2023-01-01,2023-02-01,2023-02-03,2,N/A\n"
             "008,None,Suite,2023-01-01,2023-02-01,2023-02-03,2,100.5\n")
    df, missing = S.read_source(spark, p, "bookings")
    assert missing == []
    assert df.columns[:2] == ["reservation_id", "segment"]
    assert all(t == "string" for _, t in df.dtypes)
    rows = sorted(tuple(r) for r in df.collect())
    assert rows[0][:3] == ("007", "TA", None) and rows[0][7] is None   # id stays text, tokens -> null
    assert rows[1][1] is None
    clean = C.clean_bookings(df).collect()
    assert {r["reservation_id"] for r in clean} == {"007", "008"}


def test_contract_reports_missing_columns(spark, tmp):
    p = f"{tmp}/cancellations.csv"
    write(p, "reservation_id,cancellation_date\nR1,2023-01-01\n")
    df, missing = S.read_source(spark, p, "cancellations")
    assert missing == ["reason", "refund_status"]
    # reported, not raised: the columns are added as nulls and cleaning proceeds
    from staylens.operators import clean as C

    row = C.clean_cancellations(df).collect()[0]
    assert (row["reason"], row["refund_status"]) == ("Unknown", "Unknown")


def test_missing_and_empty_files(spark, tmp):
    with pytest.raises(FileNotFoundError):
        S.load_csv(spark, f"{tmp}/absent.csv")
    p = f"{tmp}/empty.csv"
    write(p, "date,season_tag,base_rate,demand_tier\n")
    with pytest.raises(ValueError):
        S.load_csv(spark, p)


def test_write_fact_partitions_by_month(spark, tmp):
    import datetime as dt

    df = spark.createDataFrame([("R1", dt.date(2023, 1, 5)), ("R2", dt.date(2023, 2, 1)), ("R3", dt.date(2023, 2, 9))],
                               "reservation_id string, check_in_date date")
    n = sinks.write_fact(df, f"{tmp}/fact")
    assert n == 3
    back = spark.read.parquet(f"{tmp}/fact")
    assert back.filter("check_in_month = '2023-02'").count() == 2
    parts = sorted(d for d in os.listdir(f"{tmp}/fact") if d.startswith("check_in_month="))
    assert parts == ["check_in_month=2023-01", "check_in_month=2023-02"]


def test_load_roundtrip_overwrites(spark, tmp):
    df = spark.range(10).withColumnRenamed("id", "reservation_id")
    out = sinks.load_roundtrip(df, f"{tmp}/load").collect()[0]
    assert (out["rows_written"], out["rows_read"], out["matches"]) == (10, 10, True)
    out = sinks.load_roundtrip(df.limit(4), f"{tmp}/load").collect()[0]   # full replace, not append
    assert (out["rows_written"], out["rows_read"]) == (4, 4)


def test_materialize_observes_metrics(spark):
    from pyspark.sql import functions as F

    df, m = materialize(spark.range(100), "t", {"rows": F.count(F.lit(1)), "mx": F.max("id")})
    assert m == {"rows": 100, "mx": 99} and df.count() == 100
    assert "staylens" in df.inputFiles()[0]


def write_in(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_csv_doubled_quotes_and_ragged_rows(spark, tmp_path):
    from staylens.sources import csv as S

    path = write_in(tmp_path / "c", "a.csv", 'reservation_id,cancellation_date,reason,refund_status\n'
                 'R1,2023-01-01,"said ""no, thanks"", left",full\n'
                 'R2,2023-01-02,late\n'
                 'R3,2023-01-03,a,b,c\n'
                 'R4,2023-01-04,,NA\n')
    rows = {r["reservation_id"]: r for r in S.load_csv(spark, path).collect()}
    assert rows["R1"]["reason"] == 'said "no, thanks", left' and rows["R1"]["refund_status"] == "full"
    assert set(rows) == {"R1", "R4"} and rows["R4"]["reason"] is None and rows["R4"]["refund_status"] is None
    left = S.rejected(spark, path).collect()
    assert sorted(r["line"] for r in left) == ["R2,2023-01-02,late", "R3,2023-01-03,a,b,c"]
    assert S.load_csv(spark, path).select("reservation_id").count() == 2  # also when few columns are read


def test_read_all_keeps_short_rows_and_counts_long_ones(spark, tmp_path):
    from staylens.operators.quality import dq_expectations
    from staylens.plans.pipeline import Pipeline

    head = "reservation_id,segment,room_type,booking_date,check_in_date,check_out_date,nights,rate\n"
    paths = {
        "bookings": write_in(tmp_path / "b", "a.csv", head + 'B1,Corporate,"a ""b"", c",2023-01-01,2023-02-01,2023-02-03,2,100\n'
                             'B2,Corporate,"d, e",2023-01-01,2023-02-01,2023-02-03\nB3,Corporate,x,2023-01-01,2023-02-01,2023-02-03,2,100,more\n'),
        "cancellations": write_in(tmp_path / "c", "a.csv", "reservation_id,cancellation_date,reason,refund_status\n"
                                  "B2,2023-01-02,late\nB1,2023-01-03,a,b,c\nB1,2023-01-03,a,b,,\n"),
        "seasonal_pricing": write_in(tmp_path / "p", "a.csv", "date,season_tag,base_rate,demand_tier\n2023-02-01,Peak,90\n"),
    }
    frames, missing, aside = S.read_all(spark, paths)
    assert aside == {"bookings": 1, "cancellations": 2, "seasonal_pricing": 0}
    got = {r["reservation_id"]: r for r in frames["bookings"].collect()}
    assert set(got) == {"B1", "B2"} and got["B2"]["room_type"] == "d, e" and got["B2"]["nights"] is None and got["B2"]["rate"] is None
    assert [tuple(r) for r in frames["cancellations"].collect()] == [("B2", "2023-01-02", "late", None)]
    assert S.read_all(spark, paths, counted=False)[2] == {}
    p = Pipeline.from_frames(frames["bookings"], frames["cancellations"], frames["seasonal_pricing"], missing=missing, set_aside=aside)
    counts = p.cleaning_counts()
    assert p.fact.count() == 2 and counts["bookings"]["set_aside"] == 1 and counts["pricing"] == {"set_aside": 0}
    rules = {r["rule"]: (r["observed"], r["passed"]) for r in dq_expectations(
        p.raw_bookings, p.raw_cancellations, p.raw_pricing, p.fact, missing=p.missing, set_aside=p.set_aside).collect()}
    assert rules["set_aside_rows_cancellations"] == (2.0, False) and rules["set_aside_rows_pricing"] == (0.0, True)


def test_csv_columns_match_by_name_across_files(spark, tmp_path):
    from staylens.sources import csv as S

    folder = tmp_path / "many"
    write_in(folder, "a.csv", " Reservation_ID ,reason\nR1,price\n")
    write_in(folder, "b.csv", "reason,reservation_id,extra\nprice,R2,x\n")
    got = {r["reservation_id"]: (r["reason"], r["extra"]) for r in S.load_csv(spark, str(folder)).collect()}
    assert got == {"R1": ("price", None), "R2": ("price", "x")}


def test_publish_refuses_repeated_keys_and_keeps_the_old_version(spark, tmp_path):
    from staylens.sources import sinks

    schema = "reservation_id string, booking_date date, check_in_date date, room_nights int, is_cancelled boolean"
    import datetime as dt

    import pytest

    row = ("R1", dt.date(2023, 1, 1), dt.date(2023, 2, 1), 2, False)
    base = str(tmp_path / "load")
    sinks.publish(spark.createDataFrame([row], schema), base)
    for bad in ([row, row], [(None, *row[1:])], [("R2", None, *row[2:])]):
        with pytest.raises(ValueError, match="refused"):
            sinks.publish(spark.createDataFrame(bad, schema), base)
    assert sinks.read_published(spark, base).count() == 1
    sinks.publish(spark.createDataFrame([row, ("R2", *row[1:])], schema), base)
    assert sinks.read_published(spark, base).count() == 2


def test_write_fact_files_follow_the_data(spark, tmp_path):
    import glob

    from pyspark.sql import functions as F

    from staylens.sources import sinks

    fact = spark.range(3000).select(F.col("id").cast("string").alias("reservation_id"),
                                    F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 365).cast("int")).alias("check_in_date")).repartition(8)
    assert sinks.write_fact(fact, str(tmp_path / "fact")) == 3000
    assert len(glob.glob(str(tmp_path / "fact" / "check_in_month=*" / "*.parquet"))) <= 12 + 8


def reference_rows(spark, path):
    """Spark's own reader, which reads a file with quoted newlines in one task."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return sorted((tuple(r) for r in df.collect()), key=str)


def quoted_newlines(rng, n):
    import csv
    import io

    pool = ["a", "", "two words", "line\nbreak", "\n", "\n\n", 'quote " inside', '""', '"\n"', "comma, here", "a\nb\nc\nd\ne\nf", "é\n漢", "x" * 50, "1,2\n3,\"4\""]
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["reservation_id", "cancellation_date", "reason", "refund_status"])
    for i in range(n):
        w.writerow([f"R{i}", rng.choice(pool), rng.choice(pool), rng.choice(pool)])
    return out.getvalue()


@pytest.mark.parametrize("slice_bytes", [64, 300, 1 << 20])
def test_quoted_newlines_read_in_slices(spark, tmp_path, slice_bytes):
    import random

    rng = random.Random(slice_bytes)
    folder = tmp_path / "many"
    for name in ("a.csv", "b.csv"):
        write_in(folder, name, quoted_newlines(rng, 120))
    want = reference_rows(spark, str(folder))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(slice_bytes))
        spark.conf.set("spark.sql.files.openCostInBytes", "16")
        df = S.scan_csv(spark, str(folder), multiline=True)
        tasks = spark.read.option("lineSep", "\n").text(str(folder)).rdd.getNumPartitions()
        got = sorted((tuple(r) for r in df.drop(S.REJECTED).collect()), key=str)
        assert df.filter(df[S.REJECTED].isNotNull()).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(want) == 240 and got == want
    assert tasks > 20 if slice_bytes == 300 else tasks >= 1


def test_read_all_with_quoted_newlines_and_windows_line_ends(spark, tmp_path):
    paths = {
        "bookings": write_in(tmp_path / "b", "a.csv", "reservation_id,segment,room_type,booking_date,check_in_date,check_out_date,nights,rate\r\n"
                             'B1,Corporate,"two\r\nlines",2023-01-01,2023-02-01,2023-02-03,2,100\r\n\r\nB2,Direct,x,2023-01-01,2023-02-01\r\nB3,a,b,c,d,e,f,g,"h\r\n,i"\r\n'
                             'B4,a,b,c,d,e,f,g,h,"i\r\nj"\r\n'),
        "cancellations": write_in(tmp_path / "c", "a.csv", "reservation_id,cancellation_date,reason,refund_status\nB1,2023-01-02,late,full\n"),
    }
    frames, missing, aside = S.read_all(spark, paths, multiline={"bookings"})
    rows = {r["reservation_id"]: r for r in frames["bookings"].collect()}
    assert set(rows) == {"B1", "B2"} and rows["B1"]["room_type"] == "two\r\nlines" and rows["B2"]["nights"] is None
    assert aside == {"bookings": 2, "cancellations": 0}
    left = S.rejected(spark, paths["bookings"], multiline=True, keep_short=True).collect()
    assert sorted(r["line"] for r in left) == ['B3,a,b,c,d,e,f,g,"h\r\n,i"', 'B4,a,b,c,d,e,f,g,h,"i\r\nj"']
    assert frames["cancellations"].count() == 1


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    folder = tmp_path / "small"
    for i in range(300):
        write_in(folder, f"{i}.csv", "" if i == 7 else "reservation_id, Reason ,reason,\nR%d,price,,x\n" % i)
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        groups = S._header_groups(spark, str(folder))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers")) <= 2  # a shuffle's map side may run as a job of its own
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert list(groups) == [("reservation_id", " Reason ", "reason", "_c3")] and groups[("reservation_id", " Reason ", "reason", "_c3")] == [str(folder)]
    write_in(folder, "other.csv", "a,b\n")
    groups = S._header_groups(spark, str(folder))
    assert sorted(len(v) for v in groups.values()) == [1, 299]


def test_headers_of_large_files(spark, tmp_path):
    folder = tmp_path / "large"
    for i in range(3):
        write_in(folder, f"{i}.csv", "a,b\n" + "1,2\n" * 5000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        assert sorted(r["line"] for r in S._first_lines(spark, str(folder)).collect()) == ["a,b"] * 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


LOAD_SCHEMA = "reservation_id string, booking_date date, check_in_date date, room_nights int, is_cancelled boolean, note string"


def stays(rows):
    import datetime as dt

    return [(f"R{i}", dt.date(2022, 12, 1), dt.date(2023, month, 1 + i % 28), n, False, note) for i, (month, n, note) in enumerate(rows)]


def nights_by_day(df):
    from pyspark.sql import functions as F

    return df.groupBy(F.col("check_in_date").alias("date")).agg(F.sum("room_nights").alias("nights"))


def files_of(base):
    return {os.path.join(d, f) for d, _, names in os.walk(base) for f in names if f.endswith(".parquet")}


def test_a_second_load_writes_only_the_months_that_changed(spark, tmp_path):
    base, derived = str(tmp_path / "load"), {"daily": (nights_by_day, "date")}
    rows = [(1 + i % 3, 1 + i % 4, None if i % 5 else "x") for i in range(90)]
    first = spark.createDataFrame(stays(rows), LOAD_SCHEMA)
    sinks.publish(first, base, derived=derived)
    before = files_of(f"{base}/data")
    rows[4] = (2, 9, None)  # a stay of February
    second = spark.createDataFrame(stays(rows)[::-1], LOAD_SCHEMA).repartition(3)  # in another order
    version = sinks.publish(second, base, derived=derived)
    new = files_of(f"{base}/data") - before
    assert new and all(f"{version}/" in f and "__month=2023-02" in f for f in new) and {f.split("/")[-3] for f in new} == {"fact", "daily"}
    got = sinks.read_published(spark, base)
    assert got.schema == first.schema and sorted(map(str, got.collect())) == sorted(map(str, second.collect()))
    assert sorted(map(str, sinks.read_published(spark, base, "daily").collect())) == sorted(map(str, nights_by_day(second).collect()))
    removed = sinks.remove_old_versions(spark, base)
    assert len(removed) == 3  # February of both tables, and the manifest
    assert not any("__month=2023-02" in f and version not in f for f in files_of(f"{base}/data"))
    assert sorted(map(str, sinks.read_published(spark, base).collect())) == sorted(map(str, second.collect()))
    assert sinks.remove_old_versions(spark, base) == []


def test_months_leave_and_tables_empty(spark, tmp_path):
    base = str(tmp_path / "load")
    full = spark.createDataFrame(stays([(1, 1, "a"), (2, 1, None)]), LOAD_SCHEMA)
    sinks.publish(full, base)
    sinks.publish(full.filter("month(check_in_date) = 2"), base)
    assert [r["reservation_id"] for r in sinks.read_published(spark, base).collect()] == ["R1"]
    sinks.publish(full.limit(0), base)
    assert sinks.read_published(spark, base).count() == 0 and sinks.read_published(spark, base).schema == full.schema
    wider = full.selectExpr("*", "1 AS extra")  # other columns: everything is written anew
    sinks.publish(wider, base)
    assert sinks.read_published(spark, base).columns[-1] == "extra" and sinks.read_published(spark, base).count() == 2


def test_a_null_that_moves_changes_the_digest(spark):
    a = spark.createDataFrame([("x", None)], "a string, b string")
    b = spark.createDataFrame([(None, "x")], "a string, b string")
    assert sinks.month_digests(a) != sinks.month_digests(b)


def test_bucketed_tables_join_without_an_exchange(spark, small_sf):
    from staylens.operators import fact as FT
    from staylens.plans.pipeline import pipeline

    p = pipeline(spark, small_sf)
    joined = FT.join_cancellations(p.bookings_clean, p.cancellations_clean)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan, plan
    assert joined.count() == p.bookings_clean.count()
    per_key = p.bookings_clean.groupBy("reservation_id").count()
    assert "Exchange" not in per_key._jdf.queryExecution().executedPlan().toString()
