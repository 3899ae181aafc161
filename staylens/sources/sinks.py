"""Parquet sinks with written/read row-count checks, and versioned loads that write only the months that changed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from staylens.operators.repeats import surplus

#: Columns that a loaded row must have; a missing check-out or stated nights survives cleaning and is reported by the rules.
LOAD_REQUIRED = ("reservation_id", "booking_date", "check_in_date", "room_nights", "is_cancelled")


def write_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> int:
    """Overwrite ``path`` with ``df``; returns the rows written (observed in the same pass)."""
    obs = Observation(f"write_{uuid.uuid4().hex[:8]}")
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return int(obs.get["rows"])


def write_fact(fact: DataFrame, path: str) -> int:
    """The fact partitioned by check-in month for date-range pruning.

    Rows are dealt by month first (a rebalance: AQE splits a hot month and
    joins small ones), so the number of files follows the data, not tasks x
    months; they are sorted by check-in date inside each task, so files carry
    tight min/max statistics.
    """
    out = by_month(fact).sortWithinPartitions("check_in_month", "check_in_date")
    return write_table(out, path, partition_by=["check_in_month"])


def by_month(fact: DataFrame) -> DataFrame:
    """The fact with ``check_in_month``, rebalanced on it."""
    return fact.withColumn("check_in_month", F.date_format("check_in_date", "yyyy-MM")).hint("rebalance", "check_in_month")


def load_violations(typed_fact: DataFrame) -> dict[str, int]:
    """What the loaded table's schema forbids: repeated reservation ids and nulls in required columns, by count."""
    required = [c for c in LOAD_REQUIRED if c in typed_fact.columns]
    nulls = typed_fact.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required]).first()
    extra = surplus(typed_fact, ["reservation_id"]).first()["extra"]  # by hashes of the ids
    return {"repeated_reservation_id": int(extra)} | {k: int(v) for k, v in nulls.asDict().items()}


#: The rows of a version's manifest: where each month of each table lies.
MANIFEST = "table_name string, month string, folder string, n_rows bigint, digest string, schema string"
#: The month of tables without a check-in date.
ALL = "all"


def _month(df: DataFrame, date_col: str) -> Column:
    return F.coalesce(F.date_format(date_col, "yyyy-MM"), F.lit(ALL)) if date_col in df.columns else F.lit(ALL)


def month_digests(df: DataFrame, date_col: str = "check_in_date") -> dict[str, tuple[int, str]]:
    """Month -> (rows, digest): two 64-bit hashes of each row with its nulls marked, summed, so the order does not matter."""
    row = [*map(F.col, df.columns), *[F.col(c).isNull() for c in df.columns]]
    total = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    got = df.groupBy(_month(df, date_col).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.concat_ws("/", total(F.xxhash64(*row)), total(F.xxhash64(F.lit(1), *row))).alias("digest"))
    return {r["month"]: (r["n"], r["digest"]) for r in got.collect()}  # a row for each month


def _write_months(df: DataFrame, date_col: str, folder: str) -> dict[str, str]:
    """Writes ``df`` under ``folder``, a folder for each month; returns month -> folder after counting what is read back."""
    dealt = df.withColumn("__month", _month(df, date_col)).hint("rebalance", "__month")
    order = ["__month", date_col] if date_col in df.columns else ["__month"]
    written = write_table(dealt.sortWithinPartitions(*order), folder, partition_by=["__month"])
    back = df.sparkSession.read.parquet(folder).groupBy(F.col("__month").cast("string").alias("m")).count().collect()
    n_read = sum(r["count"] for r in back)
    if n_read != written:
        raise RuntimeError(f"row count mismatch after load: wrote {written}, read {n_read}")
    return {r["m"]: f"{folder}/__month={r['m']}" for r in back}


def _folder(spark: SparkSession, path: str):
    """(file system, path) as the cluster's storage layer names them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def _manifest(spark: SparkSession, base: str) -> tuple[str | None, list[Row]]:
    """(version, rows) of the latest manifest; (None, []) before the first load."""
    if not _exists(spark, f"{base}/current"):
        return None, []
    version = spark.read.parquet(f"{base}/current").agg(F.max_by("version", "published_at")).first()[0]
    return version, spark.read.parquet(f"{base}/manifests/{version}").collect()  # tables x months


def publish(
    fact: DataFrame,
    base: str,
    *,
    check: bool = True,
    date_col: str = "check_in_date",
    derived: Mapping[str, tuple[Callable[[DataFrame], DataFrame], str]] | None = None,
) -> str:
    """S8/S9 with a gate: checks keys and required columns, writes what changed, verifies it, then points to it.

    A version is a manifest: for each month of the fact, and of each table in
    ``derived``, the folder that holds it.  Months whose rows are as before
    (``month_digests``) are carried over; only the others are written, and
    derived tables (name -> function of fact rows, and the date column of what
    it returns, whose months must come from the fact's same months) only for
    those.  The current version stays in place until all is verified, so a
    failed job leaves the published tables as they were.  Violations raise
    ``ValueError`` before anything is written.  Returns the version.
    """
    if check:
        bad = {k: v for k, v in load_violations(fact).items() if v}
        if bad:
            raise ValueError(f"the load is refused: {bad}")
    spark, base, tables = fact.sparkSession, base.rstrip("/"), dict(derived or {})
    version = f"version-{uuid.uuid4().hex[:12]}"
    now = month_digests(fact, date_col)
    schemas = {"fact": fact.schema.json()} | {name: make(fact).schema.json() for name, (make, _) in tables.items()}
    known: dict[str, dict[str, Row]] = {}
    for row in _manifest(spark, base)[1]:
        if schemas.get(row["table_name"]) == row["schema"] and row["month"] is not None:
            known.setdefault(row["table_name"], {})[row["month"]] = row
    same = {m for m, (n, digest) in now.items() if m in known.get("fact", {}) and (known["fact"][m]["n_rows"], known["fact"][m]["digest"]) == (n, digest)}
    if set(tables) - set(known):
        same = set()  # a derived table that is new, or has other columns, is made from all months
    changed = sorted(set(now) - same)
    rows = [(name, m, r["folder"], r["n_rows"], r["digest"], r["schema"]) for name, months in known.items() for m, r in months.items() if m in same and name in schemas]
    if changed:
        part = fact.filter(_month(fact, date_col).isin(changed)) if same else fact
        for name, (make, col) in {"fact": (lambda df: df, date_col), **tables}.items():
            folders = _write_months(make(part), col, f"{base}/data/{version}/{name}")
            rows += [(name, m, f, *(now[m] if name == "fact" else (None, None)), schemas[name]) for m, f in folders.items()]
    rows += [(name, None, None, 0, None, schema) for name, schema in schemas.items()]  # the schema also of an empty table
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{base}/manifests/{version}")
    pointer = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"))
    pointer.coalesce(1).write.mode("append").parquet(f"{base}/current")
    return version


def read_published(spark: SparkSession, base: str, table: str = "fact") -> DataFrame:
    """The latest published version of a table under ``base``."""
    rows = [r for r in _manifest(spark, base.rstrip("/"))[1] if r["table_name"] == table]
    schema = StructType.fromJson(json.loads(rows[0]["schema"]))
    folders = [r["folder"] for r in rows if r["folder"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def remove_old_versions(spark: SparkSession, base: str, keep: int = 1) -> list[str]:
    """Removes what only versions before the latest ``keep`` hold; returns the removed folders.

    A reader that has opened an older version loses its files, so keep as many as readers may still use.
    """
    base = base.rstrip("/")
    versions = [r["version"] for r in spark.read.parquet(f"{base}/current").orderBy(F.col("published_at").desc()).collect()]
    kept = {r["folder"] for v in versions[:keep] for r in spark.read.parquet(f"{base}/manifests/{v}").collect()}
    removed = []

    def remove(path: str) -> None:
        fs, at = _folder(spark, path)
        fs.delete(at, True)
        removed.append(path)

    for v in versions[keep:]:
        if not _exists(spark, f"{base}/manifests/{v}"):
            continue
        own = {r["folder"] for r in spark.read.parquet(f"{base}/manifests/{v}").collect() if r["folder"]}
        for folder in sorted(own - kept):
            if _exists(spark, folder):
                remove(folder)
        remove(f"{base}/manifests/{v}")
    return removed


def load_roundtrip(typed_fact: DataFrame, base: str) -> DataFrame:
    """Gated load and post-load check: ``(rows_written, rows_read, matches)``.

    Raises like ``publish``; also ``RuntimeError`` when the published table holds a different count, like the original loader.
    """
    spark = typed_fact.sparkSession
    version = publish(typed_fact, base)
    written = sum(r["n_rows"] for r in spark.read.parquet(f"{base.rstrip('/')}/manifests/{version}").collect())
    read_back = read_published(spark, base)
    n_read = read_back.count()
    if n_read != written:
        raise RuntimeError(f"row count mismatch after load: wrote {written}, read {n_read}")
    return read_back.agg(F.count(F.lit(1)).alias("rows_read")).select(
        F.lit(written).cast("bigint").alias("rows_written"),
        "rows_read",
        (F.col("rows_read") == F.lit(written)).alias("matches"),
    )
