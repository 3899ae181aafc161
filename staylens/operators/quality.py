"""Profiling (null, duplicate, date, segment, numeric) and data-quality rules.

Each profile is one aggregation pass per source that produces a single wide
row, turned into long rows with ``explode(array(struct ...))`` — no joins of
one-row frames.  Rule checks return ``(rule, observed, threshold, op, passed)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.config import (
    BOOKINGS_COLUMNS,
    CANCELLATIONS_COLUMNS,
    DEFAULT_CONFIG,
    FACT_COLUMNS,
    MIN_CLEAN_RETENTION,
    MIN_FACT_RETENTION,
    MIN_FACT_ROWS,
    NOT_NULL_COLUMNS,
    NULL_THRESHOLDS,
    PRICING_COLUMNS,
    Config,
)
from staylens.functions import parse_mixed_date, ratio
from staylens.operators.repeats import surplus


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def profile_nulls(sources: Mapping[str, DataFrame]) -> DataFrame:
    """D1p: ``(source, column_name, n_rows, null_count, null_pct)`` per column."""
    frames = []
    for name, df in sources.items():
        wide = df.agg(
            F.count(F.lit(1)).alias("__n"),
            *[F.count_if(F.col(c).isNull()).alias(f"__null_{i}") for i, c in enumerate(df.columns)],
        )
        structs = [
            F.struct(F.lit(c).alias("column_name"), F.col(f"__null_{i}").alias("null_count"))
            for i, c in enumerate(df.columns)
        ]
        frames.append(
            wide.select(F.lit(name).alias("source"), F.col("__n").alias("n_rows"), F.explode(F.array(*structs)).alias("r"))
            .select("source", "r.column_name", "n_rows", "r.null_count")
        )
    out = _union(frames)
    return out.withColumn("null_pct", F.round(ratio(F.col("null_count"), F.col("n_rows")) * 100.0, 2))


def profile_dupes(sources: Mapping[str, tuple[DataFrame, str | None]], cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """D2p: ``(source, n_rows, exact_duplicate_rows, key_duplicates)``; nulls compare equal.

    Repeats are found by their hashes (``repeats.surplus``): one job per source
    for the rows and one for the keys, 8 bytes a row through the exchange.
    """
    none = F.lit(None).cast("bigint")
    frames = []
    for name, (df, key) in sources.items():
        part = lambda rows, exact, keys, name=name: [F.lit(name).alias("source"), rows.alias("n_rows"), exact.alias("exact_duplicate_rows"), keys.alias("key_duplicates")]
        frames.append(df.agg(F.count(F.lit(1)).alias("n")).select(*part(F.col("n"), none, none)))
        frames.append(surplus(df, df.columns, cfg).select(*part(none, F.col("extra"), none)))
        if key:
            frames.append(surplus(df, [key], cfg).select(*part(none, none, F.col("extra"))))
    return _union(frames).groupBy("source").agg(
        F.max("n_rows").alias("n_rows"),
        F.max("exact_duplicate_rows").alias("exact_duplicate_rows"),
        F.max("key_duplicates").alias("key_duplicates"),
    )


def profile_dates(sources: Mapping[str, tuple[DataFrame, Sequence[str]]], cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """D3p: ``(source, column_name, n_values, n_failed, min_date, max_date)`` per date column."""
    frames = []
    for name, (df, cols) in sources.items():
        aggs = []
        for i, c in enumerate(cols):
            p = F.col(f"__p{i}")
            aggs += [
                F.count(c).alias(f"__v{i}"),
                F.count_if(F.col(c).isNotNull() & p.isNull()).alias(f"__f{i}"),
                F.min(p).alias(f"__lo{i}"),
                F.max(p).alias(f"__hi{i}"),
            ]
        # parsed in a projection below the aggregate, which uses each date four times
        wide = df.select(*cols, *[parse_mixed_date(c).alias(f"__p{i}") for i, c in enumerate(cols)]).agg(*aggs)
        structs = [
            F.struct(
                F.lit(c).alias("column_name"), F.col(f"__v{i}").alias("n_values"), F.col(f"__f{i}").alias("n_failed"),
                F.col(f"__lo{i}").alias("min_date"), F.col(f"__hi{i}").alias("max_date"),
            )
            for i, c in enumerate(cols)
        ]
        frames.append(wide.select(F.lit(name).alias("source"), F.explode(F.array(*structs)).alias("r")).select(
            "source", "r.*"))
    return _union(frames)


def profile_segments(raw_bookings: DataFrame) -> DataFrame:
    """D4p: raw segment value counts, the missing value included."""
    return raw_bookings.groupBy("segment").agg(F.count(F.lit(1)).alias("n_rows"))


def profile_segment_kinds(raw_bookings: DataFrame) -> DataFrame:
    """D4p: ``(n_rows, n_missing, n_distinct)`` of the raw segment labels, from their counts."""
    counts = raw_bookings.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("segment").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("segment").alias("n_distinct"),
    )


def profile_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D5p: count / mean / stddev / min / max per numeric column (4 decimals); quartiles: ``profile_quartiles``."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"__n{i}"), F.avg(x).alias(f"__m{i}"), F.stddev_samp(x).alias(f"__s{i}"),
                 F.min(x).alias(f"__lo{i}"), F.max(x).alias(f"__hi{i}")]
    wide = df.agg(*aggs)
    structs = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"__n{i}").alias("n"),
            F.round(F.col(f"__m{i}"), 4).alias("mean"), F.round(F.col(f"__s{i}"), 4).alias("stddev"),
            F.col(f"__lo{i}").alias("min"), F.col(f"__hi{i}").alias("max"),
        )
        for i, c in enumerate(cols)
    ]
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def _melted_counts(df: DataFrame, cols: Sequence[str], dtype: str) -> DataFrame:
    """(column_name, v, n): how often each non-null value of each column occurs; partially aggregated."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(dtype).alias("v")) for c in cols])
    return (
        df.select(F.explode(pairs).alias("x")).select("x.*").filter(F.col("v").isNotNull())
        .groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    )


def profile_text(df: DataFrame, cols: Sequence[str], cfg: Config = DEFAULT_CONFIG) -> DataFrame:
    """D5p for text columns: non-null count, distinct values, the most frequent value (ties: first by name) and its count.

    Values are counted by two 64-bit hashes, so a column of unique ids sends 16
    bytes a row through the exchange, whatever its values' length; a table of
    these counts gives ``unique`` and ``freq``.  Only values whose hashes reach
    their column's ``freq`` are read again, counted as they are and compared.
    Where nothing repeats, the first value by name is the top.  Two values of
    one column with both hashes equal would be counted as one in ``unique``.
    """
    from staylens.plans.materialize import bounded_broadcast, materialize

    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in cols])
    values = df.select(F.explode(pairs).alias("x")).select("x.*").filter(F.col("v").isNotNull())
    hashed = values.withColumns({"__h": F.xxhash64("v"), "__g": F.xxhash64(F.lit(1), "v")})
    key = ["column_name", "__h", "__g"]
    counts, _ = materialize(hashed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "text-counts")
    per_column = counts.groupBy("column_name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("unique"), F.max("n").alias("freq"))
    per_column, _ = materialize(per_column, "text-columns")  # a row a column
    top, seen = materialize(
        counts.withColumnRenamed("n", "__n").join(F.broadcast(per_column.select("column_name", "freq")), "column_name")
        .filter((F.col("__n") == F.col("freq")) & (F.col("freq") > 1)).select(*key),
        "text-tops", {"n": F.count(F.lit(1))},
    )
    again = hashed.join(bounded_broadcast(top, cfg.broadcast_max_rows, int(seen["n"] or 0)), key, "left_semi")
    frequent = again.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("m")).groupBy("column_name").agg(
        F.min_by("v", F.struct(-F.col("m"), F.col("v"))).alias("v"))
    unique = values.join(F.broadcast(per_column.filter("freq = 1").select("column_name")), "column_name").groupBy("column_name").agg(F.min("v").alias("v"))
    tops = frequent.unionByName(unique).withColumnRenamed("v", "top")
    return per_column.join(F.broadcast(tops), "column_name").select("column_name", "n", "unique", "top", "freq")


def profile_quartiles(df: DataFrame, cols: Sequence[str], quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """D5p: exact quantiles per numeric column, linearly interpolated: ``(column_name, q, value)``.

    Value counts are range-partitioned by (column, value) and written; one
    total per partition and column gives every value its rank, so no column
    is ever gathered in one task or buffer.
    """
    from pyspark.sql import Window

    from staylens.plans.materialize import materialize

    counts = _melted_counts(df, cols, "double").repartitionByRange("column_name", "v")
    counts, _ = materialize(counts.withColumn("part", F.spark_partition_id()), "quartile-counts")
    totals = counts.groupBy("column_name", "part").agg(F.sum("n").alias("t"))  # columns x partitions at most
    before = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "column_name", "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("off"),
        F.sum("t").over(Window.partitionBy("column_name")).alias("total"))
    run = Window.partitionBy("column_name", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.withColumn("run", F.sum("n").over(run))
        .join(F.broadcast(offsets), ["column_name", "part"])
        .withColumn("last", F.col("off") + F.col("run") - 1)
        .withColumn("first", F.col("last") - F.col("n") + 1)
        .withColumn("q", F.explode(F.array(*[F.lit(float(x)) for x in quantiles])))
        .withColumn("rank", F.col("q") * (F.col("total") - 1))
    )
    at = lambda r: F.max(F.when((F.col("first") <= r) & (r <= F.col("last")), F.col("v")))
    low, high = at(F.floor("rank")), at(F.ceil("rank"))
    part = F.first("rank") - F.floor(F.first("rank"))
    return ranked.groupBy("column_name", "q").agg(F.round(low + (high - low) * part, 4).alias("value"))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns absent from ``df`` (case- and padding-insensitive)."""
    actual = {c.strip().lower() for c in df.columns}
    return [c for c in required if c.lower() not in actual]


def dq_expectations(
    raw_bookings: DataFrame,
    raw_cancellations: DataFrame,
    raw_pricing: DataFrame,
    fact: DataFrame,
    cfg: Config = DEFAULT_CONFIG,
    missing: Mapping[str, Sequence[str]] | None = None,
    counts: Mapping[str, int] | None = None,
    set_aside: Mapping[str, int] | None = None,
) -> DataFrame:
    """Q1–Q7 as data: ``(rule, observed, threshold, op, passed)``.

    ``missing`` carries the contract report of the scan (``csv.read_all``),
    whose frames already have the absent columns filled with nulls.

    ``counts`` carries row counts already in hand (``raw_bookings``,
    ``bookings_clean``, ``raw_cancellations``, ``fact``), as observed while a
    pipeline wrote its tables; the raw sources are then not read again.

    ``set_aside`` carries the rows that the scan left out per source
    (``csv.read_all(...)``); each source gets a rule that there are none.

    Passes without ``counts``: one read per raw source (the clean-bookings count comes
    out of the same dedup that reads raw bookings); in any case one wide
    aggregate over the fact, and its key's hashes, which a job counts.
    """
    rule_fields = ("rule", "observed", "threshold", "op")

    def rule(name: str, observed: Column, threshold: float, op: str) -> Column:
        return F.struct(F.lit(name).alias("rule"), observed.cast("double").alias("observed"),
                        F.lit(float(threshold)).alias("threshold"), F.lit(op).alias("op"))

    # Q1: schema contracts (metadata only, attached to the counts pass).
    contracts = [
        ("bookings", raw_bookings, BOOKINGS_COLUMNS),
        ("cancellations", raw_cancellations, CANCELLATIONS_COLUMNS),
        ("pricing", raw_pricing, PRICING_COLUMNS),
        ("fact", fact, FACT_COLUMNS),
    ]
    # Q2/Q3: row counts and retention.  Raw and clean bookings come from one
    # read (the dedup counts its input rows per key); the other sources are
    # counted once each; the one-row results are merged through a tagged union.
    from staylens.operators.clean import dedup_parse_bookings, valid_stay

    names = ("raw_bookings", "raw_cancellations", "raw_pricing", "bookings_clean", "fact")
    parsed = dedup_parse_bookings(raw_bookings, cfg, count_as="__rows")
    has_dates = F.col("check_in_date").isNotNull() & F.col("booking_date").isNotNull()
    tagged = _union([
        parsed.agg(F.sum("__rows").alias("raw"), F.count_if(has_dates & valid_stay()).alias("clean")).select(
            F.explode(F.array(
                F.struct(F.lit("raw_bookings").alias("t"), F.col("raw").alias("n")),
                F.struct(F.lit("bookings_clean").alias("t"), F.col("clean").alias("n")),
            )).alias("r")).select("r.t", "r.n"),
        raw_cancellations.agg(F.count(F.lit(1)).alias("n")).select(F.lit("raw_cancellations").alias("t"), "n"),
        raw_pricing.agg(F.count(F.lit(1)).alias("n")).select(F.lit("raw_pricing").alias("t"), "n"),
        fact.agg(F.count(F.lit(1)).alias("n")).select(F.lit("fact").alias("t"), "n"),
    ])
    n = {t: F.max(F.when(F.col("t") == t, F.col("n"))) for t in names}
    if counts is None:
        found = tagged.agg(*[v.alias(k) for k, v in n.items()])
    else:
        found = raw_pricing.agg(F.count(F.lit(1)).alias("raw_pricing")).select(
            "raw_pricing", *[F.lit(int(counts[k])).cast("bigint").alias(k) for k in names if k != "raw_pricing"])
    count_rules = [
        rule(f"required_columns_missing_{src}",
             F.lit(len((missing or {}).get(src) or missing_columns(df, req))), 0, "<=")
        for src, df, req in contracts
    ] + [
        rule(f"set_aside_rows_{src}", F.lit(int(n_rows)), 0, "<=") for src, n_rows in sorted((set_aside or {}).items())
    ] + [
        rule("min_rows_raw_bookings", F.col("raw_bookings"), 1, ">="),
        rule("min_rows_raw_cancellations", F.col("raw_cancellations"), 1, ">="),
        rule("min_rows_raw_pricing", F.col("raw_pricing"), 1, ">="),
        rule("min_rows_fact", F.col("fact"), MIN_FACT_ROWS, ">="),
        rule("retention_clean_bookings", ratio(F.col("bookings_clean"), F.col("raw_bookings")),
             MIN_CLEAN_RETENTION, ">="),
        rule("retention_fact", ratio(F.col("fact"), F.col("raw_bookings")), MIN_FACT_RETENTION, ">="),
    ]
    part1 = found.select(F.explode(F.array(*count_rules)).alias("r")).select("r.*")

    # Q4/Q5/Q7 and the not-null half of Q6: one wide aggregate over the fact.
    allowed = list(cfg.dim_segments)
    fact_aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(NULL_THRESHOLDS):
        fact_aggs.append(F.count_if(F.col(c).isNull()).alias(f"__null{i}"))
    for i, c in enumerate(NOT_NULL_COLUMNS):
        fact_aggs.append(F.count_if(F.col(c).isNull()).alias(f"__nn{i}"))
    fact_aggs += [
        F.count_if(~F.col("segment").isin(allowed)).alias("__noncanon"),
        F.count_if(F.col("occupancy_rate") < 0).alias("__neg_occ"),
        F.count_if(F.col("lead_time_days") < 0).alias("__neg_lead"),
    ]
    wide = fact.agg(*fact_aggs)
    fact_rules = [
        rule(f"null_fraction_{c}", ratio(F.col(f"__null{i}"), F.col("__n")), t, "<=")
        for i, (c, t) in enumerate(NULL_THRESHOLDS.items())
    ] + [
        rule("non_canonical_segment_rows", F.col("__noncanon"), 0, "<="),
        rule("negative_occupancy_rate_rows", F.col("__neg_occ"), 0, "<="),
        rule("negative_lead_time_rows", F.col("__neg_lead"), 0, "<="),
        rule("null_reservation_id_rows", F.col("__null0"), 0, "<="),
    ] + [
        # the loaded table declares these NOT NULL; e.g. a missing check-out survives cleaning
        rule(f"not_null_{c}_violations", F.col(f"__nn{i}"), 0, "<=") for i, c in enumerate(NOT_NULL_COLUMNS)
    ]
    part2 = wide.select(F.explode(F.array(*fact_rules)).alias("r")).select("r.*")

    # Q6: primary key unique.
    part3 = surplus(fact, ["reservation_id"], cfg).select(
        F.explode(F.array(rule("duplicate_reservation_ids", F.col("repeats"), 0, "<="))).alias("r")).select("r.*")

    out = _union([part1, part2, part3]).select(*rule_fields)
    passed = F.when(F.col("op") == ">=", F.col("observed") >= F.col("threshold")).otherwise(
        F.col("observed") <= F.col("threshold"))
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))
