"""Raw CSV scan with an all-string schema, header clean-up and contracts.

Values are never type-inferred at read (an id such as ``007`` stays a
string); typing happens in the cleaning operators.  Quotes inside quoted values
are doubled, files of one folder are matched by column name (each distinct
header is read with its own schema; one job finds the headers of all files).
``read_source`` and ``read_all`` keep rows with fewer values than their header,
padded with nulls, and set rows with more values aside whole instead of cutting
them: ``rejected`` returns those and ``read_all`` their number per source.

Files are split for reading.  With ``multiline=True`` quoted values may hold
newlines and files are still split: whether a slice of a file starts inside a
quoted value follows from the parity of the quotes before it, so one narrow
aggregate over the slices tells every slice where its records begin, and the
few records that lie across slices are joined from their parts.
"""

from __future__ import annotations

import csv
from collections.abc import Collection

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.config import (
    BOOKINGS_COLUMNS,
    CANCELLATIONS_COLUMNS,
    DEFAULT_CONFIG,
    PRICING_COLUMNS,
    Config,
)
from staylens.operators.clean import normalise_headers, null_tokens
from staylens.operators.quality import missing_columns
from staylens.plans.materialize import bounded_broadcast, materialize

CONTRACTS = {
    "bookings": BOOKINGS_COLUMNS,
    "cancellations": CANCELLATIONS_COLUMNS,
    "seasonal_pricing": PRICING_COLUMNS,
}


#: The raw line of a row that does not fit its header.
REJECTED = "_rejected_line"
#: A quoted value with the separator before it.
QUOTED = r'(^|,)"[^"]*+(?:""[^"]*+)*+"'


def _n_values(line: Column) -> Column:
    """Values of a raw line; a null line has null."""
    bare = F.regexp_replace(line, QUOTED, "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the first line of every file that has one, in one job.

    A task that holds a full slice of a large file holds nothing else, so it
    stops at the first rows; only small files that share a task are read on.
    """
    full = _bytes(spark, "spark.sql.files.maxPartitionBytes")

    def run(batches):
        last = None
        for batch in batches:
            files = batch.column(1).to_pylist()
            new = [i for i, f in enumerate(files) if f != (files[i - 1] if i else last)]
            last = files[-1] if files else last
            heads = [i for i in new if batch.column(2)[i].as_py() == 0]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(heads, pa.int64())) for k in (1, 0)], names=["file", "line"])
            if batch.num_rows and batch.column(3)[0].as_py() >= full:
                return

    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_block_length")
    return lines.mapInArrow(run, "file string, line string")


def _bytes(spark: SparkSession, name: str) -> int:
    """A size setting in bytes."""
    text = spark.conf.get(name).strip().lower().removesuffix("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def _names(line: str) -> tuple[str, ...]:
    """Column names of a header line, as Spark's reader gives them: empty names by place, repeated ones with their place."""
    values = next(csv.reader([line]))
    low = [v.lower() for v in values]
    return tuple(f"_c{i}" if not v else f"{v}{i}" if low.count(v.lower()) > 1 else v for i, v in enumerate(values))


def _header_groups(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Header (as read) -> files; the path itself where all files have the same header."""
    try:
        heads = _first_lines(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n")).collect()
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"raw file not found: {path}") from exc
        raise
    if len(heads) == 1:
        return {_names(heads[0]["line"]): [path]}
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in _first_lines(spark, path).collect() if heads else []:  # names and headers of the files only
        groups.setdefault(_names(row["line"]), []).append(row["file"])
    return groups


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(record): the records of CSV files, headers left out, where quoted values may hold newlines.

    Lines are dealt by slice of a file once.  A slice's lines up to its first
    record and its last, open record are parts of records that go on in other
    slices: two rows a slice at most, joined per file.
    """
    slice_of = ["__file", "__at"]
    lines = spark.read.option("lineSep", "\n").text(files).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"))
    quotes = lambda c: F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))
    per_slice, seen = materialize(lines.groupBy(*slice_of).agg(F.sum(quotes(F.col("value"))).alias("__quotes")), "csv-slices", {"n": F.count(F.lit(1))})
    before = Window.partitionBy("__file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    inside = per_slice.select(*slice_of, F.coalesce(F.sum("__quotes").over(before), F.lit(0)).alias("__before"))
    run = Window.partitionBy(*slice_of).orderBy("__id")
    numbered = (
        lines.join(bounded_broadcast(inside, DEFAULT_CONFIG.broadcast_max_rows, int(seen["n"])), slice_of)
        .withColumn("__open", F.col("__before") + F.sum(quotes(F.col("value"))).over(run) - quotes(F.col("value")))
        .withColumn("__no", F.sum(F.when(F.col("__open") % 2 == 0, 1).otherwise(0)).over(run))  # 0: goes on from an earlier slice
    )
    in_order = lambda *cols: F.sort_array(F.collect_list(F.struct(*cols)))
    parts = numbered.groupBy(*slice_of, "__no").agg(in_order("__id", "value").alias("p")).select(
        *slice_of, "__no", F.array_join("p.value", "\n").alias("record"))
    whole = (F.col("__no") > 0) & (quotes(F.col("record")) % 2 == 0)
    begun = Window.partitionBy("__file").orderBy("__at", "__no")
    across = (
        parts.filter(~whole)
        .withColumn("__link", F.sum(F.when(F.col("__no") > 0, 1).otherwise(0)).over(begun))
        .groupBy("__file", "__link").agg(in_order("__at", "__no", "record").alias("p"))
        .select(F.element_at("p.__at", 1).alias("__at"), F.element_at("p.__no", 1).alias("__no"), F.array_join("p.record", "\n").alias("record"))
    )
    found = parts.filter(whole).select("__at", "__no", "record").unionByName(across)
    is_header = (F.col("__at") == 0) & (F.col("__no") == 1)
    record = F.regexp_replace("record", "\r$", "").alias("record")
    return found.filter(~is_header).select(record).filter(F.trim("record") != "")


def scan_csv(spark: SparkSession, path: str, *, multiline: bool = False, keep_short: bool = False) -> DataFrame:
    """All rows of all files as strings, by column name, with ``_rejected_line`` set on rows that do not fit.

    With ``keep_short`` a row with fewer values than its header fits, padded with nulls.
    """
    out = None
    for header, files in sorted(_header_groups(spark, path).items()):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, REJECTED)])
        if multiline:
            ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in schema.names)
            options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED, "quote": '"', "escape": '"', "multiLine": "true"}
            part = records(spark, files).select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
        else:
            part = (
                spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"')
                .option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", REJECTED)
                .option("columnPruning", False)  # else rows would be checked only as far as the query reads
                .schema(schema)
                .csv(files)
            )
        if keep_short:
            part = part.withColumn(REJECTED, F.when(_n_values(F.col(REJECTED)) > len(header), F.col(REJECTED)))
        part = normalise_headers(part)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no file with a header: {path}")
    return out


def _looked(df: DataFrame) -> Column:
    """True; Spark refuses to read a raw CSV for the rejected line alone (e.g. a count), so filters look at a value too."""
    return F.length(F.coalesce(F.col(df.columns[0]), F.lit(""))) >= 0


def rejected(spark: SparkSession, path: str, *, multiline: bool = False, keep_short: bool = False) -> DataFrame:
    """The raw lines that ``load_csv`` leaves out: more (and, without ``keep_short``, fewer) values than their header."""
    df = scan_csv(spark, path, multiline=multiline, keep_short=keep_short)
    keep = [c for c in df.columns if c != REJECTED]
    return df.filter(F.col(REJECTED).isNotNull() & _looked(df)).select(F.col(REJECTED).alias("line"), F.to_json(F.struct(*keep)).alias("as_read"))


def load_csv(
    spark: SparkSession, path: str, cfg: Config = DEFAULT_CONFIG, *, multiline: bool = False, keep_short: bool = False
) -> DataFrame:
    """Read a CSV as strings; missing file -> ``FileNotFoundError``, no rows -> ``ValueError``.

    Rows that do not fit their header are left out (see ``rejected``); with
    ``keep_short`` those with fewer values stay, padded with nulls.
    """
    df = scan_csv(spark, path, multiline=multiline, keep_short=keep_short)
    df = null_tokens(df.filter(F.col(REJECTED).isNull() & _looked(df)).drop(REJECTED), cfg)
    if df.isEmpty():
        raise ValueError(f"file has a header but no rows: {path}")
    return df


def read_source(
    spark: SparkSession,
    path: str,
    source: str,
    cfg: Config = DEFAULT_CONFIG,
    *,
    multiline: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Load one raw source and report which contract columns are missing.

    Missing columns are reported, never raised, and added as null strings so
    the cleaning steps degrade the way the original does (e.g. without a
    check-out column, room nights come from ``nights``).  Rows with fewer
    values than their header are kept the same way; rows with more are left out.
    """
    df = load_csv(spark, path, cfg, multiline=multiline, keep_short=True)
    missing = missing_columns(df, CONTRACTS[source])
    return df.withColumns({c: F.lit(None).cast("string") for c in missing}), missing


def read_all(
    spark: SparkSession,
    paths: dict[str, str],
    cfg: Config = DEFAULT_CONFIG,
    *,
    multiline: bool | Collection[str] = False,
    counted: bool = True,
) -> tuple[dict[str, DataFrame], dict[str, list[str]], dict[str, int]]:
    """Every source in one call: (frames, missing columns, rows set aside); all contract problems reported, none raised.

    ``multiline`` names the sources whose quoted values may hold newlines (True:
    all).  The rows set aside are counted in one more read of each source;
    ``counted=False`` leaves that out and the numbers with it.
    """
    frames, missing, set_aside = {}, {}, {}
    for source, path in paths.items():
        many = multiline if isinstance(multiline, bool) else source in multiline
        frames[source], missing[source] = read_source(spark, path, source, cfg, multiline=many)
        if counted:
            set_aside[source] = rejected(spark, path, multiline=many, keep_short=True).count()
    return frames, missing, set_aside
