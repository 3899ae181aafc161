"""Cutting lineage by writing to the shared checkpoint folder.

Materialised frames are written as Parquet under the folder the cluster names
in ``spark.checkpoint.dir`` and read back, so a lost executor re-reads files
instead of recomputing the dedup shuffles.  Row counts and bounds needed for
size-checked broadcasts are gathered with an ``Observation`` during the same
write (no extra pass).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    Uses ``spark.checkpoint.dir`` / the context's checkpoint dir when set.
    Only a local-mode session (tests) with nothing configured gets a fresh
    temporary folder; a cluster session without one is an error, since a
    machine-local folder is not visible to other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no context; use the configured folder as is
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3)") from None
        return f"{configured.rstrip('/')}/{spark.conf.get('spark.app.id', 'app')}"
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3)")
        configured = tempfile.mkdtemp(prefix="staylens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the checkpoint root."""
    return f"{checkpoint_root(spark).rstrip('/')}/staylens/{name}-{uuid.uuid4().hex[:12]}"


def materialize(
    df: DataFrame,
    name: str,
    metrics: dict[str, Column] | None = None,
    *,
    sort_within: list[str] | None = None,
    partition_by: list[str] | None = None,
    bucket_by: str | None = None,
) -> tuple[DataFrame, dict]:
    """Write ``df`` to the checkpoint folder and read it back.

    ``metrics`` are aggregate expressions evaluated during the write and
    returned as a dict.  ``sort_within`` sorts each output file (not a global
    sort) so Parquet min/max statistics prune row groups on that column.

    ``bucket_by`` writes as many buckets of a column as the session has shuffle
    partitions.  A frame that comes from an exchange on that column holds whole
    buckets in each task, so every bucket is one file; joins and aggregates of
    frames written that way need no exchange on the column.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    obs = Observation(f"{name}_{uuid.uuid4().hex[:8]}") if metrics else None
    out = df.observe(obs, *[c.alias(k) for k, c in metrics.items()]) if obs else df
    if sort_within or partition_by:
        out = out.sortWithinPartitions(*(partition_by or []), *(sort_within or []))
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
        table = f"staylens_{uuid.uuid4().hex}"
        writer.format("parquet").option("path", path).bucketBy(buckets, bucket_by).sortBy(bucket_by).saveAsTable(table)
        back = spark.table(table)  # resolved to the files and their buckets
        spark.sql(f"DROP TABLE {table}")  # an external table: the files stay
        return back, (obs.get if obs else {})
    writer.parquet(path)
    if partition_by:  # partition columns come back from the directory names
        back = spark.read.parquet(path)
        return back.select(*df.columns), (obs.get if obs else {})
    # the schema is known: passing it skips the footer-reading inference job
    return spark.read.schema(df.schema).parquet(path), (obs.get if obs else {})


def bounded_broadcast(df: DataFrame, max_rows: int, known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only under a proven row bound; otherwise forbid it.

    ``known_rows`` is an exact count or an upper bound already in hand (e.g.
    observed while the frame was written).  Without one, the frame is
    counted — for a plain Parquet scan that reads footers only.  Above the
    bound the frame gets a ``merge`` hint, so the static planner cannot
    broadcast it on a file-size estimate (compressed size understates memory).
    """
    n = df.count() if known_rows is None else known_rows
    return F.broadcast(df) if n <= max_rows else df.hint("merge")
