"""Session settings.

``local_session`` is for tests and the benchmark.  ``CLUSTER_SETTINGS`` are
the settings this library is written against at scale; they are applied by
whoever builds the cluster session (e.g. ``spark-submit --conf``).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings for a large cluster run (100 TB class input).
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    # Sized for the largest shuffle, the booking key dedup: keys are unique, so
    # the partial aggregate barely shrinks it, and tens of TB of bookings go
    # through it.  AQE can merge small partitions but never splits a large
    # one (outside skew handling), so start high: 50 TB / 100k ≈ 512 MB per
    # partition, coalesced toward the advisory size on the smaller stages.
    "spark.sql.shuffle.partitions": "100000",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.files.maxPartitionBytes": "512m",
    # The library's own broadcasts are row-count-checked and the joins it does
    # not broadcast carry a merge hint.  The static threshold (a file-size
    # estimate) stays modest for un-hinted joins; AQE's runtime threshold
    # works on exact shuffle sizes.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "staylens") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
