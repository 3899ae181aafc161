"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets.

Only narrow rows (id, digest, size, checksum) move; the texts never do.

1. Size and digest every row (one scan), and write the narrow rows.
2. Range-partition them by (text digest, id): a total order in which equal
   texts are neighbours.  A text that a third of all rows share spans several
   range partitions, since the id is part of the key.
3. Sum each partition (one row per partition), turn the totals into offsets,
   and add each row's running sum inside its partition: a global prefix sum
   without a global window.
4. Row midpoints cut at equal byte targets give contiguous shards.  A group of
   equal texts that lies across a cut moves whole to the shard of its midpoint
   if it is at most ``together`` of a shard's target; larger groups are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import shuffle_parts
from staylens.plans.materialize import materialize

#: Bytes counted for a row besides its text.
ROW_BYTES = 8


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    together: float = 0.02,
) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``shard``, ``slot``.

    ``slot`` numbers the rows of a shard from 0 without gaps in the global
    order (digest of the text, id).  Null text: size 8, checksum of the empty
    text, its own group.  Null ids and repeated rows are rows like others
    (equal rows take neighbouring slots).  An empty table gives no rows; other
    columns, whatever their names, are ignored.  At most ``n_shards - 1``
    groups of equal texts, each larger than ``together`` of a shard's target,
    span two or more shards.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col),
        F.coalesce(F.md5(text), F.lit("")).alias("__h"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"),
    )
    sized, _ = materialize(sized, "shard-sizes")
    order = ["__h", id_col, "size"]
    ranged, _ = materialize(
        sized.repartitionByRange(shuffle_parts(spark), *order).withColumn("__part", F.spark_partition_id()),
        "shard-ranges",
    )

    # one row per range partition: totals -> offsets
    totals = ranged.groupBy("__part").agg(F.sum("size").alias("__b"), F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__part",
        F.coalesce(F.sum("__b").over(before), F.lit(0)).alias("__off"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__row0"),
        F.sum("__b").over(Window.partitionBy()).alias("__total"),
    )
    run = Window.partitionBy("__part").orderBy(*order)
    end = F.col("__off") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0))
    placed = (
        ranged.join(F.broadcast(offsets), "__part")  # bounded: one row per range partition
        .withColumn("__end", end)
        .withColumn("__row", F.col("__row0") + F.row_number().over(run) - 1)
        .withColumn("__shard", _cut(F.col("__end") * 2 - F.col("size"), n_shards))
        .drop("__off", "__row0", "__part")
    )
    placed, _ = materialize(placed, "shard-cuts")

    # groups across a cut: neighbours of the at most n_shards - 1 cuts
    ends = placed.groupBy("__shard").agg(F.min("__h").alias("a"), F.max("__h").alias("b"))
    split = (
        ends.select("__shard", F.explode(F.array_distinct(F.array("a", "b"))).alias("__h"))
        .groupBy("__h")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("__h")
    )
    moved = (
        placed.join(F.broadcast(split), "__h")  # bounded: fewer rows than shards
        .groupBy("__h")
        .agg(
            F.min(F.col("__end") - F.col("size")).alias("a"),
            F.max("__end").alias("b"),
            F.first("__total").alias("__total"),
        )
        .filter((F.col("b") - F.col("a")) * n_shards <= F.col("__total") * together)
        .select("__h", _cut(F.col("a") + F.col("b"), n_shards).alias("__whole"))
    )
    moved, _ = materialize(moved.coalesce(1), "shard-moved")
    cut = placed.join(F.broadcast(moved), "__h", "left").withColumn("shard", F.coalesce("__whole", "__shard"))
    first = cut.groupBy("shard").agg(F.min("__row").alias("__first"))
    return cut.join(F.broadcast(first), "shard").select(  # bounded: one row per shard
        id_col, "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        (F.col("__row") - F.col("__first")).cast("long").alias("slot"),
    )


def _cut(twice_mid, n_shards: int):
    """The shard of a point given as twice its byte offset."""
    return F.least(F.floor(twice_mid * n_shards / (F.col("__total") * 2)), F.lit(n_shards - 1)).cast("int")
