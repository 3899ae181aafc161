"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a word budget (its target) and a weight schedule over training
time.  Integrating the schedule gives the source's cumulative word demand;
inverting it at the point where a document's words are consumed gives the
document's training position, and documents are range-sorted by position.

Only narrow rows (id, source, size) move until the final sort.  A source's
consumption order is a prefix sum over range partitions (per-partition totals,
then running sums), so a source with a third of all rows is spread over many
tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import shuffle_parts, word_count
from staylens.plans.materialize import bounded_broadcast, materialize

#: Weight of the sources in code point order, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Weight over training time (time, multiplier), linear between the knots, for the same repeating order:
#: the heaviest sources come early, the lightest late.
SCHEDULES = (
    ((0.0, 1.5), (0.6, 1.0), (1.0, 0.4)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.4), (0.4, 1.0), (1.0, 1.5)),
)
#: Shares of the open rest that a source may take as a plain stretch of its order before it is filled up by size.
STRETCHES = (1.0, 0.5, 0.25, 0.0)
#: A shorter stretch is tried only where the longer ones end further than this share off the target.
TOLERANCE = 0.01
#: Sources up to this many are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def source_targets(
    sizes: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    total_ratio: float = 1.5,
    max_ratio: float = 2.0,
) -> DataFrame:
    """(source, source_size) -> also rank, weight and ``target``.

    The budget ``total_ratio`` x all sizes is shared by weight; a target stops
    at ``max_ratio`` x its source's size and the excess is reshared among the
    rest.  That fixed point is ``min(cap, level * weight)``, with the level
    read off one pass over the sources in order of cap / weight.
    """
    ranked = sizes.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    ).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(max_ratio))
    by_level = Window.orderBy(cap / F.col("weight"), F.col("rank"))
    levels = ranked.withColumn("cap", cap).select(
        "*",
        (
            (
                F.sum("source_size").over(Window.partitionBy()) * F.lit(float(total_ratio))
                - F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            )
            / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
        ).alias("level"),
        F.row_number().over(by_level).alias("at"),
    )
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    level = F.min(F.when(fits, F.struct("at", "level"))).over(Window.partitionBy())["level"]
    return levels.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select(
        "source", "source_size", "rank", "weight", "target"
    )


def invert_schedule(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which ``share`` (0 to 1) of the demand under a piecewise linear schedule is met."""
    areas = [(b - a) * (x + y) / 2 for (a, x), (b, y) in zip(knots, knots[1:], strict=False)]
    total, done, out = sum(areas), 0.0, None
    for ((a, x), (b, y)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        slope = (y - x) / (b - a)
        need = F.greatest(share * total - done, F.lit(0.0))
        # x t + slope t^2 / 2 = need, in the form that stays exact as the slope goes to 0
        root = F.sqrt(F.greatest(F.lit(x * x) + need * (2 * slope), F.lit(0.0)))
        t = F.least(F.lit(a) + F.when(root + x > 0, need * 2 / (root + x)).otherwise(0.0), F.lit(b))
        done += area
        out = F.when(share * total <= done, t) if out is None else out.when(share * total <= done, t)
    return out.otherwise(F.lit(float(knots[-1][0])))


def _fillings(rows: DataFrame, n_sources: int) -> DataFrame:
    """``rows`` with ``__more`` (taken in the last, partial pass) and ``__cut`` (the end of the plain stretch).

    The stretch is the part of the order that ends inside the open rest.  What
    it leaves open is filled from the counts of the untaken documents by size,
    longest first, as many of each size as fit; so no untaken document fits at
    the end, and every size used at least halves what is open.  One more
    document may close the gap from above if that is nearer.  Where a source
    ends more than ``TOLERANCE`` off its target (a long document lies across
    the end of its stretch), shorter stretches leave room for it.
    """
    w = F.col("size") * F.col("n_rows")
    after = [F.col("__end") > F.col("__rest") * f for f in STRETCHES]
    by_size = rows.groupBy("source", w.alias("w")).agg(
        F.first("__rest").alias("rest"), F.first("target").alias("target"),
        F.array(*[F.count_if(x) for x in after]).alias("n"),
        F.array(*[F.coalesce(F.sum(F.when(~x, w)), F.lit(0)) for x in after]).alias("in"),
    ).filter("w > 0")
    by_size, _ = materialize(by_size, "mix-sizes-left")
    sums = [F.sum(F.col("in")[i]) for i in range(len(STRETCHES))]
    sources = by_size.groupBy("source").agg(
        F.first("rest").alias("rest"), F.first("target").alias("target"), F.array(*sums).alias("in"),
        F.sort_array(F.collect_list(F.when(F.col("w") <= 2 * F.col("rest"), F.struct("w", "n"))), asc=False).alias("sizes"),
    )
    none = F.array().cast("array<struct<w:bigint,k:bigint>>")

    def fill(i: int) -> Column:
        def take(acc: Column, x: Column) -> Column:
            k = F.least(x["n"][i], F.floor(acc["open"] / x["w"]).cast("long"))
            more = F.struct(
                (acc["open"] - k * x["w"]).alias("open"),
                F.concat(acc["picks"], F.array(F.struct(x["w"].alias("w"), k.alias("k")))).alias("picks"),
            )
            return F.when(k > 0, more).otherwise(acc)

        start = F.struct((F.col("rest") - F.col("in")[i]).cast("double").alias("open"), none.alias("picks"))
        return F.aggregate("sizes", start, take)

    def nearest_above(i: int) -> Column:
        got = F.col(f"f{i}")

        def closes(x: Column) -> Column:
            used_up = F.exists(got["picks"], lambda p: (p["w"] == x["w"]) & (p["k"] >= x["n"][i]))
            return (x["w"] > got["open"]) & (x["w"] < 2 * got["open"]) & (x["n"][i] > 0) & ~used_up

        return F.array_min(F.transform(F.filter("sizes", closes), lambda x: x["w"]))

    done = sources.withColumns({f"f{i}": fill(i) for i in range(len(STRETCHES))})
    done = done.withColumns({f"c{i}": nearest_above(i) for i in range(len(STRETCHES))})
    options = []
    for i, f in enumerate(STRETCHES):
        got, close = F.col(f"f{i}"), F.col(f"c{i}")
        gap = F.coalesce(close - got["open"], got["open"])
        closed = F.concat(got["picks"], F.when(close.isNotNull(), F.array(F.struct(close.alias("w"), F.lit(1).cast("long").alias("k")))).otherwise(none))
        options.append(F.struct(
            F.when(gap <= F.col("target") * TOLERANCE, 0.0).otherwise(gap).alias("off"), F.lit(i).alias("i"),
            (F.col("rest") * f).alias("cut"), closed.alias("picks"),
        ))
    chosen, _ = materialize(done.select("source", F.array_min(F.array(*options)).alias("o")), "mix-fillings")
    cuts = chosen.select(F.col("source").alias("__t"), F.col("o.cut").alias("__cut"))
    picks, seen = materialize(
        chosen.select("source", F.col("o.cut").alias("__c"), F.explode("o.picks").alias("p"))
        .groupBy("source", "__c", F.col("p.w").alias("__w")).agg(F.sum("p.k").alias("__k")).withColumnRenamed("source", "__s"),
        "mix-picks",
        {"n": F.count(F.lit(1))},
    )
    n_picks = seen["n"] or 0
    # the end of the k-th document of each size picked: first inside range partitions, then over what these leave
    in_part = Window.partitionBy("source", "__w", "__part").orderBy("__end")
    over_all = Window.partitionBy("source", "__w").orderBy("__end")
    ends = (
        rows.join(bounded_broadcast(picks, BROADCAST_SOURCES, n_picks), F.col("source").eqNullSafe(F.col("__s")) & (w == F.col("__w")))
        .filter(F.col("__end") > F.col("__c"))
        .select("source", "__w", "__part", "__end", "__k")
        .withColumn("__r", F.row_number().over(in_part))
        .filter("__r <= __k")
        .withColumn("__r", F.row_number().over(over_all))
        .filter("__r = __k")
        .select(F.col("source").alias("__s"), "__w", F.col("__end").alias("__last"))
    )
    ends, _ = materialize(ends, "mix-ends")
    return (
        rows.join(bounded_broadcast(cuts, BROADCAST_SOURCES, n_sources), F.col("source").eqNullSafe(F.col("__t")), "left")
        .withColumn("__cut", F.coalesce("__cut", "__rest"))
        .join(bounded_broadcast(ends, BROADCAST_SOURCES, n_picks), F.col("source").eqNullSafe(F.col("__s")) & (w == F.col("__w")), "left")
        .withColumn("__more", (F.col("__end") <= F.col("__cut")) | F.coalesce(F.col("__end") <= F.col("__last"), F.lit(False)))
        .drop("__t", "__s", "__w", "__last")
    )


def mix_plan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    total_ratio: float = 1.5,
    max_ratio: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """One row per distinct (id, source, size): how often it is taken, and when.

    Columns: the id, ``source``, ``size`` (words), ``n_rows`` (input rows with
    these values, decided together), ``source_size``, ``target``, ``copies``,
    ``taken`` (words the mix takes of one such row) and ``positions`` (one
    training position in [0, 1] per copy).  A source of ratio 1.3 is read
    through once, then 0.3 of its words again: a stretch of an order hashed
    from the id, then whatever untaken documents fill the open rest (see
    ``_fillings``), until none fits.  No row is taken more than ``ceil(max_ratio)`` times.  Null text:
    size 0.  Null source: a source of its own, ranked last.  Null id: allowed.
    An empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    units = (
        docs.select(F.col(id_col), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
        .groupBy(id_col, "source", "size")
        .agg(F.count("*").alias("n_rows"))
        .withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    )
    units, _ = materialize(units, "mix-sizes")
    order = ["source", "__h", id_col, "size"]
    ranged, _ = materialize(
        units.repartitionByRange(shuffle_parts(spark), *order).withColumn("__part", F.spark_partition_id()),
        "mix-ranges",
    )
    w = F.col("size") * F.col("n_rows")
    slices = ranged.groupBy("source", "__part").agg(F.sum(w).alias("__w"))
    slices, _ = materialize(slices, "mix-slices")  # at most sources + range partitions rows
    targets, seen = materialize(
        source_targets(
            slices.groupBy("source").agg(F.sum("__w").alias("source_size")),
            weights=weights, total_ratio=total_ratio, max_ratio=max_ratio,
        ),
        "mix-targets",
        {"n": F.count(F.lit(1))},
    )
    n_sources = seen["n"] or 0
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        F.col("source").alias("__s"), F.col("__part").alias("__p"),
        F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__off"),
    )
    n_slices = n_sources + shuffle_parts(spark)
    small = bounded_broadcast(offsets, BROADCAST_SOURCES, n_slices)
    per_source = bounded_broadcast(targets.withColumnRenamed("source", "__t"), BROADCAST_SOURCES, n_sources)

    run = Window.partitionBy("source", "__part").orderBy("__h", id_col, "size")
    rows = (
        ranged.withColumn("__run", F.sum(w).over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .join(small, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__part") == F.col("__p")))
        .join(per_source, F.col("source").eqNullSafe(F.col("__t")))
        .withColumn("__end", F.col("__run") + F.col("__off"))
        .withColumn("__full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("__rest", F.col("target") - F.col("__full") * F.col("source_size"))
        .drop("__s", "__p", "__t", "__run", "__off")
    )
    rows, _ = materialize(rows, "mix-order")

    rows = _fillings(rows, n_sources)
    copies = F.col("__full") + F.when(F.col("__more"), 1).otherwise(0)

    # the k-th copy is consumed when the source has delivered k passes plus the words before it; in the last,
    # partial pass the documents after the stretch are spread over what the stretch leaves
    mid = F.col("__end") - w / 2
    left = (F.col("__rest") - F.col("__cut")) / F.greatest(F.col("source_size") - F.col("__cut"), F.lit(1.0))
    last = F.when(mid > F.col("__cut"), F.col("__cut") + (mid - F.col("__cut")) * left).otherwise(mid)
    at = lambda k: F.when(k < F.col("__full"), mid).otherwise(last)
    share = lambda k: F.when(F.col("target") > 0, F.least((k * F.col("source_size") + at(k)) / F.col("target"), F.lit(1.0))).otherwise(0.0)
    def when(u: Column) -> Column:
        out = None
        for i, knots in enumerate(schedules):
            hit, t = F.col("rank") % len(schedules) == i, invert_schedule(u, knots)
            out = F.when(hit, t) if out is None else out.when(hit, t)
        return out

    return (
        rows
        .withColumn("copies", copies)
        .withColumn("taken", F.col("size") * F.col("copies"))
        .withColumn("positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda k: when(share(k)))).otherwise(F.array().cast("array<double>")))
        .select(id_col, "source", "size", "n_rows", "source_size", "target", "copies", "taken", "positions")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row once per copy, range-sorted by training position.

    The columns are those of ``docs``.  Texts move twice: to meet their plan
    row, and into the training order.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    source_col = options.get("source_col", "source")
    plan = mix_plan(docs, **options).filter("copies > 0").select(
        F.col(id_col).alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("positions").alias("__positions")
    )
    return (
        docs.withColumn("__n", word_count(F.col(text_col)))
        .join(
            plan.hint("merge"),
            F.col(id_col).eqNullSafe(F.col("__id"))
            & F.col(source_col).eqNullSafe(F.col("__source"))
            & (F.col("__n") == F.col("__size")),
        )
        .select(*docs.columns, F.explode("__positions").alias("__position"))
        .orderBy("__position", id_col)
        .select(*docs.columns)
    )
