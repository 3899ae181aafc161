"""Connected components of links between integer nodes, as Spark jobs.

Each task first runs union-find over the links it holds and passes on a
spanning forest.  Then alternating rounds hook every node onto the smallest
node it can see (large star, small star) until nothing changes; the number of
rounds grows with the logarithm of the component size.  Rounds are written to
the shared checkpoint folder; joins on a hub's rows are plain shuffle joins,
which AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.plans.materialize import materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) of the graph of the given links."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook the larger root under the smaller, then halve all paths
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch["a"].to_numpy()])
        b = np.concatenate([b, batch["b"].to_numpy()])
        if len(a) > 1 << 20:  # memory stays in proportion to the nodes seen
            a, b = forest(a, b)
    if len(a):
        a, b = forest(a, b)
        yield pd.DataFrame({"a": a, "b": b})


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one link only and is nobody's smaller end: then each star is a component."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("p")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("n").agg(F.sum("c").alias("c"), F.max("p").alias("p")).filter("c + p > 1 and c > 0").limit(1).count()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    Links with a null end or to themselves count for nothing; repeated links
    and both directions are fine.  No links: no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter(x.isNotNull() & y.isNotNull() & (x != y))
    edges, _ = materialize(edges.mapInPandas(_local, "a long, b long").distinct(), "links")
    while not _stars(edges):
        # large star: every larger neighbour of a node moves to the node's smallest neighbour (itself included)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low, _ = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links-low")
        large = both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b")
        large, _ = materialize(large.distinct(), "links-large")
        # small star: every smaller neighbour of a node, and the node itself, move to the smallest of them
        low, _ = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "links-low")
        small = large.join(low.hint("merge"), "a").select(F.col("b").alias("u"), "m").union(low.select("a", "m")).filter("u != m")
        edges, _ = materialize(small.distinct().select(F.col("u").alias("a"), F.col("m").alias("b")), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
