"""Near-duplicate embeddings by a pivot-permutation index.

Every vector is described by its nearest reference points in order.  Pivots
come from a bounded sample by farthest-first traversal; their number grows with
the square root of the vectors, within bounds, so that inverted lists stay
short.  Two vectors are candidates when they have the same label and share at
least ``SHARED`` of their nearest pivots.

Inverted lists hold ids and pivots only.  A list is a block of numpy work:
shared-pivot counts of all its members come from matrix products, and no pair
becomes a row.  Only members with a candidate in the block fetch their vectors,
in the precision they came in, and cosines in double precision verify the
candidates.  A pair that shares several lists counts only in the list of its
smallest common pivots.

A vector is posted to the lists of single pivots.  A list longer than a block is
cut by its members' next pivots, and again by the ones after those; the pairs
that meet stay the same.  What is still longer is cut into chunks, and each pair
of chunks is a block of its own, so that no task holds more than two chunks and
no partner is lost.  Equal vectors collapse into one class before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from staylens.llm.components import components, forest
from staylens.plans.materialize import bounded_broadcast, materialize

#: Rows of the sample that pivots are chosen from (at most), pivots at 10,000 vectors, their bounds, and pivots kept per vector.
SAMPLE, PIVOTS, MIN_PIVOTS, MAX_PIVOTS, NEAREST = 4096, 128, 32, 1024, 10
#: Nearest pivots that candidates share (at least).
SHARED = 4
#: Members of a block, and of a chunk of a list that no pivot cuts any further.
BLOCK, CHUNK = 1024, 512
#: Long lists that are broadcast at most.
BROADCAST_ROWS = 500_000
#: What names a block: the label, up to three pivots (-1: none) and the two chunks.
KEY = ["group", "p", "q", "r", "i", "j"]
#: Vectors without an id get one above this, from their content.
NO_ID = 1 << 62


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Vectors of length one, scaled first so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal by cosine."""
    far, picked = np.full(len(sample), np.inf), [0]
    while len(picked) < min(n, len(sample)):
        far = np.minimum(far, 1 - sample @ sample[picked[-1]])
        nxt = int(far.argmax())
        if far[nxt] <= 1e-12:
            break
        picked.append(nxt)
    return sample[picked]


def fit(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Pivots by dimension, from a bounded sample chosen by a hash of the id."""
    share = min(1.0, 2.0 * SAMPLE / max(1, n))  # few more rows than wanted reach the driver, whatever the number of tasks
    hashed = classes.select("vec", F.pmod(F.xxhash64("rep"), F.lit(1 << 20)).alias("h")).filter(F.col("h") < share * (1 << 20))
    rows = hashed.orderBy("h").limit(SAMPLE).collect()
    want = int(min(MAX_PIVOTS, max(MIN_PIVOTS, PIVOTS * math.sqrt(n / 10_000))))
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r["vec"]), []).append(r["vec"])
    return {d: choose_pivots(unit_rows(np.array(x, dtype=np.float64)), want) for d, x in by_dim.items()}


def nearest(units: np.ndarray, pivots: np.ndarray | None, k: int, least: int = SHARED) -> np.ndarray:
    """The k nearest pivots of each vector, nearest first.  With too few pivots all vectors get the same list."""
    n = 0 if pivots is None else len(pivots)
    if n <= k:
        return np.tile(np.arange(max(n, least)), (len(units), 1))
    near = units @ pivots.T
    some = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1)


def describe(classes: DataFrame, pivots: dict[int, np.ndarray], k: int, shared: int) -> DataFrame:
    """rep, group (label and dimension) and the nearest ``pivots`` in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(2).cast(pa.list_(pa.float64()))
            size = np.diff(vecs.offsets.to_numpy())
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                take = pa.array(at)
                units = unit_rows(vecs.take(take).flatten().to_numpy().reshape(len(at), d))
                near = nearest(units, pivots.get(int(d)), k, shared).astype(np.int16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), lists], names=["rep", "group", "pivots"])

    return classes.select("rep", F.xxhash64("label", F.size("vec")).alias("group"), "vec").mapInArrow(run, "rep long, group long, pivots array<smallint>")


def _postings(described: DataFrame, shared: int) -> DataFrame:
    """The members of all blocks: the block's key, ``chunk``, rep and pivots."""
    rows = described.select("group", "rep", F.array_sort("pivots").alias("pivots"), F.lit(0).alias("at"))
    none, blocks, key = F.lit(-1).cast("smallint"), [], ["group"]
    for depth, name in enumerate("pqr", 1):
        # enough pivots must follow for a pair to share as many as it needs
        rows = rows.withColumn("at", F.explode(F.sequence(F.col("at") + 1, F.size("pivots") - shared + depth)))
        rows = rows.withColumn(name, F.element_at("pivots", F.col("at")))
        key.append(name)
        long, seen = materialize(
            rows.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > BLOCK), "pivot-long", {"rows": F.count(F.lit(1))})
        met = rows.join(bounded_broadcast(long, BROADCAST_ROWS, int(seen["rows"])), key, "left") if seen["rows"] else rows.withColumn("members", F.lit(None).cast("long"))
        rows = met.filter("members is not null")
        blocks.append(met.filter("members is null").select(
            *key, *(none.alias(x) for x in "pqr"[depth:]), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("chunk"), "rep", "pivots"))
        if not seen["rows"]:
            break
        if depth < 3:
            rows = rows.drop("members")
            continue
        chunks = F.ceil(F.col("members") / CHUNK).cast("int")
        cut = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        blocks.append(cut.select(*key, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", "pivots"))
    found = blocks[0]
    for more in blocks[1:]:
        found = found.unionByName(more)
    return found


def meeting(prefix: np.ndarray, side: np.ndarray | None, pivots: np.ndarray, shared: int) -> np.ndarray:
    """The candidates of a block as a matrix: enough pivots shared, and the block's own (``prefix``) the smallest of them.

    ``side`` tells the chunks of a block of two chunks apart (else None): inside
    a chunk only the block of that chunk alone counts.
    """
    names, at = np.unique(pivots, return_inverse=True)
    has = np.zeros((len(pivots), len(names)), dtype=np.float32)
    has[np.arange(len(pivots))[:, None], at.reshape(pivots.shape)] = 1
    low = has[:, names <= prefix.max()]
    pairs = (has @ has.T >= shared) & (low @ low.T == np.count_nonzero(prefix >= 0))
    if side is not None:
        pairs &= side[:, None] != side[None, :]
    np.fill_diagonal(pairs, False)
    return pairs


def _by_block(work: Callable[[pa.Table, list[tuple[int, int]]], pa.RecordBatch | pa.Table]):
    """Rows sorted by ``KEY``, handed to ``work`` in whole blocks (with their bounds)."""

    def keys(t: pa.Table) -> np.ndarray:
        return np.stack([t.column(c).to_numpy().astype(np.int64) for c in KEY])

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key = keys(t)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])), t.num_rows).tolist()
        found = work(t, [(x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y - x > 1])
        yield from found.to_batches() if isinstance(found, pa.Table) else [found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            key = keys(held)
            whole = int(np.argmax((key == key[:, -1:]).all(axis=0)))  # the last block may go on
            if whole:
                yield from done(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield from done(held)

    return run


def _rows(column: pa.Array, x: int, y: int) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.slice(x, y - x).flatten().to_numpy().reshape(y - x, -1)


def _candidates(shared: int):
    """Members of blocks that have a candidate there."""

    def work(t: pa.Table, blocks: list[tuple[int, int]]) -> pa.Table:
        col = {c: t.column(c).combine_chunks() for c in t.column_names}
        prefix = np.stack([col[c].to_numpy() for c in "pqr"], axis=1)
        i, j, chunk = (col[c].to_numpy() for c in ("i", "j", "chunk"))
        some = np.zeros(t.num_rows, bool)
        for x, y in blocks:
            side = chunk[x:y] != i[x] if i[x] != j[x] else None
            some[x:y] = meeting(prefix[x], side, _rows(col["pivots"], x, y), shared).any(axis=1)
        return t.filter(pa.array(some))

    return _by_block(work)


def _links(cosine: float, shared: int):
    """(a, -1, w): rows that class a links with in a block; (a, b, 0): links that keep a block's classes together."""

    def work(t: pa.Table, blocks: list[tuple[int, int]]) -> pa.RecordBatch:
        col = {c: t.column(c).combine_chunks() for c in t.column_names}
        prefix = np.stack([col[c].to_numpy() for c in "pqr"], axis=1)
        rep, n, i, j, chunk = (col[c].to_numpy() for c in ("rep", "n", "i", "j", "chunk"))
        a, b, w = [], [], []
        for x, y in blocks:
            side = chunk[x:y] != i[x] if i[x] != j[x] else None
            units = unit_rows(_rows(col["vec"], x, y).astype(np.float64))
            links = meeting(prefix[x], side, _rows(col["pivots"], x, y), shared) & (units @ units.T >= cosine)
            one, two = np.nonzero(np.triu(links))
            if not len(one):
                continue
            some = np.flatnonzero(links.any(axis=1))
            child, parent = forest(rep[x:y][one], rep[x:y][two])
            a += [rep[x:y][some], child]
            b += [np.full(len(some), -1), parent]
            w += [links[some] @ n[x:y], np.zeros(len(child), np.int64)]
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, none]).astype(np.int64)) for x in (a, b, w)], names=["a", "b", "w"])

    return _by_block(work)


def near_embeddings(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    nearest_pivots: int = NEAREST,
    shared_pivots: int = SHARED,
) -> DataFrame:
    """One row per vector: ``id``, ``n_links``, ``component`` and ``kept``.

    Vectors of equal, non-null label and dimension link at a cosine (in double
    precision) of at least ``cosine``.  A vector that is null, empty or zero,
    or holds null or non-finite components, or has no label, links with
    nothing: its component is its own id.  ``n_links`` counts rows, so rows
    repeated whole link with each other.  A null id ranks after all ids and
    shows as null.  An empty table gives no rows; other columns are ignored.
    Lists are cut by up to three pivots, so ``shared_pivots`` is three or more.
    """
    if not 3 <= shared_pivots <= nearest_pivots:
        raise ValueError("shared_pivots lies between 3 and nearest_pivots")
    kind = vectors.schema[vec_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    vec = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    valid = F.coalesce(F.col(label_col).isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(vec_col, label_col), F.lit(NO_ID)))
    base = vectors.select(
        F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(label_col).cast("string").alias("label"), valid.alias("valid"), vec.alias("vec")
    ).withColumns({"d1": F.xxhash64("vec"), "d2": F.xxhash64(F.lit(7), "vec", F.size("vec"))})
    classes, seen = materialize(
        base.filter("valid").groupBy("label", "d1", "d2").agg(F.min("key").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")),
        "pivot-classes", {"rows": F.count(F.lit(1))},
    )
    described, _ = materialize(describe(classes, fit(classes, seen["rows"] or 0), nearest_pivots, shared_pivots), "pivot-lists")
    posted = _postings(described, shared_pivots)
    met = posted.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_candidates(shared_pivots), posted.schema)
    blocks = met.join(classes.select("rep", "n", "vec").hint("merge"), "rep").repartition(*KEY).sortWithinPartitions(*KEY)
    found, _ = materialize(blocks.mapInArrow(_links(cosine, shared_pivots), "a long, b long, w long"), "pivot-links")
    links = found.filter("b < 0").groupBy("a").agg(F.sum("w").alias("links"))
    comp = components(found.filter("b >= 0 and w = 0").select("a", "b"))
    named = (
        classes.select("label", "d1", "d2", "rep", "n")
        .join(links.select(F.col("a").alias("rep"), "links").hint("merge"), "rep", "left")
        .join(comp.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left")
        .select("label", "d1", "d2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    named, _ = materialize(named, "pivot-classes-linked")
    joined = base.drop("vec").join(named.withColumn("valid", F.lit(True)).hint("merge"), ["valid", "label", "d1", "d2"], "left")
    component = F.coalesce("component", "key")
    return joined.select(
        "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(component < NO_ID, component).alias("component"), (F.col("key") == component).alias("kept"),
    )
