"""Near-duplicate documents by SuperMinHash.

A document's set holds the hashes of its word shingles.  SuperMinHash gives
each element one permutation of the signature's places and a rank per step;
place ``p`` keeps the least ``step + rank``.  Later steps cannot change a
signature whose places are all below them, so work stops early: a long
document needs one or two steps.  The ranks of an element are correlated
through its permutation, which lowers the variance against independent hashes.

1. Equal sets form a class (partial aggregation, so thousands of copies cost
   one row per map task); only class representatives go on.
2. Bands of the signature are buckets.  In each bucket every member is paired
   with one hub, which differs from bucket to bucket; pairs are made distinct
   over the buckets.  Pairs whose signatures rule the similarity out (more than
   4.5 standard deviations below it) stop here; the others are verified on the
   full sets, exactly, from the texts.  Links form components.
3. A bucket whose members lie in different components is settled as a block of
   matrix work: signatures select the members that may link across components,
   and the exact intersections of their sets come from one product.  Buckets
   larger than a block are cut into chunks, and each pair of chunks is a block.
   No pair becomes a row, no bucket is capped, and no pair of a bucket between
   components stays untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm import flat
from staylens.llm.components import components, forest
from staylens.plans.materialize import materialize

#: Signature: bands x rows places.  A pair of similarity 0.85 shares no band with probability 8e-7, one of 0.8 with 1e-4.
BANDS, ROWS = 24, 5
#: Documents without an id get one above this, from their text.
NO_ID = 1 << 62
#: Members and shingles of a chunk of a bucket (about).
CHUNK_ROWS, CHUNK_SHINGLES = 2048, 300_000
#: How far below the similarity the share of equal signature places may lie.
SLACK = 0.15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingle hashes of each text, sorted, one text after another.

    Words are runs of anything but ASCII white space, with A-Z in lower case.
    A text with fewer words than ``width`` has its whole sequence as one shingle.
    """
    raw, at = flat.spaced(texts)
    raw = LOWER[raw]
    starts, ends = flat.runs(~flat.SPACE_TABLE[raw])
    h = flat.span_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    first = np.searchsorted(starts, at)
    n = np.diff(first)
    # hash of the shingle that starts at each word; those that would leave their text are dropped
    grams = h.copy()
    for k in range(1, width):
        stop = max(0, len(h) - k)  # a piece can hold fewer words than a shingle
        grams[:stop] = flat.mix(grams[:stop] * np.uint64(0x9FB21C651E98DF25) + h[k:])
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    short = np.flatnonzero((n > 0) & (n < width))
    for i in short:
        x = h[first[i] : first[i] + 1].copy()
        for k in range(1, n[i]):
            x = flat.mix(x * np.uint64(0x9FB21C651E98DF25) + h[first[i] + k])
        grams[first[i]] = flat.mix(x + np.uint64(int(n[i])))[0]
    keep = np.arange(len(h)) - np.repeat(first[:-1], n) < np.repeat(count, n)
    grams = grams[keep]
    ends = np.cumsum(count)
    for a, b in zip(ends - count, ends, strict=True):
        grams[a:b].sort()
    new = np.ones(len(grams), dtype=bool)
    new[1:] = grams[1:] != grams[:-1]
    new[(ends - count)[count > 0]] = True
    sums = np.concatenate([[0], np.cumsum(new)])
    return grams[new], np.concatenate([[0], sums[ends]])


def signatures(sets: np.ndarray, bounds: np.ndarray, places: int) -> np.ndarray:
    """SuperMinHash: (texts, places) of step << 32 | rank; texts without an element keep the top value."""
    docs = len(bounds) - 1
    out = np.full(docs * places, np.iinfo(np.int64).max, dtype=np.int64)
    owner = np.repeat(np.arange(docs), np.diff(bounds))
    seeds, perm = sets, None
    for step in range(places):
        x = flat.mix(seeds + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        rank = (x & np.uint64(0xFFFFFFFF)).astype(np.int64) | (step << 32)
        pick = step + ((x >> np.uint64(32)) * np.uint64(places - step) >> np.uint64(32)).astype(np.int64)
        if step:
            rows = np.arange(len(perm))
            place = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, step]  # Fisher-Yates: the place drawn leaves the rest of the permutation
        else:
            place = pick
        np.minimum.at(out, owner * places + place, rank)
        # a text whose places are all filled below the next step is done
        open_ = out.reshape(docs, places).max(axis=1) >= (step + 1) << 32
        open_ &= np.diff(bounds) > 0
        go = open_[owner]
        if not go.any():
            break
        if step == 0:
            seeds, owner = seeds[go], owner[go]
            perm = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(seeds), 1))
            perm[np.arange(len(seeds)), pick[go]] = 0
        elif not go.all():
            seeds, owner, perm = seeds[go], owner[go], perm[go]
    return out.reshape(docs, places)


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    """(texts, bands) bucket keys."""
    parts = sig.astype(np.uint64).reshape(len(sig), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        key = flat.mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, k])
    return key.astype(np.int64)


def sketch(docs: DataFrame, *, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, two digests of the set, and the bucket keys (null for an empty set)."""
    schema = "id long, key long, n_shingles long, d1 long, d2 long, buckets array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = flat.strings(batch.column(2))
            for a, b in flat.pieces(texts):
                sets, bounds = shingle_sets(texts.slice(a, b - a), width)
                n = np.diff(bounds)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (flat.mix(sets), flat.mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
                d1, d2 = ((s[bounds[1:]] - s[bounds[:-1]]).astype(np.int64) for s in sums)
                keys = band_hashes(signatures(sets, bounds, bands * rows), bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(d1), pa.array(d2), lists],
                    names=["id", "key", "n_shingles", "d1", "d2", "buckets"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), node_key(id_col, text_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def node_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The id as a node; without an id, a value above all ids from the text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text_col), F.lit(NO_ID))).alias("key")


def with_signatures(texts: DataFrame, width: int, places: int) -> DataFrame:
    """(key, text) with the set's size and 16 bits of each signature place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = flat.strings(batch.column(1))
            for a, b in flat.pieces(col):
                sets, bounds = shingle_sets(col.slice(a, b - a), width)
                sig = flat.mix(signatures(sets, bounds, places).astype(np.uint64)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(bounds)), pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["key", "text", "size", "sig"],
                )

    return texts.select("key", "text").mapInArrow(run, "key long, text string, size long, sig binary")


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, sig_a, sig_b), the (a, b) that the signatures do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mask = pa.array((_sigs(batch.column(2)) == _sigs(batch.column(3))).mean(axis=1) >= percent / 100 - SLACK)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in range(2)], names=["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, text_a, b, text_b), the (a, b) whose sets have 100 x intersection >= percent x union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            ta, tb = flat.strings(ta), flat.strings(tb)
            ok = np.zeros(batch.num_rows, dtype=bool)
            for i, j in flat.pieces(tb, flat.PIECE_BYTES // 2):
                sa, ba = shingle_sets(ta.slice(i, j - i), width)
                sb, bb = shingle_sets(tb.slice(i, j - i), width)
                for k in range(j - i):
                    x, y = sa[ba[k] : ba[k + 1]], sb[bb[k] : bb[k + 1]]
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i + k] = same and 100 * same >= percent * (len(x) + len(y) - same)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def intersections(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets with each other, from products over the elements that several hold."""
    n = len(bounds) - 1
    out = np.zeros((n, n), dtype=np.float32)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    _, element, count = np.unique(sets, return_inverse=True, return_counts=True)
    several = count > 1
    column = np.cumsum(several) - 1
    keep = several[element]
    rows, cols = owner[keep], column[element[keep]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for first in range(0, int(several.sum()), 4096):
        a, b = np.searchsorted(cols, (first, first + 4096))
        part = np.zeros((n, 4096), dtype=np.float32)
        part[rows[a:b], cols[a:b] - first] = 1
        out += part @ part.T
    return out


def _runs(work, names: tuple[str, ...]):
    """A mapInArrow function that calls ``work`` on whole blocks: runs of rows with equal (bucket, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def keys(t: pa.Table) -> np.ndarray:
            return np.stack([t.column(c).to_numpy() for c in ("bucket", "i", "j")])

        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = keys(t)
            cuts = np.append(np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])), t.num_rows)
            t = t.combine_chunks()
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                got = work(t.slice(x, y - x)) if y - x > 1 else None
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in got], names=list(names))

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            key = keys(held)
            done = int(np.argmax((key == key[:, -1:]).all(axis=0)))  # the last block may go on
            if done:
                yield from emit(held.slice(0, done))
                held = held.slice(done)
        if held is not None:
            yield from emit(held)

    return run


def _apart(t: pa.Table) -> np.ndarray:
    """Pairs of a block between components; in a block of two chunks only those between the chunks."""
    comp, chunk = t.column("comp").to_numpy(), t.column("chunk").to_numpy()
    out = comp[:, None] != comp[None, :]
    if t.column("i")[0].as_py() != t.column("j")[0].as_py():
        out &= chunk[:, None] != chunk[None, :]
    return out


def block_survivors(percent: int):
    """The rows of a block that may link across components by their signatures."""

    def work(t: pa.Table):
        apart = _apart(t)
        if not apart.any():
            return None
        sig = _sigs(t.column("sig").combine_chunks())
        need = (percent / 100 - SLACK) * sig.shape[1]
        same = np.zeros(apart.shape, dtype=np.int16)
        for k in range(sig.shape[1]):
            same += sig[:, None, k] == sig[None, :, k]
        some = np.flatnonzero(((same >= need) & apart).any(axis=1))
        return [t.column(c).to_numpy()[some] for c in ("bucket", "i", "j", "chunk", "key", "comp")] if len(some) else None

    return _runs(work, ("bucket", "i", "j", "chunk", "key", "comp"))


def block_links(width: int, percent: int):
    """Links between components inside a block, as a spanning forest, verified on the full sets."""

    def work(t: pa.Table):
        apart = _apart(t)
        if not apart.any():
            return None
        sets, bounds = shingle_sets(flat.strings(t.column("text").combine_chunks()), width)
        n = np.diff(bounds)
        same = intersections(sets, bounds)
        x, y = np.nonzero(np.triu(apart & (100 * same >= percent * (n[:, None] + n[None, :] - same))))
        if not len(x):
            return None
        key = t.column("key").to_numpy()
        return forest(key[x], key[y])

    return _runs(work, ("a", "b"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: ``id``, ``key``, ``n_shingles``, ``component`` and ``kept``.

    ``key`` is the id, or for rows without one a value made from the text (``node_key``).

    Documents are linked when ``100 * intersection >= percent * union`` of
    their shingle sets; ``component`` is the smallest id reachable and
    ``kept`` says that it is the row's own.  Null, empty and wordless texts
    have the empty set and link with nothing (component: own id).  A null id
    takes part and ranks after all ids; its component is null where no row of
    the component has an id, and of those one text is kept.  Repeated rows share a component.  An empty table gives
    no rows; other columns are ignored.
    """
    marked, _ = materialize(sketch(docs, id_col=id_col, text_col=text_col, width=width, bands=bands, rows=rows), "minhash-sketch")
    some = marked.filter("n_shingles > 0")
    classes, _ = materialize(
        some.groupBy("d1", "d2", "n_shingles").agg(F.min("key").alias("rep"), F.first("buckets").alias("buckets")), "minhash-classes"
    )
    members = classes.select(F.posexplode("buckets").alias("band", "bucket"), "rep")
    shared = members.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    # every member of a bucket with company; a hot bucket's rows are split by AQE
    crowded, _ = materialize(members.join(shared.hint("merge"), ["band", "bucket"]).select(F.xxhash64("band", "bucket").alias("bucket"), "rep"), "minhash-buckets")

    ids, n_ids = materialize(crowded.select("rep").distinct(), "minhash-ids", {"n": F.count(F.lit(1))})
    texts = (
        docs.select(node_key(id_col, text_col), F.col(text_col).alias("text"))
        .join(ids.withColumnRenamed("rep", "key").hint("merge"), "key")
        .groupBy("key").agg(F.first("text").alias("text"))
    )
    texts, _ = materialize(with_signatures(texts, width, bands * rows), "minhash-texts")

    comp = None
    if n_ids["n"]:
        at = F.struct(F.xxhash64("rep", "bucket").alias("h"), F.col("rep").alias("a"))
        hubs, _ = materialize(crowded.groupBy("bucket").agg(F.min(at)["a"].alias("a")), "minhash-hubs")
        pairs = crowded.join(hubs.hint("merge"), "bucket").filter("rep != a").select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b"))
        pairs, _ = materialize(pairs.distinct(), "minhash-pairs")
        pairs, _ = materialize(likely(_with(pairs, texts, "sig"), percent), "minhash-likely")
        links, _ = materialize(verify(_with(pairs, texts, "text"), width, percent), "minhash-links")
        comp, _ = materialize(components(links), "minhash-components")
        found, new = materialize(_across(crowded, comp, texts, width, percent), "minhash-across", {"n": F.count(F.lit(1))})
        if new["n"]:
            comp, _ = materialize(components(links.union(found)), "minhash-components")

    if comp is None:
        comp = classes.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)
    reps = classes.join(comp.hint("merge"), F.col("rep") == F.col("node"), "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    placed = some.join(reps.hint("merge"), ["d1", "d2", "n_shingles"]).select("id", "key", "n_shingles", "component")
    empty = marked.filter("n_shingles = 0").select("id", "key", "n_shingles", F.col("key").alias("component"))
    return placed.unionByName(empty).select(
        "id", "key", "n_shingles", F.when(F.col("component") < NO_ID, F.col("component")).alias("component"),
        F.coalesce(F.col("key") == F.col("component"), F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id; rows repeated whole stay once."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("kept").select(F.col("key").alias("__key")).distinct()
    return (
        docs.withColumns({"__key": node_key(id_col, text_col), "__th": F.xxhash64(text_col)})
        .join(found.hint("merge"), "__key", "left_semi")
        .dropDuplicates(["__key", "__th"])
        .select(*docs.columns)
    )


def _with(pairs: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """Pairs with a column of both sides; the rows of a hub are split by AQE."""
    b = texts.select(F.col("key").alias("b"), F.col(column).alias(f"{column}_b"))
    a = texts.select(F.col("key").alias("a"), F.col(column).alias(f"{column}_a"))
    one, _ = materialize(pairs.join(b.hint("merge"), "b"), "minhash-side")
    return one.join(a.hint("merge"), "a")


def _across(crowded: DataFrame, comp: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components inside buckets."""
    sizes = texts.select(F.col("key").alias("rep"), "size")
    named = (
        crowded.join(comp.hint("merge"), F.col("rep") == F.col("node"), "left")
        .join(sizes.hint("merge"), "rep")
        .select("bucket", F.col("rep").alias("key"), "size", F.coalesce("component", "rep").alias("comp"))
    )
    named, _ = materialize(named, "minhash-named")
    open_ = (
        named.groupBy("bucket")
        .agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n"), F.sum("size").alias("s"))
        .filter("x != y and n > 2")  # of two members, the hub has tested the other
        .select("bucket", F.greatest(F.ceil(F.col("n") / CHUNK_ROWS), F.ceil(F.col("s") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    )
    open_, _ = materialize(open_, "minhash-open")
    block = ["bucket", "i", "j"]
    rows = (
        named.join(open_.hint("merge"), "bucket")
        .withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "key", "comp")
    )
    rows, _ = materialize(rows, "minhash-blocks")
    whole = lambda df, column: df.join(texts.select("key", column).hint("merge"), "key").repartition(*block).sortWithinPartitions(*block)
    some = whole(rows, "sig").mapInArrow(block_survivors(percent), "bucket long, i int, j int, chunk int, key long, comp long")
    some, _ = materialize(some, "minhash-survivors")
    return whole(some, "text").mapInArrow(block_links(width, percent), "a long, b long")
