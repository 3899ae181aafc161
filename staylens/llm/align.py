"""Aligning two tokenizers' tokens of one text, and how often pairs of their ids meet in a corpus.

Both token sequences tile the same bytes, so each is a rising list of ends.
Merging the two lists walks through all overlaps of A and B tokens; where both
end at one byte, a group closes.  The merge is cut by merge-path partitioning:

* the lists of a whole batch of texts lie one after another in one byte space;
* on every P-th diagonal of the grid (A ends x B ends) a binary search finds the
  point that the merge passes, for all diagonals at once;
* between two diagonals lie P steps, whatever the texts' lengths; all pieces
  walk side by side, and each step gives one overlap or consumes a shared end;
* groups that reach over the bounds of pieces are stitched by running sums of
  the shared ends of the pieces before.

Corpus counts are sums over distinct pairs of each text, pre-aggregated where
they arise.  They come back to the texts by joins on the pair: pairs that many
texts hold are few, by their count, and are broadcast; the rest cannot be hot.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm import bytebpe, flat
from staylens.plans.materialize import bounded_broadcast, materialize

#: Steps of a piece of the merge.
STEPS = 256
#: Bytes of text that are aligned at once.
BATCH_BYTES = 1 << 21
#: Rows of pair counts that are broadcast at most.
BROADCAST_PAIRS = 2_000_000
SPACE = "▁"


@dataclass
class Pieces:
    """A piece model, as bytes, and the bytes of its tokens.

    ``units``: no piece of the vocabulary goes on with a space after something else, so no merge does; a text may be cut
    before each run of spaces and its parts encoded one by one.
    """

    model: bytes
    sizes: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.units = SPACE in pieces and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        tokens = [token_bytes(p) for p in pieces]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.kept = bytebpe.Kept()

    def __reduce__(self):
        return Pieces, (self.model,)

    def make(self, parts: list[bytes]) -> list[bytes]:
        """Packed ids of parts that start with a space (the model adds it again, but not to an empty text)."""
        found = self.processor.encode([p[1:].decode() for p in parts], num_threads=1)
        if self.units:
            space = [self.processor.piece_to_id(SPACE)]
            found = [ids if len(p) > 1 else space for ids, p in zip(found, parts, strict=True)]
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in found]

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of texts laid out by ``flat.spaced``: each with a space before it."""
        begin, end = at[:-1] - 1, at[1:] - 1
        cut = np.zeros(len(raw), bool)
        if self.units:
            space = raw == 32
            cut[1:] = space[1:] & ~space[:-1]
        cut[begin] = True
        starts = np.flatnonzero(cut[: end[-1]]) if len(end) else begin
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, end[-1:])), pa.py_buffer(raw)])
        ids, bounds = bytebpe.spread(column, self.kept, self.make)
        return ids.astype(np.int64), bounds[np.searchsorted(starts, np.append(begin, end[-1:]))]


def token_bytes(piece: str) -> bytes:
    """A piece's bytes: the space mark as a space, <0xHH> as that byte."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE, " ").encode()


def load_pieces(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


def diagonal(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many of the first ``d`` steps of the merge of two rising lists take from ``a`` (first where both are equal)."""
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        taken = np.zeros(len(d), bool)
        taken[open_] = a[mid[open_]] <= b[d[open_] - 1 - mid[open_]]
        low = np.where(open_ & taken, mid + 1, low)
        high = np.where(open_ & ~taken, mid, high)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, group) of all overlapping tokens of two tilings of the same bytes, given their ends (rising, no empty token).

    In order of their bytes; ``group`` counts the shared ends before.
    """
    total = len(a) + len(b)
    d = np.arange(0, total, steps)
    i = diagonal(a, b, d)
    j = d - i
    end_a, end_b = np.append(a, np.iinfo(np.int64).max), np.append(b, np.iinfo(np.int64).max)
    begin_a = np.concatenate([[-1], a])  # where the token that starts at i begins; the first begins before all ends
    size = min(steps, total)
    got_i, got_j = np.empty((size, len(d)), np.int32), np.empty((size, len(d)), np.int32)
    linked, shared = np.empty((size, len(d)), bool), np.empty((size, len(d)), bool)
    for k in range(size):
        at_a, at_b = end_a[i], end_b[j]
        got_i[k], got_j[k] = i, j
        linked[k] = begin_a[i] < at_b
        shared[k] = at_a == at_b
        take = at_a <= at_b
        i = np.minimum(i + take, len(a))
        j = np.minimum(j + ~take, len(b))
    # the last piece walks on behind the ends of both lists; what it finds there are no steps
    real = np.add.outer(np.arange(size), d) < total
    linked &= real
    shared &= linked
    per_piece = shared.sum(axis=0)
    group = np.cumsum(shared, axis=0) - shared + (np.cumsum(per_piece) - per_piece)
    keep = linked.T
    return got_i.T[keep], got_j.T[keep], group.T[keep]


def _decimal(n: int) -> np.ndarray:
    """For id * 4 + separator: the id's digits and ``,`` ``|`` ``;`` or nothing, zero bytes behind them, as one number."""
    if n >= 10**7:
        raise ValueError("ids of more than seven digits")
    rows = [str(i).encode() + s for i in range(n) for s in (b",", b"|", b";", b"")]
    return np.frombuffer(b"".join(r.ljust(8, b"\0") for r in rows), np.uint64)


COMMA, BAR, SEMICOLON, NOTHING = range(4)


def written(table: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): the groups of all texts as ``a1,a2|b1;a3|b2,b3``.

    ``last_a`` and ``last_b`` are the tokens that close the groups, ``doc_ends`` the number of groups up to each text's end.
    """
    closes_a, closes_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    closes_a[last_a], closes_b[last_b] = True, True
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    # groups follow each other, in each the A tokens before the B tokens
    place_a = np.arange(len(ids_a)) + np.concatenate([[0], last_b + 1])[group_a]
    place_b = np.arange(len(ids_b)) + (last_a + 1)[group_b]
    ends = np.full(len(last_b), SEMICOLON)
    ends[doc_ends[doc_ends > 0] - 1] = NOTHING
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    code[place_a] = ids_a * 4 + np.where(closes_a, BAR, COMMA)
    after_b = np.full(len(ids_b), COMMA)
    after_b[last_b] = ends
    code[place_b] = ids_b * 4 + after_b
    padded = table[code].view(np.uint8)
    used = padded != 0
    per_token = used.reshape(-1, 8).sum(axis=1)
    so_far = np.concatenate([[0], np.cumsum(per_token)])
    token_ends = np.concatenate([[0], last_a + last_b + 2])[doc_ends]
    return padded[used], so_far[np.concatenate([[0], token_ends])]


def align(docs: DataFrame, a: bytebpe.Ranks, b: Pieces, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with both tokenizers' alignment of each text.

    New columns: ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links`` (overlapping
    pairs of tokens), ``groups`` (ids as ``a1,a2|b1;a3|b2,b3``) and ``pairs``
    (array of structs: ``pair``, which is A id * size of B's vocabulary + B id, and ``times``).

    A reads a space and the text, B the text, to which it adds the space.  Texts
    that are null or empty, or whose B tokens do not join to the bytes that A
    reads (B may rewrite white space or signs), have no tokens: zeros, empty
    groups and pairs.  Rows are independent; repeated rows give equal rows, an
    empty table none.  Columns outside ``keep`` may have any name.
    """
    schema = docs.select(*keep).schema
    new = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<struct<pair:bigint,times:int>>"
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), new])
    names = [*schema.names, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"]

    def aligned(texts: pa.Array, table: np.ndarray) -> list[pa.Array]:
        raw, at = flat.spaced(texts)  # a space before each text, one behind the last
        size = np.diff(at)  # bytes of a space and the text
        strings = texts.to_pylist()
        ids_b, bounds_b = b.encode(raw, at)
        ends_b = np.concatenate([[0], np.cumsum(b.sizes[ids_b])])
        same = (size > 1) & (np.diff(ends_b[bounds_b]) == size)
        # compare bytes only where lengths agree; byte by byte against the texts
        inside = np.repeat(same, np.diff(bounds_b))
        some = ids_b[inside]
        spelled = b.blob[flat.ranges(b.starts[some], b.sizes[some])]
        wrong = spelled != raw[flat.ranges(at[:-1][same] - 1, size[same])]
        if wrong.any():
            of = np.repeat(np.flatnonzero(same), size[same])
            same[of[wrong]] = False
            inside = np.repeat(same, np.diff(bounds_b))
            some = ids_b[inside]
        n = len(texts)
        kept = np.flatnonzero(same)
        spaced = pa.array([" " + strings[i] for i in kept], pa.large_string())
        ids_a, bounds_a = bytebpe.encode_batch(a, spaced)
        ids_a = ids_a.astype(np.int64)
        n_a, n_b, n_groups, n_links = (np.zeros(n, np.int64) for _ in range(4))
        n_a[kept], n_b[kept] = np.diff(bounds_a), np.diff(bounds_b)[kept]
        text = pa.array([""] * n, pa.string())
        pairs, times, pair_bounds = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        if len(kept):
            i, j, group = overlaps(np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[some]))
            last = np.append(group[1:] != group[:-1], True)  # a group's last link joins the tokens that close it
            doc = np.repeat(kept, np.diff(bounds_a))[i]
            n_links[:] = np.bincount(doc, minlength=n)
            n_groups[:] = np.bincount(doc[last], minlength=n)
            data, bounds = written(table, ids_a, some, i[last], j[last], np.cumsum(n_groups))
            text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())
            n_pairs = len(a.tokens) * len(b.sizes)
            key, times = np.unique(doc * n_pairs + ids_a[i] * len(b.sizes) + some[j], return_counts=True)
            pairs, pair_bounds = key % n_pairs, np.searchsorted(key // n_pairs, np.arange(n + 1))
        struct = pa.StructArray.from_arrays([pa.array(pairs), pa.array(times.astype(np.int32))], names=["pair", "times"])
        return [*map(pa.array, (n_a, n_b, n_groups, n_links)), text, pa.ListArray.from_arrays(pa.array(pair_bounds.astype(np.int32)), struct)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _decimal(max(len(a.tokens), len(b.sizes)))
        for batch in batches:
            texts = flat.strings(batch.column(len(schema)))
            for x, y in flat.pieces(texts, BATCH_BYTES):
                kept = [batch.column(k).slice(x, y - x) for k in range(len(schema))]
                yield pa.RecordBatch.from_arrays([*kept, *aligned(texts.slice(x, y - x), table)], names=names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, out)


def pair_counts(aligned: DataFrame, n_b_ids: int) -> tuple[DataFrame, int, int]:
    """(counts, rows, texts): per pair ``n`` (texts that hold it) and whether that is its A id's highest (``top``).

    ``rows`` is the number of pairs, ``texts`` the sum of ``n``.  An A id has at most as many pairs as B has ids.
    """
    counts, seen = materialize(
        aligned.select(F.inline("pairs")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")),
        "pair-counts",
        {"rows": F.count(F.lit(1)), "texts": F.coalesce(F.sum("n"), F.lit(0))},
    )
    of_a = Window.partitionBy(F.floor(F.col("pair") / F.lit(n_b_ids)))
    return counts.withColumn("top", F.col("n") == F.max("n").over(of_a)), int(seen["rows"]), int(seen["texts"])


def link_scores(aligned: DataFrame, n_b_ids: int, *, row_col: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per row (``row_col``, unique) with links: ``n_best`` (links of a pair that is its A id's most frequent) and ``count_sum``.

    With more than ``broadcast_pairs`` pairs in the corpus only those are
    broadcast that more than the ``broadcast_pairs``-th part of all texts'
    pairs hold; there are fewer of them than that.  The others meet their
    counts in a merge join, where no key has more rows than that part.
    """
    counts, rows, texts = pair_counts(aligned, n_b_ids)
    counts, _ = materialize(counts, "pair-tops")
    held = aligned.select(row_col, F.inline("pairs"))
    if rows <= broadcast_pairs:
        met = held.join(bounded_broadcast(counts, broadcast_pairs, rows), "pair")
    else:
        bound = texts // broadcast_pairs
        frequent = bounded_broadcast(counts.filter(F.col("n") > bound), broadcast_pairs, texts // (bound + 1))
        both = held.join(frequent, "pair", "left")
        rare = both.filter(F.col("n").isNull()).drop("n", "top").join(counts.filter(F.col("n") <= bound).hint("merge"), "pair")
        met = both.filter(F.col("n").isNotNull()).unionByName(rare)
    times = F.col("times").cast("long")
    return met.groupBy(row_col).agg(F.sum(F.when(F.col("top"), times).otherwise(0)).alias("n_best"), F.sum(F.col("n") * times).alias("count_sum"))
