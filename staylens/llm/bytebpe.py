"""Byte-level BPE: encoding whole texts by merge ranks, with byte offsets, and exact decoding.

Texts are cut into slices (runs of letters, digits or other signs with the space
before them, contractions, white space), and the pairs of each slice are merged
in order of rank.  The cuts are found without a regular expression:

* every code point gets a class from a table; white space and apostrophes also
  carry what follows them, so that one pass from left to right decides;
* a class is a transition function on eight states.  The functions that arise
  by chaining form a small closed set, so chaining two of them is one table
  look-up, and as chaining is associative the states of a whole batch come from
  a blocked scan: blocks side by side, then the blocks' totals, then the states;
* slices lie one after another in the batch's bytes, so their bounds make an
  Arrow column without a copy; distinct slices are merged once per batch, and
  short ones are kept by the worker.

A token's byte offset is retained; decoding puts each token's bytes there.
"""

from __future__ import annotations

import base64
import heapq
import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import flat

# --- classes and transitions ------------------------------------------------------------

LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BLANK, INNER = range(8)
#: SHORT, LONG: an apostrophe before one or two letters of a contraction.  SPACE: a space before something else than
#: white space; BLANK: other white space there; INNER: white space before more of it or at the end of the text.
IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_BLANKS, DONE, ONE_MORE, TWO_MORE = range(8)
#: The letters that complete a contraction.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")
#: Positions that one block of the scan covers.
BLOCK = 128


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """(next, cut): the state after a class, and whether a slice starts at it, for each state before it."""
    nxt, cut = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for state in range(8):
        for cls, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (SHORT, IN_OTHER), (LONG, IN_OTHER)):
            nxt[cls, state], cut[cls, state] = run, state not in (run, AFTER_SPACE)
        nxt[SPACE, state], nxt[BLANK, state] = AFTER_SPACE, DONE
        nxt[INNER, state], cut[INNER, state] = IN_BLANKS, state != IN_BLANKS
        if state not in (IN_OTHER, AFTER_SPACE):  # inside a run of signs an apostrophe is one of them
            nxt[SHORT, state], nxt[LONG, state] = ONE_MORE, TWO_MORE
    nxt[LETTER, ONE_MORE], nxt[LETTER, TWO_MORE] = DONE, ONE_MORE
    cut[LETTER, [ONE_MORE, TWO_MORE]] = False
    return nxt, cut


def _closed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(functions, chained, generators): all functions that chaining can give, and ``chained[f * n + g]``, f before g.

    Generators are the classes, then the classes at the start of a text, whose functions ignore the state before.
    """
    nxt, _ = _rules()
    generators = [tuple(map(int, row)) for row in nxt] + [(int(row[DONE]),) * 8 for row in nxt]
    known, todo = {}, [tuple(range(8)), *generators]
    while todo:
        f = todo.pop()
        if f in known:
            continue
        known[f] = len(known)
        todo += [tuple(g[s] for s in f) for g in generators]
    chained = np.zeros((len(known), len(known)), np.uint16)
    for f, i in known.items():
        for g, j in known.items():
            chained[i, j] = known[tuple(g[s] for s in f)]
    return np.array(list(known), np.uint8), chained.ravel(), np.array([known[g] for g in generators], np.uint16)


_NEXT, _CUT = _rules()
_FUNCTIONS, _CHAINED, _GENERATORS = _closed()


def _scan(x: np.ndarray) -> np.ndarray:
    """Functions chained up to and with each position."""
    k = len(_FUNCTIONS)
    if len(x) <= BLOCK:
        out = x.astype(np.int32)
        for i in range(1, len(out)):
            out[i] = _CHAINED[out[i - 1] * k + out[i]]
        return out
    rows = -(-len(x) // BLOCK)
    block = np.zeros(rows * BLOCK, np.int32)  # function 0 of the padding is never read
    block[: len(x)] = x
    block = np.ascontiguousarray(block.reshape(rows, BLOCK).T)
    for j in range(1, BLOCK):
        block[j] = _CHAINED[block[j - 1] * k + block[j]]
    before = _scan(block[-1])[:-1]
    block[:, 1:] = _CHAINED[before * k + block[:, 1:]]
    return block.T.ravel()[: len(x)]


def cuts(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where slices start, from classes and the positions where texts start."""
    if not len(classes):
        return np.zeros(0, bool)
    gen = classes.astype(np.int64)
    gen[first] += 8
    after = _FUNCTIONS[_scan(_GENERATORS[gen]), DONE]
    state = np.empty(len(classes), np.uint8)
    state[0], state[1:] = DONE, after[:-1]
    state[first] = DONE
    return _CUT[classes, state]


def unicode_classes() -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths): letter, number, white space or other for all code points, as runs, by the library's own tables."""
    import tiktoken

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    text, single = points.tobytes().decode("utf-32-le"), {bytes([i]): i for i in range(256)}
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, cls in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        found = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text)
        table[np.frombuffer(bytes(found).decode().encode("utf-32-le"), "<u4")] = cls
    at = np.concatenate([[0], np.flatnonzero(np.diff(table)) + 1])
    return table[at], np.diff(np.append(at, len(table)))


# --- vocabulary and merging -------------------------------------------------------------

#: Slices of up to so many bytes are kept by a worker, at most twice this many.
KEPT_BYTES, KEPT = 48, 1 << 18
#: Shorter slices are merged side by side, longer ones each with a heap.
HEAP_FROM = 32
NO_MERGE = np.int64(1) << 40


class Kept:
    """A worker's ids (packed as 32-bit integers) of slices seen before, in two generations.

    When the younger is full it becomes the older one, whose slices come back when they are met again; so frequent
    slices stay and memory is bounded.
    """

    def __init__(self):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, pieces: list[bytes], make: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The ids of ``pieces``; ``make`` gives those of the unknown ones."""
        found = [self.young.get(p) for p in pieces]
        missing, unknown = [i for i, ids in enumerate(found) if ids is None], []
        for i in missing:
            found[i] = self.old.get(pieces[i])
            if found[i] is None:
                unknown.append(i)
        for i, ids in zip(unknown, make([pieces[i] for i in unknown]), strict=True):
            found[i] = ids
        if len(self.young) > KEPT:
            self.young, self.old = {}, self.young
        self.young.update((pieces[i], found[i]) for i in missing if len(pieces[i]) <= KEPT_BYTES)
        return found


def spread(column: pa.Array, kept: Kept, make: Callable[[list[bytes]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of a binary column of slices, each distinct slice encoded once."""
    coded = column.dictionary_encode()
    found = kept.ids(coded.dictionary.to_pylist(), make)
    n = np.fromiter(map(len, found), np.int64, len(found)) // 4
    own = np.frombuffer(b"".join(found), "<u4")
    which = coded.indices.to_numpy(zero_copy_only=False)
    return own[flat.ranges((np.cumsum(n) - n)[which], n[which])], np.concatenate([[0], np.cumsum(n[which])])


@dataclass
class Ranks:
    """Token bytes by id, and the pairs of ids that merge; a pair's rank is the id that it merges to.

    ``whole``: a slice that is a token is not merged but taken as it is.
    """

    tokens: list[bytes]
    pairs: tuple[np.ndarray, np.ndarray]  # left << 32 | right in order, and the merged ids
    whole: bool
    classes: tuple[np.ndarray, np.ndarray]  # classes of code points as runs
    ids: dict[bytes, int] = field(init=False, repr=False)
    kept: Kept = field(init=False, repr=False, default_factory=Kept)
    by_pair: dict[int, int] = field(init=False, repr=False, default_factory=dict)

    def __post_init__(self):
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.table = np.repeat(*self.classes)
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.single = np.array([self.ids[bytes([i])] for i in range(256)], np.int64)
        left, right = np.repeat(self.single, 256), np.tile(self.single, 256)
        self.byte_pairs = self.rank(left, right).reshape(256, 256)

    def __reduce__(self):  # tasks get the tables and rebuild the rest
        return Ranks, (self.tokens, self.pairs, self.whole, self.classes)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids that pairs merge to, ``NO_MERGE`` for pairs that do not."""
        keys, merged = self.pairs
        key = left << 32 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, merged[at], NO_MERGE)


def _in_order(found: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.fromiter(found, np.int64, len(found))
    order = np.argsort(keys)
    return keys[order], np.fromiter(found.values(), np.int64, len(found))[order]


def load(path: str) -> Ranks:
    """A vocabulary from a file of base64 tokens and ranks, or from a JSON model whose ids follow its merges.

    By ranks alone every pair that joins to a token merges, and a slice that is a token is taken whole; a JSON model
    lists its pairs and takes nothing whole.
    """
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = {}
        for t, i in ids.items():
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
    else:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = byte_letters()
        ids = {bytes(map(back.__getitem__, t)): i for t, i in model["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = {model["vocab"][a] << 32 | model["vocab"][b]: model["vocab"][a + b] for a, b in merges}
        if (np.diff(list(pairs.values())) <= 0).any():
            raise ValueError("the ids of the vocabulary do not follow its merges")
    tokens = [b""] * (max(ids.values()) + 1)
    for t, i in ids.items():
        tokens[i] = t
    if not all(bytes([i]) in ids for i in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    return Ranks(tokens, _in_order(pairs), not path.endswith(".json"), unicode_classes())


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge(v: Ranks, pieces: list[bytes]) -> list[bytes]:
    """The packed ids of slices: the pair of lowest rank merges first, the leftmost of equal ones.

    Slices of one length form the rows of a matrix; a step merges one pair of every row that has one.
    """
    out = [b""] * len(pieces)
    by_size: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        known = v.ids.get(piece) if v.whole or len(piece) == 1 else None
        if known is not None:
            out[i] = struct.pack("<I", known)
        elif len(piece) >= HEAP_FROM:
            out[i] = _merge_long(v, piece)
        else:
            by_size.setdefault(len(piece), []).append(i)
    for size, rows in by_size.items():
        row = np.array(rows)
        raw = np.frombuffer(b"".join([pieces[i] for i in rows]), np.uint8).reshape(-1, size)
        ids, rank = v.single[raw], v.byte_pairs[raw[:, :-1], raw[:, 1:]]
        while True:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            low = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NO_MERGE)
            done = low == NO_MERGE
            data, width = ids[done].astype("<u4").tobytes(), ids.shape[1] * 4
            for k, i in enumerate(row[done].tolist()):
                out[i] = data[k * width : (k + 1) * width]
            if done.all():
                break
            if done.any():
                row, ids, rank, at, low = row[~done], ids[~done], rank[~done], at[~done], low[~done]
            each, cols = np.arange(len(row)), np.arange(ids.shape[1] - 1)
            ids[each, at] = low
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)  # without the right half
            rank = np.take_along_axis(rank, cols[:-1] + (cols[:-1] >= at[:, None]), axis=1)
            with_next, with_last = np.flatnonzero(at < ids.shape[1] - 1), np.flatnonzero(at > 0)
            rank[with_next, at[with_next]] = v.rank(low[with_next], ids[with_next, at[with_next] + 1])
            rank[with_last, at[with_last] - 1] = v.rank(ids[with_last, at[with_last] - 1], low[with_last])
    return out


def _merge_long(v: Ranks, piece: bytes) -> bytes:
    """The same for one slice of any length, with its pairs in a heap: n log n steps."""
    if not v.by_pair:
        v.by_pair = dict(zip(*(x.tolist() for x in v.pairs), strict=True))
    n = len(piece)
    part = v.single[np.frombuffer(piece, np.uint8)].tolist()
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        rank = v.by_pair.get(part[i] << 32 | part[after[i]]) if after[i] >= 0 else None
        if rank is not None:
            heapq.heappush(heap, (rank, i, part[i], part[after[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if part[i] != a or j < 0 or part[j] != b:
            continue  # one of the two has merged since
        part[i], part[j] = rank, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return np.array([x for x in part if x >= 0], "<u4").tobytes()


# --- batches ----------------------------------------------------------------------------


def classify(v: Ranks, points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes of code points; ``first`` are the positions where texts start."""
    classes = v.table[points]
    last = np.zeros(len(points) + 2, bool)  # positions behind a text's last code point, and behind all
    last[first] = True
    last[len(points) :] = True
    follows = np.append(points[1:], 0)
    follows[last[1:-1]] = 0
    blank = classes == BLANK
    inner = np.append(blank[1:], True) | last[1:-1]
    classes[blank & (points == 32)] = SPACE
    classes[blank & inner] = INNER
    mark = np.flatnonzero(points == 39)
    if len(mark):
        one = follows[mark]
        two = np.where(one > 0, np.append(follows[1:], 0)[mark], 0)
        classes[mark[np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = SHORT
        pair = np.zeros(len(mark), bool)
        for a, b in LONG_ENDINGS:
            pair |= (one == ord(a)) & (two == ord(b))
        classes[mark[pair]] = LONG
    return classes


def slices(v: Ranks, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(slices, bounds): the slices of all texts as one binary column, and where each text's slices start."""
    at = flat.offsets(texts) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])) if at[-1] > at[0] else pa.py_buffer(b"")
    at = at - at[0]
    points = np.frombuffer(raw.to_pybytes().decode().encode("utf-32-le"), "<u4")
    place = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=place[1:])
    first = np.unique(np.searchsorted(place, at[:-1][at[1:] > at[:-1]]))
    starts = place[:-1][cuts(classify(v, points, first), first)]
    ends = np.append(starts, place[-1])
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), raw])
    return column, np.searchsorted(starts, at)


def encode_batch(v: Ranks, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): the ids of all texts one after another, and where each text's ids start."""
    column, bounds = slices(v, texts)
    if not len(column):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    ids, each = spread(column, v.kept, lambda new: merge(v, new))
    return ids, each[bounds]


def decode_batch(v: Ranks, ids: np.ndarray, offsets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of texts from their ids and byte offsets; ``bounds`` is where each text's ids start."""
    size = v.sizes[ids]
    total = np.zeros(len(bounds) - 1, np.int64)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    total[some] = offsets[bounds[some + 1] - 1] + size[bounds[some + 1] - 1]
    starts = np.concatenate([[0], np.cumsum(total)])
    out = np.zeros(starts[-1], np.uint8)
    place = offsets + np.repeat(starts[:-1], np.diff(bounds))
    out[flat.ranges(place, size)] = v.blob[flat.ranges(v.starts[ids], size)]
    return out, starts


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Spans of an array as binary values."""
    ends = bounds.astype(np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encode(docs: DataFrame, v: Ranks, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``n_tokens``, ``ids`` and ``offsets``.

    ``ids`` and ``offsets`` (the byte in the text where each token starts) are
    binary, little-endian unsigned integers of 32 bits, as token files hold
    them.  Null and empty texts have no tokens.  Rows are independent of each
    other: repeated rows give equal rows, an empty table none.  Columns of
    ``docs`` outside ``keep`` may have any name; those in ``keep`` must not be
    called like the new ones.
    """
    schema = docs.select(*keep).schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "n_tokens bigint, ids binary, offsets binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = flat.strings(batch.column(len(schema)))
            for a, b in flat.pieces(texts):
                part = texts.slice(a, b - a)
                ids, bounds = encode_batch(v, part)
                ends = np.concatenate([[0], np.cumsum(v.sizes[ids])])
                offsets = (ends[:-1] - np.repeat(ends[bounds[:-1]], np.diff(bounds))).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(schema))), pa.array(np.diff(bounds)), _binary(ids, bounds), _binary(offsets, bounds)],
                    names=[*schema.names, "n_tokens", "ids", "offsets"],
                )

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, out)


def decode(encoded: DataFrame, v: Ranks, *, keep: list[str], ids_col: str = "ids", offsets_col: str = "offsets") -> DataFrame:
    """The columns ``keep`` with ``decoded``, the bytes of the text that ``encode`` read (null ids: null)."""
    schema = encoded.select(*keep).schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "decoded binary"])

    def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = column.cast(pa.large_binary()).fill_null(b"")
        at = flat.offsets(column)
        data = column.buffers()[2]
        got = np.frombuffer(data, "<u4", count=int(at[-1] - at[0]) // 4, offset=int(at[0])) if at[-1] > at[0] else np.zeros(0, "<u4")
        return got.astype(np.int64), (at - at[0]) // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            missing = batch.column(len(schema)).is_null()
            for a, b in flat.pieces(batch.column(len(schema)).cast(pa.large_binary()).fill_null(b"")):
                ids, bounds = numbers(batch.column(len(schema)).slice(a, b - a))
                offsets, _ = numbers(batch.column(len(schema) + 1).slice(a, b - a))
                data, starts = decode_batch(v, ids, offsets, bounds)
                text = pc.if_else(missing.slice(a, b - a), pa.scalar(None, pa.binary()), _binary(data, starts))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(schema))), text], names=[*schema.names, "decoded"])

    ids = F.col(ids_col)
    return encoded.select(*keep, ids.alias("__ids"), F.when(ids.isNotNull(), F.col(offsets_col)).alias("__offsets")).mapInArrow(run, out)
