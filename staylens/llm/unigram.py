"""SentencePiece lattices: k distinct sampled segmentations per text, and exact decoding.

A text's lattice holds every way to tile it with pieces of a vocabulary; a
segmentation's probability is in proportion to the product of its pieces'
weights.  The k segmentations with the largest Gumbel-perturbed
log-probabilities are a sample without replacement.  They are found by a
perturbed A-star search:

* the whole space is one node whose perturbed maximum is drawn first;
* the node with the largest perturbed maximum is opened: the segmentation that
  attains it is drawn from the lattice (backward sums give exact conditionals),
  emitted, and the rest of the node is split by where another segmentation
  first leaves it, each part with its own maximum, a Gumbel at its log-mass cut
  off at the opened node's value.

The bound of a node is its exact maximum, so each opening emits a sample.  The
(k+1)-st value is the threshold that turns log-probabilities into inclusion
probabilities.

No piece spans from a word into the next space, so lattices are built once for
each distinct spaced word of a batch, all positions side by side in numpy, and
those of words that come again in later batches are kept by the task; a text is
a chain of such lattices.  Random numbers come from hashes of (row key,
sample, word, step): results do not depend on batches, tasks or reruns.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import flat

SPACE = "▁"
#: Bytes of text whose lattices are held at once, and bytes of units whose lattices are computed at once.
PIECE_BYTES, BUILD_BYTES = 1 << 17, 1 << 15
#: Bytes of units whose lattices a task keeps, and units whose hashes it remembers to find those that come again.
SHARED_BYTES, MET_UNITS = 1 << 19, 1 << 19
TABLE_BITS = 19
M64 = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15


@dataclass
class Vocabulary:
    """Pieces as bytes (the space mark as a space), log-weights, and a trie as a hash table of (state, byte)."""

    pieces: list[bytes]
    weights: np.ndarray
    keys: np.ndarray
    nexts: np.ndarray
    final: np.ndarray  # piece id of each trie state, -1 without
    byte_ids: np.ndarray
    byte_weight: float


def load(model_file: str, alpha: float = 1.0) -> Vocabulary:
    """Reads a piece model.

    The model ranks its pieces; the log-weight of a piece of rank r is
    ``-alpha * log(r + 2.7)``, normalised over the vocabulary (Zipf's law).
    Byte pieces rank last and stand only for characters without a piece.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = m.get_piece_size()
    pieces, rank, byte_ids, usable = [b""] * n, np.full(n, float(n)), np.zeros(256, np.int32), np.zeros(n, bool)
    for i in range(n):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(p[1:-1], 16)] = i
            pieces[i] = bytes([int(p[1:-1], 16)])
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            pieces[i] = p.replace(SPACE, " ").encode()
            usable[i] = True
            rank[i] = min(n, -m.get_score(i))
    return build(pieces, rank, usable, byte_ids, alpha)


def build(pieces: list[bytes], rank: np.ndarray, usable: np.ndarray, byte_ids: np.ndarray, alpha: float) -> Vocabulary:
    weights = -alpha * np.log(rank + 2.7)
    weights -= np.log(np.exp(weights[usable]).sum())
    trie: dict[tuple[int, int], int] = {}
    final = [-1]
    for i in np.flatnonzero(usable):
        state = 0
        for byte in pieces[i]:
            nxt = trie.get((state, byte))
            if nxt is None:
                nxt = trie[state, byte] = len(final)
                final.append(-1)
            state = nxt
        final[state] = int(i)
    keys, nexts = np.full(1 << TABLE_BITS, -1, np.int64), np.zeros(1 << TABLE_BITS, np.int32)
    if len(trie) * 2 > len(keys):
        raise ValueError("vocabulary too large for the trie table")
    for (state, byte), nxt in trie.items():
        key = state << 8 | byte
        at = (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - TABLE_BITS)
        while keys[at] >= 0:
            at = (at + 1) & (len(keys) - 1)
        keys[at], nexts[at] = key, nxt
    return Vocabulary(pieces, weights, keys, nexts, np.array(final, np.int32), byte_ids, float(weights.min()))


def _step(v: Vocabulary, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The next trie states, -1 without."""
    key = state.astype(np.int64) << 8 | byte
    at = (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - TABLE_BITS)
    have = v.keys[at]
    out = np.where(have == key, v.nexts[at], -1)
    open_ = np.flatnonzero((have != key) & (have >= 0))
    while len(open_):
        at[open_] = (at[open_] + 1) & (len(v.keys) - 1)
        have = v.keys[at[open_]]
        hit = have == key[open_]
        out[open_[hit]] = v.nexts[at[open_[hit]]]
        open_ = open_[~hit & (have >= 0)]
    return out


@dataclass
class Lattice:
    """Edges of many unit lattices, grouped by position; unit ``i`` covers bytes ``starts[i]:ends[i]`` of ``raw``."""

    raw: np.ndarray
    first: np.ndarray  # first edge of each byte position
    source: np.ndarray  # byte position an edge leaves
    target: np.ndarray  # byte position an edge leads to, -1 at the unit's end
    piece: np.ndarray  # piece id, -1 for byte pieces
    width: np.ndarray  # bytes of the edge
    logp: np.ndarray  # log-probability of the edge at its position
    cum: np.ndarray  # cumulated probability of a position's edges, the last above 1


def lattice(v: Vocabulary, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Lattice:
    """All edges and their exact conditional probabilities, for units laid out one after another in ``raw``."""
    limit = np.repeat(ends.astype(np.int32), ends - starts)
    lead = np.flatnonzero((raw < 0x80) | (raw >= 0xC0)).astype(np.int32)
    # walk the trie from every character at once
    froms, tos, ids = [], [], []
    pos, state, depth = lead, np.zeros(len(lead), np.int32), 0
    single = np.zeros(len(raw), bool)  # a piece covers just this character
    char_end = np.append(lead[1:], np.int32(len(raw)))
    ends_char = np.zeros(len(raw) + 1, np.int32)
    ends_char[lead] = char_end
    while len(pos):
        state = _step(v, state, raw[pos + depth])
        depth += 1
        ok = state >= 0
        pos, state = pos[ok], state[ok]
        hit = v.final[state] >= 0
        at = pos[hit]
        froms.append(at)
        tos.append(at + np.int32(depth))
        ids.append(v.final[state[hit]])
        single[at[ends_char[at] == tos[-1]]] = True
        ok = pos + depth < limit[pos]
        pos, state = pos[ok], state[ok]
    bare = lead[~single[lead]]
    froms.append(bare)
    tos.append(np.minimum(ends_char[bare], limit[bare]))
    ids.append(np.full(len(bare), -1, np.int32))
    a, b, piece = np.concatenate(froms), np.concatenate(tos), np.concatenate(ids)
    # positions in order of their distance from the unit's end, so that sums run backwards
    dist = limit - np.arange(len(raw), dtype=np.int32)
    order = np.argsort(dist[a].astype(np.int64) << 33 | a.astype(np.int64) << 6 | 63 - (b - a))  # longest edge first: it is taken most often
    a, b, piece = a[order], b[order], piece[order]
    w = np.where(piece >= 0, v.weights[piece], v.byte_weight * (b - a))
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    nodes = a[new]
    beta = np.full(len(raw) + 1, 0.0)
    stop = limit[a] == b
    after = np.where(stop, np.int32(len(raw)), b)  # the unit's end counts as log 1
    steps = np.flatnonzero(np.concatenate([[True], np.diff(dist[nodes]) != 0])) if len(nodes) else np.zeros(0, np.int64)
    bounds = np.append(steps, len(nodes))
    edge_at = np.append(new, len(a))
    logp, cum = np.empty(len(a)), np.empty(len(a))
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        lo, hi = edge_at[x], edge_at[y]
        value = w[lo:hi] + beta[after[lo:hi]]
        head = edge_at[x:y] - lo
        n = np.diff(np.append(head, hi - lo))
        top = np.maximum.reduceat(value, head)
        value -= np.repeat(top, n)
        share = np.exp(value)
        total = np.add.reduceat(share, head)
        np.divide(share, np.repeat(total, n), out=cum[lo:hi])
        total = np.log(total)
        np.subtract(value, np.repeat(total, n), out=logp[lo:hi])
        beta[nodes[x:y]] = top + total
    n = np.diff(edge_at)
    for k in range(1, int(n.max(initial=1))):  # edge after edge of a position, so that no unit depends on its neighbours
        more = new[n > k] + k
        cum[more] += cum[more - 1]
    if len(new):
        cum[edge_at[1:] - 1] = 2.0  # the last edge of a position takes the rest
    first = np.zeros(len(raw) + 1, np.int64)
    first[nodes] = new
    return Lattice(raw, first, a, np.where(stop, np.int32(-1), b), piece, b - a, logp, cum)


class Store:
    """A lattice that grows: its arrays have room behind them, so that adding units copies only these.

    ``back`` gives up the units behind an earlier ``mark`` (bytes and edges); what is added next overwrites them.
    """

    ROOM = 1 << 19  # entries kept behind a mark, beside half of what is before it

    def __init__(self):
        self.columns = {k: np.zeros(0, kind) for k, kind in (("raw", np.uint8), ("first", np.int64))}
        self.columns |= {k: np.zeros(0, kind) for k, kind in (("source", np.int32), ("target", np.int32), ("piece", np.int32), ("width", np.int32), ("logp", np.float64), ("cum", np.float64))}
        self.mark = 0, 0

    def _size(self, name: str) -> int:
        return self.mark[0] if name in ("raw", "first") else self.mark[1]

    def lattice(self) -> Lattice:
        return Lattice(**{k: c[: self._size(k)] for k, c in self.columns.items()})

    def back(self, mark: tuple[int, int]) -> None:
        self.mark = mark
        for k, c in self.columns.items():
            if len(c) > self._size(k) * 3 // 2 + self.ROOM:  # a very long unit was there
                self.columns[k] = c[: self._size(k)].copy()

    def add(self, lat: Lattice) -> None:
        n_bytes, n_edges = self.mark
        more = {k: getattr(lat, k) for k in self.columns}
        more |= {"first": lat.first[:-1] + n_edges, "source": lat.source + np.int32(n_bytes), "target": np.where(lat.target < 0, np.int32(-1), lat.target + np.int32(n_bytes))}
        for k, values in more.items():
            at = self._size(k)
            if at + len(values) > len(self.columns[k]):  # one array after another, so that only one is there twice
                wider = np.empty(at + len(values) + at // 4, self.columns[k].dtype)
                wider[:at] = self.columns[k][:at]
                self.columns[k] = wider
            self.columns[k][at : at + len(values)] = values
        self.mark = n_bytes + len(lat.raw), n_edges + len(lat.source)


class Shared:
    """Lattices of units that a task has met in several batches, up to ``SHARED_BYTES`` of them.

    A batch builds lattices only for its other units, behind the shared ones; what is sampled does not depend on that.
    """

    def __init__(self, v: Vocabulary):
        none = np.zeros(0, np.int64)
        self.v, self.store = v, Store()
        self.kept = self.store.mark
        self.hashes, self.begin = np.zeros(0, np.uint64), none
        self.met = self.hashes

    @property
    def lat(self) -> Lattice:
        self.store.back(self.kept)
        return self.store.lattice()

    def lattices(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[Lattice, np.ndarray]:
        """(lattice, begin) of units that differ from each other, in order of their hashes; ``begin`` is where each lies in it.

        The lattice holds until the next call.
        """
        self.store.back(self.kept)
        known, _ = self._find(hashes)
        self._learn(raw, starts[~known], ends[~known], hashes[~known])
        known, at = self._find(hashes)
        begin = np.empty(len(hashes), np.int64)
        begin[known], begin[~known] = self.begin[at[known]], self._add(raw, starts[~known], ends[~known])
        return self.store.lattice(), begin

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, places) among the shared units."""
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        return known, at

    def _add(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Adds the lattices of units, ``BUILD_BYTES`` at a time (one unit at least); where each begins."""
        size, base = ends - starts, self.store.mark[0]
        begin = np.cumsum(size) - size
        bounds = [*np.flatnonzero(np.diff(begin // BUILD_BYTES, prepend=-1)).tolist(), len(begin)]
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            own = begin[x:y] - begin[x]
            self.store.add(lattice(self.v, raw[flat.ranges(starts[x:y], size[x:y])], own, own + size[x:y]))
        return begin + base

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        room = SHARED_BYTES - self.kept[0]
        if room <= 0:
            self.met = self.met[:0]
            return
        if not len(hashes):
            return
        at = np.minimum(np.searchsorted(self.met, hashes), max(0, len(self.met) - 1))
        old = self.met[at] == hashes if len(self.met) else np.zeros(len(hashes), bool)
        again = np.flatnonzero(old)
        again = again[np.cumsum((ends - starts)[again]) <= room]
        self.met = np.sort(np.concatenate([self.met, hashes[~old]])) if len(self.met) < MET_UNITS else hashes
        if len(again):
            all_begin = np.concatenate([self.begin, self._add(raw, starts[again], ends[again])])
            self.kept = self.store.mark
            hashes = np.concatenate([self.hashes, hashes[again]])
            order = np.argsort(hashes)
            self.hashes, self.begin = hashes[order], all_begin[order]


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def choose(lat: Lattice, pos: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The edges that uniform numbers pick at byte positions."""
    edge = lat.first[pos]
    miss = np.flatnonzero(u > lat.cum[edge])
    while len(miss):
        edge[miss] += 1
        miss = miss[u[miss] > lat.cum[edge[miss]]]
    return edge


def draw(lat: Lattice, start: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, bounds): one segmentation of each unit occurrence, drawn from its lattice."""
    n = len(start)
    counts = np.zeros(n, np.int64)
    who, pos, step = np.arange(n), start, 0
    got_who, got_edge = [], []
    while len(who):
        u = uniform(flat.mix(seeds[who] + np.uint64((step + 1) * GOLDEN & M64)))
        edge = choose(lat, pos, u)
        got_who.append(who)
        got_edge.append(edge)
        counts[who] += 1
        pos = lat.target[edge]
        go = pos >= 0
        who, pos, step = who[go], pos[go], step + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(bounds[-1], np.int64)
    for k, (w, e) in enumerate(zip(got_who, got_edge, strict=True)):
        out[bounds[w] + k] = e
    return out, bounds


class Stream:
    """Uniform and exponential numbers of one row, from a counter."""

    def __init__(self, key: int):
        self.key, self.n = key, 0

    def uniform(self) -> float:
        self.n += 1
        x = (self.key + self.n * GOLDEN) & M64
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & M64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & M64
        x ^= x >> 31
        return ((x >> 11) + 0.5) * 2.0**-53


def gumbel_below(mass: float, limit: float, stream: Stream) -> float:
    """The maximum of a set of log-mass ``mass``, given that it is at most ``limit``."""
    if mass == -math.inf:
        return -math.inf
    rest = math.exp(mass - limit) if limit < math.inf else 0.0
    return mass - math.log(rest - math.log(stream.uniform()))


@dataclass
class Path:
    edges: np.ndarray
    units: np.ndarray  # where each unit occurrence starts in ``edges``, and the end
    before: np.ndarray  # log-probability of what comes before each edge; as far as it matters
    leave: np.ndarray  # mass of the segmentations that first differ at each edge, same length
    logp: float


#: Log-probabilities below this are zero in double precision.
NOTHING = -740.0


def _path(lat: Lattice, edges: np.ndarray, units: np.ndarray) -> Path:
    logp = lat.logp[edges]
    n = min(len(edges), 256)
    while True:  # prefixes lose their probability quickly
        before = np.concatenate([[0.0], np.cumsum(logp[:n])])
        if n == len(edges) or before[-1] < NOTHING:
            break
        n = min(len(edges), n * 4)
    leave = np.exp(before[:-1]) * -np.expm1(np.minimum(logp[:n], 0.0))
    return Path(edges, units, before, leave, float(logp.sum()))


def top_k(lat: Lattice, first: tuple, fresh, stream: Stream, k: int) -> tuple[list[tuple[Path, float]], float]:
    """k segmentations of one text with their perturbed values, and the next value (-inf if there are no more).

    ``first`` holds the edges and unit bounds of the text's first draw;
    ``fresh(s)`` gives those of draw ``s``, whose words follow where sample
    ``s`` has left the path it branches from.
    """
    path = _path(lat, *first)
    value = -math.log(-math.log(stream.uniform()))
    out, heap, serial = [(path, value)], [], 0

    def push(kind, owner, lo, hi, banned, mass, limit):
        nonlocal serial
        if mass > 0:
            serial += 1
            heapq.heappush(heap, (-gumbel_below(math.log(mass), limit, stream), serial, kind, owner, lo, hi, banned))

    push("leave", path, 0, len(path.leave), (), float(path.leave.sum()), value)
    while len(out) < k and heap:
        value, _, kind, owner, lo, hi, banned = heapq.heappop(heap)
        value = -value
        if kind == "leave":
            sums = np.cumsum(owner.leave[lo:hi])
            j = lo + min(int(np.searchsorted(sums, stream.uniform() * sums[-1], side="right")), hi - lo - 1)
            banned = (int(owner.edges[j]),)
        else:
            j = lo
        # another edge at the same position
        at = lat.source[owner.edges[j]]
        z, choices = int(lat.first[at]), []
        while z < len(lat.source) and lat.source[z] == at:
            if z not in banned:
                choices.append(z)
            z += 1
        probs = np.exp(lat.logp[choices])
        sums = np.cumsum(probs)
        edge = choices[min(int(np.searchsorted(sums, stream.uniform() * sums[-1], side="right")), len(choices) - 1)]
        o = int(np.searchsorted(owner.units, j, side="right")) - 1
        tail = [edge]
        while lat.target[tail[-1]] >= 0:
            at = lat.target[tail[-1]]
            u, edge = stream.uniform(), int(lat.first[at])
            while u > lat.cum[edge]:
                edge += 1
            tail.append(edge)
        edges, units = fresh(len(out))
        cut = j + len(tail)
        after = edges[units[o + 1] :]
        new = _path(
            lat,
            np.concatenate([owner.edges[:j], tail, after]).astype(np.int64),
            np.concatenate([owner.units[: o + 1], units[o + 1 :] - units[o + 1] + cut]),
        )
        out.append((new, value))
        edge, prefix = tail[0], math.exp(owner.before[j])
        if kind == "leave":
            push("leave", owner, lo, j, (), float(owner.leave[lo:j].sum()), value)
            push("leave", owner, j + 1, hi, (), float(owner.leave[j + 1 : hi].sum()), value)
        rest = prefix * float(probs.sum() - math.exp(lat.logp[edge])) if len(choices) > 1 else 0.0
        push("other", owner, j, j + 1, (*banned, edge), rest, value)
        push("leave", new, j + 1, len(new.leave), (), float(new.leave[j + 1 :].sum()), value)
    return out, -heap[0][0] if heap else -math.inf


def units_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the units of texts laid out by ``flat.spaced``: a text starts with the space before it.

    Units start at texts, at runs of spaces, and at and after control bytes; no piece crosses those.
    """
    cut = np.zeros(len(raw) + 1, bool)
    space = raw == 32
    cut[1:-1] = space[1:] & ~space[:-1]
    control = np.flatnonzero(raw < 32)
    cut[control] = True
    cut[control + 1] = True
    begin, end = at[:-1] - 1, at[1:] - 1
    cut[begin] = True
    cut[end] = True
    cut[-1] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(raw))
    # the last text's closing space, and the opening space of empty texts, belong to no text
    doc = np.searchsorted(begin, starts, side="right") - 1
    keep = (starts < end[doc]) & (end[doc] - begin[doc] > 1)
    return starts[keep], np.minimum(ends[keep], end[doc[keep]])


def sample_texts(v: Vocabulary, texts: pa.Array, keys: np.ndarray, k: int, shared: Shared | None = None) -> Iterator[tuple[list[tuple[Path, float]], float, Lattice]]:
    """``top_k`` of every text, with the lattice that its edges refer to."""
    raw, at = flat.spaced(texts)
    starts, ends = units_of(raw, at)
    doc = np.searchsorted(at - 1, starts, side="right") - 1
    hashes = flat.span_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    own, some, which = np.unique(hashes, return_index=True, return_inverse=True)
    lat, begin = (shared or Shared(v)).lattices(raw, starts[some], ends[some], own)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    index = (np.arange(len(starts)) - bounds[doc]).astype(np.uint64)
    row = keys[doc] + index * np.uint64(0xD1342543DE82EF95)
    draws = [draw(lat, begin[which], flat.mix(row ^ np.uint64((s + 1) * 0xA24BAED4963EE407 & M64))) for s in range(k)]

    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            yield [], -math.inf, lat
            continue

        def fresh(s: int, a=a, b=b):
            edges, where = draws[s]
            return edges[where[a] : where[b]], where[a : b + 1] - where[a]

        found, rest = top_k(lat, fresh(0), fresh, Stream(int(flat.mix(keys[i : i + 1] ^ np.uint64(0x5851F42D4C957F2D))[0])), k)
        yield found, rest, lat


def piece_ids(v: Vocabulary, lat: Lattice, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts): piece ids of the edges, byte pieces written out, and the ids of each edge."""
    piece = lat.piece[edges]
    count = np.where(piece >= 0, 1, lat.width[edges])
    if (piece >= 0).all():
        return piece.astype(np.int32), count
    out = np.repeat(piece, count)
    bare = np.flatnonzero(out < 0)
    begin = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(edges)), count)[bare]
    out[bare] = v.byte_ids[lat.raw[lat.source[edges[owner]] + bare - begin[owner]]]
    return out.astype(np.int32), count


def decode(v: Vocabulary, ids) -> str:
    """The text of a piece sequence: the pieces' bytes without the opening space."""
    return b"".join([v.pieces[i] for i in ids])[1:].decode()


class Decoder:
    """Checks that piece sequences decode to texts, for many at once."""

    def __init__(self, v: Vocabulary):
        self.sizes = np.array([len(p) for p in v.pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(v.pieces), np.uint8)

    def __call__(self, ids: np.ndarray, stops: np.ndarray, owner: np.ndarray, texts: pa.Array) -> list[bool]:
        """For each text whether all its sequences (``ids[stops[s]:stops[s + 1]]`` of text ``owner[s]``) are a space and the text."""
        size = self.sizes[ids]
        data = self.blob[flat.ranges(self.starts[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[stops].tolist()
        at = flat.offsets(texts)
        raw = texts.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if len(texts) and at[-1] > at[0] else b""
        at = (at - at[0]).tolist()
        good = [True] * len(texts)
        for s, i in enumerate(owner.tolist()):
            x, y = ends[s], ends[s + 1]
            good[i] &= data[x : x + 1] == b" " and data[x + 1 : y] == raw[at[i] : at[i + 1]]
        return good


SAMPLES = "array<struct<ids:array<int>,logprob:double,perturbed:double,log_inclusion:double>>"


def encode(docs: DataFrame, v: Vocabulary, *, k: int = 2, keep: list[str], id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``samples`` and ``round_trip``.

    ``samples``: at most k distinct segmentations, largest perturbed value
    first, with the log-probability among all segmentations of the text and the
    log of the inclusion probability given the next perturbed value (0 where
    all segmentations are listed).  ``round_trip``: every sample decodes to the
    text.  Null and empty texts: no sample.  Rows are seeded by their id, so
    rows with equal id and text (null id included) have equal samples.  An
    empty table gives no rows.
    """
    schema = docs.select(*keep).schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), f"samples {SAMPLES}, round_trip boolean"])
    sample_type = pa.struct([("ids", pa.list_(pa.int32())), ("logprob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        flat.release()  # what earlier tasks of this worker have left
        shared, decodes = Shared(v), Decoder(v)
        for batch in batches:
            texts = flat.strings(batch.column(batch.num_columns - 1))
            keys = batch.column(batch.num_columns - 2).to_numpy().view(np.uint64)
            for a, b in flat.pieces(texts, PIECE_BYTES):
                part = texts.slice(a, b - a)
                edges, n_edges, rows, lat = [], [], [0], None
                logp, perturbed, inclusion = [], [], []
                for found, rest, lat in sample_texts(v, part, flat.mix(keys[a:b]), k, shared):
                    for path, value in found:
                        edges.append(path.edges)
                        n_edges.append(len(path.edges))
                        logp.append(path.logp)
                        perturbed.append(value)
                        x = path.logp - rest
                        inclusion.append(0.0 if x > 40 else x if x < -40 else math.log(-math.expm1(-math.exp(x))))
                    rows.append(rows[-1] + len(found))
                flat_edges = np.concatenate([*edges, np.zeros(0, np.int64)]).astype(np.int64)
                ids, count = piece_ids(v, lat, flat_edges)
                stops = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(n_edges)]).astype(np.int64)]
                good = decodes(ids, stops, np.repeat(np.arange(b - a), np.diff(rows)), part)
                samples = pa.StructArray.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(ids)), pa.array(logp, pa.float64()), pa.array(perturbed, pa.float64()), pa.array(inclusion, pa.float64())],
                    fields=list(sample_type),
                )
                kept = [batch.column(i).slice(a, b - a) for i in range(len(schema))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.ListArray.from_arrays(pa.array(rows, pa.int32()), samples), pa.array(good)],
                    names=[*schema.names, "samples", "round_trip"],
                )
            flat.release()

    key = F.coalesce(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(0).cast("long"))
    return docs.select(*keep, key.alias("__key"), F.col(text_col).alias("__text")).mapInArrow(run, out)

