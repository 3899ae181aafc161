"""Spelling variants: words at one edit from each other, grouped under the most frequent spelling.

Near words come from a bit-sliced position index: for each (position, letter) a
bitset over the words of a block.  A query word is read letter by letter; sets
of the words that agree so far, and of those that differ by one replaced, one
inserted or one deleted letter, are carried along side by side as bitsets, 64
words to a machine word, and a shift of the position stands for an inserted or
deleted letter.  All queries of one length in a block run together.

Two words at one edit share the first or the last half of the shorter one, so
words meet only under such a half.  A word has four of them (it may be the
shorter or the longer one).  Halves are dealt to blocks by hash; a half with
more words than a block is cut into chunks, and each pair of chunks is a block
of its own, so no block grows and none is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.plans.materialize import bounded_broadcast, materialize

#: Letters of words: A to Z in both cases, and the Latin letters from U+00C0 to U+00FF.
RUN = r"[A-Za-zÀ-ÿ]+"
#: A document's run loses a letter where this divides its checksum.
NOISE = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: Words of a block (about), and of a chunk of a half that has more.
BLOCK_WORDS = 2048
#: A form must be so many times as frequent as its variant.
RATIO = 2
#: Rows that are broadcast at most.
BROADCAST_ROWS = 500_000


def runs(text: Column) -> Column:
    """The maximal runs of letters, only A to Z lower-cased (null text: none)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(f"({RUN})"), F.lit(1))


def noisy(run: Column, checksum: Column, divisor: int = NOISE) -> Column:
    """The run, without the letter that its checksum names where ``divisor`` divides the checksum."""
    at = (checksum % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(checksum % divisor == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough.  A null id counts as an empty one."""
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"), F.explode(runs(F.col(text_col))).alias("__run"))
    word = noisy(F.col("__run"), F.crc32(F.concat("__id", F.lit(":"), "__run")))
    return (
        each.filter(F.length("__run") >= min_length).select(word.alias("word")).filter(F.length("word") >= min_length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    )


def _halves() -> Column:
    """(a, side, half) of a word: a is the length of the shorter word of a pair, side 0 its first letters, 1 its last."""
    n = F.length("word")

    def of(a: Column) -> list[Column]:
        h = F.floor(a / 2).cast("int")
        return [
            F.struct(a.alias("a"), F.lit(0).alias("side"), F.substring(F.col("word"), F.lit(1), h).alias("half")),
            F.struct(a.alias("a"), F.lit(1).alias("side"), F.substring(F.col("word"), n - (a - h) + 1, a - h).alias("half")),
        ]

    return F.array(*of(n), *of(n - 1))


def _blocks(words: DataFrame, block_words: int) -> DataFrame:
    """(block, role, a, side, half, word, n): words under their halves; role 0 both asks and answers, 1 asks, 2 answers."""
    halves, seen = materialize(
        words.select("word", "n", F.explode(_halves()).alias("k")).select("word", "n", "k.a", "k.side", "k.half"),
        "variant-halves", {"rows": F.count(F.lit(1))},
    )
    rows = int(seen["rows"])
    key = ["a", "side", "half"]
    # at most rows / block_words halves are that large
    large = halves.groupBy(*key).agg(F.count(F.lit(1)).alias("__size")).filter(F.col("__size") > block_words)
    met = halves.join(bounded_broadcast(large, BROADCAST_ROWS, rows // block_words), key, "left")
    bins = max(1, -(-rows // block_words), 1)
    small = met.filter(F.col("__size").isNull()).select(
        F.concat(F.lit("s"), F.pmod(F.xxhash64(*key), F.lit(bins)).cast("string")).alias("block"), F.lit(0).alias("role"), *key, "word", "n")
    chunks = F.ceil(F.col("__size") / F.lit(block_words)).cast("int")
    own = F.pmod(F.xxhash64("word"), chunks).cast("int")
    cut = met.filter(F.col("__size").isNotNull()).withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    name = F.concat_ws("/", F.lit("l"), F.col("a").cast("string"), F.col("side").cast("string"), "half", low.cast("string"), high.cast("string"))
    role = F.when(F.col("__own") == F.col("__other"), 0).when(F.col("__own") == low, 1).otherwise(2)
    return small.unionByName(cut.select(name.alias("block"), role.alias("role"), *key, "word", "n"))


def _bits(mask: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, bit k of word i for column 64 i + k."""
    rows, n = mask.shape
    padded = np.zeros((rows, -(-n // 64) * 64), bool)
    padded[:, :n] = mask
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class Index:
    """Bit slices of words given as rows of code points, padded with -1."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray):
        self.n, self.width = letters.shape
        self.words = -(-self.n // 64)
        place, row = np.nonzero(letters.T >= 0)
        code = place.astype(np.int64) << 32 | letters.T[place, row]
        self.codes, which = np.unique(code, return_inverse=True)
        # slice 0 is empty: it answers for letters that no word has at a position
        self.slices = np.zeros((len(self.codes) + 1, self.words), np.uint64)
        np.bitwise_or.at(self.slices, (which + 1, row >> 6), np.uint64(1) << (row & 63).astype(np.uint64))
        self.lengths = lengths

    def at(self, place: int, letter: np.ndarray) -> np.ndarray:
        """The bitsets of the words with these letters at a position, a row for each letter."""
        if place < 0 or place >= self.width:
            return np.zeros((len(letter), self.words), np.uint64)
        code = np.int64(place) << 32 | letter
        i = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return self.slices[np.where(self.codes[i] == code, i + 1, 0)]

    def of_length(self, n: int) -> np.ndarray:
        return _bits((self.lengths == n)[None, :])[0]


def one_edit(index: Index, queries: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bitsets of the indexed words that come from the queries (rows of letters, all of one length) by one edit.

    (replaced, inserted, deleted, agreeing): an indexed word has one other, one more, one fewer letter; ``agreeing`` are
    the words whose first ``half`` letters are the query's.  The word itself is in none of the first three.
    """
    rows, m = queries.shape
    exact = np.full((rows, index.words), ~np.uint64(0))
    replaced = np.zeros((rows, index.words), np.uint64)
    inserted, deleted, agreeing = exact.copy(), replaced.copy(), exact
    hit_next = index.at(0, queries[:, 0])
    for k in range(m):
        hit, letter = hit_next, queries[:, k]
        hit_next = index.at(k + 1, queries[:, k + 1]) if k + 1 < m else None
        # one letter more: so far exact and a letter passed over, or passed over before; the position is shifted up
        inserted = inserted & index.at(k + 1, letter)
        replaced = (replaced & hit) | (exact & ~hit)
        deleted = (deleted & index.at(k - 1, letter)) | exact
        exact = exact & hit
        inserted |= exact  # the next letter of the word may be the one too many
        if k + 1 == half:
            agreeing = exact
    alike = index.of_length(m)
    return replaced & alike, inserted & index.of_length(m + 1), deleted & index.of_length(m - 1), agreeing


def _letters(words: list[str], width: int) -> np.ndarray:
    out = np.full((len(words), width), -1, np.int64)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), "<u4")
    return out


def _near_in(a: int, asks: list[int], answers: list[int], words: list[str], sides: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asking rows, answering rows) of near words under halves of words of length ``a`` and ``a + 1``."""
    own = [words[i] for i in answers]
    answer = np.array(answers)
    index = Index(_letters(own, a + 1), np.array([len(w) for w in own]))
    names, which = np.unique(keys[answer], return_inverse=True)
    under = _bits(which[None, :] == np.arange(len(names))[:, None])
    for m in (a, a + 1):
        ask = np.array([i for i in asks if len(words[i]) == m], np.int64)
        spot = np.minimum(np.searchsorted(names, keys[ask]), len(names) - 1) if len(ask) else ask
        some = names[spot] == keys[ask] if len(ask) else np.zeros(0, bool)
        ask, spot = ask[some], spot[some]
        if not len(ask):
            continue
        replaced, inserted, deleted, agreeing = one_edit(index, _letters([words[i] for i in ask], m), a // 2)
        found = (replaced | inserted if m == a else deleted) & under[spot]
        # pairs with the same first half are found there; under a last half only the others count
        found &= np.where((sides[ask] == 1)[:, None], ~agreeing, ~np.uint64(0))
        bits = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")
        x, y = np.nonzero(bits)
        yield ask[x], answer[y]


SUMMARY = "word string, n_near bigint, best_n bigint, best string"


def _summary(rows: pa.Table) -> pa.Table:
    """Of one block: for each word with near words in it, how many, and the most frequent (the first of equal ones)."""
    words, n = rows["word"].to_pylist(), rows["n"].to_numpy()
    role, a, side = (rows[c].to_numpy() for c in ("role", "a", "side"))
    keys = np.unique(np.array([f"{x}/{y}/{z}" for x, y, z in zip(a.tolist(), side.tolist(), rows["half"].to_pylist(), strict=True)]), return_inverse=True)[1]
    best: dict[str, list] = {}
    for size in np.unique(a).tolist():
        here = a == size
        turns = [(np.flatnonzero(here & (role <= 1)), np.flatnonzero(here & (role != 1)))]
        if (role == 1).any():  # two chunks: each asks the other
            turns.append((np.flatnonzero(here & (role == 2)), np.flatnonzero(here & (role == 1))))
        for asks, answers in turns:
            if not (len(asks) and len(answers)):
                continue
            for x, y in _near_in(size, asks.tolist(), answers.tolist(), words, side, keys):
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    rank = (-int(n[j]), words[j])
                    known = best.get(words[i])
                    if known is None:
                        best[words[i]] = [1, rank]
                    else:
                        known[0] += 1
                        known[1] = min(known[1], rank)
    names = list(best)
    return pa.table({
        "word": pa.array(names, pa.string()),
        "n_near": pa.array([best[w][0] for w in names], pa.int64()),
        "best_n": pa.array([-best[w][1][0] for w in names], pa.int64()),
        "best": pa.array([best[w][1][1] for w in names], pa.string()),
    })


def near_words(words: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, n_near, best, best_n) of (word, n): near words of each word, and the most frequent of them (or null).

    ``words`` is unique by word; words shorter than two letters are near nothing.
    """
    blocks = _blocks(words.filter(F.length("word") >= 2), block_words)
    found = blocks.groupBy("block").applyInArrow(_summary, SUMMARY)
    best = F.min(F.struct((-F.col("best_n")).alias("r"), F.col("best").alias("w")))
    per_word = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return words.join(per_word.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("b.w").alias("best"), (-F.col("b.r")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that is reached by following forms, which must not run in circles.

    Each round doubles the steps taken, so a chain of k forms takes log2(k) rounds.
    """
    at, _ = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "variant-roots")
    while True:
        step = at.select(F.col("word").alias("__w"), F.col("root").alias("__next"))
        ahead = at.join(step.hint("merge"), F.col("root") == F.col("__w")).select(
            "word", F.col("__next").alias("root"), (F.col("root") != F.col("__next")).alias("__moved"))
        at, seen = materialize(ahead, "variant-roots", {"moved": F.count_if("__moved")})
        at = at.drop("__moved")
        if not seen["moved"]:
            return at


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Words of all texts with the spelling that they are a variant of.

    Columns: ``word``; ``form``, its near word with the largest count (the first
    in code point order of equal ones) if that is at least ``ratio`` times the
    word's own, else null; ``root``, the last word on following forms (itself
    without one); ``n``; ``n_near``; ``form_n``.  Near are two words that differ
    by exactly one inserted, deleted or replaced code point.  Null and empty
    texts have no words; repeated rows count each time; a null id is read as an
    empty one; an empty table gives no rows; further columns are ignored.
    """
    words, _ = materialize(vocabulary(docs, id_col=id_col, text_col=text_col), "variant-words")
    near, _ = materialize(near_words(words, block_words=block_words), "variant-near")
    is_form = F.col("best_n") >= F.col("n") * ratio
    forms = near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n"))
    found = roots(forms).hint("merge")
    return forms.join(found, "word").select("word", "form", "root", "n", "n_near", "form_n")
