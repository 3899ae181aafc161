"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from staylens.llm import variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def made_up(seed=3):
    """Texts of a few stems with many typos, so that near words, ties and chains of forms abound."""
    rng = random.Random(seed)
    stems = ["planet", "planer", "planner", "Straße", "ÉCOLE", "école", "aaaaa", "aaaaaa", "x" * 40, "x" * 41, "wordlike"]

    def typo(w):
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:i] + {0: "", 1: rng.choice("abcé") + w[i:], 2: rng.choice("abcé") + w[i + 1 :]}[kind] + (w[i + 1 :] if kind == 0 else "")

    rows = []
    for doc in range(300):
        words = [rng.choice(stems) for _ in range(30)]
        rows.append((doc, rng.choice([" ", "-", "1 "]).join(typo(w) if rng.random() < 0.5 else w for w in words)))
    return rows + [(None, "planet planet plante"), (None, "planet planet plante"), (7, None), (8, ""), (9, "12 !!"), (10, "plnet " * 4000)]


@pytest.mark.parametrize("block_words", [2048, 16])
def test_variants_equal_all_pairs(spark, block_words):
    rows = made_up()
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, word string, n string")
    got = {r["word"]: tuple(r) for r in variants.spelling_variants(docs, block_words=block_words).collect()}
    want = plain(rows)
    assert got == want
    assert len(got) > 100 and any(v[1] and v[2] != v[1] for v in want.values())


def test_variants_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "ab cd")], "doc_id long, text string")
    assert variants.spelling_variants(docs).count() == 0
    assert variants.spelling_variants(docs.limit(0)).count() == 0


def test_bit_slices_find_each_kind_of_edit():
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(2, 7))) for _ in range(400)})
    index = variants.Index(variants._letters(words, 8), np.array([len(w) for w in words]))
    for m in range(2, 8):
        asked = [w for w in words if len(w) == m]
        found = variants.one_edit(index, variants._letters(asked, m), 1)
        sets = [np.unpackbits(f.view(np.uint8), axis=1, bitorder="little")[:, : len(words)] for f in found]
        for q, w in enumerate(asked):
            for kind, size in ((0, m), (1, m + 1), (2, m - 1)):
                assert [words[i] for i in np.flatnonzero(sets[kind][q])] == [v for v in words if len(v) == size and one_edit(w, v)]
            assert [words[i] for i in np.flatnonzero(sets[3][q])] == [v for v in words if v[0] == w[0]]


def test_roots_follow_long_chains(spark):
    words = [f"w{i:03d}" for i in range(100)]
    forms = spark.createDataFrame([(w, words[i + 1] if i < 99 else None) for i, w in enumerate(words)], "word string, form string")
    assert {r["root"] for r in variants.roots(forms).collect()} == {"w099"}
