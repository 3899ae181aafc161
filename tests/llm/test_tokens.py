"""Byte-level BPE and the alignment of two tokenizers, against the public libraries and plain versions."""

import base64
import hashlib
import os
import random
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from staylens.llm import align, bytebpe, flat, registry

TRICKY = [
    "it's don't we'll 'S x''s 'tis 're've'll'd'm", "''s", "!'s", " 's", "\n's", "a  b   c\n\n d \t", "   ", "\n", " ", "x\n", "　　a", "  b",
    "<|endoftext|> a<|endoftext|>", "<s> a</s>", "<0x0A>", "漢字かな交じり", "😀😀 é é", "1234²Ⅷ 12", "a" * 400, "ab" * 300, " " * 300 + "x", "'" * 99, "\x00\x1c_",
    "a▁b", "▁", "ﬁ ½", "tab\tand  two",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = list("aabsteremlldvS'' \t\n\r 　1234²Ⅷ!?.,-—é漢字😀́​\x00\x1c_") + ["  ", "'ll", "'re"]
    return TRICKY + ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]


@pytest.fixture(scope="module")
def ranks():
    return bytebpe.load(registry.BYTE_RANKS)


@pytest.fixture(scope="module")
def model():
    return bytebpe.load(registry.BYTE_MODEL)


@pytest.fixture(scope="module")
def pieces():
    return align.load_pieces(registry.PIECE_MODEL)


def library(path):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def json_library():
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(registry.BYTE_MODEL)
    t.encode_special_tokens = True
    return t


def test_slices_follow_the_pattern(ranks, texts):
    import public_tokenizers
    import regex

    column, bounds = bytebpe.slices(ranks, pa.array(texts, pa.large_string()))
    found = [x.decode() for x in column.to_pylist()]
    for i, t in enumerate(texts):
        assert found[bounds[i] : bounds[i + 1]] == regex.findall(public_tokenizers.PATTERN, t), t


def test_scan_of_any_length():
    rng = np.random.default_rng(2)
    for n in (1, 2, 127, 128, 129, 1000, 128 * 128 + 5):
        classes = rng.integers(0, 8, n).astype(np.uint8)
        first = np.unique(np.append(0, rng.integers(0, n, n // 50)))
        state, want = bytebpe.DONE, []
        for i, c in enumerate(classes.tolist()):
            state = bytebpe.DONE if i in first else state
            want.append(bool(bytebpe._CUT[c, state]))
            state = int(bytebpe._NEXT[c, state])
        assert bytebpe.cuts(classes, first).tolist() == want


def test_ids_equal_the_library(ranks, texts):
    enc = library(registry.BYTE_RANKS)
    ids, bounds = bytebpe.encode_batch(ranks, pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == enc.encode_ordinary(t), t


def test_long_slices_merge_like_short_ones(ranks, monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeéthing", k=rng.randint(2, 31))).encode()[:31] for _ in range(500)]
    short = bytebpe.merge(ranks, words)
    monkeypatch.setattr(bytebpe, "HEAP_FROM", 2)
    assert bytebpe.merge(ranks, words) == short


def test_few_slices_are_kept(ranks, texts, monkeypatch):
    monkeypatch.setattr(bytebpe, "KEPT", 50)
    small = bytebpe.Ranks(ranks.tokens, ranks.pairs, ranks.whole, ranks.classes)
    for i in range(0, len(texts), 100):
        part = pa.array(texts[i : i + 100], pa.large_string())
        assert bytebpe.encode_batch(small, part)[0].tolist() == bytebpe.encode_batch(ranks, part)[0].tolist()
    assert len(small.kept.young) + len(small.kept.old) < 2000


def test_bytebpe_query_equals_the_library(spark, small_sf):
    enc = library(registry.BYTE_RANKS)
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small_sf}/documents.parquet").collect()}
    rows = registry.op11_bytebpe(spark, small_sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = enc.encode_ordinary(text[r["doc_id"]])
        want = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), *want)


EDGES = [(1, "a b", "x"), (1, "a b", "x"), (None, "a b", None), (2, None, "x"), (3, "", "x"), (4, " \n\t ", "x"), (5, "word" * 60_000, "x"), (6, " ".join(f"w{i % 977}" for i in range(40_000)), "x")]
EDGE_SCHEMA = "doc_id long, text string, ids string"  # a column called like one of the results


def test_bytebpe_edges(spark, ranks):
    docs = spark.createDataFrame(EDGES, EDGE_SCHEMA)
    encoded = bytebpe.encode(docs, ranks, keep=["doc_id"])
    rows = encoded.collect()
    assert len(rows) == len(EDGES)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["n_tokens"] == by_id[3]["n_tokens"] == 0 and bytes(by_id[2]["ids"]) == b""
    assert bytes(by_id[None]["ids"]) == bytes(by_id[1]["ids"])
    text = {i: t or "" for i, t, _ in EDGES}
    for r in rows:  # offsets point at the tokens' bytes in the text
        ids, at = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["offsets"], "<u4")
        raw = text[r["doc_id"]].encode()
        assert all(raw[a : a + len(ranks.tokens[i])] == ranks.tokens[i] for i, a in zip(ids.tolist()[:2000], at.tolist(), strict=False))
    back = bytebpe.decode(encoded, ranks, keep=["doc_id"]).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in back) == Counter((i, (t or "").encode()) for i, t, _ in EDGES)
    gap = encoded.limit(1).withColumn("ids", F.lit(None).cast("binary"))
    assert bytebpe.decode(gap, ranks, keep=["doc_id"]).first()["decoded"] is None
    none = spark.createDataFrame([], EDGE_SCHEMA)
    assert bytebpe.decode(bytebpe.encode(none, ranks, keep=["doc_id"]), ranks, keep=["doc_id"]).count() == 0


# --- alignment --------------------------------------------------------------------------


def plain_overlaps(a, b):
    begin_a, begin_b = [0, *a[:-1]], [0, *b[:-1]]
    return [(i, j) for i in range(len(a)) for j in range(len(b)) if max(begin_a[i], begin_b[j]) < min(a[i], b[j])]


def test_merge_path_finds_all_overlaps():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n)) for _ in range(2))
        i, j, group = align.overlaps(a, b, steps=int(rng.integers(1, 9)))
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == plain_overlaps(a.tolist(), b.tolist())
        shared = sorted(set(a.tolist()) & set(b.tolist()))
        assert group.tolist() == [sum(s < min(a[x], b[y]) for s in shared) for x, y in zip(i, j, strict=True)]


def test_json_model_and_pieces_equal_the_libraries(model, pieces, texts):
    spaced = [" " + t for t in texts]
    ids, bounds = bytebpe.encode_batch(model, pa.array(spaced, pa.large_string()))
    for i, e in enumerate(json_library().encode_batch(spaced, add_special_tokens=False)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == e.ids, texts[i]
    some = [t for t in texts if t and "▁" not in t]
    assert pieces.units
    ids, bounds = pieces.encode(*flat.spaced(pa.array(some, pa.large_string())))
    for i, t in enumerate(some):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == pieces.processor.encode(t), t


def plain_alignment(rows):
    """(doc rows, links) by the libraries and loops over all pairs of neighbouring tokens."""
    a_lib = json_library()
    back = bytebpe.byte_letters()
    import sentencepiece

    b_lib = sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_MODEL)
    out = []
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        a_ids = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b_ids = b_lib.encode(text or "")
        a_bytes = [bytes(back[c] for c in a_lib.id_to_token(i)) for i in a_ids]
        b_bytes = [align.token_bytes(b_lib.id_to_piece(i)) for i in b_ids]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            out.append((doc, [], [], [], []))
            continue
        i = j = 0
        links, groups, ga, gb, end_a, end_b = [], [], [a_ids[0]], [b_ids[0]], len(a_bytes[0]), len(b_bytes[0])
        while True:
            links.append((a_ids[i], b_ids[j]))
            x, y = end_a <= end_b, end_b <= end_a
            if x and y:
                groups.append((ga, gb))
                ga, gb = [], []
            i, j = i + x, j + y
            if i == len(a_ids):
                break
            if x:
                ga.append(a_ids[i])
                end_a += len(a_bytes[i])
            if y:
                gb.append(b_ids[j])
                end_b += len(b_bytes[j])
        out.append((doc, a_ids, b_ids, groups, links))
    counts = Counter(p for *_, links in out for p in set(links))
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    result = []
    for doc, a_ids, b_ids, groups, links in out:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[p] == top[p[0]] for p in links)
        digest = hashlib.sha256(said.encode()).hexdigest() if a_ids else ""
        result.append((doc, len(a_ids), len(b_ids), len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return result


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_align_query_equals_the_libraries(spark, small_sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_sf}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.op13_align(spark, small_sf).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(plain_alignment(rows))


def test_align_edges_and_rare_pairs(spark, model, pieces, texts):
    rows = [(i, t) for i, t, _ in EDGES] + [(100 + i, t) for i, t in enumerate(TRICKY)] + [(None, None), (None, "a b")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_a string").withColumn("row", F.monotonically_increasing_id())
    found = align.align(docs, model, pieces, keep=["doc_id", "row"]).cache()
    want = Counter(plain_alignment(rows))
    for bound in (align.BROADCAST_PAIRS, 10):  # all pairs broadcast; only the frequent ones
        scores = align.link_scores(found, len(pieces.sizes), row_col="row", broadcast_pairs=bound)
        both = found.join(scores, "row", "left").fillna(0, ["n_best", "count_sum"])
        got = both.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).select(*COLUMNS)
        assert Counter(map(tuple, got.collect())) == want
    none = align.align(docs.limit(0), model, pieces, keep=["doc_id", "row"])
    assert none.count() == 0 and align.link_scores(none, len(pieces.sizes), row_col="row").count() == 0
