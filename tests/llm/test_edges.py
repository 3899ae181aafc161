"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from staylens.llm import chat, html, langid, minhash, mixing, pivots, quality, shard, unigram, warc
from staylens.llm.components import components
from staylens.plans.materialize import scratch_path
from tests.llm.test_queries import grouped, near_brute, words

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, "x"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1, "x"),
    (3, None, "en", "a", 1, None),
    (4, "", None, None, None, None),
    (5, " \n\t ", "en", "b", 1, "x"),
    (6, LONG, "en", "b", 1, "x"),
    (6, LONG, "en", "b", 1, "x"),
    (None, "a row without an id but with some words in it", "en", None, 1, "x"),
    (None, "a row without an id but with some words in it", "en", None, 1, "x"),
    (7, "12345 !!!", "en", "c", 1, "x"),
    (8, "one", "fr", "c", 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- WARC ---------------------------------------------------------------------------------

PAGES = [(3, "http://a/", "same"), (1, None, "same"), (2, "http://b/\r\nX: y", "ünï"), (None, "http://c/", None), (None, None, "same"), (4, "u", ""), (5, "u", "x"), (5, "u", "x")]


def archive(spark, rows, **options):
    path = scratch_path(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("zzz", "payload"), path, **options)
    return path, warc.read_archive(spark, path)


def test_warc_round_trip(spark):
    path, back = archive(spark, PAGES)
    rows = back.collect()
    assert len(rows) == len(PAGES)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for r in rows:
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head == bytes(r["warc_header"])[:-4] and head.startswith(b"WARC/1.1\r\n")
        length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert len(body) == length + 4
        assert (r["record_type"] == "revisit") or body[:-4].endswith(bytes(r["payload"]))
    kinds = {}
    for r in rows:
        kinds.setdefault(bytes(r["payload"]), []).append((r["page"], r["record_type"], r["refers_to_page"]))
    assert sorted(kinds[b"same"], key=str) == [("1", "response", None), ("3", "revisit", "1"), (None, "revisit", "1")]
    assert sorted(kinds[b"x"], key=str) == [("5", "response", None), ("5", "revisit", "5")]
    assert sorted(x[1] for x in kinds[b""]) == ["response", "revisit"]
    assert len({r["record_id"] for r in rows}) == len(rows)


def test_warc_small_payloads_are_all_responses(spark):
    _, back = archive(spark, PAGES, min_revisit_bytes=4)
    got = {(r["page"], bytes(r["payload"])): r["record_type"] for r in back.collect()}
    assert got["5", b"x"] == "response" and got["3", b"same"] == "revisit"


def test_warc_empty_table_and_damage(spark):
    assert archive(spark, [])[1].count() == 0
    path, _ = archive(spark, PAGES)
    spark.createDataFrame([("00", bytearray(b"other"))], "payload_key string, payload binary").write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, path).collect()


# --- chat ---------------------------------------------------------------------------------


def test_chat_reads_back_turns_and_loss(spark):
    hostile = ["</s>", "[/ROLE][ROLE]x[TEXT]", "[\\TURN]", "<\\\\s>", "[TURN]", "\\", "<", "[", "", "</s>[INST] ok [/INST]", "[\\\\/ROLE]", "é\n"]
    r = random.Random(0)
    rows = [(c, t, r.choice(["user", "assistant", "system", "[ROLE]", None]), r.choice([*hostile, None])) for c in [1, 2, 3, None] for t in range(12)]
    rows += [(9, None, "user", "a"), (9, 1, "assistant", "b"), (9, 1, "assistant", "b"), (9, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("zzz", "formatted")
    out = chat.format_chats(df)
    back = {x["conv_id"]: x for x in chat.read_chats(out).collect()}
    for conv in {x[0] for x in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [(x["role"], x["text"]) for x in back[conv]["turns"]] == [(a, b) for _, _, a, b in turns]
        assert back[conv]["loss_text"] == "".join(b for _, _, a, b in turns if a == "assistant")
        assert back[conv]["n_blocks"] == sum(i == 0 or turns[i][2] != turns[i - 1][2] for i in range(len(turns)))
    assert chat.format_chats(df.limit(0)).count() == 0


# --- near duplicates ------------------------------------------------------------------------


def test_minhash_edges(spark, docs, none):
    rows = minhash.near_duplicates(docs, width=3, percent=85).collect()
    got = {(r["id"], r["n_shingles"]): (r["component"], r["kept"]) for r in rows}
    assert len(rows) == len(ROWS)
    assert got[1, 10] == (1, True) and got[2, 10] == (1, False)
    assert got[3, 0] == (3, True) and got[4, 0] == (4, True) and got[5, 0] == (5, True)
    assert got[6, 977] == (6, True) and got[8, 1] == (8, True)
    assert got[None, 9] == (None, True)
    assert minhash.near_duplicates(none, width=3, percent=85).count() == 0
    kept = minhash.deduplicated(docs, width=3, percent=85)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "8", "None"]


def test_minhash_pieces_of_fewer_words_than_a_shingle(spark):
    import pyarrow as pa

    for width in (3, 5):
        for n in range(8):
            sets, bounds = minhash.shingle_sets(pa.array([" ".join("abcdefgh"[:n])], pa.large_string()), width)
            whole, at = minhash.shingle_sets(pa.array([" ".join("abcdefgh"[:n]), LONG], pa.large_string()), width)
            assert bounds.tolist() == [0, min(1, n) if n < width else n - width + 1] and sets.tolist() == whole[: at[1]].tolist()
    rows = spark.createDataFrame([(1, "two words"), (2, "Two words"), (3, "now three words")], "doc_id long, text string").repartition(3, "doc_id")
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in minhash.near_duplicates(rows, width=5, percent=80).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3)}


def edited(base, rate, r):
    return " ".join(w if r.random() > rate else f"new{r.randrange(10**6)}" for w in base)


@pytest.mark.parametrize("chunk", [4, 2048])
def test_minhash_group_of_near_copies_equals_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK_ROWS", chunk)
    r = random.Random(chunk)
    bases = [[f"w{r.randrange(400)}" for _ in range(150)] for _ in range(2)]
    rows = [(i, edited(bases[i % 2], r.random() * 0.06, r)) for i in range(60)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert {x["id"]: (x["n_shingles"], x["component"], x["kept"]) for x in got} == near_brute(rows, 3, 85)


def test_shingles_and_signature_estimate():
    sets, bounds = minhash.shingle_sets(pa.array(["a B  c\nd", "A b c d", "x", "", "É b"], pa.large_string()), 3)
    assert np.diff(bounds).tolist() == [2, 2, 1, 0, 1]
    assert (sets[:2] == sets[2:4]).all()
    r = np.random.default_rng(0)
    both, own = r.integers(0, 2**63, 700, dtype=np.uint64), [r.integers(0, 2**63, 300, dtype=np.uint64) for _ in range(2)]
    x = [np.sort(np.concatenate([both, o])) for o in own]
    sig = minhash.signatures(np.concatenate(x), np.array([0, 1000, 2000]), 1024 // 4)
    assert abs((sig[0] == sig[1]).mean() - 700 / 1300) < 0.1


def test_signature_equals_plain_superminhash():
    r = np.random.default_rng(1)
    for n in (1, 3, 40, 400):
        items, places = r.integers(0, 2**63, n, dtype=np.uint64), 20
        want = [2**63 - 1] * places
        for x in items:
            perm = list(range(places))
            for step in range(places):
                h = int(minhash.flat.mix(np.array([x]) + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))[0])
                k = step + ((h >> 32) * (places - step) >> 32)
                perm[step], perm[k] = perm[k], perm[step]
                want[perm[step]] = min(want[perm[step]], step << 32 | (h & 0xFFFFFFFF))
        assert minhash.signatures(items, np.array([0, n]), places)[0].tolist() == want


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    want = grouped([(a, b) for a, b in links if a is not None], {x for p in links if p[0] is not None for x in p})
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] and p[0] is not None for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings -----------------------------------------------------------------------------


def embeddings_brute(rows):
    ok = [v is not None and l is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    unit = [np.array(v, float) / np.abs(v).max() / np.linalg.norm(np.array(v, float) / np.abs(v).max()) if o else None for (_, v, _), o in zip(rows, ok)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    comp = grouped([(rows[i][0], rows[j][0]) for i, j in links], {i for i, _, _ in rows})
    return [(i, sum(k in p for p in links), comp[i], comp[i] == i) for k, (i, _, _) in enumerate(rows)]


@pytest.mark.parametrize(("block", "chunk", "broadcast"), [(4, 3, 0), (16, 8, 500_000), (1024, 512, 500_000)])
def test_embeddings_equal_all_pairs(spark, monkeypatch, block, chunk, broadcast):
    for name, value in {"BLOCK": block, "CHUNK": chunk, "BROADCAST_ROWS": broadcast}.items():
        monkeypatch.setattr(pivots, name, value)
    r = np.random.default_rng(0)
    rows, base = [], r.normal(size=(6, 32))
    for i in range(600):
        v = r.normal(size=32) if i % 2 else base[i % 6] + r.normal(size=32) * 0.12
        rows.append((i, [float(x) for x in v], int(i % 3)))
    rows += [(1000, None, 1), (1001, [0.0] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, [1.0, None], 1), (1004, [], 1), (1005, rows[0][1], None)]
    rows += [(1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, [1e300, 2e300], 1), (1009, rows[2][1], rows[2][2]), (1010, rows[2][1], rows[2][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(x) for x in pivots.near_embeddings(df).collect())
    assert got == sorted(embeddings_brute(rows))
    if block < 1024:
        return
    assert pivots.near_embeddings(df.limit(0)).count() == 0
    assert sorted(tuple(x) for x in pivots.near_embeddings(df.withColumn("embedding", F.col("embedding").cast("array<float>"))).collect() if x[0] < 1000) == [
        x for x in got if x[0] < 1000]
    with pytest.raises(ValueError):
        pivots.near_embeddings(df, shared_pivots=2)


def test_embedding_postings_meet_once_at_any_block_size(spark, monkeypatch):
    """Every pair that shares enough pivots meets in exactly one block, however lists are cut."""
    r = np.random.default_rng(1)
    lists = [sorted(r.choice(12, size=7, replace=False).tolist()) for _ in range(80)] + [[0, 1, 2, 3, 4, 5, 6]] * 20
    df = spark.createDataFrame([(i, i % 2, x) for i, x in enumerate(lists)], "rep long, group long, pivots array<smallint>")
    want = sorted((i, j) for i in range(100) for j in range(i) if i % 2 == j % 2 and len(set(lists[i]) & set(lists[j])) >= 4)
    for block, chunk in ((2, 2), (10, 5), (1000, 500)):
        monkeypatch.setattr(pivots, "BLOCK", block)
        monkeypatch.setattr(pivots, "CHUNK", chunk)
        rows = pivots._postings(df, 4).toPandas()
        found = []
        for key, t in rows.groupby(pivots.KEY):
            side = (t["chunk"] != key[4]).to_numpy() if key[4] != key[5] else None
            pairs = pivots.meeting(np.array(key[1:4]), side, np.stack(t["pivots"].to_numpy()), 4)
            reps = t["rep"].to_numpy()
            found += [(max(reps[x], reps[y]), min(reps[x], reps[y])) for x, y in zip(*np.nonzero(np.triu(pairs)))]
        assert sorted(found) == want


# --- languages ------------------------------------------------------------------------------


def test_language_spans_and_edges(spark, docs, none):
    r = random.Random(0)
    vocab = {"aa": ["tok", "rak", "mik", "sor"], "bb": ["éla", "üno", "öti", "ébe"], "cc": ["слово", "дом", "мир", "лес"]}
    say = lambda lang, n: " ".join(r.choice(vocab[lang]) for _ in range(n))
    model = langid.fit([say(k, 60) for k in vocab for _ in range(5)], [k for k in vocab for _ in range(5)])
    mixed = say("aa", 30) + ". " + say("bb", 40) + "! " + say("cc", 20)
    rows = spark.createDataFrame([(1, mixed), (2, None), (3, "12 34 …"), (4, say("cc", 1)), (5, "漢字"), (6, "")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in langid.identify(rows, model, keep=["doc_id"]).collect()}
    spans = [tuple(s) for s in got[1]["lang_spans"]]
    assert [(s[2], s[1]) for s in spans] == [("aa", 30), ("bb", 40), ("cc", 20)]
    assert [got[i]["lang_pred"] for i in (2, 3, 6)] == ["und"] * 3 and got[4]["lang_pred"] == "cc" and got[5]["lang_pred"] in vocab
    assert langid.identify(docs, langid.train(docs), keep=docs.columns).count() == len(ROWS)
    empty = langid.identify(none, langid.train(none), keep=["doc_id"])
    assert empty.count() == 0
    assert {x["lang_pred"] for x in langid.identify(docs, langid.train(none), keep=["doc_id"]).collect()} == {"und"}


def test_language_stage_drops_what_no_language_fits(spark, small_sf):
    import corpus_pipeline

    r = random.Random(1)
    given = spark.read.parquet(f"{small_sf}/documents.parquet")
    text = {}
    for x in given.orderBy("doc_id").collect():
        if len(x["text"] or "") > 600:
            text.setdefault(x["lang"], x["text"][:600])
    planted = {
        -1: "все люди рождаются свободными и равными в своем достоинстве и правах " * 5,
        -2: "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια " * 5,
        -3: "人人生而自由 在尊严和权利上一律平等 " * 5,
        -4: "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw " * 5,
        -5: " ".join("".join(r.choice("qwertyuiopasdfghjklzxcvbnm") for _ in range(6)) for _ in range(60)),
        -6: "12 34 !!",
        -7: "\n".join(text.values()),
        -8: text["de"],
    }
    assert len(text) == 4
    rows = spark.createDataFrame([(i, t, None, "planted", len(t)) for i, t in planted.items()], given.schema)
    kept = {x["doc_id"] for x in corpus_pipeline.language_id(spark, given.unionByName(rows), small_sf).collect()}
    assert {i for i in planted if i in kept} == {-7, -8}
    assert {x["doc_id"] for x in given.collect()} <= kept


def test_viterbi_bound_equals_plain_viterbi():
    r = np.random.default_rng(0)
    for _ in range(60):
        lens = r.integers(0, 40, 5)
        scores = r.normal(0, 2, (lens.sum(), 3)).astype(np.float32)
        bounds = np.concatenate([[0], np.cumsum(lens)])
        got = langid.label_words(scores, bounds, 4.0)
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            v, back = scores[a].astype(float), []
            for t in range(a + 1, b):
                move = v[None, :] - 4.0 * (1 - np.eye(3))
                back.append(move.argmax(axis=1))
                v = move.max(axis=1) + scores[t]
            value = sum(scores[a + i, x] for i, x in enumerate(got[a:b])) - 4.0 * (got[a + 1 : b] != got[a : b - 1]).sum()
            assert abs(value - v.max()) < 1e-3


# --- quality --------------------------------------------------------------------------------


def repeat_brute(ws, k=8):
    from collections import Counter

    wins = [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]
    n = Counter(wins)
    return len({j for i, w in enumerate(wins) if n[w] > 1 for j in range(i, i + k)})


def test_quality_counts_and_edges(spark, docs, none):
    r = random.Random(0)
    texts = [" ".join(r.choice("ab") for _ in range(n)) for n in (7, 8, 9, 15, 16, 17, 40, 80)] + ["a " * 30, "p q r s t u v w " * 2 + "x", None, "", "a\n \na\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in quality.quality_cascade(df, all_counts=True).collect():
        ws = words(x["text"])
        lines = [y for y in (x["text"] or "").split("\n") if words(y)]
        assert (x["__n_words"], x["__n_repeat_words"], x["__n_dup_lines"]) == (len(ws), repeat_brute(ws), len(lines) - len(set(lines)))
    lazy = {x["doc_id"]: x["__kept"] for x in quality.quality_cascade(df).collect()}
    assert lazy == {x["doc_id"]: x["__kept"] for x in quality.quality_cascade(df, all_counts=True).collect()}
    assert quality.quality_cascade(docs).filter("__kept").count() <= len(ROWS)
    assert quality.quality_cascade(none).count() == 0


def test_cascade_orders_by_rejection_per_cost():
    assert quality.cascade_order({"a": (1.0, 0.5), "b": (0.1, 0.1), "c": (0.1, 0.2), "d": (5.0, 0.0)}) == ["c", "b", "a", "d"]


# --- segmentations --------------------------------------------------------------------------


def tiny_vocabulary():
    pieces = [b"", *[bytes([i]) for i in range(256)], b" ", b"a", b"b", b"ab", b" a", b"ba", b" ab", "é".encode()]
    usable = np.array([False] * 257 + [True] * 8)
    return unigram.build(pieces, np.arange(len(pieces), dtype=float), usable, np.arange(1, 257, dtype=np.int32), 1.0)


def all_segmentations(v, raw):
    """(ids, weight) of every tiling of a text's bytes, by recursion."""
    if not raw:
        return [((), 0.0)]
    out, char = [], raw.decode()[0].encode()
    for i in range(257, len(v.pieces)):
        if raw.startswith(v.pieces[i]):
            out += [((i, *rest), v.weights[i] + w) for rest, w in all_segmentations(v, raw[len(v.pieces[i]) :])]
    if char not in v.pieces[257:]:
        ids = tuple(int(v.byte_ids[b]) for b in char)
        out += [((*ids, *rest), v.byte_weight * len(char) + w) for rest, w in all_segmentations(v, raw[len(char) :])]
    return out


@pytest.mark.parametrize("text", ["ab ba", "abab", "é\nab", "ab  b"])
def test_samples_are_top_k_without_replacement(text):
    v = tiny_vocabulary()
    every = dict(all_segmentations(v, (" " + text).encode()))
    total = np.log(np.sum(np.exp(list(every.values()))))
    p = {ids: np.exp(w - total) for ids, w in every.items()}
    first, pairs, n = {}, {}, 4000
    for found, rest, lat in unigram.sample_texts(v, pa.array([text] * n, pa.large_string()), unigram.flat.mix(np.arange(n, dtype=np.uint64)), 3):
        ids = [tuple(int(x) for x in unigram.piece_ids(v, lat, path.edges)[0]) for path, _ in found]
        assert len(set(ids)) == len(ids) == min(3, len(p))
        assert all(abs(path.logp - np.log(p[i])) < 1e-9 for i, (path, _) in zip(ids, found))
        values = [g for _, g in found] + [rest]
        assert values == sorted(values, reverse=True)
        first[ids[0]] = first.get(ids[0], 0) + 1
        pairs[ids[:2][0], ids[1]] = pairs.get((ids[0], ids[1]), 0) + 1
    for ids, q in p.items():
        assert abs(first.get(ids, 0) / n - q) < 4.5 * np.sqrt(q * (1 - q) / n) + 1e-3
    for (a, b), c in pairs.items():  # without replacement: p(a) p(b) / (1 - p(a))
        q = p[a] * p[b] / (1 - p[a])
        assert abs(c / n - q) < 4.5 * np.sqrt(q * (1 - q) / n) + 1e-3


def test_all_segmentations_listed_where_few():
    v = tiny_vocabulary()
    (found, rest, _), = list(unigram.sample_texts(v, pa.array(["a"], pa.large_string()), np.array([1], np.uint64), 10))
    assert len(found) == 2 and rest == -np.inf


def test_encode_edges(spark, docs, none):
    v = unigram.load("/opt/tokenizers/piece_bpe_32k.model")
    rows = unigram.encode(docs, v, k=3, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(ROWS) and all(r["round_trip"] for r in rows)
    for r in rows:
        assert (len(r["samples"]) > 0) == bool(r["text"])
        assert all(unigram.decode(v, s["ids"]) == r["text"] and s["log_inclusion"] <= 0 for s in r["samples"])
    assert [r["samples"] for r in rows if r["doc_id"] == 6][0] == [r["samples"] for r in rows if r["doc_id"] == 6][1]
    assert unigram.encode(none, v, keep=["doc_id"]).count() == 0


# --- pages ----------------------------------------------------------------------------------


@pytest.mark.parametrize("page, texts", [
    ("", []),
    ("plain", ["plain"]),
    ("<p>a<p>b &amp; c&nbsp;d<br>e</p><script>x('</p>')</script><style>p{}</style><!-- no --><i>f</i>g", ["a", "b & c d e", "fg"]),
    ("<title>t</title><noscript>n</noscript><textarea><b>x</b></textarea>", ["t", "<b>x</b>"]),
    ("a < b <em>c</em> <img alt='>'> d <unclosed", ["a < b c d"]),
    ("<script>never closed", []),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
])
def test_blocks(page, texts):
    assert [b.text for b in html.blocks(page)] == texts


@pytest.mark.parametrize("page, texts", [
    ("<html><head><title>t</title><meta charset=x><body><p>a</p><p>b</p></body></html>", ["a", "b"]),
    ("<head><script>x</script><style>y</style><link rel=z><div>a</div>b", ["a", "b"]),
    ("<head><title>t</title>\n  plain <i>words</i>", ["plain words"]),
    ("<head><noscript><link><body><p>a", ["a"]),
    ("<head><head><title>t</title></head><p>a", ["a"]),
    ("<head><base><img src=x>a<p>b", ["a", "b"]),
    ("<head>\n<title>t</title><template><p>x</p></template><noscript><p>n</p></noscript>\n</head><body>a", ["a"]),
])
def test_head_without_end_tag(page, texts):
    assert [b.text for b in html.blocks(page)] == texts


def test_labeller_on_unseen_layouts_and_edges(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(r.randint(3, 40))) + "." for _ in range(200)]
    model = html.fit([html.layout(texts, r) for _ in range(500)], epochs=6)
    tests = [html.layout(texts, r) for _ in range(120)]
    right = [((p >= 0.5) == y).mean() for p, (b, y) in zip(html.predict(model, [b for b, _ in tests]), tests) if b]
    assert np.mean(right) > 0.97
    page = "<nav><a href=/>Home</a></nav><article><h1>T</h1><p>One two three four.</p><p>Five six seven.</p></article><div class=comments><p>Nice.</p></div><footer>&copy; x</footer>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, page)], "page_id long, html string")
    got = {x["page_id"]: x["main_text"] for x in html.extract(rows, model, keep=["page_id"]).collect()}
    assert got == {1: "T One two three four. Five six seven.", 2: "", 3: "", 4: got[1]}
    assert html.extract(rows.limit(0), model, keep=["page_id"]).count() == 0


def test_gradients():
    r = random.Random(1)
    pages = [html.layout(["alpha beta gamma.", "delta"], r) for _ in range(3)]
    f, y, lens = html.features([b for b, _ in pages]), np.concatenate([y for _, y in pages]), [len(b) for b, _ in pages]
    m = html.new_model()
    _, g = html.gradients(m, f, lens, y)
    for k in m:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = m[k][at]
        m[k][at] = old + 1e-5
        up = html.gradients(m, f, lens, y)[0]
        m[k][at] = old - 1e-5
        down = html.gradients(m, f, lens, y)[0]
        m[k][at] = old
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6 + 1e-4 * abs(g[k][at])


def test_shared_lattices_leave_samples_as_they_are(monkeypatch):
    from staylens.llm.registry import PIECE_MODEL

    v = unigram.load(PIECE_MODEL)
    rng = random.Random(9)
    pool = ["alpha", "beta", "gamma delta", "\n", "naïve", "漢字", "  two", "x" * 30, ""]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(60)]
    keys = unigram.flat.mix(np.arange(len(texts), dtype=np.uint64))

    def samples(size, shared):
        out = []
        for i in range(0, len(texts), size):
            part = pa.array(texts[i : i + size], pa.large_string())
            for found, rest, lat in unigram.sample_texts(v, part, keys[i : i + size], 3, shared):
                out.append(([(unigram.piece_ids(v, lat, p.edges)[0].tolist(), p.logp, x) for p, x in found], rest))
        return out

    whole = samples(len(texts), None)
    assert samples(1, unigram.Shared(v)) == whole and samples(7, unigram.Shared(v)) == whole
    monkeypatch.setattr(unigram, "SHARED_BYTES", 20)
    small = unigram.Shared(v)
    assert samples(4, small) == whole and len(small.lat.raw) <= 20


def test_sampling_keeps_its_memory():
    import tracemalloc

    from staylens.llm.registry import PIECE_MODEL

    v = unigram.load(PIECE_MODEL)
    rng = random.Random(4)
    pool = ["".join(rng.choices("etaoinshrdlu", k=9)) for _ in range(80_000)]  # more than a task keeps
    texts = pa.array([" ".join(rng.choices(pool, k=1000)) for _ in range(300)], pa.large_string())
    keys = unigram.flat.mix(np.arange(len(texts), dtype=np.uint64))
    tracemalloc.start()
    shared = unigram.Shared(v)
    for a, b in unigram.flat.pieces(texts, unigram.PIECE_BYTES):
        assert all(len(found) == 2 for found, _, _ in unigram.sample_texts(v, texts.slice(a, b - a), keys[a:b], 2, shared))
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(shared.lat.raw) > unigram.SHARED_BYTES - 100
    assert peak < 100e6, (held, peak)


def test_units_are_added_behind_the_shared_ones():
    from staylens.llm.registry import PIECE_MODEL

    v = unigram.load(PIECE_MODEL)
    raw = np.frombuffer(" naïve 漢字 alpha\n".encode(), np.uint8)
    ends = np.array([7, 14, 20, 21])
    starts = np.append(0, ends[:-1])
    whole, store = unigram.lattice(v, raw, starts, ends), unigram.Store()
    store.add(unigram.lattice(v, raw[:7], starts[:1], ends[:1]))
    mark = store.mark
    for _ in range(2):  # what lies behind the mark is given up
        store.back(mark)
        for a, b in zip(starts[1:], ends[1:]):
            store.add(unigram.lattice(v, raw[a:b], np.array([0]), np.array([b - a])))
        got = store.lattice()
        assert bytes(got.raw) == bytes(raw) and len(got.source) == len(whole.source)
        edges = lambda lat: sorted(zip(lat.source.tolist(), lat.target.tolist(), lat.piece.tolist(), lat.width.tolist(), lat.logp.tolist(), lat.cum.tolist()))
        assert edges(got) == edges(whole)
        assert all(got.source[got.first[p]] == p for p in set(got.source.tolist()))
    long = np.full(400_000, ord("e"), np.uint8)
    store.add(unigram.lattice(v, long, np.array([0]), np.array([len(long)])))
    store.back(mark)
    assert bytes(store.lattice().raw) == bytes(raw[:7]) and sum(c.nbytes for c in store.columns.values()) < 20e6


def test_decoding_is_checked_byte_by_byte():
    from staylens.llm.registry import PIECE_MODEL

    v = unigram.load(PIECE_MODEL)
    texts = pa.array(["ab c", "", "né"], pa.large_string())
    spelled = [[v.pieces.index(c.encode()) if c.encode() in v.pieces else -1 for c in t] for t in (" ab c", " né")]
    ids = np.array(spelled[0] + spelled[1])
    assert (ids >= 0).all()
    stops, owner = np.array([0, 5, 8]), np.array([0, 2])
    check = unigram.Decoder(v)
    assert check(ids, stops, owner, texts) == [True, True, True]
    assert check(ids, stops, owner, pa.array(["ab d", "", "ne"], pa.large_string())) == [False, True, False]


def test_deep_pages_take_time_in_proportion():
    import time

    model = html.new_model(seed=3)
    for deep in ("<div>word", "<b>word<p>x", "<div class=a>word</span>", "<b>", "<a><p>"):
        page = deep * 50_000 + "<p>end</p>" * 50
        t = time.perf_counter()
        found = html.blocks(page)
        assert html.predict(model, [found])[0].shape == (len(found),)
        assert time.perf_counter() - t < 30, deep
    found = html.blocks("<div>word" * 50_000)
    assert len(found) == 50_000 and len(found[-1].path) == 50_000


def test_path_means_equal_written_out_paths():
    model = html.new_model(seed=4)
    page = "bare<div class='a b'><p>one<p id=x>two<ul><li>three<li>four <a href=z>five</a></ul></div></div>six<table><tr><td>7<td>8</table>"
    found = html.blocks(page)
    written = html.features([found])
    want = html._means(model["path"], written.path, written.path_at)
    got = html.features([found], model["path"]).path
    assert np.allclose(got, want, atol=1e-12) and [b.text for b in found] == ["bare", "one", "two", "three", "four five", "six", "7", "8"]


def test_long_conversations(spark):
    from pyspark.sql import functions as F

    turns = spark.range(50_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("té </s> "), F.col("id").cast("string")).alias("text"))
    import time

    t = time.perf_counter()
    row = chat.read_chats(chat.format_chats(turns)).first()
    assert time.perf_counter() - t < 60
    assert [(x["role"], x["text"]) for x in row["turns"]] == [("assistant" if i % 3 else "user", f"té </s> {i}") for i in range(50_000)]
    assert row["loss_text"] == "".join(f"té </s> {i}" for i in range(50_000) if i % 3)


# --- mixing and shards ------------------------------------------------------------------------


def test_mixing_edges(spark, docs, none):
    plan = mixing.mix_plan(docs)
    got = {(r["doc_id"], r["source"]): r for r in plan.collect()}
    assert got[6, "b"]["n_rows"] == 2 and got[None, None]["n_rows"] == 2 and got[3, "a"]["size"] == 0
    for r in got.values():
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"] and len(r["positions"]) == r["copies"]
        assert all(0 <= t <= 1 for t in r["positions"])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["n_rows"] * r["copies"] for r in got.values())
    assert mixing.mix_plan(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mix_fills_sources_with_long_documents(spark):
    r = random.Random(4)
    sizes = {"a": [2770, *[r.randrange(5, 200) for _ in range(26)]], "b": [2065, *[r.randrange(5, 160) for _ in range(26)]],
             "c": [r.randrange(1, 40) for _ in range(400)], "d": [7] * 300, "e": [900, 800, 700] + [3] * 50}
    rows = [(f"{s}{i}", "w " * n, s) for s, ns in sizes.items() for i, n in enumerate(ns)]
    got = mixing.mix_plan(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()
    assert len(got) == len(rows)
    for s in sizes:
        mine = [x for x in got if x["source"] == s]
        target, size, taken = mine[0]["target"], mine[0]["source_size"], sum(x["taken"] for x in mine)
        assert abs(taken - target) <= 0.01 * target, (s, taken, target)
        full = int(target // size)
        assert all(x["copies"] in (full, full + 1) for x in mine)
        assert not any(x["size"] <= target - taken for x in mine if x["copies"] == full)


def test_schedule_inversion(spark):
    from pyspark.sql import functions as F

    knots = ((0.0, 0.0), (0.3, 2.0), (0.6, 0.5), (1.0, 1.0))
    t = np.linspace(0, 1, 20001)
    w = np.interp(t, *zip(*knots))
    demand = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))])
    us = np.linspace(0, 1, 41)
    df = spark.createDataFrame([(float(u),) for u in us], "u double")
    got = [r[0] for r in df.select(mixing.invert_schedule(F.col("u"), knots)).collect()]
    assert np.abs(np.array(got) - np.interp(us, demand / demand[-1], t)).max() < 1e-3


def test_shards_keep_small_groups_whole_and_cut_large_ones(spark, docs, none):
    assert shard.shard_by_bytes(none, 4).count() == 0
    got = shard.shard_by_bytes(docs, 3).collect()
    assert len(got) == len(ROWS) and {r["shard"] for r in got} <= {0, 1, 2}
    r = random.Random(0)
    rows = [(i, "x" * 100 if i % 3 == 0 else f"{r.randrange(250)} " * 20) for i in range(3000)]
    text = dict(rows)
    out = shard.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8, together=0.05).collect()
    sizes, where = np.zeros(8), {}
    for x in out:
        sizes[x["shard"]] += x["size"]
        where.setdefault(text[x["doc_id"]], set()).add(x["shard"])
    assert abs(sizes - sizes.mean()).max() < 0.05 * sizes.mean()
    assert {t for t, s in where.items() if len(s) > 1} <= {"x" * 100}


# --- pipeline -------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, small_sf, none):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_sf}/documents.parquet")
    base = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select(*base).collect()]
        out = stage(spark, docs, small_sf)
        out, _ = corpus_pipeline.materialize(out, "pipeline-test")
        rows = out.collect()
        if name != "encode":
            assert out.columns == base and {tuple(r) for r in rows} <= set(before)
        if name == "near_dedup":
            kept = {i for i, (_, _, k) in near_brute([r[:2] for r in before], 5, 80).items() if k}
            assert sorted(r["doc_id"] for r in rows) == sorted(kept)
        if name == "encode":
            assert len(rows) == len(before) and all(r["round_trip"] for r in rows)
        docs = out
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.drop("size"), small_sf).count() == 0
