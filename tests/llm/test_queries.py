"""Registered queries against their SQL, or a brute-force version where SQL cannot express them."""

import itertools
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as E
from staylens.llm import registry
from staylens.plans.compare import compare


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, small_sf, duck, key):
    ok, msg = compare(registry.queries()[key](spark, small_sf), duck, registry.oracle_sql()[key])
    assert ok, msg


def test_entry_registers_every_operator_and_the_pipeline():
    names = E.queries()
    assert {n for n in range(1, 14) if any(k.startswith(f"op{n}_") for k in names)} == set(range(1, 14))
    assert "pipeline" in names


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def shingles(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def grouped(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    links = [
        (a, b) for (a, x), (b, y) in itertools.combinations(sets.items(), 2)
        if x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    return {i: (len(sets[i]), c, c == i) for i, c in grouped(links, sets).items()}


def test_minhash_query_equals_all_pairs(spark, small_sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in registry.op3_minhash(spark, small_sf).collect()}
    assert got == near_brute(rows, 3, 85)


def test_langid_query_on_held_out_documents(spark, small_sf):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small_sf}/documents.parquet").collect()}
    rows = registry.op5_langid(spark, small_sf).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_html_query_on_articles(spark, small_sf):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small_sf}/pages.parquet").collect()}
    for r in registry.op8_html(spark, small_sf).collect():
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", body))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_shard_query_law(spark, small_sf):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small_sf}/documents.parquet").collect()}
    rows = registry.op10_shard(spark, small_sf).collect()
    assert len(rows) == len(text)
    sizes, slots = np.zeros(24), {}
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert abs(sizes - sizes.mean()).max() <= max(r["size"] for r in rows) + 0.02 * sizes.mean()


def test_sampled_segmentations_decode_and_differ(spark, small_sf):
    for r in registry.op7_sentencepiece(spark, small_sf).collect():
        ids = [tuple(s["ids"]) for s in r["samples"]]
        values = [s["perturbed"] for s in r["samples"]]
        assert r["round_trip"] and len(set(ids)) == len(ids) == 2 and values == sorted(values, reverse=True)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixed_sources_meet_their_targets(spark, small_sf, sf):
    rows = registry.op9_mixing(spark, small_sf.replace("sf0.001", sf)).collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{small_sf.replace('sf0.001', sf)}/documents.parquet").select("doc_id", "source").collect()}
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())


def plain_language(model, text, penalty=12.0):
    """(language, share of letters, spans) of one text: dynamic programming over its words, one by one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from staylens.llm import flat, langid

    if not any(map(str.isalpha, text)):
        return langid.UND, 0.0, 0
    raw, _ = flat.spaced(pc.utf8_lower(pa.array([text], pa.large_string())))
    _, _, letters, scores, _ = langid.word_scores(model, raw, raw)
    value, came = [0.0] * len(model.langs), []
    for s in scores.astype(np.float64).tolist():
        best = max(range(len(value)), key=lambda k: value[k])
        back = [k if value[k] >= value[best] - penalty else best for k in range(len(value))]
        value = [max(value[k], value[best] - penalty) + s[k] for k in range(len(value))]
        came.append(back)
    label, labels = max(range(len(value)), key=lambda k: value[k]), []
    for back in reversed(came):
        labels.append(label)
        label = back[label]
    labels.reverse()
    held = [sum(n for n, x in zip(letters.tolist(), labels, strict=True) if x == k) for k in range(len(value))]
    spans = sum(i == 0 or labels[i] != labels[i - 1] for i in range(len(labels)))
    top = max(range(len(held)), key=lambda k: held[k]) if sum(held) else model.prior
    return model.langs[top], held[top] / max(1, sum(held)), spans


def test_langid_query_equals_plain_dynamic_programming(spark, small_sf):
    from staylens.llm import langid

    docs = spark.read.parquet(f"{small_sf}/documents.parquet")
    model = langid.train(docs.filter(~registry.held_out()))
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9), r["n_spans"]) for r in registry.op5_langid(spark, small_sf).collect()}
    for r in docs.collect():
        lang, score, spans = plain_language(model, r["text"] or "")
        assert got[r["doc_id"]] == (lang, round(score, 9), spans), r["doc_id"]
    assert len(got) == docs.count()


def test_language_stage_keeps_what_the_query_would(spark, small_sf):
    import corpus_pipeline
    from staylens.llm import langid

    docs = spark.read.parquet(f"{small_sf}/documents.parquet")
    model = langid.train(docs.filter(~registry.held_out()))
    fits = {r["doc_id"]: r for r in langid.identify(docs, model, keep=["doc_id"]).collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, small_sf).collect()}
    assert kept == {i for i, r in fits.items() if plain_language(model, text_of(docs, i))[0] != langid.UND and r["lang_fit"] >= corpus_pipeline.MIN_LANG_FIT}


def text_of(docs, doc_id, _texts={}):  # noqa: B006
    if not _texts:
        _texts.update({r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()})
    return _texts[doc_id]


def test_quality_stage_keeps_what_its_sql_keeps(spark, small_sf, duck):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_sf}/documents.parquet")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, small_sf).collect())
    want = duck.sql(f"SELECT doc_id FROM ({registry.oracle_sql()['op6_quality']}) WHERE kept ORDER BY doc_id").fetchall()
    assert kept == [r[0] for r in want]


def test_mixing_stage_repeats_what_its_sql_takes(spark, small_sf, duck):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_sf}/documents.parquet")
    rows = corpus_pipeline.mix_sources(spark, docs, small_sf).groupBy("doc_id").count().collect()
    want = duck.sql(f"SELECT doc_id, size, taken FROM ({registry.oracle_sql()['op9_mixing']})").fetchall()
    got = {r["doc_id"]: r["count"] for r in rows}
    assert all(got.get(i, 0) * size == taken for i, size, taken in want)
