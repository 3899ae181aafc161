"""Language identification with spans: script ranges, per-word scores, Viterbi with a switching penalty.

Training counts byte trigrams and whole words of a bounded sample of labelled
texts per language.  A word's script (from the ranges of its letters) narrows
the candidate languages to those that were seen in that script; each candidate
gets the word's log-likelihood, and Viterbi over the words, with a penalty per
change of language, labels spans of mixed texts.  A text's language is the one
whose spans hold most of its letters.

How well a text fits is a figure of its own: the log-likelihood of its trigrams
under the languages of its spans, between that of equally likely trigrams (0)
and that of the training texts (1).  Words in a script that no language uses
count 0, letters beside digits not at all, so text of an unlearned language has a language that scores best, but
a low fit.

Most texts have one language.  For those the best constant labelling is proved
optimal without running Viterbi: if no stretch of words gains more than half a
penalty by another language, no path with a switch can win.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import flat

UND = "und"
TRIGRAM_BITS = 15
WORD_BITS = 17
#: Labelled texts of a language that the model is fitted on (at most, all languages together: this times their number).
SAMPLE_PER_LANG = 1500

#: Scripts by the lead byte of a letter's UTF-8 sequence (ranges of code points).
SCRIPTS = ("none", "latin", "greek", "cyrillic", "armenian-hebrew", "arabic", "indic", "other-e1", "kana-cjk-marks", "cjk", "hangul", "rest")
SCRIPT_OF = np.zeros(256, dtype=np.uint8)
for _s, _ranges in {
    1: [(0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xCD)],
    2: [(0xCE, 0xCF)],
    3: [(0xD0, 0xD4)],
    4: [(0xD5, 0xD7)],
    5: [(0xD8, 0xDF)],
    6: [(0xE0, 0xE0)],
    7: [(0xE1, 0xE1)],
    8: [(0xE3, 0xE3)],
    9: [(0xE4, 0xE9)],
    10: [(0xEA, 0xED)],
    11: [(0xEE, 0xF4)],
}.items():
    for _a, _b in _ranges:
        SCRIPT_OF[_a : _b + 1] = _s


@dataclass
class Model:
    langs: list[str]
    trigrams: np.ndarray  # (2^TRIGRAM_BITS, langs) log-likelihoods, centred
    words: np.ndarray  # (2^WORD_BITS, langs), centred; 0 where unseen
    allowed: np.ndarray  # (scripts, langs)
    prior: int  # most frequent language of the sample
    level: np.ndarray  # (2^TRIGRAM_BITS) what centring took off the trigrams
    usual: np.ndarray  # (langs) mean log-likelihood of a trigram of the training texts


#: Log-likelihood of a trigram where all are equally likely.
CHANCE = -TRIGRAM_BITS * float(np.log(2))


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters or spaces, starts, ends): runs of letters; signs written as C2 xx or E2 xx xx count as spaces."""
    letter = SCRIPT_OF[raw] > 0
    letter |= (raw >= 0x80) & (raw < 0xC0)
    for lead, width in ((0xC2, 2), (0xE2, 3)):
        at = np.flatnonzero(raw == lead)
        for k in range(width):
            letter[at + k] = False  # a lead byte is never among the last bytes: a space follows each text
    c = np.where(letter, raw, np.uint8(32))
    starts, ends = flat.runs(letter)
    return c, starts, ends


def _trigram_ids(c: np.ndarray) -> np.ndarray:
    """Of the trigram around each byte but the first and last."""
    x = c.astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - TRIGRAM_BITS)


def fit(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    index = {x: i for i, x in enumerate(names)}
    tri = np.zeros((1 << TRIGRAM_BITS, len(names)))
    words = np.zeros((1 << WORD_BITS, len(names)))
    scripts = np.zeros((len(SCRIPTS), len(names)))
    n = np.zeros(len(names))
    for text, lang in zip(texts, langs, strict=True):
        k = index[lang]
        raw, _ = flat.spaced(pc.utf8_lower(pa.array([text], pa.large_string())))
        c, a, b = _words(raw)
        n[k] += 1
        if not len(a):
            continue
        ids = _trigram_ids(c)[np.flatnonzero(c[1:-1] != 32)]
        tri[:, k] += np.bincount(ids, minlength=len(tri))
        words[:, k] += np.bincount((flat.span_hashes(raw, a, b) >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=len(words))
        scripts[:, k] += np.bincount(SCRIPT_OF[raw[a]], minlength=len(SCRIPTS))

    def logs(counts: np.ndarray, smooth: float) -> np.ndarray:
        return np.log((counts + smooth) / (counts.sum(axis=0) + smooth * len(counts)))

    def centred(counts: np.ndarray, smooth: float) -> np.ndarray:
        p = logs(counts, smooth)
        return (p - p.mean(axis=1, keepdims=True)).astype(np.float32)

    seen = words.sum(axis=1, keepdims=True) > 1
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    p = logs(tri, 0.5)
    usual = (tri * p).sum(axis=0) / np.maximum(tri.sum(axis=0), 1)
    return Model(
        names, centred(tri, 0.5), np.where(seen, centred(words, 0.5), np.float32(0)), share > 0.005, int(n.argmax()) if names else -1,
        p.mean(axis=1).astype(np.float32) if names else np.zeros(len(tri), np.float32), np.maximum(usual, CHANCE + 1e-3),
    )


def word_scores(model: Model, raw: np.ndarray, orig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, trigrams, letters, scores, fits): of each word, its start, its trigrams (none in a code), its letters, and per language a log-likelihood and
    how far its trigrams are from chance to the usual (summed over the trigrams; 0 in a script the language does not use)."""
    c, a, b = _words(raw)
    if not len(a):
        return a, a, a, np.zeros((0, len(model.langs)), np.float32), np.zeros((0, len(model.langs)), np.float32)
    scores = np.empty((len(a), len(model.langs)), dtype=np.float32)
    fits = np.empty_like(scores)
    step = 1 << 18  # words at a time
    for i in range(0, len(a), step):
        s, e = a[i : i + step], b[i : i + step]
        lo, hi = s[0], e[-1]
        ids = _trigram_ids(c[lo - 1 : hi + 1])
        part = c[lo:hi] != 32
        got = model.trigrams[ids[part]]
        first = np.concatenate([[0], np.cumsum(e - s)[:-1]])
        scores[i : i + step] = np.add.reduceat(got, first, axis=0)
        level = np.add.reduceat(model.level[ids[part]], first) - (e - s) * np.float32(CHANCE)
        fits[i : i + step] = (scores[i : i + step] + level[:, None]) / (model.usual - CHANCE)
        scores[i : i + step] += model.words[(flat.span_hashes(raw[lo:hi], s - lo, e - lo) >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
    ok = model.allowed[SCRIPT_OF[raw[a]]]
    some = ok.any(axis=1, keepdims=True)
    scores = np.where(ok, scores, scores.min(axis=1, keepdims=True) - 20)
    scores[~some[:, 0]] = 0
    fits[~ok] = 0
    # letters beside a digit belong to a code (key, address, checksum) and count neither way
    code = ((raw[a - 1] >= 0x30) & (raw[a - 1] <= 0x39)) | ((raw[b] >= 0x30) & (raw[b] <= 0x39))
    fits[code] = 0
    leads = np.concatenate([[0], np.cumsum((orig < 0x80) | (orig >= 0xC0))])  # code points, not bytes
    return a, np.where(code, 0, b - a), leads[b] - leads[a], scores, fits


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best labels of each sequence of per-word scores; sequences run side by side, longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(scores)
    lens = np.array([len(scores[i]) for i in order])
    if not len(lens) or not lens[0]:
        return out
    width = scores[0].shape[1]
    # one row per (step, active sequence), step by step
    active = np.array([(lens > t).sum() for t in range(lens[0])])
    at = np.concatenate([[0], np.cumsum(active)])
    dense = np.empty((at[-1], width), dtype=np.float64)
    for k, i in enumerate(order):
        dense[at[: lens[k]] + k] = scores[i]
    came = np.empty((at[-1], width), dtype=np.int8)
    own = np.arange(width, dtype=np.int8)
    v = np.zeros((active[0], width))
    ends = np.empty(len(order), dtype=np.int8)
    for t in range(lens[0]):
        n = active[t]
        if n < len(v):
            ends[n : len(v)] = v[n:].argmax(axis=1)
            v = v[:n]
        best = v.argmax(axis=1)
        top = v[np.arange(n), best][:, None] - penalty
        stay = v >= top
        came[at[t] : at[t + 1]] = np.where(stay, own, best[:, None].astype(np.int8))
        v = np.where(stay, v, top) + dense[at[t] : at[t + 1]]
    ends[: len(v)] = v.argmax(axis=1)
    for k, i in enumerate(order):
        labels = np.empty(lens[k], dtype=np.int8)
        cur = int(ends[k])
        steps = came[at[: lens[k]] + k]
        for t in range(lens[k] - 1, -1, -1):
            labels[t] = cur
            cur = steps[t, cur]
        out[i] = labels
    return out


def label_words(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """The language index of each word, for texts with words ``bounds[i]:bounds[i + 1]``."""
    n = np.diff(bounds)
    labels = np.zeros(len(scores), dtype=np.int8)
    some = np.flatnonzero(n)
    if not len(some):
        return labels
    first = bounds[:-1][some]
    best = np.add.reduceat(scores.astype(np.float64), first, axis=0).argmax(axis=1)
    labels[:] = np.repeat(best, n[some])
    gain = scores - scores[np.arange(len(scores)), labels][:, None]
    # largest gain of a stretch of words, by language: running sum less its minimum so far inside the text
    sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(gain, axis=0, dtype=np.float64)])
    shift = np.repeat(np.arange(len(some)) * (2 * np.abs(sums).max() + 1), n[some])[:, None]
    low = np.minimum.accumulate(sums[:-1] - shift, axis=0)
    most = np.maximum.reduceat((sums[1:] - shift - low).max(axis=1), first)
    mixed = some[most > penalty / 2]
    for i, got in zip(mixed, viterbi([scores[bounds[i] : bounds[i + 1]] for i in mixed], penalty), strict=True):
        labels[bounds[i] : bounds[i + 1]] = got
    return labels


def _piece(model: Model, texts: pa.Array, penalty: float) -> tuple[list, np.ndarray, np.ndarray, pa.Array]:
    """(language or und, score, fit, spans) of each text."""
    lower = pc.utf8_lower(texts)
    raw, at = flat.spaced(lower)
    start, trigrams, letters, scores, fits = word_scores(model, raw, raw)
    bounds = np.searchsorted(start, at)
    labels = label_words(scores, bounds, penalty)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    k = len(model.langs)
    held = np.bincount(doc * k + labels, weights=letters, minlength=len(texts) * k).reshape(-1, k)
    total = held.sum(axis=1)
    pred = held.argmax(axis=1)
    score = np.where(total > 0, held.max(axis=1) / np.maximum(total, 1), 0.0)
    size = np.bincount(doc, weights=trigrams, minlength=len(texts))
    fit = np.clip(np.bincount(doc, weights=fits[np.arange(len(labels)), labels], minlength=len(texts)) / np.maximum(size, 1), 0.0, 1.0)
    latin = np.concatenate([[0], np.cumsum((raw >= 0x61) & (raw <= 0x7A))])
    sure = latin[at[1:]] > latin[at[:-1]]
    out = [model.langs[p] for p in pred]
    for i in np.flatnonzero(~sure):  # no ASCII letter: look at the characters
        if not any(map(str.isalpha, texts[int(i)].as_py())):
            out[i], score[i], fit[i] = UND, 0.0, 0.0
            bounds_i = slice(bounds[i], bounds[i + 1])
            labels[bounds_i] = -1
        elif not total[i]:
            out[i] = model.langs[model.prior]
    new = np.ones(len(labels), dtype=bool)
    new[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
    new &= labels >= 0
    head = np.flatnonzero(new)
    stop = np.minimum(np.append(head[1:], len(labels)), bounds[doc[head] + 1]) if len(head) else head
    spans = pa.StructArray.from_arrays(
        [pa.array((head - bounds[doc[head]]).astype(np.int32)), pa.array((stop - head).astype(np.int32)), pa.array([model.langs[x] for x in labels[head]], pa.string())],
        ["first_word", "n_words", "lang"],
    )
    where = np.concatenate([[0], np.cumsum(np.bincount(doc[head], minlength=len(texts)))]).astype(np.int32)
    return out, score, fit, pa.ListArray.from_arrays(pa.array(where), spans)


def training_sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_lang: int) -> list:
    """At most ``per_lang`` x languages labelled rows, chosen by a hash of the id, evenly over the languages."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        (F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) / (1 << 20)).alias("u"),
    )
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = counts.count()
    if not n_langs:
        return []
    shares = counts.select(F.col("lang").alias("__l"), (F.lit(per_lang * 1.0) / F.col("n")).alias("__share")).hint("merge" if n_langs > 10_000 else "broadcast")
    picked = labelled.join(shares, F.col("lang") == F.col("__l")).filter("u < __share").select("lang", "text", "u")
    return picked.orderBy("u").limit(per_lang * n_langs).select("lang", "text").collect()


def train(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", per_lang: int = SAMPLE_PER_LANG) -> Model:
    rows = training_sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, per_lang=per_lang)
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model, *, keep: list[str], text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred``, ``lang_score``, ``lang_fit`` and ``lang_spans``.

    ``lang_score`` is the share of the text's letters in spans of
    ``lang_pred``, whether or not they look like it; ``lang_fit`` tells how
    well the words fit the languages of their spans (0 chance, 1 as the training
    texts; 0 for text in a script that no language uses); ``lang_spans`` lists (first_word, n_words, lang).  Null
    text, or text without a letter: ``und``, score and fit 0, no spans.  Each row
    stands alone, so repeated rows agree; an empty table gives no rows.  A
    model without languages calls everything ``und``.
    """
    schema = docs.select(*keep).schema
    names = [*keep] if text_col in keep else [*keep, text_col]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "lang_pred string, lang_score double, lang_fit double, lang_spans array<struct<first_word:int,n_words:int,lang:string>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = flat.strings(batch.column(names.index(text_col)))
            for a, b in flat.pieces(texts):
                part = texts.slice(a, b - a)
                if model.langs:
                    lang, score, fit, spans = _piece(model, part, penalty)
                else:
                    lang, score, fit, spans = [UND] * (b - a), np.zeros(b - a), np.zeros(b - a), pa.array([[]] * (b - a), pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())])))
                kept = [batch.column(i).slice(a, b - a) for i in range(len(schema))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score), pa.array(fit), spans], names=[*schema.names, "lang_pred", "lang_score", "lang_fit", "lang_spans"])

    return docs.select(*names).mapInArrow(run, out)
