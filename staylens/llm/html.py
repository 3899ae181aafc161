"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between
block-level tags, each with its tag path.  A bidirectional LSTM in numpy reads,
block by block, the mean of learned vectors of the path's tags and class words,
the mean of learned vectors of the block's hashed words, and a few numbers; its
two states classify every block in the context of the whole page.

Training needs no hand labels: a bounded sample of the given pages supplies
text, from which pages of many layouts are laid out anew with known roles
(article body, menu, header, advert, sidebar, notice, form, reader comments,
footer); class names are dropped or replaced at random so that the network also
learns from structure and neighbours.
"""

from __future__ import annotations

import html as htmllib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import flat

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.DOTALL,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody "
    "td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript iframe noembed noframes template svg math object audio video canvas head".split())
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
#: What a head can hold; any other start tag, and any text, ends a head that is open.
IN_HEAD = frozenset("html title meta link base basefont bgsound script style noscript noframes template".split())
#: A start tag on the left closes an open element on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PATH_BITS, WORD_BITS = 11, 8
PATH_DIM, WORD_DIM, NUMBERS, HIDDEN_DIM = 24, 6, 6, 20
#: Pages that the labeller is fitted on (at most), laid out this many times each.
SAMPLE_PAGES, LAYOUTS = 160, 8


class Element:
    """An open element: its tag and class words, and the element around it.

    Blocks share the elements around them, so a page's paths need memory in proportion to its tags however deep they lie.
    ``sums`` keeps what ``_path_sum`` adds up, for one table.
    """

    __slots__ = ("around", "names", "size", "sums")

    def __init__(self, around: Element | None, names: tuple[str, ...]):
        self.around, self.names, self.sums = around, names, None
        self.size = len(names) + (around.size if around else 0)


@dataclass
class Block:
    inside: Element | None  # the innermost element around the text
    text: str  # references decoded, white space collapsed
    linked: float  # share of the characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        """Tags and class words from the outermost element inwards."""
        parts, at = [], self.inside
        while at:
            parts.append(at.names)
            at = at.around
        return tuple(x for names in reversed(parts) for x in names)


_TAGS: dict[str, tuple[str, ...]] = {}


def _names(name: str, rest: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role."""
    key = name + rest
    got = _TAGS.get(key)
    if got is None:
        words = {w.lower() for m in NAMED.finditer(rest) for w in WORDS.findall(m[1])} if "=" in rest else ()
        got = (name, *("." + w for w in sorted(words)))
        if len(_TAGS) > 20_000:
            _TAGS.clear()
        _TAGS[key] = got
    return got


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page that hold text, in page order."""
    out: list[Block] = []
    stack: list[Element] = []
    solid: list[int] = []  # places of block elements in the stack
    opened: dict[str, int] = {}  # open elements by tag, so that end tags without a start cost nothing
    text: list[str] = []
    links = hidden = linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            raw = "".join(text)
            words = " ".join((htmllib.unescape(raw) if "&" in raw else raw).split())
            if words:
                out.append(Block(stack[-1] if stack else None, words, min(1.0, linked / max(1, len(raw)))))
            text.clear()
        linked = 0

    def pop(n: int) -> None:
        nonlocal links, hidden
        for e in stack[n:]:
            name = e.names[0]
            links -= name == "a"
            hidden -= name in HIDDEN
            opened[name] -= 1
        del stack[n:]
        while solid and solid[-1] >= n:
            solid.pop()

    pos, end = 0, len(page)
    while pos < end:
        m = TAG.search(page, pos)
        stop = m.start() if m else end
        if stop > pos and hidden and stack[-1].names[0] == "head" and page[pos:stop].strip(" \t\n\f\r"):
            pop(len(stack) - 1)
        if stop > pos and not hidden:
            text.append(page[pos:stop])
            if links:
                linked += stop - pos
        if not m:
            break
        pos = m.end()
        if m[2] is None:
            if page.startswith("<![CDATA[", stop) and not hidden:
                text.append(page[stop + 9 : pos - 3 if page.endswith("]]>", 0, pos) else pos])
            continue
        name = m[2].lower()
        if name in BLOCK:
            flush()
        if m[1]:
            if name == "br":
                text.append(" ")
            if opened.get(name):
                i = len(stack) - 1
                while stack[i].names[0] != name:
                    i -= 1
                pop(i)
            continue
        if hidden and stack:
            if stack[-1].names[0] == "head":
                if name == "head":
                    continue
                if name not in IN_HEAD:
                    pop(len(stack) - 1)
            elif name == "body" and opened.get("head"):
                pop(next(i for i, e in enumerate(stack) if e.names[0] == "head"))
        if name in VOID:
            if name == "br" and not hidden:
                text.append(" ")
            continue
        if name in BLOCK:
            nearest = stack[solid[-1]].names[0] if solid else ""
            if nearest == "p" or nearest in CLOSES.get(name, ()):
                pop(solid[-1])
        if m[3].endswith("/>") and name in HIDDEN:
            continue
        if name in BLOCK:
            solid.append(len(stack))
        stack.append(Element(stack[-1] if stack else None, _names(name, m[3])))
        opened[name] = opened.get(name, 0) + 1
        links += name == "a"
        hidden += name in HIDDEN
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, pos)
            to = close.start() if close else end
            if not hidden and name in ("textarea", "title", "xmp"):
                text.append(page[pos:to])
            pos = to
    flush()
    return out


def _hash(token: str, bits: int) -> int:
    return (zlib.crc32(token.encode("utf-8", "surrogatepass")) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)


@dataclass
class Features:
    path: np.ndarray  # token indices, block after block; for given vectors their means instead
    path_at: np.ndarray  # where each block's indices start, and the end
    word: np.ndarray
    word_at: np.ndarray
    numbers: np.ndarray


_PATHS: dict[tuple[str, ...], list[int]] = {}


def _path_tokens(path: tuple[str, ...]) -> list[int]:
    got = _PATHS.get(path)
    if got is None:
        tags = [x for x in path if x[0] != "."]
        tokens = [*path, *("leaf " + x for x in tags[-1:]), *("two " + " ".join(tags[-2:]),), "root"]
        got = [_hash(x, PATH_BITS) for x in tokens]
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        _PATHS[path] = got
    return got


_OWN: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _own(kind: str, names: tuple[str, ...], table: np.ndarray) -> np.ndarray:
    """Sum of the vectors of an element's own tokens, or of the last tokens of a path."""
    got = _OWN.get((kind, names))
    if got is None or got[0] is not table:
        if len(_OWN) > 20_000:
            _OWN.clear()
        got = _OWN[kind, names] = (table, table[[_hash(x, PATH_BITS) for x in names]].sum(axis=0))
    return got[1]


def _path_sum(e: Element, table: np.ndarray) -> np.ndarray:
    """Sum of the vectors of all tokens from the outermost element to ``e``; each element adds to its parent's once."""
    todo = []
    while e and (e.sums is None or e.sums[0] is not table):
        todo.append(e)
        e = e.around
    total = e.sums[1] if e else 0.0
    for x in reversed(todo):
        total = total + _own("", x.names, table)
        x.sums = (table, total)
    return total


def _path_mean(e: Element | None, table: np.ndarray) -> np.ndarray:
    """The mean vector of the tokens that ``_path_tokens`` gives for the path, without writing the path out."""
    if e is None:
        return _own("end", ("two ", "root"), table) / 2
    tag = e.names[0]
    two = "two " + (e.around.names[0] + " " + tag if e.around else tag)
    return (_path_sum(e, table) + _own("end", ("leaf " + tag, two, "root"), table)) / (e.size + 3)


def features(pages: list[list[Block]], table: np.ndarray | None = None) -> Features:
    """Numbers of all blocks; with ``table`` (the paths' vectors) the mean vectors of the paths instead of their tokens."""
    path, word, path_at, word_at, numbers = [], [], [0], [0], []
    for page in pages:
        for i, b in enumerate(page):
            if table is None:
                path += _path_tokens(b.path)
                path_at.append(len(path))
            else:
                path.append(_path_mean(b.inside, table))
            ws = b.text.split()
            word += [zlib.crc32(w.encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1) for w in ws]
            word_at.append(len(word))
            stops = sum(map(b.text.count, ".!?"))
            numbers.append((np.log1p(len(ws)) / 4, b.linked, min(1.0, stops / len(ws)), i / len(page), 1.0 / (1 + i), b.text[-1] in ".!?:"))
    path = np.array(path, np.int64) if table is None else np.array(path).reshape(-1, PATH_DIM)
    return Features(path, np.array(path_at), np.array(word, np.int64), np.array(word_at), np.array(numbers, np.float64).reshape(-1, NUMBERS))


def _means(table: np.ndarray, index: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = np.diff(at)[:, None]
    return np.add.reduceat(table[index], at[:-1], axis=0) / n if len(n) else np.zeros((0, table.shape[1]))


@dataclass
class Packed:
    """Sequences side by side, longest first: step t of sequence k is row ``at[t] + k``."""

    at: np.ndarray
    ahead: np.ndarray  # row of each packed entry, reading forwards
    back: np.ndarray  # and backwards


def pack(lens: list[int]) -> Packed:
    n = np.array(lens, np.int64)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    order = np.argsort(-n, kind="stable")
    n, first = n[order], first[order]
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest), side="left")
    at = np.concatenate([[0], np.cumsum(active)])
    k = np.arange(at[-1]) - np.repeat(at[:-1], active)
    t = np.repeat(np.arange(longest), active)
    return Packed(at, first[k] + t, first[k] + n[k] - 1 - t)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def lstm(x: np.ndarray, at: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False):
    """States of packed inputs; with ``keep`` also what the backward pass needs."""
    h_dim = u.shape[0]
    z = x @ w + b
    hs = np.empty((len(x), h_dim))
    cs, gates = (np.empty((len(x), h_dim)), np.empty((len(x), 4 * h_dim))) if keep else (None, None)
    h = c = np.zeros((int(at[1]) if len(at) > 1 else 0, h_dim))
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        g = z[lo:hi] + h[: hi - lo] @ u
        g[:, : 3 * h_dim] = _sigmoid(g[:, : 3 * h_dim])
        g[:, 3 * h_dim :] = np.tanh(g[:, 3 * h_dim :])
        i, f, o, new = np.split(g, 4, axis=1)
        c = f * c[: hi - lo] + i * new
        h = o * np.tanh(c)
        hs[lo:hi] = h
        if keep:
            cs[lo:hi], gates[lo:hi] = c, g
    return hs, (cs, gates)


def lstm_back(dh_out: np.ndarray, x: np.ndarray, at: np.ndarray, w, u, hs, kept):
    """Gradients of (x, w, u, b)."""
    cs, gates = kept
    h_dim = u.shape[0]
    dz = np.empty_like(gates)
    dh = dc = np.zeros((0, h_dim))
    du = np.zeros_like(u)
    for t in range(len(at) - 2, -1, -1):
        lo, hi = at[t], at[t + 1]
        pad = hi - lo - len(dh)
        dh = np.concatenate([dh, np.zeros((pad, h_dim))]) + dh_out[lo:hi]
        dc = np.concatenate([dc, np.zeros((pad, h_dim))])
        i, f, o, new = np.split(gates[lo:hi], 4, axis=1)
        th = np.tanh(cs[lo:hi])
        dc = dc + dh * o * (1 - th * th)
        before = cs[at[t - 1] : at[t - 1] + hi - lo] if t else np.zeros((hi - lo, h_dim))
        dz[lo:hi] = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - new * new)], axis=1)
        if t:
            du += hs[at[t - 1] : at[t - 1] + hi - lo].T @ dz[lo:hi]
        dh, dc = dz[lo:hi] @ u.T, dc * f
    return dz @ w.T, x.T @ dz, du, dz.sum(axis=0)


def new_model(seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d, h = PATH_DIM + WORD_DIM + NUMBERS, HIDDEN_DIM
    model = {"path": r.normal(0, 0.5, (1 << PATH_BITS, PATH_DIM)), "word": r.normal(0, 0.5, (1 << WORD_BITS, WORD_DIM)), "out": r.normal(0, 0.1, 2 * h + d), "bias": np.zeros(1)}
    for s in ("f", "b"):
        bias = np.zeros(4 * h)
        bias[h : 2 * h] = 1
        model |= {"w" + s: r.normal(0, 1 / np.sqrt(d), (d, 4 * h)), "u" + s: r.normal(0, 1 / np.sqrt(h), (h, 4 * h)), "c" + s: bias}
    return model


def _inputs(m: dict, f: Features) -> np.ndarray:
    path = f.path if f.path.ndim == 2 else _means(m["path"], f.path, f.path_at)
    return np.concatenate([path, _means(m["word"], f.word, f.word_at), f.numbers], axis=1)


def _score(m: dict, x: np.ndarray, p: Packed, keep: bool = False):
    hs, kept = {}, {}
    states = np.empty((len(x), 2 * HIDDEN_DIM))
    for k, (s, rows) in enumerate((("f", p.ahead), ("b", p.back))):
        hs[s], kept[s] = lstm(x[rows], p.at, m["w" + s], m["u" + s], m["c" + s], keep)
        states[rows, k * HIDDEN_DIM : (k + 1) * HIDDEN_DIM] = hs[s]
    full = np.concatenate([states, x], axis=1)
    return _sigmoid(full @ m["out"] + m["bias"]), full, hs, kept


def predict(m: dict, pages: list[list[Block]]) -> list[np.ndarray]:
    """The probability of each block of each page to be main text."""
    lens = [len(x) for x in pages]
    some = [x for x in pages if x]
    if not some:
        return [np.zeros(0)] * len(pages)
    f = features(some, m["path"])
    got = _score(m, _inputs(m, f), pack([len(x) for x in some]))[0]
    return np.split(got, np.cumsum(lens)[:-1])


def gradients(m: dict, f: Features, lens: list[int], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy and its gradient."""
    p = pack(lens)
    x = _inputs(m, f)
    prob, full, hs, kept = _score(m, x, p, keep=True)
    loss = -np.mean(np.where(y, np.log(prob + 1e-12), np.log(1 - prob + 1e-12)))
    d = (prob - y) / len(y)
    g = {"out": full.T @ d, "bias": np.array([d.sum()])}
    dfull = d[:, None] * m["out"]
    dx = dfull[:, 2 * HIDDEN_DIM :].copy()
    for k, (s, rows) in enumerate((("f", p.ahead), ("b", p.back))):
        part = dfull[rows, k * HIDDEN_DIM : (k + 1) * HIDDEN_DIM]
        dxs, g["w" + s], g["u" + s], g["c" + s] = lstm_back(part, x[rows], p.at, m["w" + s], m["u" + s], hs[s], kept[s])
        dx[rows] += dxs
    for name, index, at, cols in (("path", f.path, f.path_at, slice(0, PATH_DIM)), ("word", f.word, f.word_at, slice(PATH_DIM, PATH_DIM + WORD_DIM))):
        n = np.diff(at)
        g[name] = np.zeros_like(m[name])
        np.add.at(g[name], index, np.repeat(dx[:, cols] / n[:, None], n, axis=0))
    return float(loss), g


def fit(pages: list[tuple[list[Block], np.ndarray]], *, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 0) -> dict[str, np.ndarray]:
    """Adam over (blocks, labels) pages."""
    m, r = new_model(seed), random.Random(seed)
    pages = [x for x in pages if x[0]]
    one, two, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for epoch in range(epochs):
        r.shuffle(pages)
        for i in range(0, len(pages), batch):
            part = pages[i : i + batch]
            f = features([x for x, _ in part])
            _, g = gradients(m, f, [len(x) for x, _ in part], np.concatenate([y for _, y in part]))
            step += 1
            lr = rate * (0.5 if epoch >= epochs - 2 else 1.0)
            for k, v in g.items():
                one[k] = 0.9 * one[k] + 0.1 * v
                two[k] = 0.999 * two[k] + 0.001 * v * v
                m[k] -= lr * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return m


# --- layouts for training ---------------------------------------------------------------

#: Roles around an article: elements and class words that pages commonly use for them.
ROLES = {
    "menu": (("nav", "div", "ul", "header", "menu"), "nav navbar menu navigation topnav main-menu breadcrumb breadcrumbs pagination tabs links toc"),
    "header": (("header", "div", "section"), "header site-header masthead top topbar branding logo banner hero-title page-header"),
    "advert": (("div", "aside", "section", "ins", "p", "span"), "ad ads advert advertisement adsbox sponsored sponsor promo promotion banner-ad commercial adslot"),
    "sidebar": (("aside", "div", "section"), "sidebar side-bar widget related recommended popular trending more-stories rail secondary share social tags"),
    "notice": (("div", "section", "aside", "dialog", "p"), "cookie cookies cookie-banner notice consent gdpr alert popup modal newsletter subscribe disclaimer message warning"),
    "form": (("form", "div", "fieldset"), "form search login signup search-form contact-form subscribe-form register"),
    "comments": (("section", "div", "ol", "ul"), "comments comment comment-list commentlist discussion replies respond responses reader-comments disqus"),
    "footer": (("footer", "div", "section"), "footer site-footer bottom copyright legal colophon credits page-footer"),
}
MAIN = (("article", "main", "div", "section", "td"), "article content main post entry entry-content article-body post-content story story-body text body-text main-content")


def _attrs(r: random.Random, words: str, known: float) -> str:
    if r.random() > known:
        other = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
        return r.choice(("", "", f' class="{other}"', f' id="{other}{r.randint(1, 99)}"'))
    return f' {r.choice(("class", "class", "id"))}="{r.choice(words.split())}"'


def layout(texts: list[str], r: random.Random) -> tuple[list[Block], np.ndarray]:
    """A page laid out at random from texts, and which of its blocks are the article's."""
    main_mark = "\ue000"  # marks the article\'s blocks while a page is laid out
    pick = lambda: r.choice(texts)
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    short = lambda: esc(" ".join(pick().split()[: r.randint(1, 8)]))
    para = lambda: esc(pick())
    some = lambda: para() if r.random() < 0.6 else short()

    def links(n: int) -> str:
        if r.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(n)) + "</ul>"
        return r.choice((" ", " | ", "")).join(f'<a href="/x">{short()}</a>' for _ in range(n))

    def role(kind: str) -> str:
        tags, words = ROLES[kind]
        tag = r.choice(tags)
        own = tag in ("nav", "header", "aside", "footer", "form", "menu")
        attrs = _attrs(r, words, 0.5 if own else 1.0) if own else _attrs(r, words, 1.0)
        if kind == "menu":
            body = links(r.randint(2, 8))
        elif kind == "header":
            body = r.choice((f"<h1>{short()}</h1>", f'<a href="/">{short()}</a>', f"<div>{short()}</div><p>{short()}</p>", short())) + (links(r.randint(2, 5)) if r.random() < 0.4 else "")
        elif kind == "advert":
            body = r.choice((some(), f'<a href="/x">{some()}</a>', f"<p>{some()}</p>"))
        elif kind == "sidebar":
            body = f"<h3>{short()}</h3>" * (r.random() < 0.6) + r.choice((links(r.randint(2, 6)), f"<p>{some()}</p>" * r.randint(1, 2), f"<ul><li>{short()}</li><li>{short()}</li></ul>", some()))
        elif kind == "notice":
            body = r.choice((some(), f"<p>{some()}</p>", f"<p>{some()}</p><button>{short()}</button>", f'{some()} <a href="/p">{short()}</a>'))
        elif kind == "form":
            body = f"<label>{short()}</label><input type=text>" * r.randint(1, 3) + r.choice(("", f"<select><option>{short()}<option>{short()}</select>", f"<textarea>{short()}</textarea>", f"<p>{short()}</p>")) + f"<button>{short()}</button>"
        elif kind == "comments":
            one = lambda: r.choice((f"<p>{some()}</p>", f'<div class="{r.choice(("comment", "reply", "comment-body"))}">{some()}</div>', f"<li><b>{short()}</b> <p>{some()}</p></li>", f'<article class="comment"><h4>{short()}</h4><p>{some()}</p></article>'))
            body = r.choice((f"<h3>{short()}</h3>", f"<h2>{short()}</h2>", "")) + "".join(one() for _ in range(r.randint(1, 5)))
        else:
            body = r.choice((f"&copy; {short()}", f"<p>{some()}</p>", f"&copy; x &middot; {short()}...", links(r.randint(2, 5)) + f"<p>{short()}</p>"))
        return f"<{tag}{attrs}>{body}</{tag}>"

    def paragraph() -> str:
        t = main_mark + some()
        kind = r.random()
        if kind < 0.62:
            return f"<p>{t}</p>"
        if kind < 0.70:
            return f"<p><b>{t}<br>"
        if kind < 0.76:
            return f"<h{r.randint(2, 4)}>{main_mark}{short()}</h{r.randint(2, 4)}>"
        if kind < 0.82:
            return "<ul>" + "".join(f"<li>{main_mark}{some()}</li>" for _ in range(r.randint(1, 4))) + "</ul>"
        if kind < 0.86:
            return f"<blockquote><p>{t}</p></blockquote>"
        if kind < 0.90:
            return f"<table><tr><td>{t}</td><td>{main_mark}{short()}</td></tr></table>"
        if kind < 0.93:
            return f"<pre>{t}</pre>"
        if kind < 0.96:
            return f'<p>{t} <a href="/y">{short()}</a> {short()}</p>'
        return f"<figure><figcaption>{main_mark}{short()}</figcaption></figure>" if kind < 0.98 else f"<div>{t}</div>"

    tag, attrs = r.choice(MAIN[0]) if r.random() < 0.4 else "article", ""
    if tag in ("div", "section", "td"):
        attrs = _attrs(r, MAIN[1], 1.0)
    elif r.random() < 0.4:
        attrs = _attrs(r, MAIN[1], 0.7)
    head = f"<h1>{main_mark}{short()}</h1>" if r.random() < 0.85 else ""
    if r.random() < 0.08:
        head = f"<header>{head}</header>"
    body = [paragraph() for _ in range(r.randint(1, 14))]
    for kind in ("advert", "notice", "sidebar", "form", "menu"):
        if r.random() < 0.10:
            body.insert(r.randint(0, len(body)), role(kind))
    if r.random() < 0.12:
        body.append(role("comments"))
    inner = f"<{tag}{attrs}>{head}{''.join(body)}</{tag}>"
    if tag == "td":
        inner = f"<table><tr><td>{links(3)}</td>{inner}</tr></table>"
    top = [role(k) for k in ("notice", "header", "menu", "advert", "sidebar") if r.random() < 0.5]
    bottom = [role(k) for k in ("comments", "sidebar", "form", "advert", "notice", "menu") if r.random() < 0.35]
    if r.random() < 0.5:
        r.shuffle(top)
    r.shuffle(bottom)
    foot = role("footer") if r.random() < 0.85 else ""
    page = "".join(top) + inner + "".join(bottom) + foot
    if r.random() < 0.4:
        page = f'<div class="{r.choice(("wrapper", "container", "page", "site", "row"))}">{page}</div>'
    found = blocks(f"<html><body>{page}</body></html>")
    return [Block(b.inside, t, b.linked) for b in found if (t := b.text.replace(main_mark, "").strip())], np.array([main_mark in b.text for b in found if b.text.replace(main_mark, "").strip()], bool)


def train(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES, seed: int = 0) -> dict[str, np.ndarray]:
    """The labeller, fitted on layouts of the texts of at most ``sample`` pages (chosen by a hash of their id)."""
    share = min(1.0, 2.0 * sample / max(1, pages.count()))  # few more rows than wanted reach the driver, whatever the number of tasks
    hashed = pages.select(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)).alias("h"), F.col(html_col).alias("x"))
    rows = hashed.filter((F.col("h") < share * (1 << 20)) & F.col("x").isNotNull()).orderBy("h", F.length("x")).limit(sample).select("x").collect()
    texts = [b.text for row in rows for b in blocks(row["x"])] or ["text"]
    r = random.Random(seed)
    return fit([layout(texts, r) for _ in range(max(200, len(rows) * LAYOUTS))], seed=seed)


def extract(pages: DataFrame, model: dict[str, np.ndarray], *, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` of ``pages`` with ``main_text`` and ``n_blocks`` (all leaf blocks).

    Blocks labelled main are joined in page order by one space.  Null and
    empty pages and pages without a main block give the empty text.  Each page
    stands alone, so repeated rows agree; an empty table gives no rows.
    """
    schema = pages.select(*keep).schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "main_text string, n_blocks int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = flat.strings(batch.column(batch.num_columns - 1))
            for a, b in flat.pieces(source, 1 << 20):
                found = [blocks(x) for x in source.slice(a, b - a).to_pylist()]
                text = [" ".join(x.text for x, p in zip(page, prob, strict=True) if p >= 0.5) for page, prob in zip(found, predict(model, found), strict=True)]
                kept = [batch.column(i).slice(a, b - a) for i in range(len(schema))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string()), pa.array([len(x) for x in found], pa.int32())], names=[*schema.names, "main_text", "n_blocks"])

    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(run, out)
