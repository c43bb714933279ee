"""HTML extraction: a linear-chain conditional random field labels the leaf blocks of a page, and Viterbi decoding picks the main text.

Blocks are the runs of text between block-level tags; features are ancestor tags, words of ancestors' class and id, and the
text's shape. The model is trained by gradient ascent on the likelihood of labelled pages, which labelled_pages() lays out from
many page designs, so the labels are known by construction.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attributes: names, with values quoted or not; a quote that never closes, or one inside an unquoted value, is a plain character.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+"""
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements that hold no text of the page: CODE up to the end of a cut-off page, others only if they are closed.
_CODE = {"script", "style", "xmp"}
_RAW = _CODE | {"textarea", "title", "iframe", "noembed", "noframes"}
_NESTED = {"noscript", "template", "svg", "math", "object"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"ul", "ol", "dl", "table", "select"}
_P_SCOPES = _SCOPES | {"div", "article", "section", "main", "body"}
#: Ancestors that features are drawn from: the outermost and the nearest ones.
OUTER, NEAR = 8, 24


@dataclass
class Block:
    text: str
    path: tuple
    link: float  # share of characters in links
    features: list[str] = field(default_factory=list)


class _Open:
    """The open elements. Where each name lies is kept, so closing one never looks through those above it more than once."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.where: dict[str, list[int]] = {}

    def push(self, name: str, words: tuple[str, ...]) -> None:
        self.where.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, words))

    def last(self, names) -> int:
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=-1)

    def close(self, names, scopes=()) -> None:
        """Closes the nearest of the names and all in it, unless a scope lies in between."""
        at = self.last(names)
        if at >= 0 and at >= self.last(scopes):
            for name, _ in self.stack[at:]:
                self.where[name].pop()
            del self.stack[at:]

    def path(self) -> tuple:
        return tuple(self.stack) if len(self.stack) <= OUTER + NEAR else (*self.stack[:OUTER], *self.stack[-NEAR:])


def _end(page: str, name: str, at: int, nested: bool) -> int:
    """Where the element that begins before `at` ends, or -1."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>]|\Z)[^>]*?(/?)(?:>|\Z)", re.I).finditer(page, at):
        depth += -1 if m[1] else int(nested and not m[2])
        if not depth:
            return m.end()
    return -1


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: text between block-level tags, references decoded, white space made one space. Never fails."""
    out: list[Block] = []
    opened, lost = _Open(), set()
    texts: list[str] = []
    linked = 0
    path: tuple = ()

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join(entities.unescape("".join(texts)).split())
            if text:
                out.append(Block(text, path, min(1.0, linked / max(1, sum(map(len, texts))))))
            texts.clear()
        linked = 0

    at, size, skip_to = 0, len(page), 0
    for m in _TAG.finditer(page):
        if m.start() < skip_to:
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            if not texts:
                path = opened.path()
            texts.append(piece)
            if opened.where.get("a"):
                linked += len(piece)
        at = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name == "br":
            texts.append(" ")
            if len(texts) == 1:
                path = opened.path()
            continue
        if name not in _INLINE:
            flush()
        if closing:
            opened.close((name,))
        elif name in _RAW or name in _NESTED:
            if not rest.endswith("/") and name not in lost:
                end = _end(page, name, at, name in _NESTED)
                if end >= 0 or name in _CODE:
                    at = skip_to = end if end >= 0 else size
                else:
                    lost.add(name)  # never closed from here on
        elif name not in _VOID:
            if name not in _INLINE:
                opened.close(("p",), _P_SCOPES)
                if name in _CLOSES:
                    opened.close(_CLOSES[name], _SCOPES)
            if not rest.endswith("/"):
                opened.push(name, tuple(w for g in _NAMES.findall(rest) for w in _WORD.findall("".join(g).lower())[:16]))
    if at < size:
        if not texts:
            path = opened.path()
        texts.append(page[at:])
    flush()
    return out


def _shape(b: Block) -> list[str]:
    tags = {t for t, _ in b.path} - {"html", "body"}
    names = {w for _, ws in b.path for w in ws}
    near = next((t for t, _ in reversed(b.path) if t not in _INLINE), "body")
    n, words = len(b.text), b.text.count(" ") + 1
    out = [f"in:{t}" for t in tags - _INLINE] + [f"name:{w}" for w in names] + [f"near:{near}", f"words:{min(6, words.bit_length())}", f"link:{round(b.link * 3)}"]
    out.append("ends" if b.text[-1] in ".!?…。\"”»)" else "open")
    if b.text[0] in "©" or "©" in b.text[:40]:
        out.append("rights")
    if b.text.count("|") + b.text.count("·") + b.text.count("»") > 1:
        out.append("bars")
    if sum(c.isdigit() for c in b.text) * 4 > n:
        out.append("digits")
    out.append(f"near:{near}/words:{min(6, words.bit_length())}")
    if not tags & {"article", "main"} and not names:
        out.append(f"bare:{near}/words:{min(6, words.bit_length())}")
    return out


def described(page: str) -> list[Block]:
    found = blocks(page)
    shapes = [_shape(b) for b in found]
    for i, b in enumerate(found):
        b.features = ["bias", *shapes[i], *(f"-1 {f}" for f in (shapes[i - 1] if i else ["start"]) if not f.startswith("name:")), *(f"+1 {f}" for f in (shapes[i + 1] if i + 1 < len(found) else ["end"]) if not f.startswith("name:"))]
    return found


@dataclass
class Crf:
    """Two labels, 0 other and 1 main: log-odds of each feature, and scores of label pairs."""

    weights: dict[str, float]
    pairs: np.ndarray

    def decode(self, found: list[Block]) -> list[int]:
        """The most likely labels (Viterbi)."""
        if not found:
            return []
        (a, b), (c, d) = self.pairs.tolist()
        get, back = self.weights.get, []
        zero, one = 0.0, sum(get(f, 0.0) for f in found[0].features)
        for x in found[1:]:
            z0, z1, o0, o1 = zero + a, one + c, zero + b, one + d
            back.append((int(z1 > z0), int(o1 > o0)))
            zero, one = max(z0, z1), max(o0, o1) + sum(get(f, 0.0) for f in x.features)
        labels = [int(one > zero)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[str, list[int]]], steps: int = 120, rate: float = 0.1, ridge: float = 2e-3) -> Crf:
    """Adam on the conditional log-likelihood; forward and backward sums run over all pages at once."""
    names: dict[str, int] = {}
    docs = [[[names.setdefault(f, len(names)) for f in b.features] for b in described(page)] for page, _ in pages]
    assert all(len(d) == len(y) for d, (_, y) in zip(docs, pages, strict=True)), "each segment is one block"
    n, t = len(docs), max(map(len, docs))
    width = max(len(x) for d in docs for x in d)
    index = np.full((n, t, width), len(names))
    gold, live = np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (d, (_, y)) in enumerate(zip(docs, pages, strict=True)):
        gold[i, : len(y)], live[i, : len(y)] = y, True
        for j, x in enumerate(d):
            index[i, j, : len(x)] = x
    w, pairs = np.zeros(len(names) + 1), np.zeros((2, 2))
    truth = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & live[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)])
    m1, v1, m2, v2 = 0.0, 0.0, 0.0, 0.0
    flat = index[live]
    for step in range(1, steps + 1):
        node = np.zeros((n, t, 2))
        node[..., 1] = np.where(live, w[index].sum(-1), 0)
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = node[:, 0]
        for j in range(1, t):
            alpha[:, j] = np.where(live[:, j, None], node[:, j] + np.logaddexp(alpha[:, j - 1, :1] + pairs[0], alpha[:, j - 1, 1:] + pairs[1]), alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            ahead = node[:, j + 1] + beta[:, j + 1]
            beta[:, j] = np.where(live[:, j + 1, None], np.logaddexp(ahead[:, :1] + pairs[:, 0], ahead[:, 1:] + pairs[:, 1]), 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        chance = np.exp(alpha + beta - total[:, None, None])[..., 1]
        expected = np.array([[(np.exp(alpha[:, :-1, a] + pairs[a, b] + node[:, 1:, b] + beta[:, 1:, b] - total[:, None]) * live[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)])
        miss = (gold - chance)[live]
        g1 = np.bincount(flat.ravel(), np.repeat(miss, width), minlength=len(w)) / n - ridge * w
        g1[-1] = 0
        g2 = (truth - expected) / n - ridge * pairs
        m1, v1, m2, v2 = 0.9 * m1 + 0.1 * g1, 0.99 * v1 + 0.01 * g1**2, 0.9 * m2 + 0.1 * g2, 0.99 * v2 + 0.01 * g2**2
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w = w + rate * fix * m1 / (np.sqrt(v1) + 1e-8)
        pairs = pairs + rate * fix * m2 / (np.sqrt(v2) + 1e-8)
    return Crf({k: float(w[i]) for k, i in names.items()}, pairs)


def labelled_pages(n: int = 400, seed: int = 11, names: slice = slice(None)) -> list[tuple[str, list[int]]]:
    """Pages of many designs with a label for each block: the article against menus, headers, footers, sidebars, notices, adverts,
    forms and reader comments, with landmark tags, named divisions or bare ones, in any order a real page might have. `names` picks
    which of the names of each kind of element are used, so that others can be held out."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    word = lambda: "".join(pick("a", "e", "i", "o", "u", "é", "ü") + pick("n", "r", "th", "st", "l", "d", "ment") for _ in range(rng.integers(1, 4)))
    words = lambda lo, hi: " ".join(word() for _ in range(rng.integers(lo, hi)))
    sentence = lambda lo=3, hi=22: words(lo, hi).capitalize() + pick(".", ".", ".", "!", "?")
    prose = lambda lo=1, hi=6: " ".join(sentence() for _ in range(rng.integers(lo, hi)))
    pages = []
    for _ in range(n):
        labels: list[int] = []

        def put(text: str, label: int, labels=labels) -> str:
            labels.append(label)
            return text

        def rare(p: float) -> bool:
            return rng.random() < p

        def named(kinds: tuple, tag: str | None = None) -> tuple[str, str]:
            """An element that says what it is by its tag, by a class or id, or both."""
            name = pick(*kinds[names])
            style = pick(f'class="{name}"', f'id="{name}"', f'class="{pick("site", "page", "block", "widget", "top")}-{name}"', f'class="{name} {pick("wide", "clearfix", "col", "box")}"')
            if tag and rare(0.6):
                return (f"<{tag}>" if rare(0.6) else f"<{tag} {style}>"), f"</{tag}>"
            return f"<div {style}>", "</div>"

        def menu() -> str:
            a, z = named(("nav", "menu", "navigation", "breadcrumb", "toolbar"), "nav")
            items = [f'<a href="/{word()}">{put(words(1, 3), 0)}</a>' for _ in range(rng.integers(2, 8))]
            return a + ("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rare(0.8) else "".join(f"<div>{x}</div>" for x in items)) + z

        def advert() -> str:
            a, z = named(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"))
            return a + (f"<p>{put(prose(1, 3), 0)}</p>" if rare(0.4) else put(prose(1, 3), 0)) + z

        def notice() -> str:
            a, z = named(("cookie", "cookies", "notice", "consent", "newsletter", "subscribe", "alert", "gdpr", "popup", "share", "social"))
            text = f"<p>{put(prose(1, 3), 0)}</p>" if rare(0.6) else put(prose(1, 2), 0)
            return a + text + (f"<button>{put(words(1, 3), 0)}</button>" if rare(0.5) else "") + z

        def form() -> str:
            return f'<form action="/{word()}">' + f"<label>{put(words(1, 4), 0)}</label><input name=q><div></div><button>{put(words(1, 2), 0)}</button></form>"

        def header() -> str:
            a, z = named(("header", "masthead", "banner", "topbar", "logo"), "header")
            inner = f"<{(h := pick('h1', 'div', 'p', 'h2'))}>{put(words(1, 5), 0)}</{h}>"
            return a + inner + (f"<p>{put(sentence(), 0)}</p>" if rare(0.4) else "") + (menu() if rare(0.3) else "") + z

        def footer() -> str:
            a, z = named(("footer", "foot", "copyright", "legal", "colophon"), "footer")
            inner = "&copy; " * rare(0.6) + words(1, 4) + pick(" &middot; ", " | ", " ") + prose(1, 3)
            return a + (f"<p>{put(inner, 0)}</p>" if rare(0.5) else put(inner, 0)) + (menu() if rare(0.2) else "") + z

        def sidebar() -> str:
            a, z = named(("sidebar", "related", "aside", "widget", "recommended", "popular", "tags"), "aside")
            return a + f"<h3>{put(words(1, 4), 0)}</h3>" * 1 + "".join(f"<{pick('p', 'p', 'div')}>{put(prose(1, 3), 0)}" + pick("</p>", "</div>") for _ in range(rng.integers(1, 4))) + z

        def comments() -> str:
            a, z = named(("comments", "comment", "discussion", "replies", "respond", "disqus"), "section") if rare(0.7) else ('<section class="comments">', "</section>")
            if a == "<section>":
                a = '<section id="comments">'
            inner = f"<h3>{put(words(1, 3), 0)}</h3>" if rare(0.6) else ""
            for _ in range(rng.integers(1, 5)):
                b, y = pick(('<div class="comment">', "</div>"), ("<article class=comment>", "</article>"), ("<li class='comment-body'>", "</li>"), ("<div>", "</div>"))
                inner += b + (f"<div>{put(words(1, 3), 0)}</div>" if rare(0.4) else "") + f"<p>{put(prose(1, 5), 0)}</p>" + y
            return a + inner + z

        def inline(text: str) -> str:
            kind = rng.integers(8)
            if kind == 0:
                return f"<b>{text}</b>"
            if kind == 1:
                return text + f' <a href="/{word()}">{words(1, 3)}</a> ' + sentence()
            if kind == 2:
                return f"<em>{words(1, 3)}</em> " + text
            return text

        def article() -> str:
            plain = rare(0.12)
            a, z = ("<div>", "</div>") if plain else named(("content", "article", "post", "main", "entry", "story", "body", "text"), pick("article", "article", "main"))
            out = a
            if rare(0.75):
                h = pick("h1", "h1", "h2")
                title = put(words(2, 9).capitalize() + pick("", ".", "."), 1)
                out += f"<header><{h}>{title}</{h}></header>" if rare(0.12) and not plain else f"<{h}>{title}</{h}>"
            for _ in range(rng.integers(1, 14)):
                kind = rng.integers(16)
                if kind == 0:
                    out += "<ul>" + "".join(f"<li>{put(pick(words(1, 6), sentence()), 1)}</li>" for _ in range(rng.integers(1, 5))) + "</ul>"
                elif kind == 1:
                    out += f"<h{(k := rng.integers(2, 5))}>{put(words(1, 6), 1)}</h{k}>"
                elif kind == 2:
                    out += f"<blockquote><p>{put(prose(1, 3), 1)}</p></blockquote>"
                elif kind == 3 and rare(0.5):
                    out += pick(advert, notice, form, sidebar)()
                elif kind == 4:
                    out += f"<p><b>{put(inline(sentence()), 1)}<br><p>{put(prose(), 1)}</p>"
                elif kind == 5:
                    out += f"<p>{put(pick(word().capitalize() + '.', sentence(1, 4)), 1)}</p>"
                elif kind == 6 and rare(0.4):
                    out += f"<pre>{put(words(2, 9), 1)}</pre>"
                elif kind == 7 and rare(0.4):
                    out += "<table><tr>" + "".join(f"<td>{put(words(1, 4), 1)}</td>" for _ in range(rng.integers(1, 4))) + "</tr></table>"
                else:
                    out += f"<p>{put(inline(prose()), 1)}</p>" if rare(0.9) else f"<div>{put(prose(), 1)}</div>"
            return out + z

        parts = [*(f for f, p in ((header, 0.4), (menu, 0.75), (advert, 0.5), (notice, 0.3), (form, 0.15), (sidebar, 0.2)) if rare(p))]
        rng.shuffle(parts)
        after = [f for f, p in ((comments, 0.4), (sidebar, 0.35), (advert, 0.25), (notice, 0.2), (form, 0.15), (menu, 0.15)) if rare(p)]
        rng.shuffle(after)
        body = "".join(f() for f in parts) + article() + "".join(f() for f in after) + (footer() if rare(0.85) else "")
        pages.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}" + "</body></html>" * rare(0.9), labels))
    return pages


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), n_pages: int = 400, seed: int = 11) -> DataFrame:
    """One row for each page: the kept columns, text (the main blocks in page order, joined by \\n), n_chars (code points), n_blocks.

    Whole pages are read, of any length and depth, in linear time; cut-off or malformed ones too. A null or empty page gives an empty
    text. Ties between labels go to the boilerplate side. Repeated rows each give a row; an empty table gives none. Null ids are
    kept. Other columns are never read. Pages are independent, so there is no shuffle and no hot key. The
    model is trained on `n_pages` labelled pages of fixed seed: a bound that does not depend on the input.
    """
    model = pages.sparkSession.sparkContext.broadcast(train(labelled_pages(n_pages, seed)))

    @F.pandas_udf("text string, n_blocks bigint")
    def main_text(column: pd.Series) -> pd.DataFrame:
        crf, rows = model.value, []
        for page in column:
            found = described(page or "")
            rows.append(("\n".join(b.text for b, y in zip(found, crf.decode(found), strict=True) if y), len(found)))
        return pd.DataFrame(rows, columns=["text", "n_blocks"])

    out = pages.select(*(F.col(c) for c in keep), main_text(F.col(html)).alias("_main"))
    return out.select(*keep, F.col("_main.text").alias("text"), F.length("_main.text").cast("bigint").alias("n_chars"), F.col("_main.n_blocks").alias("n_blocks"))
