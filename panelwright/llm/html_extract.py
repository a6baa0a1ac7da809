"""Main text of web pages: a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: Within a tag: an attribute's name and, after an equals sign, what its value starts with.
_NEXT = re.compile(r"[\s/]*(?:(>)|([^\s/>=][^\s/>=]*|=)(?:\s*=\s*(\"|'|[^\s>\"'][^\s>]*)?)?)")
_NAMING = frozenset(("class", "id", "role", "aria-label"))
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed values of HTML: elements within a block, without content, and with content that isn't page text.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title noscript template svg math iframe object textarea select".split())
#: An opening one of these ends an open one of the same row, unless one of ``_SCOPES`` stands between.
_ENDS = {t: frozenset(g.split()) for g in ("p", "li", "dt dd", "option", "tr", "td th") for t in g.split()}
_CLOSE_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPES = frozenset("article aside body div footer form header main nav ol section table td th ul".split())


@dataclass
class Block:
    """``tags``: the kinds of elements around the text; ``near``: the landmark nearest to it."""

    text: str
    tags: frozenset[str]
    leaf: str
    near: str
    names: frozenset[str]
    links: int


#: Elements that say what a part of a page is for.
_LANDMARKS = frozenset("article main nav aside footer header form".split())
#: Kinds of elements that are told apart; all others are one kind.
_KNOWN = INLINE | VOID | _SCOPES | _CLOSE_P | frozenset(_ENDS) | _LANDMARKS | frozenset("button caption details dialog figcaption label legend menu optgroup summary tbody tfoot thead".split())
#: Names of one element, and of all around a block, that are read at most once each; real pages have far fewer.
_NAMES = 256


class _Page:
    """Reads a page from left to right; every character is looked at a fixed number of times, but for sorting out names."""

    def __init__(self, page: str):
        self.page, self.blocks = page, []
        # Of each open element: its tag and what a block in it inherits.
        self.stack: list[tuple[str, frozenset[str], str, frozenset[str]]] = []
        self.open: Counter[str] = Counter()
        self.held: list[str] = []
        self.linked = self.in_link = 0
        self.last = {q: page.rfind(q) for q in "\"'"}

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                leaf, tags, near, names = self.stack[-1] if self.stack else ("", frozenset(), "none", frozenset())
                self.blocks.append(Block(text, tags, leaf, near, names, self.linked))
        self.held, self.linked = [], 0

    def take(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self.held.append(text)
            if self.in_link:
                self.linked += len(text)

    def attributes(self, at: int) -> tuple[int, set[str], bool]:
        """From behind a tag's name: the place behind the tag (-1: it has no end), its names, and whether it closes itself."""
        page, names = self.page, set()
        while m := _NEXT.match(page, at):
            at = m.end()
            if m[1]:
                return at, names, page[m.start() : at].rstrip(">").endswith("/")
            value = m[3]
            if value in self.last:
                if self.last[value] >= at:
                    end = page.index(value, at)
                    value, at = page[at:end], end + 1
                else:  # never closed: it ends with the tag
                    end = page.find(">", at)
                    value, at = page[at : end if end >= 0 else len(page)], end if end >= 0 else len(page)
            if value and m[2].lower() in _NAMING and len(names) < _NAMES:
                names.update(x.lower() for x in _NAME.findall(value[:4096]))
        return -1, names, False

    def close(self, count: int) -> None:
        for tag, *_ in self.stack[count:]:
            self.open[tag] -= 1
        del self.stack[count:]

    def element(self, tag: str, names: set[str]) -> None:
        ends = _ENDS.get(tag, frozenset()) | (frozenset(("p",)) if tag in _CLOSE_P else frozenset())
        if any(self.open[x] > 0 for x in ends):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ends:
                    self.close(i)
                    break
                if self.stack[i][0] in _SCOPES:
                    break
        _, tags, near, around = self.stack[-1] if self.stack else ("", frozenset(), "none", frozenset())
        kind = tag if tag in _KNOWN else "other"
        # Most elements bring nothing new, so deep pages share the sets of their outer elements.
        tags = tags if kind in tags else tags | {kind}
        fresh = names - around if len(around) < _NAMES else ()
        self.stack.append((tag, tags, tag if tag in _LANDMARKS else near, around | fresh if fresh else around))
        self.open[tag] += 1

    def read(self) -> list[Block]:
        page, at, size = self.page, 0, len(self.page)
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                self.take(page[at:start])
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else size
                continue
            if page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                if end >= 0:
                    self.take(page[at:start])
                    at = end + 1
                    continue
            m = _TAG.match(page, start + 1)
            if not m:
                self.take(page[at : start + 1])
                at = start + 1
                continue
            self.take(page[at:start])
            at, names, alone = self.attributes(m.end())
            if at < 0:  # cut off within a tag
                at = size
                break
            tag, closing = m[2].lower(), bool(m[1])
            if tag == "br":
                self.held.append(" ")
            elif tag in RAW and not closing:
                if not alone or tag in ("script", "style", "title", "textarea"):
                    at = self.skip(tag, at)
            elif tag in INLINE:
                if tag == "a":
                    self.in_link = 0 if closing else 1
            elif tag in VOID:
                if tag not in ("img", "input"):
                    self.flush()
            elif closing:
                self.flush()
                self.in_link = 0
                if self.open[tag] > 0:
                    i = len(self.stack) - 1
                    while self.stack[i][0] != tag:
                        i -= 1
                    self.close(i)
            elif tag not in ("html", "body", "head"):
                self.flush()
                self.in_link = 0
                self.element(tag, names)
        self.take(page[at:])
        self.flush()
        return self.blocks

    def skip(self, tag: str, at: int) -> int:
        """Behind the end of an element whose content isn't page text; without an end, that of the page."""
        if tag not in _RAW_END:
            _RAW_END[tag] = re.compile(rf"</{tag}\b[^>]*>", re.I)
        end = _RAW_END[tag].search(self.page, at)
        return end.end() if end else len(self.page)


_RAW_END: dict[str, re.Pattern] = {}


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: the text between block-level tags, decoded, with single spaces.

    Null and empty pages have none. A quote that never closes ends with its tag; a page that is cut off within a tag ends before it.
    """
    return _Page(page).read() if page else []


#: Words of page furniture in text.
_CUES = re.compile(r"(?i)\b(cookies?|consent|privacy|subscribe|newsletter|sign up|log ?in|advertisement|sponsored|copyright|all rights|share this|read more|related|comments?|reply|terms)\b|©|»|\|")


def features(page: list[Block]) -> list[list[str]]:
    """What the field sees of each block: its ancestors, their names, and its text."""
    last_h1 = next((i for i, b in enumerate(page) if "h1" in b.tags), None)
    out = []
    for i, b in enumerate(page):
        f = ["bias"]
        f += [f"in:{t}" for t in b.tags]
        if b.leaf:
            f.append(f"leaf:{b.leaf}")
        # The landmark nearest to the block says most.
        f.append(f"near:{b.near}")
        f += [f"name:{n}" for n in b.names]
        n = len(b.text)
        f.append(f"chars:{min(6, n.bit_length() // 2)}")
        share = b.links / n
        f.append("links:" + ("none" if share == 0 else "some" if share < 0.5 else "most"))
        if b.text[-1] in ".!?…":
            f.append("stop")
        if _CUES.search(b.text):
            f.append("cue")
        f.append("h1:" + ("none" if last_h1 is None else "before" if i < last_h1 else "at" if i == last_h1 else "after"))
        out.append(f)
    return out


@dataclass(frozen=True)
class Field:
    """Weights of a feature for content against furniture, and of neighbouring labels; 1 is content."""

    weights: dict[str, float]
    moves: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, page: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not page:
            return []
        get, moves = self.weights.get, self.moves
        back: list[tuple[int, int]] = []
        s0, s1 = 0.0, sum(get(x, 0.0) for x in page[0])
        for f in page[1:]:
            e = sum(get(x, 0.0) for x in f)
            a, b = (s0 + moves[0][0], s1 + moves[1][0]), (s0 + moves[0][1], s1 + moves[1][1])
            back.append((int(a[1] > a[0]), int(b[1] > b[0])))
            s0, s1 = max(a), max(b) + e
        labels = [int(s1 > s0)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def fit_field(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.1, l2: float = 1e-2) -> Field:
    """Maximum likelihood with forward-backward marginals, all pages at once."""
    names = sorted({x for f, _ in pages for b in f for x in b})
    index = {x: i for i, x in enumerate(names)}
    top, n = max(len(y) for _, y in pages), len(pages)
    rows, columns, y = [], [], np.full((n, top), -1)
    for p, (f, labels) in enumerate(pages):
        y[p, : len(labels)] = labels
        for i, b in enumerate(f):
            rows += [p * top + i] * len(b)
            columns += [index[x] for x in b]
    rows, columns = np.array(rows), np.array(columns)
    w, t = np.zeros(len(names)), np.zeros((2, 2))
    live = y >= 0
    seen_w = np.bincount(columns, (y.reshape(-1)[rows] == 1).astype(float), len(names))
    pair = live[:, 1:]
    seen_t = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)], float)
    m1, m2 = np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    for step in range(1, rounds + 1):
        e = np.zeros((n, top, 2))
        e[:, :, 1] = np.bincount(rows, w[columns], n * top).reshape(n, top)
        fwd = np.zeros((n, top, 2))
        fwd[:, 0] = e[:, 0]
        for i in range(1, top):
            nxt = np.logaddexp(fwd[:, i - 1, 0, None] + t[0], fwd[:, i - 1, 1, None] + t[1]) + e[:, i]
            fwd[:, i] = np.where(live[:, i, None], nxt, fwd[:, i - 1])
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        bwd, got_t = np.zeros((n, top, 2)), np.zeros((2, 2))
        for i in range(top - 2, -1, -1):
            ahead = bwd[:, i + 1] + e[:, i + 1]
            joint = fwd[:, i, :, None] + t[None] + ahead[:, None, :] - total[:, None, None]
            got_t += (np.exp(np.minimum(joint, 0)) * live[:, i + 1, None, None]).sum(axis=0)
            prev = np.logaddexp(t[:, 0] + ahead[:, 0, None], t[:, 1] + ahead[:, 1, None])
            bwd[:, i] = np.where(live[:, i + 1, None], prev, bwd[:, i + 1])
        one = np.exp(np.minimum(fwd[:, :, 1] + bwd[:, :, 1] - total[:, None], 0)) * live
        got_w = np.bincount(columns, one.reshape(-1)[rows], len(names))
        grad = np.append((seen_w - got_w) / n - l2 * w / 10, (seen_t - got_t).reshape(-1) / n - l2 * t.reshape(-1) / 10)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, t = w + move[:-4], t + move[-4:].reshape(2, 2)
    return Field(dict(zip(names, w.tolist())), tuple(map(tuple, t.tolist())))


class PageMaker:
    """Labelled pages made by rule: furniture and article parts around known text, in many mark-ups."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        style = r.random()
        made = ["".join(r.choice(("th", "er", "on", "an", "re", "la", "de", "ung", "ción", "é", "ou", "st")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        text = " ".join(made)
        if style < 0.1:
            text = text.upper() + "!!"
        elif style < 0.2:
            text = " | ".join(made)
        elif style < 0.3:
            text = " ".join(w + r.choice(("%%%", "***", "###", "&amp;&amp;")) for w in made)
        return text.capitalize() + r.choice((".", ".", ".", "", "?"))

    def wrap(self, tag: str, names: tuple[str, ...], inner: str) -> str:
        attr = f' class="{self.r.choice(names)}"' if names else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self) -> str:
        items = "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(self.r.randint(2, 8)))
        return f"<ul>{items}</ul>"

    def furniture(self, where: str) -> str:
        """A part that is no content; ``where``: top, within, side or bottom."""
        r, w = self.r, self.words
        kinds = {
            "top": ("nav", "header", "notice", "ad"),
            "within": ("ad", "aside", "form", "share", "notice"),
            "side": ("aside", "sidebar", "ad", "nav"),
            "bottom": ("comments", "footer", "related", "form", "notice"),
        }[where]
        kind = r.choice(kinds)
        if kind == "nav":
            return self.wrap(r.choice(("nav", "nav", "div")), ("menu", "nav", "navbar", "breadcrumbs", "navigation main"), self.links())
        if kind == "header":
            return self.wrap(r.choice(("header", "div")), ("site-header", "header", "masthead", "top banner"), f"<p>{w(1, 8)}</p>" + r.choice(("", self.links())))
        if kind == "notice":
            return self.wrap(r.choice(("div", "section")), ("cookie-notice", "notice", "consent banner", "alert", "gdpr", "popup modal"), f"<p>{w(3, 30)}</p><button>{w(1, 2)}</button>")
        if kind == "ad":
            return self.wrap(r.choice(("div", "div", "aside", "section")), ("ad", "ads", "advert", "sponsored", "promo", "ad-slot banner"), r.choice((w(2, 40), f"<p>{w(2, 30)}</p>")))
        if kind in ("aside", "sidebar"):
            return self.wrap("aside" if kind == "aside" else "div", ("sidebar", "widget", "related", "side-bar rail"), f"<h3>{w(1, 4)}</h3>" + r.choice((self.links(), f"<p>{w(3, 40)}</p>")))
        if kind == "form":
            return self.wrap("form", ("newsletter", "search", "subscribe", "login", "contact"), f"<label>{w(1, 5)}</label><input type=text><p>{w(2, 15)}</p><button>{w(1, 2)}</button>")
        if kind == "share":
            return self.wrap("div", ("share", "social", "tags", "toolbar"), self.links())
        if kind == "comments":
            said = "".join(self.wrap("div", ("comment", "comment-body", "reply"), f"<p>{w(3, 60)}</p>") for _ in range(r.randint(1, 4)))
            return self.wrap(r.choice(("section", "div")), ("comments", "discussion", "comment-list", "responses"), f"<h3>{w(1, 3)}</h3>{said}")
        if kind == "related":
            return self.wrap("section", ("related", "recommended", "more-stories"), f"<h3>{w(1, 3)}</h3>{self.links()}")
        return self.wrap("footer", ("footer", "site-footer", "copyright"), r.choice((f"&copy; {w(1, 20)}", f"<p>{w(1, 30)}</p>", self.links())))

    def content(self) -> str:
        r, w = self.r, self.words
        p = r.random()
        if p < 0.6:
            return r.choice(("<p>{}</p>", "<p><b>{}<br>", "<p>{}")).format(w(1, 80))
        if p < 0.7:
            return f"<h2>{w(1, 8)}</h2>"
        if p < 0.78:
            return "<ul>" + "".join(f"<li>{w(1, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if p < 0.85:
            return f"<blockquote><p>{w(3, 40)}</p></blockquote>"
        if p < 0.92:
            return f'<p>{w(3, 30)} <a href="/x">{w(1, 6)}</a> {w(1, 20)}</p>'
        if p < 0.94:
            return f"<pre>{w(3, 30)}</pre>"
        if p < 0.96:
            return self.wrap(r.choice(("section", "div")), r.choice(((), ("part", "text", "row"))), f"<h3>{w(1, 6)}</h3><p>{w(1, 40)}</p>")
        if p < 0.97:
            return f"<figure><figcaption>{w(2, 12)}</figcaption></figure>" if r.random() < 0.5 else f"<dl><dt>{w(1, 3)}</dt><dd>{w(2, 12)}</dd></dl>"
        return "<table><tr>" + "".join(f"<td>{w(1, 4)}</td>" for _ in range(3)) + "</tr></table>"

    def page(self) -> list[tuple[str, int]]:
        """Pieces of mark-up; the blocks of a piece have its label, -1 is mark-up without a block of its own."""
        r, out = self.r, []
        for _ in range(r.randint(0, 3)):
            out.append((self.furniture("top"), 0))
        holder = r.choice(("article", "article", "article", "main", "div"))
        names = {"div": ("content", "article", "post", "entry-content", "story body", "main-content"), "main": ("", "content")}.get(holder, ("", "post", "entry"))
        name = r.choice(names)
        out.append((f'<{holder} class="{name}">' if name else f"<{holder}>", -1))
        if r.random() < 0.85:
            title = f"<h1>{self.words(1, 12)}</h1>"
            out.append((f"<header>{title}</header>" if r.random() < 0.15 else title, 1))
        for _ in range(r.randint(1, 12)):
            if r.random() < 0.07:
                out.append((self.furniture("within"), 0))
            out.append((self.content(), 1))
        if r.random() < 0.15:
            out.append((self.furniture("bottom"), 0))
        out.append((f"</{holder}>", -1))
        for where in ("side", "bottom", "bottom"):
            if r.random() < 0.6:
                out.append((self.furniture(where), 0))
        return out

    def labelled(self) -> tuple[str, list[int]]:
        """A page and the labels of its blocks, told apart by marks that only this method sees."""
        pieces = self.page()
        marked = "".join(re.sub(r">([^<>]*[^<>\s][^<>]*)", lambda m, y=y: f">\x01{y}" + m[1], f">{x}")[1:] for x, y in pieces)
        labels = []
        for b in blocks(marked):
            labels.append(int(b.text[b.text.index("\x01") + 1]))
        return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(x for x, _ in pieces) + "</body></html>", labels


def train_field(pages: int = 600, seed: int = 11) -> Field:
    maker = PageMaker(seed)
    made = []
    for _ in range(pages):
        page, labels = maker.labelled()
        f = features(blocks(page))
        if len(f) == len(labels) and f:
            made.append((f, labels))
    return fit_field(made)


_fields: dict[str, Field] = {}


def default_field() -> Field:
    """The field trained on made pages; always the same, so it is trained once."""
    if "field" not in _fields:
        _fields["field"] = train_field()
    return _fields["field"]


def main_text(page: str | None, field: Field) -> str:
    """The blocks that are content, joined by spaces; empty for null and empty pages."""
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, field.decode(features(found))) if y)


def extract_text(df: DataFrame, html_column: str = "html", field: Field | None = None) -> Column:
    """A column with the main text of whole pages; no shuffle.

    Null and empty pages give an empty text, as do pages without content; mark-up that is cut off or
    wrongly nested is read as far as it goes. Repeated rows give equal texts.
    """
    shared = df.sparkSession.sparkContext.broadcast(field or default_field())

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, shared.value) for p in pages], dtype="object")

    return extract(F.col(html_column))
