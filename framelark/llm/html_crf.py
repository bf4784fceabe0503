"""Main text of HTML pages with a linear-chain conditional random field.

A page becomes the sequence of its leaf blocks: runs of text that no block-level
tag interrupts.  A block's features are its ancestors' tags, the words of their
class, id and role attributes, and figures of its text.  The field is trained
on labelled pages (``training_pages``), and Viterbi decoding labels all blocks
of a page at once.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.llm._spark import release

#: A "<" outside quotes ends what is no tag, so that a scan never goes far ahead in vain.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^<>]*+>?"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/><]*+)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.DOTALL,
)
#: References of very many digits, which are no character.
LONG_REFERENCE = re.compile(r"&#(?:0*+([0-9]{8,})|[xX]0*+([0-9a-fA-F]{7,}));?")
ZEROS = re.compile(r"&#([xX]?)0{8,}")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
#: Words of an attribute; capitals begin one.
NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
SPACE = re.compile(r"\s+")
#: Elements whose content is no text of the page.  An unclosed one is empty; script and style go on to the page's end.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "select", "title"}
TO_THE_END = {"script", "style"}
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "img", "wbr", "br", "button", "input",
}
#: Attribute words that pages commonly give to their parts (fixed values).
MAIN_NAMES = ("article", "content", "post", "entry", "main", "story", "body", "text", "page", "prose", "markdown")
OTHER_NAMES = {
    "nav": ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs"),
    "header": ("header", "masthead", "topbar", "branding", "logo", "banner", "top"),
    "footer": ("footer", "bottom", "copyright", "legal", "colophon"),
    "aside": ("sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "rail", "secondary"),
    "notice": ("notice", "cookie", "consent", "alert", "warning", "gdpr", "popup", "modal", "paywall", "message", "toast", "announcement"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "commercial"),
    "form": ("form", "newsletter", "subscribe", "signup", "login", "search", "contact"),
    "comments": ("comments", "comment", "discussion", "replies", "reply", "respond", "disqus", "feedback"),
    "share": ("share", "social", "sharing", "follow", "tags", "meta", "byline", "author"),
}
ZONES = {"article", "main", "nav", "header", "footer", "aside", "form", "head", "dialog"}
ZONE_NAMES = frozenset(MAIN_NAMES).union({"hidden"}, *OTHER_NAMES.values())
#: Names that tell nothing of a part's kind.  Other words and tags are no features, so these never grow with a page.
PLAIN_NAMES = ("container", "wrapper", "wrap", "box", "inner", "list", "site")
KNOWN_NAMES = ZONE_NAMES.union(PLAIN_NAMES)
#: A tag that opens closes these while they are the innermost block.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_P = INLINE | VOID - {"hr"}
KNOWN_TAGS = ZONES | {
    "html", "body", "div", "section", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody",
    "thead", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "details", "summary", "center", "address", "fieldset",
}


@dataclass
class Level:
    """An open element with what holds for it and all around it."""

    tag: str
    tags: frozenset[str]
    names: frozenset[str]
    zone: tuple[str, ...]  # of the nearest element that says what it is for


OUTSIDE = Level("-", frozenset(), frozenset(), ("-",))


@dataclass
class Block:
    text: str
    level: Level
    linked: int  # characters inside links


def nested(outer: Level, tag: str, own: frozenset[str]) -> Level:
    zone = (*((tag,) if tag in ZONES else ()), *sorted(own & ZONE_NAMES)) or outer.zone
    tags = outer.tags if tag in outer.tags or tag not in KNOWN_TAGS else outer.tags | {tag}
    names = outer.names if own <= outer.names else outer.names | own
    return Level(tag, tags, names, zone)


def decoded(raw: str) -> str:
    if "&" not in raw:
        return raw
    if "&#" in raw:
        raw = LONG_REFERENCE.sub("\ufffd", ZEROS.sub(r"&#\1", raw))
    return html.unescape(raw)


def blocks_of(page: str | None) -> list[Block]:
    """The non-empty leaf blocks in page order, white space made single spaces.

    The work grows with the page's length alone, however deep or broken it is.
    """
    out: list[Block] = []
    stack: list[Level] = [OUTSIDE]
    open_ = Counter()  # how often a tag is on the stack
    endless: set[str] = set()  # tags that are closed nowhere further on
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(text, stack[-1], linked))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = decoded(raw)
        parts.append(text)
        if links:
            linked += len(text.strip())

    page, at = page or "", 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            parts.append(m["cdata"])
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE or (not open_[tag] and tag != "p"):
                continue
            flush()
            if open_[tag]:
                while True:
                    gone = stack.pop().tag
                    open_[gone] -= 1
                    if gone == tag:
                        break
                links = 0
            continue
        closed = m["attrs"].endswith("/")
        if tag in RAW:
            parts.append(" ")
            if closed and tag == "svg":
                continue
            end = None if tag in endless else RAW_END[tag].search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(tag)
                at = len(page) if tag in TO_THE_END else at
            continue
        if tag in INLINE:
            if tag == "a":
                links = 1
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        while stack[-1].tag in CLOSED_BY.get(tag, ()) or (stack[-1].tag == "p" and tag not in KEEPS_P):
            open_[stack.pop().tag] -= 1
        links = 0
        if tag not in VOID and not closed:
            stack.append(nested(stack[-1], tag, names_of(m["attrs"]) if m["attrs"].strip() else frozenset()))
            open_[tag] += 1
    flush()
    return out


@functools.lru_cache(maxsize=4096)
def names_of(attrs: str) -> frozenset[str]:
    """Known words of class, id and role; ``hidden`` for what is not shown."""
    names: set[str] = set()
    for key, value in ATTRIBUTE.findall(attrs):
        key = key.lower()
        if key == "hidden" or (key == "aria-hidden" and "true" in value.lower()):
            names.add("hidden")
        elif key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
                names.add("hidden")
        else:
            names.update(w for n in NAME.findall(value) if (w := n.lower()) in KNOWN_NAMES)
    return frozenset(names)


def features(blocks: list[Block]) -> list[list[str]]:
    """The active features of every block of a page."""
    longest = max((len(b.text) for b in blocks), default=1)
    out = []
    for b in blocks:
        n = len(b.text)
        words = b.text.count(" ") + 1
        share = b.linked / n
        f = [f"t:{t}" for t in b.level.tags] + [f"n:{w}" for w in b.level.names]
        f += [f"zone:{z}" for z in b.level.zone]
        f.append(f"parent:{b.level.tag}")
        f.append(f"words:{min(words.bit_length(), 7)}")
        f.append("links:" + ("0" if share < 0.1 else "1" if share < 0.6 else "2"))
        f.append(f"end:{b.text[-1] in '.!?:;…。' + chr(34)}")
        f.append(f"long:{n * 4 >= longest}")
        f.append("bias")
        if "©" in b.text or "(c)" in b.text.lower()[:40]:
            f.append("rights")
        out.append(f)
    return out


@dataclass
class Field:
    """Weights of two labels: 1 is main text."""

    index: dict[str, int]
    emit: np.ndarray  # features x 2
    move: np.ndarray  # 2 x 2
    start: np.ndarray  # 2

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most probable labels of one page, by Viterbi."""
        if not rows:
            return []
        get, emit = self.index.get, self.emit
        score = np.array([emit[[i for w in f if (i := get(w)) is not None]].sum(axis=0) for f in rows]).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = score[0][0] + self.start[0], score[0][1] + self.start[1]
        back = []
        for s0, s1 in score[1:]:
            x0, x1, y0, y1 = a + m00, b + m10, a + m01, b + m11
            back.append((x1 > x0, y1 > y0))
            a, b = max(x0, x1) + s0, max(y0, y1) + s1
        label = int(b > a)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 80, rate: float = 0.3, ridge: float = 2e-3) -> Field:
    """Maximise the conditional likelihood by gradient ascent (Adagrad)."""
    index: dict[str, int] = {}
    for rows, _ in pages:
        for f in rows:
            for w in f:
                index.setdefault(w, len(index))
    pages = [(r, y) for r, y in pages if r]
    n, longest = len(pages), max(len(r) for r, _ in pages)
    width = max(len(f) for r, _ in pages for f in r)
    cells = np.full((n, longest, width), len(index))  # the last row stays zero
    gold = np.zeros((n, longest), dtype=np.int64)
    there = np.zeros((n, longest), dtype=bool)
    for i, (rows, y) in enumerate(pages):
        gold[i, : len(y)], there[i, : len(y)] = y, True
        for j, f in enumerate(rows):
            cells[i, j, : len(f)] = [index[w] for w in f]
    emit, move, start = np.zeros((len(index) + 1, 2)), np.zeros((2, 2)), np.zeros(2)
    sums = [np.full_like(v, 1e-6) for v in (emit, move, start)]
    pick = np.eye(2)[gold] * there[..., None]
    pairs = (there[:, 1:] & there[:, :-1])[..., None, None]
    seen_pairs = (np.eye(2)[gold][:, :-1, :, None] * np.eye(2)[gold][:, 1:, None, :] * pairs).sum(axis=(0, 1))
    for _ in range(rounds):
        s = emit[cells].sum(axis=2)
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0] + start
        for t in range(1, longest):
            a = alpha[:, t - 1, :, None] + move
            top = a.max(axis=1)
            a = s[:, t] + top + np.log(np.exp(a - top[:, None]).sum(axis=1))
            alpha[:, t] = np.where(there[:, t, None], a, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b = move + (s[:, t + 1] + beta[:, t + 1])[:, None]
            top = b.max(axis=2)
            b = top + np.log(np.exp(b - top[..., None]).sum(axis=2))
            beta[:, t] = np.where(there[:, t + 1, None], b, 0)
        top = alpha[:, -1].max(axis=1)
        z = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(axis=1))
        one = np.exp(alpha + beta - z[:, None, None]) * there[..., None]
        two = np.exp(alpha[:, :-1, :, None] + move + (s + beta)[:, 1:, None] - z[:, None, None, None]) * pairs
        gap = (pick - one)[..., None, :]
        g = np.zeros_like(emit)
        for label in (0, 1):
            weight = np.broadcast_to(gap[..., label], cells.shape)
            g[:, label] = np.bincount(cells.ravel(), weights=weight.ravel(), minlength=len(g))
        g[-1] = 0
        grads = [g / n - ridge * emit, (seen_pairs - two.sum(axis=(0, 1))) / n - ridge * move, (pick[:, 0] - one[:, 0]).sum(axis=0) / n - ridge * start]
        for v, a, d in zip((emit, move, start), sums, grads, strict=True):
            a += d * d
            v += rate * d / np.sqrt(a)
    return Field(index, emit[:-1], move, start)


# --- labelled pages ----------------------------------------------------------

def _words(rng: random.Random, n: int) -> str:
    letters = "etaoinshrdlucmfwypvbgk"
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 10))) for _ in range(n))


def _sentence(rng: random.Random, low: int = 4, high: int = 24) -> str:
    return _words(rng, rng.randint(low, high)).capitalize() + rng.choice(".....!?")


def _paragraph(rng: random.Random) -> str:
    return " ".join(_sentence(rng) for _ in range(rng.choice((1, 1, 2, 3, 5, 9))))


def training_page(rng: random.Random) -> tuple[str, set[str]]:
    """A made-up page and the texts of its main blocks."""
    main: set[str] = set()

    def attrs(names: tuple[str, ...], chance: float = 0.8) -> str:
        if rng.random() > chance:
            return ""
        name = rng.choice(names)
        if rng.random() < 0.5:
            other = _words(rng, 1)  # a word that no page has twice
            name = rng.choice((f"{name}-{rng.choice(('wrap', 'box', 'inner', 'list'))}", f"site-{name}", f"{name} {rng.choice(names)}", f"{name}-{other}", f"{other}_{name}", f"{name}{other.capitalize()}-{name}"))
        return f' {rng.choice(("class", "class", "id"))}="{name}"'

    def link(text: str) -> str:
        return f'<a href="/{rng.randint(1, 99)}">{text}</a>'

    def item() -> str:
        return link(_words(rng, rng.randint(1, 4)))

    def menu() -> str:
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>"

    def loose() -> str:
        return rng.choice((_paragraph(rng), _sentence(rng), _words(rng, rng.randint(1, 5))))

    def other(kind: str) -> str:
        names = OTHER_NAMES[kind]
        if kind == "nav":
            return rng.choice((f"<nav{attrs(names)}>{menu()}</nav>", f"<div{attrs(names, 1)}>{menu()}</div>", f"<ul{attrs(names, 1)}><li>{item()}</li><li>{item()}</li></ul>"))
        if kind == "header":
            tag = rng.choice(("header", "header", "div"))
            return f"<{tag}{attrs(names, 1 if tag == 'div' else 0.5)}>{rng.choice((item(), loose(), '<h1>' + _words(rng, 2) + '</h1>', '<p>' + loose() + '</p>'))}</{tag}>"
        if kind == "footer":
            tag = rng.choice(("footer", "footer", "div"))
            text = rng.choice(("&copy; " + _words(rng, 2) + " &middot; " + _sentence(rng), f"<p>{loose()}</p>", menu(), "&copy; 2020 " + _words(rng, 3)))
            return f"<{tag}{attrs(names, 1 if tag == 'div' else 0.5)}>{text}</{tag}>"
        if kind == "aside":
            tag = rng.choice(("aside", "aside", "div", "section"))
            return f"<{tag}{attrs(names, 0.5 if tag == 'aside' else 1)}><h3>{_words(rng, 2)}</h3>{rng.choice((menu(), '<p>' + loose() + '</p>', loose()))}</{tag}>"
        if kind == "form":
            if rng.random() < 0.3:
                return f"<div{attrs(names, 1)}><p>{loose()}</p></div>"
            return f"<form{attrs(names, 0.6)}><label>{_words(rng, 2)}</label><input name=q>{rng.choice(('', '<p>' + loose() + '</p>'))}<button>{_words(rng, 1)}</button></form>"
        if kind == "comments":
            tag = rng.choice(("section", "div", "ol"))
            inner = "".join(f'<{rng.choice(("div", "li", "article"))}{attrs(("comment", "reply"), 0.8)}><p>{loose()}</p></div>' for _ in range(rng.randint(1, 4)))
            return f"<{tag}{attrs(names, 1)}><h2>{_words(rng, 1)}</h2>{inner}</{tag}>"
        tag = rng.choice(("div", "div", "section", "p"))
        inner = loose() if tag == "p" or rng.random() < 0.6 else f"<p>{loose()}</p>"
        return f"<{tag}{attrs(names, 1)}>{inner}</{tag}>"

    def keep(text: str) -> str:
        main.add(SPACE.sub(" ", text).strip())
        return text

    def article() -> str:
        out = []
        if rng.random() < 0.8:
            title = keep(_words(rng, rng.randint(2, 12)))
            out.append(rng.choice((f"<h1>{title}</h1>", f"<h2>{title}</h2>", f"<header><h1>{title}</h1></header>")))
        for _ in range(rng.choice((1, 2, 3, 5, 8, 14))):
            r = rng.random()
            text = keep(_paragraph(rng) if rng.random() < 0.85 else _words(rng, rng.randint(1, 3)).capitalize() + ".")
            if r < 0.6:
                out.append(f"<p>{text}</p>")
            elif r < 0.68:
                out.append(f"<p><b>{text}<br>")
            elif r < 0.74:
                out.append(f"<div>{text}</div>")
            elif r < 0.8:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif r < 0.86:
                out.append(f"<h2>{keep(_words(rng, rng.randint(1, 6)))}</h2><p>{text}</p>")
            elif r < 0.92:
                out.append("<ul>" + "".join(f"<li>{keep(loose())}</li>" for _ in range(3)) + f"</ul><p>{text}</p>")
            elif r < 0.96:
                out.append(f"<pre>{text}</pre>")
            else:
                out.append(f"<table><tr><td>{text}</td><td>{keep(_words(rng, 2))}</td></tr></table>")
            if rng.random() < 0.25:
                out.append(other(rng.choice(("ad", "notice", "notice", "share", "aside", "form", "nav", "comments"))))
        return "".join(out)

    if rng.random() < 0.04:  # text without markup, or with paragraphs alone
        text = [keep(_paragraph(rng)) for _ in range(rng.randint(1, 3))]
        return (keep(" ".join(text)) if rng.random() < 0.5 else "".join(f"<p>{t}</p>" for t in text)), main
    before = [other(k) for k in rng.sample(("nav", "header", "ad", "notice", "form", "share"), rng.randint(1, 4))]
    after = [other(k) for k in rng.sample(("footer", "aside", "comments", "share", "ad", "nav", "notice", "form"), rng.randint(1, 5))]
    body = rng.choice(
        (
            lambda: f"<article{attrs(MAIN_NAMES, 0.4)}>{article()}</article>",
            lambda: f"<main{attrs(MAIN_NAMES, 0.3)}>{article()}</main>",
            lambda: f"<div{attrs(MAIN_NAMES, 1)}>{article()}</div>",
            lambda: f"<main><article>{article()}</article></main>",
            lambda: article(),
            lambda: keep(_paragraph(rng)),
            lambda: f"<div{attrs(('container', 'wrapper'), 0.7)}><div{attrs(MAIN_NAMES, 1)}>{article()}</div></div>",
        )
    )()
    page = f"<html><head><title>{_words(rng, 3)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"
    return page, main


@functools.cache
def field(pages: int = 600, seed: int = 11) -> Field:
    """The field trained on ``pages`` made-up pages; the same on every machine."""
    rng = random.Random(seed)
    rows = []
    for _ in range(pages):
        page, main = training_page(rng)
        blocks = blocks_of(page)
        rows.append((features(blocks), [int(b.text in main) for b in blocks]))
    return train(rows)


def extract(page: str | None, model: Field) -> str:
    """The main text of one page: its main blocks, one to a line."""
    blocks = blocks_of(page)
    labels = model.decode(features(blocks))
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def main_text(pages: DataFrame, html_col: str = "html"):
    """A column: the main text of the whole page, empty for a null or empty one."""
    sent = pages.sparkSession.sparkContext.broadcast(field())

    @F.pandas_udf("string")
    def text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for page in pages:
            yield pd.Series([extract(p, sent.value) for p in page], dtype=object)
        release()

    return text(F.col(html_col).cast("string"))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` for every row, repeats and null ids included.

    A page without main text, null or empty html give an empty text.  Nothing
    is cut from long pages.  An empty table gives an empty result; other
    columns are not looked at.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), main_text(pages, html_col).alias("text"))
    return rows.select("id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
