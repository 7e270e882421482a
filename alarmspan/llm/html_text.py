"""Main text of web pages: flat text blocks, described by their words, links and neighbours, sorted by a decision tree."""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmspan.llm.common import renamed

# Markup, in the order it is tried: comments, elements whose content is no text, tags, declarations, then text.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<title\b[^>]*>(?:(?:(?!</head|<body\b|<title\b).)*?</title\s*>|[^<]*)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
_ROLE = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
# Names that tell the state of an element, not what it is: with-sidebar, no-header, comments-open.
_STATE = re.compile(r"(?:has|with|no|without|not|hide|show|is)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled|on|off|left|right|visible|hidden)")
_SPACE = re.compile(r"\s+")

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meta "
                   "q ruby s samp small source span strike strong sub sup time tt u var wbr link".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form menu dialog select button fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar header masthead footer copyright cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login form search share sharing social comment comments "
    "disqus respond reply replies related recommended recommendations widget toolbar pagination pager skip complementary "
    "contentinfo".split())
MAIN = frozenset("article main".split())


@dataclass
class Element:
    """An open block element: aside for certain, by its name only (class, id, role, or a form), or the page's main part."""
    tag: str
    aside: bool = False
    named: bool = False
    main: bool = False
    words: int = 0


@dataclass
class Block:
    """Text between two block-level tags."""
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    around: list[Element] = field(default_factory=list)  # those that are aside, named aside or main
    aside: bool = False
    main: bool = False
    text: str = ""
    words: int = 0
    density: float = 0.0

    def close(self) -> "Block":
        self.text = _SPACE.sub(" ", unescape("".join(self.parts))).strip()
        self.words = len(self.text.split())
        in_links = len(_SPACE.sub(" ", unescape("".join(self.linked))).split())
        self.density = min(1.0, in_links / self.words) if self.words else 0.0
        return self


def blocks(html: str) -> list[Block]:
    """Text blocks in page order.

    A block is aside if an element around it is: by what it is, or by a whole word of its class, id or role.  A name counts
    for nothing if the element holds most of the page's words and the page marks no main part outside it: then it is the
    page, not something beside it.
    """
    out: list[Block] = []
    around: list[Element] = []
    now, links = Block(), 0

    def cut() -> None:
        nonlocal now
        if now.parts and now.close().text:
            out.append(now)
            for element in now.around:
                element.words += now.words
        now = Block(around=[e for e in around if e.aside or e.named or e.main])

    for m in _MARKUP.finditer(html):
        if m["text"] is not None:
            now.parts.append(m["text"])
            if links:
                now.linked.append(m["text"])
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"]:
                now.parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if m["close"] else 1
            if tag in ("br", "img", "input"):
                now.parts.append(" ")
                if links:
                    now.linked.append(" ")
            continue
        if m["close"]:
            depth = next((i for i in range(len(around) - 1, -1, -1) if around[i].tag == tag), None)
            if depth is not None:
                del around[depth:]
        elif tag not in VOID:
            roles = " ".join(next((g for g in r if g), "") for r in _ROLE.findall(m["attributes"])).lower()
            names = {w for token in roles.split() if not _STATE.fullmatch(token) for w in _WORDS.findall(token)}
            names = ASIDE_WORDS.intersection(names) | ({"header"} if tag == "header" else set())
            if any(e.main for e in around):
                names -= {"header"}  # an article's own header holds its title
            named = tag not in ("html", "body") and (bool(names) or tag == "form")
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and around and around[-1].tag == tag:
                around.pop()  # these end where the next one starts
            around.append(Element(tag, tag in ASIDE and tag != "form", named, tag in MAIN))
            if tag == "p" and links:
                links = 0
        if tag not in INLINE and tag in ("p", "article", "nav", "footer", "body"):
            links = 0
        cut()
    cut()
    total = sum(b.words for b in out)
    large = {id(e) for b in out for e in b.around if e.named and not e.aside and 2 * e.words > total}
    if large:
        settled = [b for b in out if any(e.main and not e.named for e in b.around) and not any(e.aside for e in b.around)
                   and not any(e.named and id(e) not in large for e in b.around)]
        for b in out:
            for e in b.around:
                if id(e) in large and all(any(x is e for x in other.around) for other in settled):
                    e.named = False
    for b in out:
        b.aside = any(e.aside or e.named for e in b.around)
        b.main = any(e.main and not e.named for e in b.around)
    return out


# Labelled blocks.  Columns: words, link density, words and density of the block before, of the block after, aside (1), place
# (1: inside the page's article or main part; 0: the page marks none; -1: outside the marked part); then main text (1) or not.
LABELLED = """
 2 1.0   0 0.0   2 1.0  1  0  0
 1 1.0   2 1.0   1 1.0  1 -1  0
 3 1.0   1 1.0  40 0.0  1  1  0
12 0.0   1 1.0   8 0.0  1 -1  0
35 0.0  60 0.0   0 0.0  1 -1  0
80 0.0  50 0.0  60 0.0  1  1  0
45 0.1  30 0.0  20 0.5  1  0  0
 8 0.0  90 0.0   6 0.0  1  1  0
 1 0.0   4 0.0   9 0.0  1  0  0
50 0.0  80 0.0   3 1.0  1  1  0
30 0.0  70 0.0   2 1.0  1 -1  0
 6 1.0  55 0.0   4 1.0  1  1  0
20 0.0   3 1.0  50 0.0  1  1  0
60 0.2  45 0.0  70 0.0  1  0  0
10 0.0  30 0.0  25 0.0  1  1  0
 2 0.0   6 0.0   3 0.0  1  1  0
25 0.0   0 0.0  40 0.0  1  0  0
90 0.0  65 0.0   5 1.0  1  0  0
 9 0.0  12 0.0   5 0.0  0  1  1
 1 0.0  40 0.0  60 0.0  0  1  1
 2 0.0   3 0.0   1 0.0  0  1  1
60 0.0   8 0.0  90 0.0  0  1  1
25 0.2  70 0.0   0 0.0  0  1  1
 5 0.0   0 0.0   4 0.0  0  1  1
 3 1.0  50 0.0  40 0.0  0  1  1
12 1.0  60 0.1  30 0.0  0  1  1
 4 1.0  20 0.0   0 0.0  0  1  1
 7 0.6   9 0.0  12 0.1  0  1  1
150 0.0 90 0.0  30 0.0  0  1  1
40 0.0   9 0.0   3 1.0  0  1  1
 2 0.0   5 0.0   2 1.0  0  1  1
30 0.1  60 0.0   5 1.0  0  1  1
 8 0.0   3 1.0   2 1.0  0  1  1
60 0.0   2 1.0   4 1.0  0  1  1
 6 1.0   0 0.0  50 0.0  0  1  1
15 0.0  10 0.0  12 0.0  0  1  1
70 0.3  20 1.0  15 0.0  0  1  1
 6 1.0   5 1.0   7 1.0  0  1  1
 4 1.0   8 1.0   3 1.0  0  1  1
 2 1.0   2 1.0   3 1.0  0  1  1
12 0.0   1 1.0   8 0.0  0 -1  0
70 0.0  45 0.0   3 1.0  0 -1  0
 5 0.0  20 0.0  30 0.0  0 -1  0
25 0.0   6 0.0   9 0.0  0 -1  0
60 0.0   0 0.0   2 1.0  0 -1  0
 3 0.0  40 0.0   0 0.0  0 -1  0
40 0.1  60 0.0  50 0.0  0 -1  0
 2 1.0   2 1.0   2 1.0  0 -1  0
45 0.0  30 0.0  60 0.0  0  0  1
22 0.1   6 0.0  35 0.0  0  0  1
90 0.2   4 1.0  70 0.0  0  0  1
18 0.0  50 0.0   3 1.0  0  0  1
35 0.0   8 0.0   2 1.0  0  0  1
55 0.1   3 1.0   4 1.0  0  0  1
30 0.0   0 0.0   0 0.0  0  0  1
16 0.0   5 0.0   6 0.5  0  0  1
 6 0.0  40 0.0  55 0.0  0  0  1
 3 0.0  25 0.0  30 0.1  0  0  1
 8 0.0   3 1.0  45 0.0  0  0  1
 5 0.0   2 0.0   4 0.0  0  0  0
 4 0.0   1 1.0   2 1.0  0  0  0
 7 0.0  30 0.0   2 1.0  0  0  0
 3 0.0  60 0.0   0 0.0  0  0  0
 2 1.0   3 1.0   1 1.0  0  0  0
 9 0.9  30 0.0  40 0.0  0  0  0
25 0.9   3 1.0   4 1.0  0  0  0
 4 0.0   6 1.0  40 0.0  0  0  1
 6 0.0   2 1.0   3 0.0  0  0  0
40 0.8  35 0.9   8 1.0  0  0  0
 1 1.0   0 0.0   2 1.0  0  0  0
 1 1.0   1 1.0  40 0.0  0  0  0
 5 1.0   0 0.0  60 0.0  0  0  0
 3 1.0  50 0.0   0 0.0  0  0  0
12 1.0  30 0.0  45 0.0  0  0  0
"""


def grow(x: np.ndarray, y: np.ndarray):
    """Classification tree by Gini impurity: a leaf (0 or 1) or (feature, threshold, below or equal, above).

    Of equally good cuts the one with the widest gap, relative to its feature's spread, is taken.
    """
    if y.min() == y.max():
        return int(y[0])
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            below = x[:, f] <= (a + b) / 2
            impurity = sum(part.mean() * (1 - part.mean()) * len(part) for part in (y[below], y[~below]))
            key = (round(impurity, 9), -(b - a) / (values[-1] - values[0]), f)
            if best is None or key < best[0]:
                best = key, f, (a + b) / 2
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, cut = best
    below = x[:, f] <= cut
    return f, float(cut), grow(x[below], y[below]), grow(x[~below], y[~below])


@lru_cache(maxsize=1)
def tree():
    rows = np.array([[float(v) for v in line.split()] for line in LABELLED.strip().splitlines()])
    return grow(rows[:, :-1], rows[:, -1])


def is_main(features: tuple, node) -> bool:
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return bool(node)


def main_text(html: str | None) -> tuple[str, int]:
    """Main text of a page, one line per block, and how many blocks it has."""
    found = blocks(html or "")
    marked = any(b.main for b in found)
    none, kept = Block(), []
    for before, b, after in zip([none, *found], found, [*found[1:], none]):
        place = 0 if not marked else 1 if b.main else -1
        if is_main((b.words, b.density, before.words, before.density, after.words, after.density, int(b.aside), place), tree()):
            kept.append(b.text)
    return "\n".join(kept), len(kept)


def extract_text(pages: DataFrame, html: str = "html", text: str = "text", n_blocks: str = "n_blocks") -> DataFrame:
    """``pages`` with ``text`` and ``n_blocks`` in place of any such columns: each page's main text, whole.

    Null and empty pages, and pages without main text, give the empty text; pages are read one by one, so repeated rows
    are alike and a very long page needs memory for itself; a page that breaks off is read to its end; an empty table gives
    no rows.
    """
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([main_text(x) for x in batch], columns=["text", "n"])

    read = F.pandas_udf(extracted, "text string, n long")
    both, = renamed(pages, "_read")
    names = {text.lower(), n_blocks.lower()}
    return pages.withColumn(both, read(F.col(html))).select(
        *[c for c in pages.columns if c.lower() not in names], F.col(f"{both}.text").alias(text), F.col(f"{both}.n").alias(n_blocks))
