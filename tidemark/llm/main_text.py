"""Main text of web pages: flat text blocks, classified by a decision tree over a block and its two neighbours.

A page becomes a flat list of blocks: runs of text that no block-level tag interrupts. Each block is described by its
number of words and link density, those of the blocks before and after it, and by what the open tags
around it say: a mark, which an element that holds most of the page's text outvotes, and whether there is an article. A decision tree, trained here on the small table `EXAMPLES`, keeps or
drops it. On a page with an article element that element and the marks decide nearly alone; without one, the neighbours tell a short line of prose from a menu's.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The tags of HTML by what they mean for the flow of text.
UNSEEN = "script style noscript template textarea title iframe svg math canvas audio video object select datalist"
INLINE = "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
CONTAINERS = "nav header footer aside form div section article main ul ol dl table figure dialog menu body html blockquote details fieldset center button"
AROUND = "nav footer aside menu dialog button"
# Words in class, id or role that name what surrounds an article.
NAMES = (
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription paywall nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs pagination pager sidebar aside complementary contentinfo footer bottom toolbar comment comments commentlist respond "
    "reply replies disqus discussion related recommended trending popular share sharing social login signup signin register search widget "
    "copyright disclaimer skip"
)
TOP_NAMES = "header masthead topbar banner"
# Of an article element itself only these count: what else its classes say is about its content.
CARD_NAMES = "ad ads advert advertisement sponsored promo comment comments reply replies related recommended"

_UNSEEN, _INLINE, _CONTAINERS, _AROUND = (frozenset(x.split()) for x in (UNSEEN, INLINE, CONTAINERS, AROUND))
_NAMES, _TOP_NAMES, _CARD_NAMES = frozenset(NAMES.split()), frozenset(TOP_NAMES.split()), frozenset(CARD_NAMES.split())
# Attributes: a quote opens a value right after "=" only, anywhere else it is a character like others.
_MORE = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"
_CLOSED = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>/]|/(?!>))*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)(?:\s" + _CLOSED + r")?/>"
    r"|<(?P<raw>" + "|".join(UNSEEN.split()) + r")(?=[\s/>])" + _MORE + r">.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<more>" + _MORE + r")>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE)
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORD_EDGE = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

FEATURES = ("words_before", "words", "words_after", "links_before", "links", "links_after", "around", "share", "core")
# Labelled blocks. words: number of words, links: share of them inside links, for the block before, the block itself and
# the block after. around: 1 inside a menu, footer or hidden element, 0.8 inside a form, 0.5 inside an element whose class, id or role names an advert,
# notice, comment or the like. share: the least share of the page's words outside links that a form or such an element around the block holds. core: 1 inside an
# article or main element, -1 outside it on a page that has one, 0 on a page without. Last: 1 for main text.
EXAMPLES = (
    # Blocks without such an element around them.
    (0, 1, 1, 0, 1, 1, 1, 1, -1, 0), (1, 1, 1, 1, 1, 1, 1, 1, -1, 0), (1, 1, 8, 1, 1, 0, 1, 1, -1, 0), (1, 8, 12, 1, 0, 0, 1, 1, -1, 0), (1, 40, 12, 1, 0, 0, 1, 1, -1, 0), (60, 12, 0, 0, 0, 0, 1, 1, -1, 0), (60, 90, 0, 0, 0, 0, 1, 1, -1, 0), (60, 30, 50, 0, 0, 0, 1, 1, 1, 0),
    (60, 3, 50, 0, 0, 0, 1, 1, 1, 0), (80, 120, 60, 0, 0, 0, 1, 1, 1, 0), (60, 8, 4, 0, 1, 1, 1, 1, 1, 0), (12, 9, 80, 0, 0, 0, 1, 1, 0, 0), (60, 70, 6, 0, 0, 1, 1, 1, 0, 0), (0, 2, 2, 0, 1, 1, 1, 1, 0, 0), (0, 5, 20, 0, 0, 0, 1, 1, 0, 0), (5, 2, 0, 0, 0, 0, 1, 1, 0, 0),
    (1, 10, 70, 1, 0, 0, 0, 1, -1, 0), (0, 60, 70, 0, 0, 0, 0, 1, -1, 0), (70, 60, 0, 0, 0, 0, 0, 1, -1, 0), (3, 3, 3, 1, 1, 1, 0, 1, -1, 0), (90, 4, 2, 0, 0, 0, 0, 1, -1, 0), (2, 2, 90, 0, 0, 0, 0, 1, -1, 0), (8, 15, 8, 0.5, 0.2, 0.5, 0, 1, -1, 0), (8, 12, 70, 0, 0, 0, 0, 1, 1, 1),
    (1, 10, 90, 1, 0, 0, 0, 1, 1, 1), (12, 70, 60, 0, 0, 0, 0, 1, 1, 1), (70, 1, 60, 0, 0, 0, 0, 1, 1, 1), (70, 2, 3, 0, 0, 0, 0, 1, 1, 1), (2, 1, 1, 0, 0, 0, 0, 1, 1, 1), (60, 9, 12, 0, 0, 0, 0, 1, 1, 1), (9, 1, 12, 0, 0, 0, 0, 1, 1, 1), (0, 4, 0, 0, 0, 0, 0, 1, 1, 1),
    (40, 30, 30, 0, 0.4, 0, 0, 1, 1, 1), (70, 6, 50, 0, 1, 0, 0, 1, 1, 1), (30, 2, 30, 0, 1, 0, 0, 1, 1, 1), (4, 300, 0, 1, 0, 0, 0, 1, 1, 1), (200, 3, 0, 0, 0, 0, 0, 1, 1, 1), (3, 5, 4, 0, 0.3, 0, 0, 1, 1, 1), (12, 1, 1, 0, 1, 1, 0, 1, 1, 1), (1, 8, 30, 1, 1, 0, 0, 1, 1, 1),
    (3, 6, 9, 1, 1, 1, 0, 1, 1, 1), (8, 3, 3, 0, 1, 1, 0, 1, 1, 1), (90, 12, 4, 0, 0.9, 1, 0, 1, 1, 1), (5, 25, 6, 0, 0.6, 0.5, 0, 1, 1, 1), (70, 80, 60, 0, 0, 0, 0, 1, 0, 1), (2, 60, 70, 1, 0, 0, 0, 1, 0, 1), (70, 60, 5, 0, 0, 1, 0, 1, 0, 1), (8, 40, 3, 0, 0.1, 0, 0, 1, 0, 1),
    (70, 3, 60, 0, 0, 0, 0, 1, 0, 1), (60, 1, 40, 0, 0, 0, 0, 1, 0, 1), (70, 8, 30, 0, 0, 0, 0, 1, 0, 1), (1, 8, 60, 0, 0, 0, 0, 1, 0, 1), (60, 30, 0, 0, 0, 0, 0, 1, 0, 1), (50, 4, 0, 0, 0, 0, 0, 1, 0, 1), (0, 12, 0, 0, 0, 0, 0, 1, 0, 1), (0, 90, 0, 0, 0, 0, 0, 1, 0, 1),
    (3, 3, 3, 1, 1, 1, 0, 1, 0, 0), (0, 3, 3, 0, 1, 1, 0, 1, 0, 0), (3, 4, 60, 1, 1, 0, 0, 1, 0, 0), (60, 4, 4, 0, 1, 1, 0, 1, 0, 0), (4, 12, 4, 1, 0.8, 1, 0, 1, 0, 0), (60, 20, 4, 0, 0.9, 1, 0, 1, 0, 0), (1, 3, 1, 1, 0, 1, 0, 1, 0, 0), (5, 20, 6, 0, 0.6, 0.5, 0, 1, 0, 0),
    (60, 60, 2, 0, 0, 1, 0, 1, 0, 1), (70, 25, 3, 0, 0.05, 1, 0, 1, 0, 1), (3, 30, 3, 1, 0, 1, 0, 1, 0, 1), (0, 45, 2, 0, 0.1, 1, 0, 1, 0, 1), (10, 50, 60, 1, 0.2, 0, 0, 1, 0, 1), (60, 70, 60, 0, 0, 0, 1, 1, 0, 0), (0, 90, 0, 0, 0, 0, 1, 1, 0, 0), (8, 60, 3, 0, 0, 0, 1, 1, 1, 0),
    (70, 80, 60, 0, 0.05, 0, 1, 1, 1, 0), (60, 55, 60, 0, 0.1, 0, 1, 1, 0, 0), (0, 60, 60, 0, 0, 0, 1, 1, 1, 0), (2, 2, 60, 1, 1, 0, 0, 1, 0, 0), (2, 2, 0, 1, 1, 0, 0, 1, 0, 0), (0, 2, 60, 0, 1, 0, 0, 1, 0, 0), (60, 2, 2, 0, 1, 1, 0, 1, 0, 0), (60, 5, 0, 0, 1, 0, 0, 1, 0, 0),
    (80, 3, 70, 0, 1, 0, 0, 1, 0, 0),
    # On pages without an article: short blocks are told apart by what stands beside them.
    (70, 2, 3, 0, 0, 0, 0, 1, 0, 1), (3, 2, 60, 0, 0, 0, 0, 1, 0, 1), (3, 3, 3, 0, 0, 0, 0, 1, 0, 1), (2, 1, 70, 0, 0, 0, 0, 1, 0, 1), (60, 1, 2, 0, 0, 0, 0, 1, 0, 1), (1, 2, 1, 0, 0, 0, 0, 1, 0, 1), (2, 2, 2, 1, 0, 1, 0, 1, 0, 0), (1, 4, 1, 1, 0, 1, 0, 1, 0, 0),
    (3, 1, 2, 1, 0, 1, 0, 1, 0, 0), (60, 2, 2, 0, 0, 1, 0, 1, 0, 0), (4, 3, 3, 1, 0.2, 1, 0, 1, 0, 0), (2, 5, 1, 0.8, 0, 1, 0, 1, 0, 0), (0, 3, 2, 0, 0, 1, 0, 1, 0, 0), (2, 3, 0, 1, 0, 0, 0, 1, 0, 0), (0, 2, 60, 0, 0, 0, 0, 1, 0, 1), (2, 6, 70, 1, 0, 0, 0, 1, 0, 1),
    (1, 1, 60, 1, 0, 0, 0, 1, 0, 1), (40, 12, 3, 0, 0.9, 1, 0, 1, 0, 0), (3, 9, 3, 1, 1, 1, 0, 1, 0, 0), (60, 12, 3, 0, 0, 1, 0, 1, 0, 1), (70, 8, 2, 0, 0.1, 1, 0, 1, 0, 1),
    # Marked by a class, in an element of little of the page's text and of most of it; then in forms.
    (60, 70, 60, 0, 0, 0, 0.5, 0.2, 0, 1), (0, 90, 0, 0, 0, 0, 0.5, 0.2, 0, 1), (8, 60, 3, 0, 0, 0, 0.5, 0.2, 1, 1), (70, 80, 60, 0, 0.05, 0, 0.5, 0.2, 1, 1), (60, 55, 60, 0, 0.1, 0, 0.5, 0.2, 0, 1), (60, 3, 50, 0, 0, 0, 0.5, 0.2, 1, 0), (60, 30, 50, 0, 0, 0, 0.5, 0.2, 1, 0), (60, 15, 4, 0, 0, 1, 0.5, 0.2, 1, 0),
    (12, 9, 80, 0, 0, 0, 0.5, 0.2, 0, 0), (60, 30, 0, 0, 0, 0, 0.5, 0.2, 0, 0), (0, 15, 0, 0, 0, 0, 0.5, 0.2, 0, 0), (60, 70, 6, 0, 0.7, 1, 0.5, 0.2, 0, 0), (60, 70, 6, 0, 0.7, 1, 0.5, 0.2, 1, 0), (60, 3, 2, 0, 1, 1, 0.5, 0.2, 1, 0), (60, 90, 0, 0, 0, 0, 0.5, 0.2, -1, 0), (1, 40, 12, 1, 0, 0, 0.5, 0.2, -1, 0),
    (2, 2, 2, 1, 1, 1, 0.5, 0.2, 0, 0),
    (70, 60, 60, 0, 0, 0, 0.5, 0.9, 0, 1), (5, 40, 60, 0, 0, 0, 0.5, 0.8, 0, 1), (70, 2, 60, 0, 0, 0, 0.5, 0.9, 0, 1), (70, 5, 40, 0, 0, 0, 0.5, 0.7, 1, 1), (60, 9, 0, 0, 0, 0, 0.5, 0.6, 1, 1), (0, 5, 70, 0, 0, 0, 0.5, 0.8, 0, 1), (2, 5, 60, 1, 0, 0, 0.5, 0.6, 0, 1), (70, 80, 2, 0, 0, 0, 0.5, 0.9, 1, 1),
    (0, 5, 60, 0, 0, 0, 0.5, 0.6, 1, 1), (60, 4, 0, 0, 0, 0, 0.5, 0.6, 0, 1), (60, 15, 4, 0, 0, 1, 0.5, 0.4, 1, 0), (60, 3, 50, 0, 0, 0, 0.5, 0.4, 1, 0), (60, 30, 0, 0, 0, 0, 0.5, 0.4, 0, 0), (0, 12, 4, 0, 0, 0, 0.5, 0.4, 0, 0), (70, 80, 70, 0, 0, 0, 0.8, 0.9, 1, 1), (0, 5, 60, 0, 0, 0, 0.8, 0.9, 0, 1),
    (70, 3, 60, 0, 0, 0, 0.8, 0.9, 1, 1), (60, 9, 0, 0, 0, 0, 0.8, 0.6, 0, 1), (5, 60, 60, 0, 0, 0, 0.8, 0.6, 0, 1), (60, 70, 6, 0, 0, 0, 0.8, 0.3, 0, 0), (60, 5, 3, 0, 0, 0, 0.8, 0.1, 1, 0), (5, 2, 0, 0, 0, 0, 0.8, 0.1, 0, 0), (0, 60, 60, 0, 0, 0, 0.8, 0.4, 1, 0), (3, 80, 60, 0, 0, 0, 0.8, 0.4, 0, 0),
)


class Tree:
    """A binary decision tree: at each node the feature and threshold that leave the least Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12):
        self.keep = float(y.mean()) if len(y) else 0.0
        self.feature = None
        if depth == 0 or self.keep in (0.0, 1.0):
            return
        best = (len(y) * 2 * self.keep * (1 - self.keep) - 1e-9, None, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] < cut
                left = sum(2 * p * (1 - p) * n for p, n in ((y[low].mean(), low.sum()), (y[~low].mean(), (~low).sum())))
                if left < best[0] - 1e-9:
                    best = (left, f, float(cut))
        _, self.feature, self.cut = best
        if self.feature is not None:
            low = x[:, self.feature] < self.cut
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.keep)
        low, out = x[:, self.feature] < self.cut, np.empty(len(x))
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def trained_tree() -> Tree:
    table = np.array(EXAMPLES, float)
    return Tree(table[:, :-1], table[:, -1])


def _stands_around(tag: str, more: str, in_core: bool) -> float:
    """Whether an element surrounds the article: 1 by its tag or as it is hidden, 0.8 as a form, 0.5 by what its class, id or role say."""
    if tag in ("html", "body"):
        return 0.0
    names = _CARD_NAMES if tag in ("article", "main") else _NAMES
    if tag in _AROUND or (tag == "header" and not in_core):
        return 1.0
    named = 0.8 if tag == "form" else 0.0
    for found in _ATTRIBUTE.finditer(more) if more else ():
        name, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _UNSHOWN.search(value):
            return 1.0
        if name in ("class", "id", "role"):
            parts = {p.lower() for p in _WORD_EDGE.split(value) if p}
            if parts & names or (parts & _TOP_NAMES and not in_core):
                named = max(named, 0.5)
    return named


def _marked(rows: list[tuple], spans: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Per block the strongest mark of the elements (mark, first block, last block + 1) around it, and the least share of the page's words outside
    links that one of them holds. An element of links for the most part holds nothing."""
    words = np.array([r[0] for r in rows], float)
    free = words * (1 - np.array([r[1] for r in rows], float)) * (np.array([r[2] for r in rows], float) < 1)
    total, plain = np.concatenate([[0.0], words.cumsum()]), np.concatenate([[0.0], free.cumsum()])
    mark, share = np.zeros(len(rows)), np.ones(len(rows))
    for strength, first, last in spans:
        held, own = total[last] - total[first], plain[last] - plain[first]
        part = own / plain[-1] if plain[-1] and own * 3 >= held * 2 else 0.0
        mark[first:last] = np.maximum(mark[first:last], strength)
        share[first:last] = np.minimum(share[first:last], part)
    return mark, share


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """The texts of the page's blocks in order, and their features as in `FEATURES`."""
    texts, rows = [], []
    open_tags: list[tuple[str, bool, bool, list | None]] = []
    spans: list[list] = []
    run: list[str] = []
    linked, in_link, whole_link, around, core, own = 0, False, False, False, False, 0.0

    def close() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                texts.append(text)
                words = text.count(" ") + 1
                if 0 < own < 1:  # marked by the block's own tag
                    spans.append([own, len(rows), len(rows) + 1])
                rows.append((words, min(1.0, linked / words), float(around or own == 1), core))
            run.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        piece = html.unescape(piece)
        run.append(piece)
        if in_link:
            linked += len(piece.split())

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                close()
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m["end"] and _HREF.search(m["more"]) is not None
            # A link that ends before another begins holds what is in it, blocks too; one that never ends stops at the next block.
            whole_link = in_link and (following := _LINK.search(page, m.end())) is not None and following[1] == "/"
        elif tag == "br":
            run.append(" ")
        if tag in _INLINE:
            continue
        close()
        in_link = in_link and whole_link
        # A paragraph or heading speaks for its own block; what it holds ends with the next tag of its kind.
        own = _stands_around(tag, m["more"], core) if not m["end"] and tag not in _CONTAINERS and m["more"] else 0.0
        if tag not in _CONTAINERS:
            continue
        if m["end"]:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    _, around, core, _ = open_tags[k]
                    for *_, span in open_tags[k:]:
                        if span:
                            span[2] = len(rows)
                    del open_tags[k:]
                    break
        else:
            surrounds = _stands_around(tag, m["more"], core or tag in ("article", "main"))
            span = [surrounds, len(rows), -1] if 0 < surrounds < 1 else None
            open_tags.append((tag, around, core, span))
            if span:
                spans.append(span)
            around, core = around or surrounds == 1, core or (tag in ("article", "main") and not surrounds)
    if at < len(page):
        say(page[at:])
    close()
    if not rows:
        return texts, np.empty((0, len(FEATURES)))
    words, links, marks, cores = (np.array(c, float) for c in zip(*rows, strict=True))
    named, share = _marked(rows, [(s, a, len(rows) if b < 0 else b) for s, a, b in spans])
    share[marks == 1] = 1
    before = lambda v: np.concatenate([[0.0], v[:-1]])
    after = lambda v: np.concatenate([v[1:], [0.0]])
    place = np.where(cores > 0, 1.0, -1.0) if cores.any() else np.zeros(len(cores))
    return texts, np.column_stack([before(words), words, after(words), before(links), links, after(links), np.maximum(marks, named), share, place])


def _extractor(tree: Tree):
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            split = [blocks(p) if p else ([], np.empty((0, len(FEATURES)))) for p in pages]
            kept = tree.predict(np.concatenate([x for _, x in split])) >= 0.5 if split else np.empty(0)
            out, at = [], 0
            for texts, _ in split:
                out.append("\n".join(t for t, k in zip(texts, kept[at : at + len(texts)], strict=True) if k))
                at += len(texts)
            yield pd.Series(out, dtype=object)

    return extract


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html).

    A null, empty or text-free page gives an empty text. Character references are decoded, white space within a block becomes one
    blank, and kept blocks are joined by line ends; nothing is cut. Repeated rows give repeated results; other columns are not read.
    """
    found = pages.select("page_id", "url", _extractor(trained_tree())(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
