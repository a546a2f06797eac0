"""Main text of web pages: flat text blocks, classified by a decision tree over their words, links and neighbours."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only

#: Element names by their part in a page.
SKIPPED = frozenset("script style noscript template svg math iframe object select textarea button head title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTENT = frozenset("article main".split())
MARGIN = frozenset("nav header footer aside form menu dialog".split())
NESTED = CONTENT | MARGIN | frozenset("div section ul ol table figure details blockquote dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role attributes that name what is never main text, and those that may as well
#: stand on a part of it ("related work", "side effects"): their blocks are told apart by their words and links.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs masthead footer copyright comment comments reply replies disqus respond "
    "newsletter subscribe signup login pagination pager skip toolbar".split()
)
DOUBTFUL = frozenset("side rail toc header foot share sharing social related recommended search tags".split())
#: Elements that hold a sentence or a title, not an entry of a list or a cell.
PARAGRAPHS = HEADINGS | frozenset("p pre blockquote".split())
#: Elements whose end tag may be left out, by the openings that end them.
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "tr": frozenset(["tr"])}
FEATURES = ("furniture", "article", "heading", "paragraph", "words", "links", "words_before", "links_before", "words_after", "links_after")
#: Neighbours of a labelled block, before and after: none, a link, a menu line, a short and a long paragraph.
_AROUND = ((0, 0.0), (1, 1.0), (6, 1.0), (5, 0.0), (80, 0.0))
#: Labelled blocks outside article and furniture. Columns as in FEATURES, then 1 for main text.
_PLAIN = (
    (0, 0, 0, 1, 80, 0.00, 60, 0.00, 70, 0.00, 1), (0, 0, 0, 1, 45, 0.05, 8, 0.00, 60, 0.00, 1), (0, 0, 0, 1, 30, 0.00, 90, 0.00, 45, 0.02, 1),
    (0, 0, 0, 0, 150, 0.03, 5, 1.00, 4, 1.00, 1), (0, 0, 0, 1, 22, 0.00, 35, 0.00, 40, 0.00, 1), (0, 0, 0, 1, 18, 0.10, 50, 0.02, 30, 0.00, 1),
    (0, 0, 0, 1, 9, 0.00, 60, 0.00, 70, 0.00, 1), (0, 0, 0, 0, 12, 0.00, 40, 0.00, 35, 0.00, 1), (0, 0, 1, 1, 6, 0.00, 3, 1.00, 60, 0.00, 1),
    (0, 0, 1, 1, 5, 0.00, 70, 0.00, 40, 0.00, 1), (0, 0, 1, 1, 8, 0.00, 30, 0.00, 55, 0.00, 1), (0, 0, 0, 1, 90, 0.00, 0, 0.00, 0, 0.00, 1),
    (0, 0, 0, 0, 3, 1.00, 2, 1.00, 3, 1.00, 0), (0, 0, 0, 0, 6, 0.80, 4, 1.00, 5, 0.90, 0), (0, 0, 0, 0, 15, 0.60, 5, 1.00, 8, 0.70, 0),
    (0, 0, 0, 1, 40, 0.70, 3, 1.00, 4, 1.00, 0), (0, 0, 0, 0, 4, 0.00, 2, 1.00, 3, 0.00, 0), (0, 0, 0, 0, 7, 0.00, 4, 0.00, 5, 1.00, 0),
    (0, 0, 0, 1, 10, 0.40, 60, 0.00, 0, 0.00, 0), (0, 0, 0, 0, 3, 0.00, 5, 0.00, 2, 0.00, 0), (0, 0, 1, 1, 3, 0.00, 4, 1.00, 3, 1.00, 0),
    (0, 0, 0, 0, 8, 0.00, 3, 1.00, 6, 0.00, 0), (0, 0, 0, 1, 5, 0.00, 80, 0.00, 0, 0.00, 0), (0, 0, 1, 1, 2, 1.00, 2, 1.00, 6, 1.00, 0),
)


def labelled() -> list[tuple]:
    """The table that the tree is trained on: blocks of each kind of container amid each kind of neighbours.

    Furniture is never main text, whatever its length; an article's blocks are, but for short entries all of links. In
    doubtful containers an article's sentences are main text if they are long and bear few links; outside of all of these
    paragraphs are, and other blocks by their neighbours.
    """
    around = list(product(_AROUND, _AROUND))
    rows = [(2, a, h, p, w, k, *b, *c, 0) for i, (b, c) in enumerate(around) for a, h, p, w, k in ((0, 0, 0, 6, 1.0), (i % 2, i % 3 == 0, 1, (3, 12, 60, 200)[i % 4], 0.0))]
    rows += [(1, a, h, p, w, k, *b, *c, y) for i, (b, c) in enumerate(around) for a, h, p, w, k, y in ((1, 0, i % 2, (2, 6, 10)[i % 3], 1.0, 0), (1, 0, 0, (3, 6, 9)[i % 3], 0.0, 0), (1, 0, 1, (15, 30, 90)[i % 3], 0.1 * (i % 3), 1), (0, 0, i % 2, (4, 20, 60)[i % 3], 0.5 * (i % 3), 0))]
    rows += [(0, 1, h, p, w, k, *b, *c, 1) for i, (b, c) in enumerate(around) for h, p, w, k in ((0, i % 2, (1, 5, 60, 300)[i % 4], 0.0), (i % 2, i % 2, (2, 9, 14, 90)[i % 4], 0.3 * (i % 2)), (i % 2, 1, (1, 3, 9, 25)[i % 4], 1.0))]
    rows += [(0, 1, 0, 0, w, 1.0, *b, *b, 0) for w, b in product((1, 4, 8), _AROUND)]
    rows += [(0, 0, 0, 1, (14, 20, 35)[i % 3], 0.0, *b, *c, 1) for i, (b, c) in enumerate(around)]
    rows += [(0, 0, 1, 1, w, 0.0, *b, *c, y) for i, b in enumerate(_AROUND) for w in (2, 4, 8) for c, y in (((15 + 9 * i, 0.0), 1), ((3 + i, 1.0), 0))]
    return rows + list(_PLAIN)


_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*(?:>|\Z))|<[!?][^>]*(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


def train(rows: list[tuple] | None = None, depth: int = 7, least: int = 1) -> tuple:
    """A tree of (feature, threshold, left, right) and leaves 0 or 1, grown by Gini impurity; ties take the first split."""
    data = np.array(labelled() if rows is None else rows, float)
    x, y = data[:, :-1], data[:, -1]

    def grow(at: np.ndarray, left: int):
        share = y[at].mean()
        if left == 0 or share in (0.0, 1.0):
            return int(share >= 0.5)
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[at, f])
            for t in (values[1:] + values[:-1]) / 2:
                low, high = at[x[at, f] <= t], at[x[at, f] > t]
                if min(len(low), len(high)) < least:
                    continue
                cost = sum(len(s) * y[s].mean() * (1 - y[s].mean()) for s in (low, high))
                if best is None or cost < best[0] - 1e-12:
                    best = cost, f, float(t), low, high
        if best is None:
            return int(share >= 0.5)
        return best[1], best[2], grow(best[3], left - 1), grow(best[4], left - 1)

    return grow(np.arange(len(y)), depth)


def classify(tree, features: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def _furniture(attributes: str) -> int:
    """2 if the attributes name furniture, 1 if what they name is doubtful, else 0."""
    words = {w for m in _NAMED.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())}
    return 2 if words & FURNITURE else 1 if words & DOUBTFUL else 0


def blocks(page: str) -> list[tuple[str, int, bool, bool, bool, int, int]]:
    """(text, furniture, in an article, heading, paragraph, words, words in links) of each flat block of a page, in order.

    The innermost element that tells decides whether a block is furniture (2) or article; one that is doubtful makes it 1
    and leaves the article as it is around it. Broken markup is borne: an end tag closes the nearest element of its name,
    if one is open; elements whose end tag may be left out end where the next one opens; comments and skipped elements
    are passed over.
    """
    out: list = []
    stack: list[tuple[str, int]] = []  # name; 1 article, -1 furniture, 2 doubtful, 0 as its parent
    text: list[str] = []
    links = anchor = 0
    kind = ""

    def state() -> tuple[int, bool]:
        doubtful = False
        for _, m in reversed(stack):
            if m == 2:
                doubtful = True
            elif m:
                return (2, False) if m < 0 else (int(doubtful), True)
        return int(doubtful), False

    def flush() -> None:
        nonlocal links
        words = "".join(text).split()
        if words:
            out.append((" ".join(words), *state(), kind in HEADINGS, kind in PARAGRAPHS, len(words), min(links, len(words))))
        text.clear()
        links = 0

    at = 0
    while True:
        m = _TAG.search(page, at)
        raw = page[at : m.start() if m else len(page)]
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            text.append(plain)
            links += len(plain.split()) if anchor else 0
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in SKIPPED and not closing:
            if not m[3].endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name not in ("head", "title"):
                    at = len(page)
            continue
        if name == "a":
            anchor = 0 if closing else 1
        if name == "br":
            text.append(" ")
        if name in INLINE or name in SKIPPED or name == "br":
            continue
        flush()
        kind = "" if closing else name
        if not closing and stack:  # an open paragraph ends with any block, a list's entry or a cell with the next
            open_ = stack[-1][0]
            if open_ == "p" or name in CLOSED_BY.get(open_, ()):
                stack.pop()
        if name in NESTED:
            if not closing:
                anchor = 0
                named = _furniture(m[3])
                mark = -1 if name in MARGIN or named == 2 else 1 if name in CONTENT else 2 if named else 0
                stack.append((name, mark))
            elif any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
        elif not closing:
            named = _furniture(m[3])
            if named:
                stack.append((name, -1 if named == 2 else 2))
        elif stack and stack[-1][0] == name:
            stack.pop()
    flush()
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    sizes = [(0, 0.0), *((words, links / words) for *_, words, links in found), (0, 0.0)]
    kept = []
    for i, (text, furniture, article, heading, paragraph, *_) in enumerate(found):
        before, here, after = sizes[i], sizes[i + 1], sizes[i + 2]
        if classify(tree, (furniture, article, heading, paragraph, *here, *before, *after)):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html): the main text of each page.

    Null and empty html give an empty text; repeated rows each return; page_id and url pass through, nulls too. Rows
    never leave their task.
    """
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(t.as_py(), tree) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
