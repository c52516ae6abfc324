"""Main text of web pages: the highest-scoring contiguous region, words scoring positive and tags negative.

Each page is a sequence of tokens: words, with the kind of element they stand in, and tags. Weights are log odds of a
token's kind inside against outside the content of labelled pages; pages that mark their content with ``<article>`` or
``<main>`` label themselves, a bounded sample of them is enough. One linear scan finds the region of greatest sum. Menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out of the region's text.

Null and empty pages give an empty text. Unclosed elements are closed as browsers do. Rows are independent.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import hashed_sample

#: Most labelled pages that weights are fitted on, chosen by hash.
LABELLED_PAGES = 2_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
SPACE = re.compile(r"\s+")
#: Elements whose content is no markup; those without an end tag; blocks.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed"}
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "td", "th", "thead", "tbody", "tfoot",
          "caption", "blockquote", "pre", "section", "article", "main", "header", "footer", "nav", "aside", "figure", "figcaption", "form", "fieldset",
          "hr", "address", "body", "html", "head", "details", "summary", "center", "dialog"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements and whole names of class, id or role that mark what is no content.
OUTSIDE = {"nav", "footer", "aside", "form", "button", "select", "head", "menu", "dialog", "option", "label", "script", "style", "title", "noscript",
           "template", "iframe", "svg", "textarea", "object", "audio", "video", "canvas", "map", "xmp", "noembed"}
OUTSIDE_NAMES = {"ad", "ads", "adv", "advert", "advertisement", "adverts", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "menu", "nav", "navbar",
                 "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "sidebar", "side", "aside", "widget", "related", "recommended",
                 "comment", "comments", "reply", "replies", "respond", "disqus", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal",
                 "newsletter", "subscribe", "subscription", "signup", "share", "sharing", "social", "login", "search", "toolbar", "pagination", "pager",
                 "copyright", "legal", "skip", "tags", "toc", "alert", "contentinfo", "complementary", "form"}
INSIDE = {"article", "main"}
#: Weights where no labelled page shows the kind.
UNSEEN_WORD, UNSEEN_TAG, OUTSIDE_WORD = 0.5, -0.3, -1.5


class _Page:
    """Tokens of one page in order: (kind, block number or None, is tag, inside a marked article) and the blocks' texts.

    ``shown`` are the numbers of elements that are not left out in spite of their names; ``held`` gives the words of those left out.
    """

    def __init__(self, source: str, shown: frozenset[int] = frozenset()):
        self.shown, self.held, self.named, self.number, self.words = shown, {}, [], 0, 0
        self.tokens: list[tuple[str, int, bool, bool]] = []
        self.blocks: list[list[str]] = [[]]
        self.stack: list[tuple[str, bool]] = []
        self.out = self.inside = 0
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            self.text(source[at:m.start() if m else n])
            if not m:
                break
            at = m.end()
            if m[0].startswith("<![CDATA["):
                self.text(m[0][9:].removesuffix("]]>"), decode=False)
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self.close(name)
            else:
                self.open(name, m[3] or "")
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                    at = end.end() if end else n
                    self.close(name)
        while self.stack:
            self.pop()

    def text(self, piece: str, decode: bool = True) -> None:
        if not piece:
            return
        piece = html.unescape(piece) if decode and "&" in piece else piece
        if not self.out:
            self.blocks[-1].append(piece)
        words = len(piece.split())
        self.words += words
        if words:
            kind = "outside" if self.out else f"word:{self.stack[-1][0] if self.stack else 'body'}"
            self.tokens.append((kind, len(self.blocks) - 1, words, self.inside > 0 and not self.out))

    def cut(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def mark(self, name: str) -> None:
        self.tokens.append((f"tag:{name}", len(self.blocks) - 1, 0, self.inside > 0 and not self.out))

    def pop(self) -> None:
        name, out = self.stack.pop()
        if self.named and self.named[-1][0] > len(self.stack):
            _, number, before = self.named.pop()
            self.held[number] = self.words - before
        self.out -= out
        self.inside -= name in INSIDE

    def open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.cut()
            if name == "p" or name in BLOCKS and any(x == "p" for x, _ in self.stack):
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] == "p":
                        while len(self.stack) > i:
                            self.pop()
                        break
                    if self.stack[i][0] in BLOCKS:
                        break
            if name in ("li", "tr", "td", "th", "dt", "dd", "option") and self.stack and self.stack[-1][0] == name:
                self.pop()
            if name in INSIDE:
                while self.stack and self.stack[-1][1]:
                    self.pop()
        self.mark(name)
        if name == "br":
            self.text(" ")
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCKS:
            return
        if name == "body":
            while self.stack and self.stack[-1][0] in ("head", "title"):
                self.pop()
        names = {w for g in NAMES.findall(attributes) for w in "".join(g).lower().split()}
        named = name not in HEADINGS and name not in ("html", "body", *INSIDE) and bool(names & OUTSIDE_NAMES)
        if named:
            self.number += 1
            named = self.number not in self.shown
        lead = name == "header" and not self.inside or name == "header" and not any(x in INSIDE for x, _ in self.stack)
        out = name not in ("html", "body", *INSIDE) and bool(name in OUTSIDE or lead or named or HIDDEN.search(attributes))
        self.stack.append((name, out))
        if named:
            self.named.append((len(self.stack), self.number, self.words))
        self.out += out
        self.inside += name in INSIDE

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.cut()
        self.mark(f"/{name}")
        if any(x == name for x, _ in self.stack):
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()
            if name in BLOCKS:
                self.cut()


def page_of(source: str) -> _Page:
    """The page; an element whose name marks it as no content is kept if it holds most of the page's words."""
    shown: frozenset[int] = frozenset()
    while True:
        page = _Page(source, shown)
        most = {k for k, words in page.held.items() if 2 * words > page.words}
        if not most:
            return page
        shown |= most


def count_kinds(source: str) -> dict[str, tuple[int, int]]:
    """Of one labelled page: for each kind of token how many stand inside and outside the marked content."""
    seen: Counter = Counter()
    for kind, _, words, inside in page_of(source).tokens:
        seen[kind, inside] += words or 1
    return {k: (seen[k, True], seen[k, False]) for k, _ in seen}


def weights_from(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log odds, smoothed, words held above and tags below zero."""
    total_in, total_out = sum(a for a, _ in counts.values()) + 1, sum(b for _, b in counts.values()) + 1
    out = {}
    for kind, (a, b) in counts.items():
        odds = math.log((a + 0.5) / total_in) - math.log((b + 0.5) / total_out)
        if kind == "outside":
            out[kind] = min(OUTSIDE_WORD, odds)
        elif kind.startswith("word:"):
            out[kind] = max(0.1, min(3.0, odds)) if a else min(-0.5, max(-3.0, odds))
        else:
            out[kind] = max(-1.0, min(-0.05, odds))
    return out


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """Text of the region of greatest sum, a block a line."""
    page = page_of(source or "")
    best, start, total, found = 0.0, 0, 0.0, None
    for i, (kind, _, words, _) in enumerate(page.tokens):
        if words and kind != "outside":
            total += words * weights.get(kind, UNSEEN_WORD)
        elif not words:
            total += weights.get(kind, UNSEEN_TAG)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i)
    if not found:
        return ""
    first, last = page.tokens[found[0]][1], page.tokens[found[1]][1]
    lines = (SPACE.sub(" ", "".join(b)).strip() for b in page.blocks[first:last + 1])
    return "\n".join(x for x in lines if x)


def learn_weights(pages: DataFrame, html_col: str = "html", max_pages: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most ``max_pages`` self-labelled pages, those of least hash. Only counts per kind come to the driver."""
    labelled = pages.select(F.col(html_col).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    sample = hashed_sample(labelled, F.xxhash64("html"), max_pages, labelled.count())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for source in batch["html"]:
                for kind, (a, b) in count_kinds(source).items():
                    seen[kind, "inside"] += a
                    seen[kind, "outside"] += b
            kinds = sorted({k for k, _ in seen})
            yield pd.DataFrame({"kind": kinds, "inside": [seen[k, "inside"] for k in kinds], "outside": [seen[k, "outside"] for k in kinds]}).astype({"inside": "int64", "outside": "int64"})

    counts = sample.mapInPandas(count, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"))
    top = counts.orderBy((F.col("a") + F.col("b")).desc(), "kind").limit(1_000).collect()
    return weights_from({r["kind"]: (r["a"], r["b"]) for r in top})


def extract(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per page: the ``carry`` columns and ``text``."""
    carry = carry if carry is not None else ["page_id", "url"]
    weights = learn_weights(pages, html_col) if weights is None else weights

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return column.map(lambda s: main_text(s if isinstance(s, str) else "", weights)).astype(object)

    return pages.select(*carry, texts(F.col(html_col)).alias("text"))
