"""Main text of web pages by the ratios of their tag paths.

A page is read once into text blocks, each with its root-to-leaf path of block tags. Text length, punctuation and link characters are summed
by path and divided by the path's blocks; both ratios are smoothed over the blocks in page order, averaged by path again and fused into
sqrt(length * punctuation) * (1 - link share). Paths above a share of the deviation are content, and the element that holds most of them (an
article or main element where there is one) is the container: its other blocks are part of the text too, so that headings, short
paragraphs, lists and tables stay. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go by their element or
by the words of their class, id and role; a header inside an article stays. If that leaves nothing, class words are ignored.

Markup may be broken: end tags that HTML leaves out are implied, others may be missing, tags and comments may be cut off. The reader passes over a page once,
so time is linear in its length. Null and empty pages give empty text; repeated rows are read alike; other columns pass through, whatever
their names (one named like an output column is replaced).
"""

from __future__ import annotations

import html

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
RAW_ENDS = {t: re.compile(f"</{t}(?=[\\s/>])", re.I | re.A) for t in RAW}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center details dir div dl dd dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
#: An element of the first kind ends open ones of the second, unless one of the third stands between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ()),
}
SCOPES = ("table", "td", "th", "caption", "button", "object")
OF_HEAD = frozenset("html head meta link base title style script noscript template".split())
#: Elements that hold no main text.
NOISE = frozenset("head nav footer aside form button select dialog menu svg canvas audio video object datalist search".split())
#: Words of a class, id or role that say the same.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners cookie cookies consent gdpr "
    "notice notices notification popup modal overlay newsletter subscribe subscription signup login signin paywall sidebar sidebars sidenav aside complementary menu menus nav navbar "
    "navigation breadcrumb breadcrumbs header masthead contentinfo footer comment comments commentlist disqus reply replies respond discussion share sharing sharebar social related "
    "recommended recommendations teaser widget widgets toolbar pagination pager skip search hidden alert toast disclaimer copyright tags byline".split()
)
KEPT_WORDS = ("has-", "no-", "with-", "without-", "not-")
NEVER = frozenset("html body main article".split())
MARKS = re.compile(r"[,.;:!?…。，、；：！？]")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
#: Weights of a block's neighbours in smoothing, and the share of the deviation over which a path is content.
KERNEL = np.array([0.25, 0.5, 0.25])
SHARE = 0.5


def hinted(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether the words of an element's attributes name it as something else than main text."""
    if not attributes or tag in NEVER:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name in ("class", "id", "role"):
            for word in value.split():
                found = WORDS.intersection(re.split(r"[^a-z]+", word)) if not word.startswith(KEPT_WORDS) else ()
                if found and not (in_article and found == {"header"}):
                    return True
    return False


class Reader:
    """One pass over a page: `blocks` are (path, element, text, link characters), `elements` are (parent, tag)."""

    def __init__(self, page: str, hints: bool):
        self.hints, self.blocks = hints, []
        self.elements, self.paths = [(-1, "")], {}
        self.stack: list[tuple] = []  # (tag, element, path, noise, inline)
        self.open: dict[str, list[int]] = {}
        self.block_at: list[int] = []
        self.pieces, self.linked = [], 0
        self.read(page)
        self.flush()

    def last(self, *tags: str) -> int:
        return max((at[-1] for t in tags if (at := self.open.get(t))), default=-1)

    def top(self) -> tuple:
        return self.stack[-1] if self.stack else ("", 0, -1, False, False)

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            _, element, path, _, _ = self.top()
            self.blocks.append((path, element, text, min(self.linked, len(text))))
        self.pieces, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw and self.top()[0] == "head" and not raw.isspace():
            self.close(len(self.stack) - 1)
        if raw and not self.top()[3]:
            piece = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(piece)
            if self.open.get("a"):
                self.linked += len(piece.strip())

    def close(self, at: int) -> None:
        """End the elements from a place of the stack on."""
        if self.block_at and self.block_at[-1] >= at:
            self.flush()
        while len(self.stack) > at:
            tag, *_, inline = self.stack.pop()
            self.open[tag].pop()
            if not inline:
                self.block_at.pop()

    def start(self, tag: str, attributes: str) -> None:
        inline = tag in INLINE
        if self.open.get("head") and tag not in OF_HEAD:
            self.close(self.last("head"))
        if tag in CLOSES_P and (p := self.last("p")) > self.last(*SCOPES):
            self.close(p)
        if tag in IMPLIED:
            ended, kept = IMPLIED[tag]
            if (at := self.last(*ended)) > self.last(*kept):
                self.close(at)
        if tag in HEADINGS and self.top()[0] in HEADINGS:
            self.close(len(self.stack) - 1)
        if tag == "a" and (at := self.last("a")) > (self.block_at[-1] if self.block_at else -1):
            self.close(at)
        if not inline:
            self.flush()
        _, parent, path, noise, _ = self.top()
        article = bool(self.open.get("article"))
        noise = noise or tag in NOISE or (tag == "header" and not article) or (self.hints and hinted(tag, attributes, article))
        if not inline:
            self.elements.append((parent, tag))
            parent, path = len(self.elements) - 1, self.paths.setdefault((path, tag), len(self.paths))
            self.block_at.append(len(self.stack))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, parent, path, noise, inline))

    def end(self, tag: str) -> None:
        at = self.last(tag)
        inline = tag in INLINE
        if at < 0 or (inline and self.block_at and self.block_at[-1] > at) or (tag not in SCOPES and at < self.last("table", "td", "th", "caption") and tag not in ("tr", "tbody", "thead", "tfoot", "body", "html")):
            return
        self.close(at)

    def read(self, page: str) -> None:
        at, size, last = 0, len(page), page.rfind(">")
        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                self.text(page[at:])
                return
            nxt = page[lt + 1 : lt + 2]
            if nxt == "!" or nxt == "?" or (nxt == "/" and not page[lt + 2 : lt + 3].isalpha()):
                self.text(page[at:lt])
                if page.startswith("<!--", lt):
                    end = lt + 4 if page.startswith(("<!-->", "<!--->"), lt) else page.find("-->", lt + 4)
                    step = page.find(">", end) + 1 if end >= 0 else 0
                else:
                    step = page.find(">", lt) + 1
                if step <= 0:
                    return
                at = step
                continue
            if not (nxt == "/" or (nxt.isascii() and nxt.isalpha())):
                self.text(page[at : lt + 1])
                at = lt + 1
                continue
            self.text(page[at:lt])
            m = TAG.match(page, lt) if lt < last else None
            if m is None:  # cut off within a tag
                return
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self.end(tag)
            elif tag in VOID:
                if tag == "br":
                    self.text(" ")
                elif tag == "hr":
                    self.start(tag, "")
                    self.close(len(self.stack) - 1)
            elif tag in RAW:
                end = RAW_ENDS[tag].search(page, at)
                at = page.find(">", end.end()) + 1 if end else 0
                if at <= 0:  # not ended: the rest belongs to it
                    return
            else:
                self.start(tag, m[3])
                if m[3].endswith("/") and tag in ("svg", "path", "use"):
                    self.close(len(self.stack) - 1)


def content_paths(path: np.ndarray, length: np.ndarray, marks: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Whether each block's path is content: ratios by path, smoothed over the blocks, fused and held against their deviation."""
    n = np.bincount(path)
    ratio = lambda x: np.convolve(np.pad((np.bincount(path, x) / np.maximum(n, 1))[path], 1, "edge"), KERNEL, "valid")
    by_path = lambda x: np.bincount(path, x) / np.maximum(n, 1)
    links = np.bincount(path, linked) / np.maximum(np.bincount(path, length), 1)
    fused = np.sqrt(by_path(ratio(length)) * by_path(ratio(marks))) * (1 - links)
    # A path whose blocks hold no mark is carried by its neighbours only.
    fused = np.where(np.bincount(path, marks) > 0, fused, 0)
    return (fused > SHARE * fused[path].std())[path] & (fused[path] > 0)


def container(elements: list[tuple[int, str]], at: list[int], mass: np.ndarray) -> int:
    """The article, else main element of the most content; else the deepest element that holds nine tenths of it."""
    held = np.zeros(len(elements))
    np.add.at(held, at, mass)
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i][0]] += held[i]
    for tag in ("article", "main"):
        found = [i for i, (_, t) in enumerate(elements) if t == tag]
        if found and held[best := max(found, key=lambda i: (held[i], -i))] >= 0.5 * held[0] > 0:
            return best
    deep = [i for i in range(1, len(elements)) if held[i] >= 0.9 * held[0] and elements[i][1] != "p"]
    return max(deep, default=0)


def main_blocks(page: str, hints: bool = True) -> list[str]:
    """The texts of the content blocks, in page order."""
    r = Reader(page, hints)
    if not r.blocks:
        return main_blocks(page, False) if hints else []
    path, at, texts, linked = zip(*r.blocks)
    path = np.unique(np.array(path), return_inverse=True)[1]
    length, marks = np.array([len(t) for t in texts], float), np.array([len(MARKS.findall(t)) for t in texts], float)
    content = content_paths(path, length, marks, np.array(linked, float))
    if not content.any():
        content = np.ones(len(texts), bool)
    top = container(r.elements, list(at), np.where(content, length - np.array(linked), 0))
    inside = np.zeros(len(r.elements), bool)
    inside[top] = True
    for i, (parent, _) in enumerate(r.elements):
        inside[i] |= parent >= 0 and inside[parent]
    keep = [bool(inside[a]) for a in at]
    # A heading right before the container belongs to its text.
    if any(keep):
        first = keep.index(True)
        while first > 0 and r.elements[at[first - 1]][1] in HEADINGS:
            first -= 1
            keep[first] = True
    return [t for t, k in zip(texts, keep) if k]


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """pages without their html, plus text and n_chars."""

    @F.pandas_udf("string")
    def extracted(html_text: pd.Series) -> pd.Series:
        return html_text.map(lambda x: " ".join(main_blocks(x)) if isinstance(x, str) else "")

    text = extracted(F.col(page).cast("string"))
    out = pages.select(*[c for c in pages.columns if c not in (page, "text", "n_chars")], text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
