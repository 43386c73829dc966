"""Operator 1: main text of web pages by shallow block features and a decision tree.

A page is cut into flat text blocks at block-level tags.  A block is described
by its word count and link density and those of the blocks before and after
it, by whether it is a heading, and by what the elements around it say: an
article, page furniture, and names in class, id or role that hint at
furniture.  A CART tree fitted on a small labelled table - the blocks of the
sample pages below - decides which blocks are main text; no feature decides by
itself.

Defined results: null or empty html, and pages without main text, give an
empty text; a page cut off in the middle is read as far as it goes, an
unfinished tag, comment or script at its end is dropped; a control, picture or
drawing that is never closed ends at the next block-level tag; repeated rows
give repeated results; an empty table gives an empty result; other columns
pass unchanged, and columns named text or n_chars are replaced.  Pages are
read whole, whatever their length, in time proportional to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Sample pages, one a line.  ``=N`` stands for a main-text block of N words, ``-N`` for another
#: block, ``@M`` after it for how many of the words are linked.
SAMPLES = """
<nav><ul><li>-1@1</li><li>-1@1</li><li>-2@2</li></ul></nav><div class="ad">-8</div><article><h1>=10</h1><p>=60</p><p>=3</p><p>=90@4</p><p>=14</p></article><footer>-14</footer>
<nav><ul><li>-1@1</li><li>-1@1</li></ul></nav><div class="ad">-12</div><article><h1>=7</h1><p>=2</p><p>=1</p></article><footer>-9</footer>
<nav><a>-6@6</a></nav><div class="ad">-9</div><article><h1>=4</h1><p>=1</p></article><footer>-20</footer>
<header class="site"><a>-2@2</a><p>-6</p></header><main><article><header><h1>=9</h1><p>=4</p></header><p>=45@3</p><h2>=3</h2><p>=120@6</p><ul><li>=9@4</li><li>=12</li></ul><blockquote>=25</blockquote></article><aside><h3>-2</h3><p>-40</p><p>-5@5</p></aside></main><footer>-30@4</footer>
<div id="header"><h1>-3@3</h1></div><div id="menu"><li>-2@2</li><li>-1@1</li></div><div id="content"><h2>=6</h2><p>=40</p><p>=55@3</p><p>=18@2</p><h3>=4</h3><p>=30@5</p><p>=8</p><p>=70</p></div><div id="footer">-8@3</div>
<div><a>-1@1</a></div><div>-3@3</div><div>=16</div><div>=90@9</div><div>=20</div><div>-2@2</div><div>-1</div>
<p>-3@3</p><h1>=8</h1><p>=50</p><p>=6</p><p>=60</p><p>=22@1</p><div>-5@4</div><div>-2@2</div><div>-8@5</div>
<div>-2@2</div><h2>-3</h2><div>-2@2</div><div>-4@4</div><h2>-5</h2><div>-4@3</div><div>-3@3</div><div>-14@10</div><div>-35@28</div><div>-60@45</div><div>-12@10</div>
<article class="post"><h1>=6</h1><p class="byline">-4</p><p>=80@8</p><p>=35</p><div class="share-buttons">-2@2</div><section class="related-posts"><h3>-2</h3><p>-9@9</p><p>-30@6</p></section></article><section id="comments"><h2>-2</h2><article class="comment"><p>-50</p></article><article class="comment"><p>-110@2</p><p>-20</p></article></section>
<article><h1>=5</h1><p>=70</p><div class="related-work"><p>=50</p><p>=42@3</p></div><div class="comment-on-law"><p>=60</p><p>=5</p></div><p>=33</p></article>
<div class="share price article"><h1>=9</h1><p>=55</p><p>=20@2</p></div><div class="share-links">-4@4</div>
<article id="comment-on-tax"><h1>=5</h1><p>=48</p><p>=52</p></article><div class="comments"><p>-45</p><p>-25</p></div>
<div class="notes-on-advertising"><p>=45</p><p>=62</p></div><div class="footer-links">-7@7</div>
<div class="menu-of-the-day"><p>=40@2</p><p>=25</p></div><div class="menu">-3@3</div><div class="menu">-20@3</div>
<div class="cookie-notice">-25@3</div><div class="sidebar"><article><h1>=8</h1><p>=44</p><p>=30</p></article><p>-35</p><p>-4@4</p></div><div class="sidebar"><p>-60</p><h3>-3</h3></div>
<article><p>=40</p><form><p>-14</p><p>-30@3</p></form><aside><p>-50</p></aside><p>=5@5</p><p>=60@2</p><nav>-3@3</nav><p>-2@2</p><p>-3@3</p><p>-1@1</p><p>-4@4</p></article>
<article><h2>=3</h2><h3>=1</h3><p>=7</p><p>=25@5</p><p>=4</p><p>=1</p><p>=14@4</p><p>=2</p><p>=5</p><p>=15@9</p><p>=40</p><h4>=4@4</h4><p>=30@3</p></article>
<div class="banner"><p>-40</p></div><div class="newsletter-signup"><p>-18</p><p>-25@1</p></div><div class="popup"><p>-70</p></div><div class="notice">-30</div><p>=35</p><p>=40@2</p>
<main><div class="ad-slot"><p>-20</p></div><p>=28</p><p>=3</p><p>=45</p><div class="advertisement">-35@5</div><p>=50</p></main><footer><p>-12</p><p>-4@4</p><p>-60</p></footer>
<header><h1>-4</h1><p>-12</p></header><p>=30</p><p>=45@2</p><p>=6</p><p>=35</p><footer>-6</footer><p>-3@3</p>
<div hidden><p>-30</p></div><p>=4</p><p>=35@2</p><p>=28</p><div>-9</div><div>-1</div><div>-9@6</div>
<div class="related-events"><p>-3@3</p><p>-4@4</p><p>-6@5</p></div><div class="sharp-image">-2@2</div><p>=55</p><p>=31</p>
<div class="comment-policy"><p>-5@5</p></div><div>-5</div><div>-3</div><div>-4@4</div><h3>-2</h3><div>-2@2</div>
<nav><a>-2@2</a></nav><article><h1>=6</h1><p>=3</p><p>=24</p></article><nav>-2@2</nav><footer>-3@3</footer>
<nav><li>-1@1</li><li>-2@2</li></nav><main><article><h1>=3</h1><h2>=9</h2><p>=5</p><p>=2@1</p><p>=11@2</p><ul><li>=2</li><li>=3</li></ul></article></main><aside>-4@4</aside><footer><p>-11</p></footer>
<ul class="nav"><li>-1@1</li></ul><div class="post"><h2>=5</h2><p>=9</p><p>=4</p><p>=50@2</p><h2>=4</h2><p>=10</p></div><div class="pager">-3@3</div>
<div><a>-6@6</a></div><h1>=7</h1><p>=8</p><p>=60</p><p>=45</p><div>-6@6</div>
<nav>-5@5</nav><article><h1>=4@4</h1><p>=38</p><p>=6</p><table><tr><td>=1</td><td>=2</td></tr><tr><td>=1</td><td>=1</td></tr></table><p>=6</p></article><div class="ad">-6@6</div>
<nav>-4@4</nav><header><p>-5</p></header><article><p>=2</p></article><article><h2>=5</h2><p>=17</p></article><form>-5</form><div class="cookie-bar">-8@1</div>
<article><h1>=6</h1><p>=55</p><p>=12@11</p><p>=48</p><ul><li>=9@9</li><li>=30</li></ul><p>=62</p><p>=3@3</p><p>=41</p></article>
<main><p>=70</p><p>=10@9</p><p>=66@2</p><p>=7@7</p><p>=80</p><h2>=4</h2><p>=5@5</p><p>=52</p></main><div>-5@5</div>
<article><p>=45</p><ul><li>=8@8</li><li>=6@6</li><li>=9@9</li></ul><p>=50</p></article><div>-9@9</div>
<div><h1>=7</h1><p>=58</p><p>=11@10</p><p>=47</p><p>=33@2</p></div><div>-4@4</div>
<nav><a>-2@2</a></nav><div><h1>=4</h1><p>=48</p><p>=50</p><div class="share-links">-2@2</div></div><div class="comments"><p>-24</p></div>
<nav>-1@1</nav><div><h1>=2</h1><p>=48</p><p>=7@7</p><p>=49</p></div><footer>-3</footer>
<div>-3@3</div><section><h1>=3</h1><p>=36</p><p>=12@10</p><p>=61</p></section><div>-2@2</div>
<nav>-3@3</nav><div><h1>=5</h1><p>=60</p><p>=3@3</p><p>=52</p><p>=45</p></div><footer>-6@2</footer>
<div>=40</div><div class="breadcrumb">-4@3</div><div>=8</div><div>=18</div><div>=35@1</div><div>=2</div><div>=28</div><div class="copyright">-12</div>
"""

#: Elements without text of the page: their inside is not markup, or it is not read.
RAW = frozenset("script style".split())
SKIPPED = frozenset("textarea title iframe noscript template svg select button object canvas math audio video map".split())
NESTING = frozenset("template svg object map math video audio".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
LANDMARK = frozenset("article aside body details dialog div fieldset figure footer form header main menu nav ol search section span table td ul p".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may stand around a whole page.
WRAPPERS = frozenset("article div fieldset form header main section span table td".split())
FURNITURE_TAGS = frozenset("nav footer aside form dialog menu search fieldset".split())
#: Words in class, id or role that hint at page furniture, alone or beside words of structure.
HINTS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner comment comments disqus reply replies "
    "respond discussion menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations popular trending widget modal popup overlay copyright pagination pager "
    "contentinfo complementary search footer".split()
)
STRUCTURE = frozenset(
    "a area article articles aside bar block body bottom box btn button buttons center col column container content count form foot grid group head header icon icons "
    "inner item items left line link links list main message module more page panel post posts right row section site slot small story stories tab text title to top unit wrap wrapper zone".split()
)
#: Words that hint at furniture unless an article stands inside.
SOFT = frozenset("sidebar side rail header masthead topbar toolbar alert legal disclaimer meta byline tags toc skip".split())
ARTICLE = frozenset("article articlebody maintext story storybody entry post postbody postcontent entrycontent".split())

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    around: tuple[int, int, int] | int  # while a page is read, the number of the element it stands in


#: What the elements around a place say: article (0, 1), furniture (0, 1 unless an article stands inside, 2), hint (0, 1 weak, 2 strong).
PLAIN = (0, 0, 0)


def _names(value: str) -> tuple[int, bool, bool]:
    """(furniture hint, soft hint, article) of a class, id or role value."""
    hint, soft, article = 0, False, False
    for token in _CAMEL.sub("-", value).lower().split():
        words = _WORDS.findall(token)
        rest = [w for w in words if w not in HINTS and w not in SOFT]
        if len(rest) < len(words):
            whole = all(w in STRUCTURE or w in ARTICLE for w in rest)
            if any(w in HINTS for w in words):
                hint = max(hint, 2 if whole else 1)
            elif whole:
                soft = True
        elif any(w in ARTICLE for w in words) and all(w in ARTICLE or w in STRUCTURE for w in words):
            article = True
    return (min(hint, 1) if article else hint), soft, article


def _around(tag: str, attrs: str, outer: tuple[int, int, int]) -> tuple[int, int, int]:
    """What holds inside an element, from its tag and attributes and what holds around it."""
    article, furniture, hint = outer
    opens = tag in ("article", "main")
    if tag in FURNITURE_TAGS:
        furniture = 2
    elif tag == "header" and not article:
        furniture = max(furniture, 1)
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name = name.lower()
            value = value.strip("\"'")
            if name in ("class", "id", "role"):
                h, soft, a = _names(value)
                hint = max(hint, h)
                opens |= a
                if soft and not a:
                    furniture = max(furniture, 1)
                if name == "role" and value.lower() in ("main", "article"):
                    opens = True
            elif name == "itemprop" and value.lower() == "articlebody":
                opens = True
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                furniture = 2
    if opens:
        article, furniture = 1, furniture if furniture == 2 else 0
    return article, furniture, hint


class Elements:
    """Elements of a page that may say what stands inside them: marks, words below, and whether the page's title is below."""

    def __init__(self):
        self.tag, self.attrs, self.outer, self.words = ["html"], [""], [0], [0]
        self.title: int | None = None
        self.article: int | None = None

    def open(self, tag: str, attrs: str, outer: int) -> int:
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.outer.append(outer)
        self.words.append(0)
        n = len(self.tag) - 1
        if self.article is None and tag in ("article", "main"):
            self.article = n
        return n

    def add(self, inside: int, plain: int, title: bool) -> None:
        self.words[inside] += plain
        if title and self.title is None:
            self.title = inside

    def around(self) -> list[tuple[int, int, int]]:
        """What holds inside each element.

        A wrapper - it holds the page's first h1 (without one, its first
        article) and half or more of its unlinked words - is no furniture,
        whatever its names, and neither is the body.
        """
        words = list(self.words)
        for k in range(len(words) - 1, 0, -1):
            words[self.outer[k]] += words[k]
        wraps = set()
        k = self.title if self.title is not None else self.article
        while k:
            if 2 * words[k] >= words[0]:
                wraps.add(k)
            k = self.outer[k]
        out = [PLAIN]
        for k in range(1, len(words)):
            outer = out[self.outer[k]]
            got = _around(self.tag[k], self.attrs[k], outer)
            if self.tag[k] == "body" or k in wraps and self.tag[k] in WRAPPERS:
                got = (got[0], 0 if got[0] and outer[1] < 2 else outer[1], outer[2])
            out.append(got)
        return out


class _Closers:
    """Where each element of a kind ends: the end of its closing tag, found in one pass per kind of tag."""

    def __init__(self, html: str):
        self.html, self.found = html, {}

    def end(self, tag: str, at: int) -> int | None:
        """End of the element whose opening tag ends at ``at``; None if it is never closed."""
        if tag not in self.found:
            ends: dict[int, int] = {}
            open_: list[int] = []
            for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*+>", re.I).finditer(self.html):
                if not m[1]:
                    if tag not in NESTING:
                        open_.clear()
                    if not m[0].endswith("/>"):
                        open_.append(m.end())
                elif open_:
                    ends[open_.pop()] = m.end()
            self.found[tag] = ends
        return self.found[tag].get(at)


def blocks(html: str | None) -> list[Block]:
    """Flat text blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # open elements and their numbers
    marks = Elements()
    opened: Counter = Counter()
    parts: list[str] = []
    linked_parts: list[str] = []
    in_link = heading = skipping = top = False
    html = html or ""
    at, end = 0, len(html)
    inside = 0
    closers = _Closers(html)

    def close():
        if parts:
            words = unescape("".join(parts)).split()
            if words:
                linked = len(unescape(" ".join(linked_parts)).split()) if linked_parts else 0
                linked = min(linked, len(words))
                marks.add(inside, len(words) - linked, top)
                out.append(Block(" ".join(words), len(words), linked, heading, inside))
            parts.clear()
            linked_parts.clear()

    while at < end:
        m = _TAG.search(html, at)
        stop = m.start() if m else end
        if stop > at and not skipping:
            piece = html[at:stop]
            parts.append(piece)
            if in_link:
                linked_parts.append(piece)
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing:
                found = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(html, at)
                at = found.end() if found else end
            continue
        if tag in SKIPPED:
            if closing or attrs.endswith("/"):
                skipping = skipping and not closing
            elif (to := closers.end(tag, at)) is not None:
                at = to
            else:
                skipping = True
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag in BLOCK:
            skipping = False
            close()
            heading = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and not closing
            top = heading and tag == "h1"
        if tag in LANDMARK:
            if closing:
                if not opened[tag]:
                    continue
                while True:
                    last, _ = stack.pop()
                    opened[last] -= 1
                    if last == tag:
                        break
                inside = stack[-1][1] if stack else 0
                if tag != "span":
                    in_link = False
            else:
                if tag in ("span", "p") and _around(tag, attrs, PLAIN) == PLAIN:
                    continue  # left open or not, it marks nothing
                if tag == "span":
                    close()
                inside = marks.open(tag, attrs, inside)
                stack.append((tag, inside))
                opened[tag] += 1
    close()
    around = marks.around()
    for b in out:
        b.around = around[b.around]
    return out


def features(bs: list[Block]) -> list[tuple]:
    """A row per block: what holds around it, heading, and words and link density of it, the one before and the one after."""
    own = [(b.words, b.linked / b.words) for b in bs]
    pad = [(0, 0.0), *own, (0, 0.0)]
    return [(*b.around, int(b.heading), *pad[k + 1], *pad[k], *pad[k + 2]) for k, b in enumerate(bs)]


_SIZE = re.compile(r"([=-])(\d+)(?:@(\d+))?")


def labelled(samples: str = SAMPLES) -> tuple[list[tuple], list[int]]:
    """Feature rows and labels (1 is main text) of the blocks of sample pages."""

    def words(m: re.Match) -> str:
        n, linked = int(m[2]), int(m[3] or 0)
        plain = " ".join(["main" if m[1] == "=" else "other"] * (n - linked))
        return plain + (f" <a>{' '.join(['main' if m[1] == '=' else 'other'] * linked)}</a>" if linked else "")

    rows, labels = [], []
    for page in samples.strip().splitlines():
        bs = blocks(_SIZE.sub(words, page))
        rows += features(bs)
        labels += [int(b.text.startswith("main")) for b in bs]
    return rows, labels


class Tree:
    """Binary classification tree (CART, Gini impurity)."""

    def __init__(self, rows: list[tuple], labels: list[int], depth: int = 10, least: int = 1):
        self.root = self._grow(rows, labels, depth, least)

    def _grow(self, rows, labels, depth, least):
        ones = sum(labels)
        if depth == 0 or ones in (0, len(labels)) or len(labels) <= least:
            return int(2 * ones >= len(labels))
        best = None
        for f in range(len(rows[0])):
            order = sorted(range(len(rows)), key=lambda i: rows[i][f])
            left = 0
            for k in range(1, len(order)):
                left += labels[order[k - 1]]
                a, b = rows[order[k - 1]][f], rows[order[k]][f]
                if a == b:
                    continue
                right = ones - left
                cost = left * (1 - left / k) + right * (1 - right / (len(order) - k))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, (a + b) / 2)
        if best is None:
            return int(2 * ones >= len(labels))
        _, f, cut = best
        lo = [i for i in range(len(rows)) if rows[i][f] < cut]
        hi = [i for i in range(len(rows)) if rows[i][f] >= cut]
        grow = lambda at: self._grow([rows[i] for i in at], [labels[i] for i in at], depth - 1, least)
        return (f, cut, grow(lo), grow(hi))

    def predict(self, row: tuple) -> int:
        node = self.root
        while type(node) is tuple:
            node = node[2] if row[node[0]] < node[1] else node[3]
        return node


def fit(samples: str = SAMPLES) -> Tree:
    """The tree for sample pages in the form of ``SAMPLES``."""
    return Tree(*labelled(samples))


def main_text(html: str | None, tree: Tree) -> str:
    bs = blocks(html)
    return " ".join(b.text for b, row in zip(bs, features(bs), strict=True) if tree.predict(row))


def text_column(html: Column | str, samples: str = SAMPLES) -> Column:
    """Column: main text of a page."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = fit(samples)
        for s in batches:
            yield pd.Series([main_text(h, tree) for h in s], dtype=object)

    return text(html)


def extract_main_text(pages: DataFrame, html_col: str = "html", samples: str = SAMPLES) -> DataFrame:
    """``pages`` with text and n_chars."""
    out = pages.withColumn("text", text_column(F.col(html_col), samples))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(common.table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
