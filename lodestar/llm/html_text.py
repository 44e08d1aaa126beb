"""Main text of web pages: flat text blocks, classified by a decision tree trained on a small labelled table.

A page is cut into flat blocks at block-level tags. A block's features are its words and its link density, the same of the
blocks before and after it, whether it ends like a sentence, what kind of tag holds it, and four facts of the markup around it, of
which the names of classes and ids are one (``FEATURES``). The tree is grown from ``LABELLED`` when the module is first used;
kept blocks are joined in page order.

White space is what ``str.split`` takes for it, no-break spaces included; ``<br>`` is white space. Unclosed tags,
cut-off pages and unknown tags are read the way browsers do in outline: a block ends an open paragraph, an item the item before it,
a closing tag its nearest open partner or nothing. What is skipped (scripts, buttons, pictures) ends at its own closing tag, at a
tag that can't stand in it, or not at all if nothing closes it. A page is read once from front to back, in time linear in its length.

Defined results: null and empty pages give an empty text, and so do pages without text; a null id or URL stays null; repeated rows
are repeated; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KINDS = {**dict.fromkeys(HEADINGS, 1), **dict.fromkeys("p pre blockquote figcaption".split(), 2), **dict.fromkeys("li dd dt".split(), 3)}
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
SKIPPED = frozenset("audio button canvas datalist head map math noscript object select svg template video".split())
#: Skipped elements in which no text block can stand: one ends them.
NARROW = frozenset("button head math select svg".split())
WHOLE = frozenset("datalist noscript template".split())
#: An item ends the item before it, as far as the list that both stand in.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
FURNITURE_TAGS = frozenset("aside dialog footer menu nav".split())
FURNITURE_ROLES = frozenset("banner complementary contentinfo navigation search".split())
MAIN_TAGS = frozenset("article main".split())
FURNITURE_WORDS = frozenset("""
ad ads adsense advert adverts advertisement advertising adbox adslot sponsor sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices
alert popup modal overlay sidebar sidebars menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs footer masthead topbar toolbar
comment comments commentlist replies reply respond disqus share sharing social newsletter subscribe subscription signup
widget widgets pagination pager copyright disclaimer login signin search searchform tags skip
""".split())
#: Words that turn a name into a remark on the layout ("has-sidebar"), and those after which a header is the article's own.
LAYOUT_WORDS = frozenset("has with no without layout".split())
OWN_WORDS = frozenset("article post entry story content".split())

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+[^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_CLOSING = re.compile(r"""[.!?:;…。！？]["'”’»)\]]*$""")

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "sentence", "heading", "paragraph", "item", "in_main", "main_share", "in_furniture_tag", "in_furniture_name"]
NAMES = FEATURES.index("in_furniture_name")
SIZES = 8
LEAST_LEAF = 6
NAMES_WORTH = 0.5  # what a cut by names gains, against the same gain by any other feature

#: Fixed values, labelled by hand: one page a line, in outline. ``+40.`` stands for forty words of main text with a full stop, ``-3``
#: for three words of something else.
LABELLED = """
<nav><ul><li><a>-1</a><li><a>-1</a><li><a>-2</a></ul></nav><div class=ad>-7.</div><article><h1>+8</h1><p>+40.<p>+60.<p>+5.</article><footer>-9.</footer>
<nav><ul><li><a>-1</a><li><a>-1</a></ul></nav><div class=ad>-14.</div><article><h1>+14.</h1><p>+2.</article><footer>-12.</footer>
<nav><a>-1</a> <a>-1</a></nav><article><h1>+3</h1><p>+6.<p>+3<p>+90.<blockquote>+25.</blockquote><p>+12</article><div>-20.</div><footer>-30.</footer>
<header><a>-2</a><p>-6</header><nav><a>-5</a></nav><main><h1>+7</h1><p>+80.<ul><li>+6<li>+9.<li><a>+3</a><li>+2 <a>+2</a></ul><h2>+3</h2><p>+30.</main><aside><h3>-2</h3><p>-18.<p>-35.</aside><footer><p>-12</footer>
<div id=top>-3</div><div id=menu><a>-1</a> <a>-2</a> <a>-1</a></div><div id=content><h1>+6</h1><p>+45.<p>+70.<p>+22.</div><div id=sidebar><h3>-2</h3><p>-25.<ul><li><a>-3</a><li><a>-4</a></ul></div><div id=footer>-8</div>
<table><tr><td><a>-1</a><td><a>-2</a><td><a>-1</a></table><table><tr><td><font>+60.</font><p>+44.<p>+31.<td><a>-3</a><br><a>-2</a></table><center>-5</center>
<table><tr><td><a>-4</a><tr><td><h2>+5</h2>+90.<br><br>+40.<tr><td>-4</table>
<div><div><a>-2</a></div><div><a>-1</a><a>-1</a><a>-1</a></div></div><div><h1>+9</h1><div>+5</div><p>+50.<p>+8.<p>+65.</div><div><h4>-2</h4><a>-5</a></div><div><a>-4</a></div><div>-6</div>
<div><a>-1</a> <a>-1</a> <a>-2</a></div><h1>+5</h1><p>+28.<p>+33.<p>+41.<div><a>-6</a></div><div><a>-7</a></div><div>-4</div>
<p>+3</p>
<p>+12.</p>
<div>+5</div>
+9.
<body>+2</body>
<h1>+4</h1><p>+6.
<h1>+3</h1><p>+25.<p>+4.
<h2>+5</h2><div>+30.</div><div>+22.</div>
<ul><li><a>-1</a><li><a>-2</a></ul><p>+15.
<div class="post widget-area-none"><h1>+6</h1><p>+44.<p>+38.</div>
<div class=popup-page><div><a>-2</a> <a>-1</a></div><h1>+7</h1><p>+50.<p>+62.<p>+9.<div>-5</div></div>
<form class=search-page><h1>+4</h1><p>+70.<p>+55.<p>+48.</form>
<div class="social theme"><article><h1>+5</h1><p>+33.<p>+4.<p>+29.</article></div>
<main class=banner><h1>+6</h1><p>+51.<p>+20.</main><footer>-4</footer>
<nav><a>-3</a></nav><article><h1>+8</h1><p>+25.<p>+60.<section class=comments><h3>-2</h3><div><p>-18.</div><div><p>-42.<p>-7.</div></section></article>
<article><h1>+6</h1><p>+35.<div class=share><a>-1</a> <a>-1</a></div><p>+48.<div class=ad>-9.</div><p>+52.<div class=newsletter-signup><p>-14.<p>-5</div></article><footer>-7</footer>
<article><header><h1>+9</h1><p>+5</header><p>+66.<figure><figcaption>+8.</figcaption></figure><p>+37.<table><tr><td>+2<td>+3<tr><td>+1<td>+4</table><footer>-10.</footer></article>
<article><h1>+4</h1><h2>+2</h2><p>+90.<h2>+3</h2><p>+75.<pre>+12</pre><ol><li>+10.<li>+14.<li>+8.</ol><h2>+1</h2><ol><li>+6 <a>+5</a><li>+4 <a>+6</a></ol></article>
<article><h1>+5</h1><p>+20 <a>+3</a> +15.<p><a>+8</a><p>+2 <a>+9</a><p>+31.<ul><li><a>+2</a><li><a>+3</a><li><a>+1</a></ul></article><section class=comments><article><p>-15.</article><article><p>-30.<p>-4.</article></section>
<div class=cookie-notice><p>-16.<p>-2</div><main><h1>+6</h1><p>+30.<p>+42.</main><div class=related-posts><h3>-2</h3><ul><li><a>-6</a><li><a>-8</a></ul></div>
<div class=cookie-consent>-24.</div><div class=header><a>-2</a></div><div class=content><h1>+8</h1><p>+38.<p>+55.</div><div id=comments><h2>-2</h2><ol><li><p>-20.<li><p>-33.<li><p>-6.</ol></div><div class=copyright>-7.</div>
<div class=topbar><p>-9.</div><div><h1>+5</h1><p>+61.<p>+47.<p>+14.</div><div class=comment><p>-26.</div><div class=comment><p>-11.</div><div class=sidebar><p>-31.</div>
<ul class=nav><li>-1<li>-1<li>-2</ul><div class=breadcrumbs>-5</div><div><h1>+7</h1><p>+58.<p>+39.</div><form><p>-3<p>-4</form><p class=disclaimer>-22.
<div><p>+48.<p>+3.<p>+57.<p>+1.<p>+36.</div><form>-2 <br> -1</form><div><a>-3</a></div>
<main><h1>+5</h1><dl><dt>+2<dd>+18.<dt>+3<dd>+25.</dl><p>+10.</main><aside><p>-40.</aside><footer><ul><li><a>-2</a><li><a>-1</a></ul><p>-11.</footer>
<article><section id=abstract><h2>+1</h2><p>+120.</section><section id=discussion><h2>+1</h2><p>+88.<p>+61.</section><div class=related-work><h2>+2</h2><p>+73.</div></article><footer>-5</footer>
<div role=banner>-4</div><div role=main><h1>+6</h1><p>+27.<p>+7.</div><div role=complementary><p>-28.</div><div role=contentinfo>-13.</div>
<header><h1>-2</h1><p>-7.</header><article><h2>+7</h2><p>+46.</article><article><h2>+5</h2><p>+39.</article><nav><a>-2</a> <a>-2</a></nav>
<div class=wrap><h1>+4</h1><p>+40.<p>+40.</div><section class=comments><article><p>-15.</article></section><aside><p>-11.</aside>
<div><h1>+6</h1><p>+75.<p>+32.<p>+54.</div><div id=comments><article><p>-22.<p>-9.</article><article><p>-5.</article></div><footer>-8</footer>
<nav><a>-1</a> <a>-1</a></nav><div class=ad>-15.</div><article><h1>+4</h1><p>+3.</article><footer>-16.</footer>
<p class=notice>-12.<div><h1>+6</h1><p>+43.<p>+29.</div><p class=copyright>-6.
"""


def marks(attributes: str) -> tuple[bool, bool, bool]:
    """Whether a tag's attributes hide it or give it a role beside the main text, name it as furniture, make it the main part."""
    hard = named = main = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            hard = True
        elif name == "role":
            hard |= value.strip().lower() in FURNITURE_ROLES
            main |= value.strip().lower() in MAIN_TAGS
        elif name in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in _WORD.findall(token)}
                if not words & LAYOUT_WORDS:
                    named |= bool(words & FURNITURE_WORDS) or (words == {"header"}) or (bool(words & {"related", "recommended"}) and bool(words & {"articles", "links", "news", "posts", "stories"}))
                    named &= not (words & OWN_WORDS and words & {"header"})
    return hard, named, main


class Block:
    __slots__ = ("furniture", "kind", "linked", "main", "named", "text", "words")

    def __init__(self, text: str, words: int, linked: float, kind: int, main: bool, furniture: bool, named: int):
        self.text, self.words, self.linked, self.kind, self.main, self.furniture, self.named = text, words, linked, kind, main, furniture, named


class Reader:
    """The flat blocks of one page, and how many words each part named as furniture has, by its number."""

    def __init__(self, page: str):
        self.page, self.blocks, self.parts = page, [], []
        self.stack: list[tuple[str, bool, bool, int]] = []  # tag, main, furniture, number of the innermost named part or -1
        self.open: Counter[str] = Counter()
        self.above: list[int] = []  # the named part around each named part
        self.link = False
        self.last: dict[str, int] = {}
        self.read()
        self.size = [0] * len(self.above)
        for b in self.blocks:
            if b.named >= 0:
                self.size[b.named] += b.words
        for i in range(len(self.above) - 1, -1, -1):
            if self.above[i] >= 0:
                self.size[self.above[i]] += self.size[i]

    def end_block(self) -> None:
        if not self.parts:
            return
        text = " ".join(html.unescape("".join(t for t, _ in self.parts)).split())
        if text:
            linked = sum(len("".join(html.unescape(t).split())) for t, in_link in self.parts if in_link)
            tag, main, furniture, named = self.stack[-1] if self.stack else ("", False, False, -1)
            # a text without spaces still has words
            words = max(text.count(" ") + 1, len(text) // 12)
            self.blocks.append(Block(text, words, min(1.0, linked / (len(text) - text.count(" "))), KINDS.get(tag, 0), main, furniture, named))
        self.parts.clear()

    def pop(self, count: int) -> None:
        for tag, *_ in self.stack[len(self.stack) - count :]:
            self.open[tag] -= 1
        del self.stack[len(self.stack) - count :]

    def begin(self, tag: str, attributes: str) -> None:
        self.end_block()
        self.link = False
        if self.stack and self.stack[-1][0] == "p":
            self.pop(1)
        if tag in ENDS:
            same, stop = ENDS[tag]
            k = len(self.stack) - 1
            while k >= 0 and self.stack[k][0] not in stop and self.stack[k][0] not in MAIN_TAGS:
                if self.stack[k][0] in same:
                    self.pop(len(self.stack) - k)
                    break
                k -= 1
        if tag == "hr":
            return
        _, main, furniture, named = self.stack[-1] if self.stack else ("", False, False, -1)
        hard, is_named, is_main = marks(attributes) if attributes else (False, False, False)
        is_main |= tag in MAIN_TAGS
        furniture = (furniture and tag != "main") or hard or tag in FURNITURE_TAGS or (tag == "header" and not main)
        if (is_named or tag == "form") and tag not in ("body", "html"):
            self.above.append(named)
            named = len(self.above) - 1
        self.stack.append((tag, main or is_main, furniture, named))
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        self.end_block()
        self.link = False
        if self.open[tag] and tag not in ("body", "html"):
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self.pop(len(self.stack) - k)

    def closes(self, tag: str, at: int) -> bool:
        """Whether a closing tag of this name follows."""
        if tag not in self.last:
            found = [m.start() for m in re.finditer(rf"</{re.escape(tag)}(?=[\s/>])", self.page, re.I)]
            self.last[tag] = found[-1] if found else -1
        return self.last[tag] >= at

    def read(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        skip, depth = "", 0
        while at < n:
            m = _TAG.search(page, at)
            start = m.start() if m else n
            if start > at and not skip:
                self.parts.append((page[at:start], self.link))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            closing, tag = bool(m[1]), m[2].lower()
            alone = m[3].rstrip().endswith("/")
            if skip:
                if tag == skip:
                    depth += -1 if closing else 0 if alone or skip in NARROW else 1
                    skip = skip if depth else ""
                    continue
                if tag in BLOCK and skip not in WHOLE and not (skip == "select" and tag in ("option", "optgroup", "hr")):
                    # a block can't stand in a narrow element; any other ends with the part that it stands in
                    if (skip in NARROW) if not closing else self.open[tag] or (skip == "head" and tag in ("head", "html")):
                        skip = ""
                if skip and not (tag in RAW and not closing):
                    continue
            if tag in RAW and not closing:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at) if self.closes(tag, at) else None
                at = end.start() if end else n
                continue
            if tag in SKIPPED:
                if not closing and not alone and (tag in NARROW or self.closes(tag, at)):
                    skip, depth = tag, 1
                continue
            if tag == "a":
                self.link = not closing
            elif tag in ("br", "img"):
                self.parts.append((" ", self.link))
            elif tag in BLOCK:
                if closing:
                    self.end(tag)
                else:
                    self.begin(tag, m[3])
        self.end_block()


def features(reader: Reader) -> np.ndarray:
    """One row of ``FEATURES`` a block. A named part that holds three quarters of the page's words is a wrapper, no furniture."""
    blocks = reader.blocks
    if not blocks:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.linked for b in blocks], float)
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    kind = np.array([b.kind for b in blocks])
    main = np.array([b.main and not b.furniture for b in blocks], float)
    named = np.array([b.named >= 0 and 4 * reader.size[b.named] < 3 * words.sum() for b in blocks], float)
    sentence = np.array([bool(_CLOSING.search(b.text[-8:])) for b in blocks], float)
    furniture = np.array([b.furniture for b in blocks], float)
    share = np.full(len(blocks), (words * main).sum() / words.sum())
    return np.stack([words, links, before(words), before(links), after(words), after(links), sentence, kind == 1, kind == 2, kind == 3, main, share, furniture, named], axis=1)


class Tree:
    """A binary tree of one-feature cuts, grown on the Gini impurity; a cut by names has to gain more than any other."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.value = float(y.mean()) if len(y) else 0.0
        self.cut: tuple[int, float] | None = None
        best, impurity = 1e-9, lambda v: len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0
        if depth and 0 < self.value < 1:
            for j in range(x.shape[1]):
                seen = np.unique(x[:, j])
                for c in (seen[1:] + seen[:-1]) / 2:
                    low = x[:, j] <= c
                    if not LEAST_LEAF <= low.sum() <= len(y) - LEAST_LEAF:
                        continue
                    gain = impurity(y) - impurity(y[low]) - impurity(y[~low])
                    gain *= NAMES_WORTH if j == NAMES else 1.0
                    if gain > best:
                        best, self.cut = gain, (j, float(c))
        if self.cut:
            low = x[:, self.cut[0]] <= self.cut[1]
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.cut:
            return np.full(len(x), self.value)
        low = x[:, self.cut[0]] <= self.cut[1]
        out = np.empty(len(x))
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def labelled() -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of the blocks of each page of ``LABELLED``, read in ``SIZES`` sizes: as stated, and with other lengths."""
    out = []
    for line in LABELLED.strip().split("\n"):
        read = []
        for i in range(SIZES):
            r = random.Random(i)

            def words(m: re.Match, i: int = i, r: random.Random = r) -> str:
                n = max(1, round(int(m[2]) * 2 ** r.uniform(-1, 1))) if i else int(m[2])
                return " ".join([m[1] + "word"] + ["word"] * (n - 1)) + m[3]

            reader = Reader(re.sub(r"([+-])([0-9]+)(\.?)(?![^<]*>)", words, line))
            read.append((features(reader), np.array([float("+word" in b.text) for b in reader.blocks])))
        out.append((np.concatenate([x for x, _ in read]), np.concatenate([y for _, y in read])))
    return out


@cache
def trained_tree() -> Tree:
    pages = labelled()
    return Tree(np.concatenate([x for x, _ in pages]), np.concatenate([y for _, y in pages]))


def main_text(page: str | None) -> str:
    reader = Reader(page or "")
    keep = trained_tree().predict(features(reader)) >= 0.5
    return "\n".join(b.text for b, k in zip(reader.blocks, keep, strict=True) if k)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    source = small_batches(pages).select(id_col, url_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = [f.dataType.simpleString() for f in source.schema]
    return source.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")


def op1(pages: DataFrame) -> DataFrame:
    return extract(pages)
