"""Main text by the tree: unclosed tags, misleading names, held-out layouts, and time."""

import time

import numpy as np
import pytest

from lodestar.llm import html_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p class='notice'>Advert<div><p>A</p><p>B</p></div>", "A\nB"),
        ("<ul><li class='nav-item'>Home<li class='nav-item'>News</ul><article><p>One two.</p><p>Three.</p></article>", "One two.\nThree."),
        ("<nav><ul><li class='nav-item'>Home<li>News</nav><article><p>One two.</p></article>", "One two."),
        ("<article><button>Share<p>A</p><p>B b b.</p></article>", "A\nB b b."),
        ("<article><svg><p>A</p><video><p>B</p></article>", "A\nB"),
        ("<article><select><option>x<option>y<p>A b</p></article>", "A b"),
        ("<article><object>no plugin</object><p>A b</p></article>", "A b"),
        ("<article><p>Intro words.</p><section id='discussion'><p>Disc words.</p></section><div class='related-work'><p>Rel words.</p></div></article>", "Intro words.\nDisc words.\nRel words."),
        ("<p>Just one short line</p>", "Just one short line"),
        ("<div class='popup-page'><div><a href=/>Home</a></div><h1>The title of it</h1>" + "<p>Many words that make up the text of this page, and then some more.</p>" * 4 + "</div>", "The title of it" + "\nMany words that make up the text of this page, and then some more." * 4),
        ("<article><p>Body of the text.</p><section class=comments><h3>2 comments</h3><p>I liked it a lot, thank you.</p></section></article>", "Body of the text."),
        ("<form><div><h1>A title</h1>" + "<p>Pages of some builders stand in one large form, with all that they have.</p>" * 3 + "</div></form>", "A title" + "\nPages of some builders stand in one large form, with all that they have." * 3),
        ("<p>a&nbsp;b&#x2014;c &lt;i&gt;</p>", "a b—c <i>"),
    ],
)
def test_pages_of_other_layouts(page, text):
    assert html_text.main_text(page) == text


def accuracy(blank):
    """Share of right verdicts on layouts that the tree was not grown on, one left out at a time."""
    pages, right = html_text.labelled(), []
    for i, (x, y) in enumerate(pages):
        rest = [p for j, p in enumerate(pages) if j != i]
        tree = html_text.Tree(np.concatenate([p[0] for p in rest]), np.concatenate([p[1] for p in rest]))
        x = x.copy()
        if blank:
            x[:, html_text.NAMES] = 0
        right.append((tree.predict(x) >= 0.5) == y)
    return np.concatenate(right).mean()


def test_layouts_left_out():
    assert accuracy(False) > 0.9 and accuracy(True) > 0.8


@pytest.mark.parametrize("piece", ["<li class='menu'>x", "<div class='ad'>x", "<p class=notice>x", "<button>x", "</section><div>x", "<object>x", "<svg>", "<noscript>y", "<td>x", "<dl><dt>x", "<script>", "&amp", "<a href='x"])
def test_time_is_linear(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.time()
    html_text.main_text(page)
    assert time.time() - start < 12


def test_nulls(spark):
    pages = spark.createDataFrame([(None, "u", "<p>a b</p>"), (None, None, None)], "page_id long, url string, html string")
    assert sorted((x["text"], x["url"] or "", x["n_chars"]) for x in html_text.op1(pages).collect()) == [("", "", 0), ("a b", "u", 3)]
