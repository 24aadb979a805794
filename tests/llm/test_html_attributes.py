"""Attributes by whole names, open heads and long class lists."""

import random
import time

import numpy as np
import pytest

from corpusworks.llm import html
from tests.llm.test_documents import SENTENCES


@pytest.mark.parametrize(
    "page,blocks",
    [
        ('<p aria-hidden="false">a</p>', ["a"]),
        ('<p aria-hidden="true">a</p><p ARIA-HIDDEN=true>b</p>c', ["c"]),
        ('<p>see <a href="/the-hidden-lake">the lake</a></p>', ["see the lake"]),
        ('<article data-title="The hidden valley"><p>a</p></article>', ["a"]),
        ("<p title='hidden' data-style=\"display:none\">a</p>", ["a"]),
        ("<p data-x=1 hidden>a</p><p hidden=''>b</p><p class=x/hidden>c</p>", ["c"]),
        ('<p style="color:red" style="display:none">a</p>', ["a"]),
        ("<head><title>t</title><body><p>a</p>", ["a"]),
        ("<html><head><meta charset=utf-8><title>t</title><style>s</style><div>a</div>", ["a"]),
        ("<head><title>t</title>\n a<p>b", ["a", "b"]),
        ("<head><noscript>n<body>a", ["a"]),
        ("<head><title>t</title><noscript>n<p>m</p></noscript></head><p>a", ["a"]),
        ("<head><title>t</title></head><header>a</header>", ["a"]),
        ('<p title=5">one</p><p>two</p>', ["one", "two"]),
        ("<div data-x=it's>alpha</div><p>beta</p>it's", ["alpha", "beta", "it's"]),
        ('<a href=/o"x>link</a> <p>rest</p>', ["link", "rest"]),
        ('<p title="a>b" x>c</p><p title = \'d>e\'>f</p>', ["c", "f"]),
        ('<p title="a""b>c</p><p =>d</p><p x= >e</p>', ["c", "d", "e"]),
        ('<p title=a=">b</p>', ["b"]),
    ],
)
def test_leaf_blocks(page, blocks):
    assert [b.text for b in html.leaf_blocks(page)] == blocks


def test_all_class_and_id_words_count():
    utility = " ".join(f"px-{k}" for k in range(40))
    (block,) = html.leaf_blocks(f'<div class="{utility} comments" data-id="other" id="sidebar">a</div>')
    assert {"word:comments", "word:sidebar", "word:px"} <= set(html.features([block])[0])
    assert "word:other" not in html.features([block])[0]


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "x", "<b class=q>" * 50_000 + "<p>a" * 500, "".join(f"<div class=c{k}><p>a" for k in range(20_000)), "<p " + "a= " * 200_000 + ">b", "<li>" * 50_000, "</b>" * 100_000 + "<a" * 50_000],
)
def test_time_grows_with_the_page(page):
    model = html.ChainModel({"bias": 1.0})
    start = time.monotonic()
    html.main_text(model, page)
    assert time.monotonic() - start < 3


def test_elements_around_count_once_and_end():
    blocks = html.leaf_blocks('<div class="x y"><div class="x"><p>a</p></div><section id=y>b</section>c</div>d')
    assert [sorted(f for f in fs if f[:3] in ("in:", "wor") and ":" in f and not f.startswith("words")) for fs in html.features(blocks)] == [
        ["in:div", "in:p", "word:x", "word:y"], ["in:div", "in:section", "word:x", "word:y"], ["in:div", "word:x", "word:y"], []]
    model = html.ChainModel({"in:div": 2.0, "word:x": 3.0, "word:y": 5.0, "in:p": 7.0})
    assert html.scores(model, blocks) == [17.0, 10.0, 10.0, 0.0]


def test_layouts_without_telling_names():
    """Learned layouts and names are not those held out: nothing but random names, and another draw of pages."""
    learned = [(html.features(html.leaf_blocks(p)), y) for p, y in html.labelled_pages(SENTENCES, 500)]
    model = html.fit(learned)
    held_out = list(html.labelled_pages(SENTENCES, 150, seed=123, nameless=1.0))
    right = [np.mean([a == b for a, b in zip(html.decode(model, html.features(html.leaf_blocks(p))), y, strict=True)]) for p, y in held_out]
    assert len(held_out) > 100 and np.mean(right) > 0.93
    text = [" ".join(random.Random(k).sample(SENTENCES, 3)) for k in range(2)]
    for name in ("content", "css-1ab", "sc-bdVaJa kTqLmn", ""):
        page = f'<body><div class="{name}"><h1>A heading of words</h1><p>{text[0]}</p><p>{text[1]}</p></div></body>'
        assert html.main_text(model, page).endswith("\n".join(text))
