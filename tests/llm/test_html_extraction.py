from __future__ import annotations

import html as entities
import re

import pytest

from tallyspan.llm import html_extraction as h
from tallyspan.llm.shared import table

NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'
LONG = "This is a long paragraph of the article with many words that say something of substance to its readers. " * 3


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""), ("just text", "just text"),
    (f"<body>{NAV}<article><h1>Title &amp; more</h1><p>{LONG}</p><p>Short.</p></article><footer>End</footer></body>", f"Title & more\n\n{LONG.strip()}\n\nShort."),
    (f"<article><p><b>One\n\t two<br><p>Three<p>Four &eacute;&#233;&#x4e00;</article>", "One two\n\nThree\n\nFour éé一"),
    (f"<body><header>Site</header><div class='sidebar'><p>Side</p></div><main><p>{LONG}</p><div class='advert-box'><p>Buy</p></div><p>Last</p></main><div id='comments'><p>{LONG} reader</p></div></body>", f"{LONG.strip()}\n\nLast"),
    (f"<body><div class='top-menu'>{NAV}</div><div id='wrap'><div class='story'><p>{LONG}</p><p>Tail</p></div></div><div class='cookie-notice'>We use cookies</div></body>", f"{LONG.strip()}\n\nTail"),
    (f"<body><article><p>{LONG}</p><form><p>Mail</p><input></form><script>var a='<p>x</p>';</script><style>p{{}}</style><aside>Aside</aside><p>End</p></article>", f"{LONG.strip()}\n\nEnd"),
    (f"<article><p>{LONG}</p><ul><li>First</li><li>Second</li></ul><blockquote>Quoted</blockquote><pre>a  b\nc</pre></article>", f"{LONG.strip()}\n\nFirst\n\nSecond\n\nQuoted\n\na b c"),
    (f"<body><article><p>{LONG}</p></article><section class='comments'><article><p>{LONG}</p><p>{LONG}</p></article></section></body>", LONG.strip()),
])
def test_pages(html, text):
    assert h.main_text(html) == text


@pytest.mark.parametrize("html", [
    *[f"<body><div class='{c}'><article><p>{LONG}</p><p>Tail</p></article></div></body>" for c in ("content no-sidebar", "post has-sidebar", "layout-sidebar-right", "sidebar", "widget")],
    *[f"<body><div class='{c}'><div><p>{LONG}</p><p>Tail</p></div></div></body>" for c in ("content no-sidebar", "content-sidebar-wrap", "modal")],
    f"<body><form action='/'><div>{NAV}</div><article><p>{LONG}</p><form><p>Mail</p></form><p>Tail</p></article></form></body>",
    f"<body><form action='/'>{NAV}<div id='page'><div><p>{LONG}</p><p>Tail</p></div></div></form></body>",
    f"<article class='post comments-open'><p>{LONG}</p><section id='related-work'><p>Tail</p></section></article>",
    f"<article><p>{LONG}</p><section id='social-effects'><p>Tail</p></section></article>",
    f"<article><p>{LONG}</p><section id='search'><p>Tail</p></section></article>",
    f"<article><p>{LONG}</p><h2 id='notice'>Tail</h2></article>",
    f"<main><p>{LONG}</p><p>Tail</p><div class='comments'><p>{LONG}</p><p>{LONG}</p></div><div class='related-posts'><p>{LONG}</p></div></main>",
    f"<article><p>{LONG}</p><p>Tail</p><ul class='share-buttons'><li>Share</li></ul></article><div id='comment-list'><p>{LONG}</p></div>",
])
def test_marks_take_out_furniture_only(html):
    assert h.main_text(html) == f"{LONG.strip()}\n\nTail"


@pytest.mark.parametrize(("html", "text"), [
    (f"<div id=page><h1>Title</h1><div class=body><p>{LONG}</p><p>{LONG}</p></div></div>", ["Title", LONG, LONG]),
    (f"<div id=page><h1><a href='/'>Title</a></h1><p><a href='/x'>Home</a> <a href='/y'>News</a></p><div><p>{LONG}</p><p>{LONG}</p></div></div>", ["Title", LONG, LONG]),
    (f"<body>{NAV}<section><p>First</p></section><section><p>{LONG}</p><p>{LONG}</p></section><section><p>Last</p></section><footer>End</footer></body>", ["First", LONG, LONG, "Last"]),
    (f"<body><div><div><p>Lead <a href='/a'>a</a></p><div><p>{LONG}</p><p>{LONG}</p></div></div><div><p>Note</p></div></div></body>", ["Lead a", LONG, LONG, "Note"]),
    (f"<body>{NAV}<div><article><p>{LONG}</p><p>{LONG}</p></article><article><h2>Two</h2><p>{LONG}</p></article><article><p>End</p></article></div><footer>x</footer></body>", [LONG, LONG, "Two", LONG, "End"]),
    (f"<body><div><article><p>{LONG}</p><p>{LONG}</p></article></div><div><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article></div><div><article><p>Card</p></article></div></body>", [LONG] * 5),
])
def test_nothing_beside_the_heaviest_part_is_lost(html, text):
    assert h.main_text(html) == "\n\n".join(t.strip() for t in text)


PLAIN = "".join(f"<div><span>{w}</span></div>" for w in ("Home", "News", "Sport", "Weather", "Contact", "Imprint"))


#: Pages without article or main, and without any mark or furniture element: only the clusters can tell.
@pytest.mark.parametrize(("html", "text"), [
    (f"<body><div>{PLAIN}</div><div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>{LONG}</p></div><div>{PLAIN}</div></body>", ["Title", LONG, "Short.", LONG, LONG]),
    (f"<body>{PLAIN}<p>{LONG}</p><p>Mid</p><p>{LONG}</p><p>{LONG}</p>{PLAIN}</body>", [LONG, "Mid", LONG, LONG]),
    (f"<table><tr><td>{PLAIN}</td><td><div><h2>Head</h2>{LONG}<br>{LONG}<p>{LONG}</p></div></td><td>{PLAIN}</td></tr></table>", ["Head", f"{LONG.strip()} {LONG}", LONG]),
])
def test_clusters_decide(html, text, monkeypatch):
    kept = h.main_text(html)
    assert all(t.strip() in kept for t in text) and "Weather" not in kept and "Sport" not in kept
    monkeypatch.setattr(h, "smoothed", lambda ratio: ratio * 0)  # without the levels nothing tells them apart
    assert "Weather" in h.main_text(html)


@pytest.mark.parametrize(("html", "text"), [
    (f"<body><form action='/'>{NAV}<article><h1>T</h1><p>{LONG}</p></article></form></body>", f"T\n\n{LONG.strip()}"),
    (f"<body>{NAV}<div class='social-policy'><article><h1>T</h1><p>{LONG}</p></article></div></body>", f"T\n\n{LONG.strip()}"),
    (f"<body><header><h1>Site</h1></header><article><header><h1>T</h1></header><p>{LONG}</p><footer>x</footer></article></body>", f"T\n\n{LONG.strip()}"),
    (f"<article><p>{LONG}</p><![foo bar]><p>Tail</p><![CDATA[x]]><!foo><?php x ?></article>", f"{LONG.strip()}\n\nTail"),
    ("<![foo bar]>", ""), ("<![endif]", "<![endif]"), ("a<b &amp; c", "a<b & c"), ("</", "</"), ("&#xffffffff;&#0;", "\ufffd\ufffd"),
])
def test_odd_pages(html, text):
    assert h.main_text(html) == text


def test_malformed_markup_never_raises():
    import random

    draw = random.Random(11)
    parts = ["<", ">", "<!", "<![", "]]>", "]>", "<!--", "-->", "--!>", "</", "/>", "<?", "<div", "<p>", "</p>", "<a href='", '"', "'", "=", "&", "&#", "&#x41", ";", "<script>", "</script", "<style>", "<title>", "<table>", "<td>", "<li>", "<article>", "</article>", "<![CDATA[", "<!DOCTYPE", " ", "\n", "text", "\x00", "é", "<br/>", "<plaintext>", "<textarea>", "<svg>"]
    for _ in range(4000):
        html = "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))
        assert isinstance(h.main_text(html), str), html


@pytest.mark.parametrize("part", ["<div>x", "<b>x", "<div class=ad>x", "<article>x", "<p><b>", "<b><p>x", "</x>", "<b></i>", "<li><b>", "<form>x", "<table><td>x", "<div hidden>x", "<", "<a ", "&", "<!", "<![", "<![x]>", "<br>x", "x<p>", "<!-- >", "<!--", "<a '>", "<script></"])
def test_long_and_deep_pages_take_linear_time(part):
    import time

    def took(n):
        began = time.process_time()
        h.main_text(part * n)
        return time.process_time() - began

    took(100)
    assert took(20_000) < 16 * max(took(5_000), 0.05)


def test_whole_values_are_marks():
    assert all(map(h.marks, ("ad", "x top-menu", "cookie-notice", "advert-box", "ad-300x250", "skip-to-content", "footer_widgets", "navigation", "sidebar-content", "related-posts")))
    assert not any(map(h.marks, ("", "no-sidebar", "has-sidebar", "layout-sidebar-right", "related-work", "social-effects", "content-sidebar", "search-results", "adobe", "shared", "--")))


def test_smoothing_keeps_the_level():
    import numpy as np

    assert np.allclose(h.smoothed(np.full(9, 4.0)), 4.0)
    assert h.smoothed(np.asarray([0.0, 0, 9, 0, 0]))[2] < 9


def test_every_page_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in table(spark, sf, "pages").collect()}
    rows = h.op6_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.DOTALL)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_awkward_tables(spark):
    rows = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>x", "t"), (2, "u", "<div>" * 3000 + "deep", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in h.extract(rows).collect()) == [(0, "x", 1), (1, "", 0), (1, "", 0), (2, "deep", 4)]
    assert h.extract(rows.limit(0)).count() == 0
