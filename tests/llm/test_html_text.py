"""Main text of pages: given pages against their article element, made-up templates with known articles, and broken markup."""

import html
import random
import re
import time

import pytest

from isthmus.llm import html_text as ht
from isthmus.llm.queries import queries

PROSE = "It is known that the river was wide and the boats of the town lay in it, as they had for a year, and that on most days the men at the quay were not in a hurry to go."
OTHER = "Nous avons de la place dans une maison et il est clair que les gens de la ville ne sont pas pour ce plan, mais que la plupart vient par le train avec des amis."


def test_given_pages(spark, sf):
    """Brute force: on these pages the article element holds the main text, and b is its only inline element."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").join(queries()["op11_html_text"](spark, sf), ["page_id", "url"]).collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1].replace("<b>", "").replace("</b>", "")
        want = " ".join(html.unescape(re.sub("<[^>]+>", "\n", inner)).split())
        assert r.text == want and r.n_chars == len(want)


AWAY = [
    '<nav><ul><li><a href="/">Home</a><li><a href="/a">All of the news that is in</a></ul></nav>',
    f'<div class="ad-slot">{PROSE}</div>', f'<aside>{PROSE}</aside>', f'<div id="sidebarLeft"><p>{PROSE}</div>', f'<form action="/x"><p>{PROSE}<input name=q><select><option>one</select></form>',
    f'<section class="comments"><h3>3 comments</h3><article class="comment"><p>{PROSE}</article></section>', f'<div class="cookie-notice"><p>{PROSE}</p><button>OK</button></div>',
    f"<footer>&copy; 2020 {PROSE}</footer>", f"<script>var a = '<p>{PROSE}</p>';</script><style>p{{}}</style><noscript>{PROSE}</noscript>", f"<!-- <p>{PROSE}</p> -->",
    f'<div role="complementary">{PROSE}</div>', f'<div style="display: none">{PROSE}</div>', f'<div hidden>{PROSE}</div>', f'<div><h2>Reader comments</h2><p>{PROSE}</p><p>{PROSE}</p></div>',
    "<div><p>" + " ".join(f'<a href="/{i}">A link of the site and more of it</a>' for i in range(9)) + "</p></div>", '<header><a href="/">The site</a> of the day</header>',
]
INSIDE = [
    (f"<p>{PROSE}</p><p>{PROSE}", f"{PROSE} {PROSE}"), (f"<h2>A heading</h2><p>{PROSE} {PROSE}</p>", f"A heading {PROSE} {PROSE}"), ("<p>Short.<p>Yes, <i>very</i> short.", "Short. Yes, very short."),
    (f"<ul><li>one<li>two <b>or</b> t<em>hr</em>ee</ul><blockquote>{OTHER}</blockquote>", f"one two or three {OTHER}"), (f"<p>{PROSE}<br>next&nbsp;line &amp; &lt;b&gt; caf&eacute; &#x1F600; &#8364;</p>", f"{PROSE} next line & <b> café 😀 €"),
    (f"<table><tr><td>1<td>2<tr><td>{PROSE}</table>", f"1 2 {PROSE}"), (f'<p>See <a href="/x">this</a> and <a href="/y">that</a>: {PROSE}</p>', f"See this and that: {PROSE}"),
]


@pytest.mark.parametrize("seed", range(30))
def test_templates(seed):
    r = random.Random(seed)
    around = lambda: "".join(r.sample(AWAY, r.randint(1, 5)))
    parts = r.sample(INSIDE, r.randint(2, 5))
    between = lambda: r.choice(["", "\n ", r.choice(AWAY[:5] + AWAY[6:7])])
    inner = "".join(between() + m for m, _ in parts)
    start, end = r.choice([("<article>", "</article>"), ("<main><h1>", "</h1></main>"), ('<div role="main">', "</div>"), ('<div class="wrap"><article class="post has-sidebar"><header class="entry-header">', "</header></article></div>")])
    if start.startswith("<main"):
        start, end = "<main>", "</main>"
    page = f"<!DOCTYPE html><html class='no-js'><head><title>{PROSE}</title></head><body class=\"sidebar-right\">{around()}{start}{inner}{end}{around()}"
    assert ht.main_text(page) == " ".join(t for _, t in parts)


def test_pages_without_article_element():
    body = "".join(f"<p>{PROSE} {PROSE}</p>" for _ in range(3))
    page = f'<div id="top"><p>Menu</p></div><div>{body}<p>A short one in it.</p><p>{PROSE}</p></div><div><p>Terms</p></div><div><p>Contact</p></div><div><p>Jobs</p></div>'
    want = " ".join([f"{PROSE} {PROSE}"] * 3 + ["A short one in it.", PROSE])
    # The block next to the last good one inherits its label; those nearer to the page's end don't.
    assert ht.main_text(page).startswith(want) and "Jobs" not in ht.main_text(page) and "Menu" not in ht.main_text(page.replace("<p>Menu</p>", '<p><a href="/">Menu</a></p>'))
    assert ht.main_text(f"<form id=all>{body}</form>") == " ".join([f"{PROSE} {PROSE}"] * 3)
    assert ht.main_text("just words") == "just words" and ht.main_text("<p>短い文。</p>" + "<p>" + "長い文です。" * 40 + "</p>").endswith("長い文です。")


def test_labels_are_inherited():
    make = lambda n, **k: ht.Block("w" * n, 0, False, False, 0, n_words=1, **k)
    blocks = [make(9, label="good"), make(9, label="short"), make(9, label="short"), make(9, label="bad"), make(9, label="near"), make(9, label="good"), make(9, label="short")]
    assert ht._second(blocks, "bad", False) == ["good", "good", "bad", "bad", "good", "good", "bad"]
    assert ht._second(blocks, "good", True) == ["good", "good", "good", "bad", "good", "good", "good"]


@pytest.mark.parametrize("page", ["<", "<p", "<p>a<b", "a <3 b", "</p></div>x", "<!--", "<!-- x", "<script>", "<title>t", "&", "&#0; &#xFFFFFF; &bogus;", "<p a='>x", '<p a=">y</p>', "<p x=it's>don't</p>", "<![CDATA[x]]>y", "<?php x ?>z", "<svg/>a<svg></svg>", "\x00", "<p>" * 50, "<div>" * 3000 + "x", "</" * 40, "<a<b>c"])
def test_broken_markup(page):
    assert isinstance(ht.main_text(page), str)
    assert ht.main_text(page + f"</script></title>--><article><p>{PROSE}</p></article>").endswith(PROSE) or page.startswith(("<p a", "<a<b")) or page in ("<", "<p", "<p>a<b")


def test_quotes_and_references():
    assert ht.main_text(f"<article><p title=it's>don't {PROSE}</p><p title='a > b' data-x=\"c > d\">e</p></article>") == f"don't {PROSE} e"
    assert ht.main_text("<article><p>a&ampb &am &copy 1 &#65;&#x42;</p></article>") == "a&b &am © 1 AB"


@pytest.mark.parametrize("piece", ["<div>", "<p class=ad>x", "<noscript>", "<!--", "<p a='", "</x>", "&", "<a href=x>y", "<span class=ad>q", "<li>w", "< ", "</p><p>word "])
def test_long_pages_take_linear_time(piece):
    began = time.process_time()
    ht.main_text(piece * (2_000_000 // len(piece)))
    assert time.process_time() - began < 30


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (1, "u", "", 1), (2, None, f"<article><p>{PROSE}😀</p></article>", 1), (2, None, f"<article><p>{PROSE}😀</p></article>", 1), (None, "v", "<p>" + "word and " * 3_000_000, 1)], "page_id long, url string, html string, text int")
    got = sorted(map(tuple, ht.extracted(df).collect()), key=str)
    assert [x[3] for x in got if x[0] == 1] == [0, 0] and [x[2] for x in got if x[0] == 2] == [PROSE + "😀"] * 2 and [x[3] for x in got if x[0] == 2] == [len(PROSE) + 1] * 2
    assert [x[3] for x in got if x[0] is None] == [len("word and ") * 3_000_000 - 1]
    assert ht.extracted(df.where("false")).count() == 0
    blocks = ht.page_blocks(df.where("page_id = 2")).collect()
    assert len(blocks) == 2 and all(b.kept and b.stop_density > 0.2 and b.link_density == 0 for b in blocks)
