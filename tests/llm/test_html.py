from __future__ import annotations

import random
import re
import time

import pytest

from viewgrain.llm import html

SCHEMA = "page_id long, url string, html string, text string, `row` int"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li>Menu</nav><div class="cookie-notice">We use</div>
<article><h1>Title &amp; more</h1><p>One&nbsp;two<br>three <b>bold</b><p>Next   para<!-- no --></p>
<div class="ad">Buy</div><form>Name <input></form><aside>See also</aside>
<section id="comments"><p>First!</p></section></article><footer>&copy; x</footer></body></html>"""


def texts(session, rows, **options):
    frame = session.createDataFrame([(*r, "old", 1) for r in rows], SCHEMA)
    out = html.main_text(frame, **options).select("row.page_id", "text")
    return {r.page_id: r.text for r in out.collect()}


def test_structure(session):
    rows = [(1, "http://a.example/1", PAGE), (2, None, None), (3, "x", ""), (4, "http://a.example/2", "plain < text & more"),
            (5, "http://b.example/", "<p>open <p>tags<div>here<arti"), (6, "http://b.example/", "<" * 3000 + " " + "a" * 50_000)]
    got = texts(session, rows)
    assert got[1] == "Title & more\nOne two three bold\nNext para"
    assert (got[2], got[3], got[4], got[5]) == ("", "", "plain < text & more", "open\ntags\nhere")
    assert got[6].endswith("a" * 50)
    assert texts(session, []) == {}


def test_templates_of_a_host_are_deleted(session):
    def page(i, extra=""):
        return f"<body><div><p>Top stories today</p></div><div><p>Text number {i}.</p>{extra}</div></body>"

    rows = [(i, f"http://WWW.a.example:80/{i}", page(i)) for i in range(12)]
    rows += [(100 + i, "http://a.example/same", page(0)) for i in range(30)]  # one page, however often
    rows += [(200 + i, f"http://b.example/{i}", page(i)) for i in range(3)]  # too few to tell
    got = texts(session, rows)
    assert all(got[i] == f"Text number {i}." for i in range(12))
    assert all(got[100 + i] == "Top stories today\nText number 0." for i in range(30))
    assert got[200] == "Top stories today\nText number 0."


def test_shared_paragraphs_of_articles_stay(session):
    body = "<article><p>A passage that all quote.</p><div>Share this page</div><p>Own text {}.</p></article>"
    got = texts(session, [(i, f"http://c.example/{i}", body.format(i)) for i in range(10)])
    assert all(got[i] == f"A passage that all quote.\nOwn text {i}." for i in range(10))


@pytest.mark.parametrize("source", ["</p></b>", "<p", "<a href='x>y'>z</a>", "<script>never closed", "&#x41;&amp&lt;b&gt;", "<li>a<li>b"])
def test_broken_markup_does_not_raise(source):
    page = html.parse(source)
    assert len(html.subtree_hashes(page)) == len(page.names)


def test_pages_without_html_or_with_several_roots_are_different_pages(session):
    head = "<!DOCTYPE html><head><title>T</title></head><body><div>Unmarked menu</div><p>Text {}.</p></body>"
    roots = "<div>Unmarked menu</div><p>Text {}.</p>"
    rows = [(i, f"http://d.example/{i}", head.format(i)) for i in range(8)]
    rows += [(100 + i, f"http://e.example/{i}", roots.format(i)) for i in range(8)]
    rows += [(200 + i, f"http://f.example/{i}", roots.format(0)) for i in range(8)]  # one page
    got = texts(session, rows)
    assert all(got[i] == got[100 + i] == f"Text {i}." for i in range(8))
    assert all(got[200 + i] == "Unmarked menu\nText 0." for i in range(8))


def test_marks_are_whole_and_spare_what_holds_an_article(session):
    rows = [
        (1, "x", "<article class='post no-sidebar'><p>One.</p><div class='sidebar-left'>Side</div></article>"),
        (2, "x", "<main class='comments-open'><p>Two.</p><ul id='comment-list'><li>First!</ul></main>"),
        (3, "x", "<div class='content-sidebar-wrap'><main><p>Three.</p></main><div class='widget sidebar'>Side</div></div>"),
        (4, "x", "<div id='sidebar'><main><p>Four.</p></main></div>"),
        (5, "x", "<div class='no-ads'><p>Five.</p></div><div class='site-footer'>Foot</div><div class='comments_open'>Six.</div>"),
        (6, "x", "<div class='header'><article><p>Seven.</p></article></div><nav><article>Eight</article></nav>"),
    ]
    assert texts(session, rows) == {1: "One.", 2: "Two.", 3: "Three.", 4: "Four.", 5: "Five.\nSix.", 6: "Seven."}


def test_sections_of_a_host_have_templates_of_their_own(session):
    page = "<body><div>Notice of section {}</div><div><p>Text number {}.</p></div></body>"
    rows = [(i, f"http://g.example/{i % 4}/{i}", page.format(i % 4, i)) for i in range(80)]
    rows += [(100 + i, f"http://h.example/{i}", page.format(min(i, 76), i)) for i in range(80)]  # on four of 80
    got = texts(session, rows)
    assert all(got[i] == f"Text number {i}." for i in range(80))
    assert all(got[100 + i] == f"Notice of section {min(i, 76)}\nText number {i}." for i in range(80))


COMMENT = "<article class='{}'><p>A comment.</p></article>"


@pytest.mark.parametrize(
    "source",
    [
        "<article><p>Text.</p></article>" + COMMENT.format("comment"),
        "<main><p>Text.</p>" + COMMENT.format("comment-body") * 3 + "</main>",
        "<div><p>Text.</p></div><ol class='commentlist'><li>" + COMMENT.format("") + "</ol>",
        "<div><p>Text.</p></div>" + COMMENT.format("comment even") * 2,
        "<article><p>Text.</p>" + COMMENT.format("") + "</article>",
        "<article class='shell'><article><p>Text.</p>" + COMMENT.format("") + "</article></article>",
        "<main class='comments-open'><article class='comments-open'><p>Text.</p></article></main>",
        "<article><section class='reply'>Text.</section></article>",
        "<article><div class='notice'>Text.</div></article>",
        "<main><p class='share'>Text.</p><div class='share'>Tell all</div><p class='ad'>Buy</p></main>",
        "<main><div class='search-results'>Text.</div><form>Find</form></main>",
    ],
)
def test_comments_go_and_parts_of_the_article_stay(session, source):
    assert texts(session, [(1, "x", source)]) == {1: "Text."}


def test_open_tags_and_pieces_take_linear_time():
    began = time.monotonic()
    page = html.parse("<span>x</span><font>" * 100_000 + "<p>y" * 1000)
    assert len(page.names) == 201_000 and page.texts[-1] == "y"
    assert html.parse("<p>" + "a<!-- b -->" * 200_000).texts == ["a" * 200_000]
    assert len(html.subtree_hashes(html.parse("<div>x" * 50_000))) == 50_000
    assert time.monotonic() - began < 30


def test_templates_against_brute_force(session):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        host, n = f"k{i % 3}.example", rng.randint(2, 5)
        blocks = [f"<div><p>block {rng.randint(0, 9)} of {host}</p></div>" for _ in range(n)]
        rows.append((i, f"http://{host}/{i}", "<body>" + "".join(blocks) + "</body>"))
    on: dict[tuple[str, str], set[str]] = {}
    pages: dict[str, set[str]] = {}
    split = {i: re.findall(r"block \d+ of \S+?(?=<)", source) for i, _, source in rows}
    for i, url, source in rows:
        pages.setdefault(url.split("/")[2], set()).add(source)
        for block in split[i]:
            on.setdefault((url.split("/")[2], block), set()).add(source)
    asked = {h: max(html.LEAST_PAGES, min(len(p) * html.LEAST_SHARE, (len(p) * html.LEAST_PAGES * html.LEAST_SHARE) ** 0.5)) for h, p in pages.items()}
    want = {
        i: "\n".join(b for b in split[i] if len(on[url.split("/")[2], b]) < asked[url.split("/")[2]]) for i, url, _ in rows
    }
    assert texts(session, rows) == want
