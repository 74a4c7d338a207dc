"""Main text of pages whose marks, opaque elements or unclosed tags must not cut or empty the article."""

import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from protolens.llm import html_extract

BODY = "<h1>Title</h1><p>First paragraph of the text.</p><p>Second one.</p>"
TEXT = ["Title", "First paragraph of the text.", "Second one."]
LINK = '<p><a href="/a">Short link</a></p>'
PAGES = {
    "has-sidebar": (f'<div class="content has-sidebar">{BODY}</div><div class="sidebar">Side</div>', TEXT),
    "no-comments": (f'<section class="post no-comments">{BODY}</section>', TEXT),
    "layout class": (f'<div class="sidebar-right"><div class="content">{BODY}</div></div>', TEXT),
    "form around the page": (f'<body><form id="aspnet" action="/"><nav><a href="/">menu</a></nav>{BODY}<footer>foot</footer></form></body>', TEXT),
    "form in the page": (f"<body>{BODY}<form><p>Your name</p><input></form></body>", TEXT),
    "svg ends itself": (f'<svg class="i"/>{BODY}', TEXT),
    "iframe ends itself": (f'<iframe src="x" />{BODY}', TEXT),
    "iframe": (f'<iframe src="x">frame</iframe>{BODY}', TEXT),
    "unclosed object": (f'<p>Lead</p><object data="x">{BODY}', ["Lead", *TEXT]),
    "unclosed script": (f"{BODY}<script>var x = 1;<p>After</p>", [*TEXT, "After"]),
    "unclosed comment": (f"<!-- no end {BODY}", TEXT),
    "unclosed title": (f"<title>T<body>{BODY}", TEXT),
    "unclosed nav": (f'<nav><a href="/">menu</a><article>{BODY}</article>', TEXT),
    "share price": (f"<article>{BODY}<p class='share price'>Ten euro</p></article>", [*TEXT, "Ten euro"]),
    "share buttons": (f"<article>{BODY}<div class='share-buttons'>Tell others</div></article>", TEXT),
    "post-header": (f'<article><div class="post-header"><h1>Title</h1></div>{BODY[14:]}</article>', TEXT),
    "paragraphs of one link": (LINK * 5 + BODY + LINK * 5, ["Short link"] * 5 + TEXT + ["Short link"] * 5),
    "apostrophe in a bare value": ("<p><a title=it's href=x>One</a> two</p><p>it's</p>", ["One two", "it's"]),
    "data-id is no id": (f'<div data-id="menu" title="class=ad">{BODY}</div>', TEXT),
    "long comments": (f"{BODY}<section id='comments'><p>{'said ' * 300}</p></section>", TEXT),
    "comments as articles": (f"{BODY}<div class='comment-list'><article><p>{'said ' * 300}</p></article></div>", TEXT),
    "menus, notices, adverts": (f"<div class='site-header'>S</div><div class='main-nav'>M</div><div class='cookie-notice'>C</div><div class='ad ad-top x1'>A</div>{BODY}<div role='contentinfo'>F</div>", TEXT),
    "advert among inline tags": ("<p>One <span class='advert'>Buy</span><b>two</p><p>three</b> four</p>", ["One two", "three four"]),
    "only a footer": ("<footer>foot</footer>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_whole_text_of(name):
    page, want = PAGES[name]
    assert html_extract.main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize("unit", ["<b>", "<div>", "<svg>", "<!--", "<script>", "<a", '<a b="', "</b>", "<p><b>", "<i><div>", "<object></b>"])
def test_time_grows_with_the_length_of_odd_pages(unit):
    def seconds(size):
        at = time.process_time()
        html_extract.main_text(unit * (size // len(unit)))
        return time.process_time() - at

    seconds(10_000)
    assert seconds(1_000_000) < max(1.0, 400 * seconds(25_000))  # a square would be 1600 times


def test_deep_pages_are_tracked_to_their_depth():
    page = "<div>" * 30_000 + "<div class='ad'>Buy</div><p>Deep</p>" + "</div>" * 30_000 + "<p>After</p>"
    assert html_extract.main_text(page) == "Deep\n\nAfter"


class Plain(HTMLParser):
    """The text of the given pages' article element, line by line, by the standard parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.lines = 0, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.lines += [""] if tag in ("h1", "p", "article") else []
        self.lines[-1] += " " * (tag == "br")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.lines += [""] if tag in ("h1", "p", "article") else []

    def handle_data(self, data):
        self.lines[-1] += data if self.depth else ""


def test_given_pages_against_the_standard_parser(sf="/root/testdata/sf0.01"):
    for page in pq.read_table(f"{sf}/pages.parquet")["html"].to_pylist():
        lines = [" ".join(x.split()) for x in Plain(page).lines]
        assert html_extract.main_text(page) == "\n\n".join(x for x in lines if x)


def test_columns_with_clashing_names(spark):
    rows = [(1, "u", PAGES["no-comments"][0], "t", 3), (1, "u", PAGES["no-comments"][0], "t", 3), (None, None, None, None, None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0)] + [(1, "\n\n".join(TEXT), len("\n\n".join(TEXT)))] * 2
