"""Main text on layouts that no training page has: whole texts, and precision and recall of blocks."""

import html
import re

import pytest

from meshloom.llm import htmltext

A = "The ferry to the northern islands will run twice a day from the first week of May, the harbour office said on Monday."
B = "Tickets can be bought on board or at the kiosk by the pier; children under six travel free with an adult."
C = "A spare boat stands ready in case of storms, so that the mail and the school run are never late by more than a day."
TITLE = "Ferry returns to the islands"
BODY = [TITLE, A, B, C]
MARKUP = f"<h1>{TITLE}</h1><p>{A}</p><p>{B}</p><p>{C}</p>"
NAV = "<ul><li><a href='/'>Start</a></li><li><a href='/n'>News</a></li><li><a href='/w'>Weather</a></li></ul>"

PAGES = {
    "form around the page": (f'<form id="aspnetForm" method="post"><input type="hidden" value="x"><div class="topmenu">{NAV}</div><div id="main">{MARKUP}</div><div id="footer">Copyright 2019 Harbour News</div></form>', BODY),
    "class of the body": (f'<body class="menu-open sidebar-right"><div class="nav">{NAV}</div><div class="text">{MARKUP}</div></body>', BODY),
    "two-sided class": (f'<nav>{NAV}</nav><section class="widget-content">{MARKUP}</section><footer><p>All rights reserved by the publisher.</p></footer>', BODY),
    "no tags": (A + " " + B, [A + " " + B]),
    "only paragraphs": (f"<p>{A}<p>{B}<p>{C}", [A, B, C]),
    "comment that never ends": (f"<div class='post'>{MARKUP}</div><!-- <p>draft of a text that nobody should read", BODY),
    "declaration that never ends": (f"<div class='post'>{MARKUP}</div><!draft of a text", BODY),
    "table layout": (f"<table><tr><td class='menu'>{NAV}</td><td>{MARKUP}</td></tr></table>", BODY),
    "inline elements": (f"<article><h1>{TITLE}</h1><p>{A[:40]}<a href='/x'>{A[40:60]}</a><em>{A[60:]}</em></p></article>", [TITLE, A]),
    "comments of readers": (f"<main>{MARKUP}</main><div class='comments'><h3>3 replies</h3><div class='comment'><p>{A} I was on that boat, and it was late.</p></div><div class='comment'><p>{B} Too dear for me, I shall swim this year.</p></div></div>", BODY),
    "advert inside": (f"<article><h1>{TITLE}</h1><p>{A}</p><div class='advert-box'><p>Buy two boats and pay for one.</p></div><p>{B}</p></article>", [TITLE, A, B]),
    "notice and sidebar": (f"<div class='cookie-banner'><p>We use cookies to make this page better for you and our partners.</p><button>Fine</button></div><div class='layout'><div class='story'>{MARKUP}</div><div class='sidebar'><h4>Most read</h4>{NAV}</div></div>", BODY),
    "blog": (f"<header class='site'><p class='tagline'>Notes from the quay</p><nav>{NAV}</nav></header><div class='entry'><h2>{TITLE}</h2><div class='entry-body'><p>{A}</p><blockquote>{B}</blockquote><ul><li>{C}</li></ul></div></div><footer>Powered by ink</footer>", BODY),
    "search form": (f"<form action='/s'><label>Find</label><input name='q'></form><div id='content'>{MARKUP}</div><form class='newsletter'><p>Get our letter every Friday.</p><input type='email'></form>", BODY),
    "last paragraph a link": (f"<body><nav>{NAV}</nav><article>{MARKUP}<p><a href='/x'>Read the full timetable of the ferry.</a></p></article><footer>c 2020</footer></body>", [*BODY, "Read the full timetable of the ferry."]),
    "links in the text": (f"<body><nav>{NAV}</nav><main><h1>{TITLE}</h1><p>{A}</p><ul><li><a href='/a'>The timetable of the summer</a></li><li><a href='/b'>The prices for cars and bicycles</a></li></ul><p>{B}</p></main><footer>c 2020</footer></body>", [TITLE, A, "The timetable of the summer", "The prices for cars and bicycles", B]),
    "comment body": (f"<body><nav>{NAV}</nav><div id='content'>{MARKUP}<div class='comment-body'><p>I like the ferry and my children do, too.</p></div></div></body>", BODY),
    "advert content": (f"<body><div class='post'><p>{A}</p><div class='ad-content'><p>Buy two, get one free until Sunday.</p></div><p>{B}</p></div></body>", [A, B]),
    "short article": (f"<nav>{NAV}</nav><article><h1>{TITLE}</h1><p>Soon.</p></article><footer>Harbour News, Pier 3, open from nine to five on working days.</footer>", [TITLE, "Soon."]),
}


@pytest.fixture(scope="module")
def model():
    return htmltext.default_model()


@pytest.mark.parametrize("name", ["form around the page", "class of the body", "two-sided class", "no tags", "only paragraphs", "comment that never ends", "declaration that never ends", "inline elements", "short article"])
def test_layouts_keep_the_whole_article(model, name):
    page, want = PAGES[name]
    assert htmltext.extract(page, model) == want


def test_precision_and_recall_of_blocks(model):
    found = wanted = right = 0
    for page, want in PAGES.values():
        got = htmltext.extract(page, model)
        found, wanted, right = found + len(got), wanted + len(want), right + len(set(got) & set(want))
    assert right / found >= 0.95 and right / wanted >= 0.95, (right, found, wanted)


def test_articles_between_boilerplate_against_patterns(spark, model):
    """Where the article is marked as such, its blocks are what stands between its block tags."""
    words = "stone river house cloud light table".split()
    pages = []
    for k in range(40):
        text = lambda n, k=k: html.escape(" ".join(words[(k * 5 + i * i) % 6] for i in range(1 + (k * n) % 60)) + " & <more>")
        article = f"<h1>{text(3)}</h1><p><b>{text(7)}<br>{text(2)}<p>{text(11)}</p><p>{text(5)}\n {text(4)}</p>"
        pages.append((k, f"<html><head><title>t</title><style>p{{}}</style></head><body><nav>{NAV}</nav><!-- ad --><div class='ad'>{text(9)}</div><article>{article}</article><footer>&copy; {text(8)}</footer></body></html>"))
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    for k, page in pages:
        inner = re.search("<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split("</?(?:h1|p)>", inner)]
        assert got[k] == "\n\n".join(b for b in blocks if b)


def test_empty_table(spark):
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_cut_off_tags_are_markup_and_closed_foreign_elements_end():
    """On every Python version; what follows `<svg/>` stays."""

    def text(html):
        return "".join(t for _, t in htmltext.Tree(html).runs)

    assert [text(h) for h in ("<div><p", "<p>a</p><p clas", "<p>b</p></artic", "<p>c</p><!-- x", "<a href='x")] == ["", "a", "b", "c", ""]
    assert text("<p>A</p><svg/><p>B</p>") == "AB" and text("<p>A <svg class='i'/> tail</p>") == "A  tail" and text("a < b") == "a < b"
    tree = htmltext.Tree("<p>A</p><svg/><p>B</p>")
    assert [tree.nodes[i].tag for i, _ in tree.runs] == ["p", "p"]
