"""WARC archives and HTML extraction."""

import base64
import gzip
import hashlib
import random
import time

import pytest

from siltmark.llm import html_text, warc
from siltmark.llm.sharing import shared_folder

PAGES = [(1, "http://a/\r\nX: y", "<p>same</p>"), (2, None, None), (3, "http://c/", ""), (7, "http://d/", "<p>same</p>"), (7, "http://d/", "<p>same</p>"),
         (5, "http://é/", "x" * 300_000), (None, "http://n/", "<p>same</p>"), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n é")]


def frame(spark, rows=None):
    df = spark.createDataFrame(PAGES if rows is None else rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'z' AS digest", "1 AS bytes", "'q' AS record_type")


def test_archives_round_trip(spark):
    folder = shared_folder(spark, "warc-test")
    index = warc.write_archives(warc.with_record_types(frame(spark).repartition(2)), folder)
    got = warc.read_archives(index, folder).collect()
    assert len(got) == len(PAGES)
    top = {}
    for i, _, h in PAGES:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    html = {}
    for i, _, h in PAGES:
        html[i] = h or ""
    for r in got:
        h = html[r.page_id]
        kind = "response" if r.page_id == top[h] else "revisit"
        assert (r.record_type, r.payload_bytes) == (kind, len(h.encode()))
        assert r.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert r.refers_to == (None if kind == "response" else top[h])
        assert r.payload is None if kind == "revisit" else bytes(r.payload) == h.encode()
    # a selection reads only its own ranges
    some = warc.read_archives(index.filter("page_id = 5"), folder).collect()
    assert [r.page_id for r in some] == [5]
    one = index.filter("page_id = 6").first()
    system, path = warc.file_system(folder)
    with system.open_input_file(f"{path}/{one.file}") as f:
        assert gzip.decompress(f.read_at(one.length, one.offset)).startswith(b"WARC/1.1\r\n")


def test_no_pages(spark):
    folder = shared_folder(spark, "warc-test")
    index = warc.write_archives(warc.with_record_types(frame(spark, [])), folder)
    assert warc.read_archives(index, folder).count() == 0
    assert html_text.extract(frame(spark, [])).count() == 0


def test_coalesced_reads():
    assert warc.coalesced([(0, 10), (10, 5), (100, 5)], gap=4) == [(0, 15, [0, 1]), (100, 105, [2])]
    assert warc.coalesced([(0, 10), (12, 10)], gap=4, most=15) == [(0, 10, [0]), (12, 22, [1])]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header>Site name</header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy now</div><aside>Side</aside><article><header><h1>Title &amp; more</h1></header>
<p>First para\tgraph with<br>a break.<p>Second <b>bold</b> one &lt;ok&gt;&#233;.<form><p>Subscribe</p></form>
<ul><li>item one<li>item two</ul><!-- hidden --><p>End.</article><section id="comments"><p>I disagree with all of this.</p></section>
<footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst para graph with a break.\n\nSecond bold one <ok>é.\n\nitem one\n\nitem two\n\nEnd."
    assert html_text.main_text("") == "" and html_text.main_text("<nav>only</nav>") == ""
    assert html_text.main_text("plain words") == "plain words"
    assert html_text.main_text("<article><p>cut off") == "cut off"
    deep = "<div>" * 20000 + "<p>inside some text</p>"
    assert html_text.main_text(deep) == "inside some text"


def test_ratio_without_article():
    long = "word " * 60
    page = f"<body><div><a>x</a><a>y</a><a>z</a></div><p>{long}</p><p>{long}</p><div><a>p</a><i>q</i><b>r</b></div></body>"
    assert html_text.main_text(page) == f"{long.strip()}\n\n{long.strip()}"


def test_extract_edges(spark):
    got = {r.page_id: r for r in html_text.extract(frame(spark, PAGES[1:3])).collect()}
    assert got[2].text == "" and got[2].n_chars == 0 and got[3].url == "http://c/"


def test_no_depth_is_too_deep():
    for open_ in ("<div>", "<font>", "<a>"):
        page = open_ * 6000 + "<script>var source = 1;</script><nav>menu of links</nav><p>inside some text</p><footer>foot</footer>"
        assert html_text.main_text(page) == "inside some text"
    # an end tag far down closes its own element, not an outer one of that name
    assert html_text.main_text("<nav>" + "<span>" * 6000 + "<nav>x</nav>still a menu" + "</span>" * 6000 + "</nav><p>text</p>") == "text"


def test_ratio_decides_on_every_page():
    long = "word " * 60
    text = long.strip()
    # a small teaser article beside a main text in a div
    page = f"<body><div><p>{long}</p><p>{long}</p><p>{long}</p></div><article><p>{long[:100]}</p></article></body>"
    assert html_text.main_text(page).split("\n\n")[:3] == [text] * 3
    # clustered lines outside the article stay, short ones inside it too
    page = f"<article><p>{long}</p><p>{long}</p><p>Yes.</p></article><ul><li><a>a</a><li><a>b</a></ul><div><p>{long}</p><p>{long}</p></div>"
    assert html_text.main_text(page) == "\n\n".join([text, text, "Yes.", text, text])


def test_names_and_places_are_weights():
    long = "word " * 60
    text = long.strip()
    for open_, close in (('<div class="widget Blog"><article>', "</article></div>"), ('<div class="post has-comments">', "</div>"),
                         ('<section id="related-work">', "</section>"), ("<form>", "</form>"), ("<aside><article>", "</article></aside>")):
        assert html_text.main_text(f"<nav><a>Home</a></nav>{open_}<p>{long}</p><p>{long}</p>{close}<footer>me</footer>") == f"{text}\n\n{text}", open_
    assert html_text.main_text(f'<p>{long}</p><p>{long}</p><div class="comments"><p>I disagree.</p></div>') == f"{text}\n\n{text}"


@pytest.mark.parametrize("part", ["<a ", "<a href=\"", "<!", "</", "<?", "&", "&#", "<div>", "<p>", "</p>", "<a b=c ", "<![CDATA[", "<script>", "x<", "<![foo[x]]>", "<![ x>", "<!--", "<b><i>", "</b></i>", "<li>", "<a <a>", "'\"<", "<a b='"])
def test_hostile_pages_are_read_in_linear_time(part):
    started = time.time()
    for tail in ("", ">", "<p>" + "some words that are the text of the page " * 5):
        assert isinstance(html_text.main_text(part * ((1 << 20) // 3 // len(part)) + tail), str)
    assert time.time() - started < 30


def test_malformed_pages_never_fail():
    rng = random.Random(8)
    parts = ["<", ">", "!", "[", "]", "--", "/", "a", "p", "div", " ", '"', "'", "=", "&", "#", ";", "x", "script", "CDATA", "doctype", "?", "<p>", "</p>", "<article>", "word ", "\x00", "<!", "<![", "]]>", "é", "<!--", "-->"]
    for _ in range(5000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert isinstance(html_text.main_text(page), str), page


def test_cut_off_markup_is_no_text():
    long = "<p>" + "Words of the article that go on for a while. " * 4 + "</p>"
    want = html_text.main_text(long)
    for tail in ('<a href="x', "<!DOCTYPE [<!x", "</di", "<?php x", "<!-- never closed", "<![CDATA[ x"):
        assert html_text.main_text(long + tail) == want
    assert html_text.main_text(long + "<![foo[x]]>" + "<![ x>") == want
    assert html_text.main_text("<p>" + "one < two and three <3 four " * 5) == ("one < two and three <3 four " * 5).strip()


def test_short_lines_of_the_main_block_stay():
    long = "A long paragraph of the text, with many words in it, so that its ratio is high. " * 4
    page = f"<body><ul class=menu><li><a href=/>Home</a></ul><div><p>{long}</p><p>Yes.</p><p>{long}</p><h2>Last words</h2><ul><li>one</li><li>two</li></ul></div><div class=footer>(c) us</div></body>"
    assert html_text.main_text(page).split("\n\n") == [long.strip(), "Yes.", long.strip(), "Last words", "one", "two"]
    short = [f"Line {k} of it." for k in range(30)]
    page = "<body><article>" + "".join(f"<p>{x}</p>" for x in short) + f"</article><div><p>{long * 5}</p></div></body>"
    assert html_text.main_text(page).split("\n\n")[:30] == short
