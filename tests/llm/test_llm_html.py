"""Main text of pages."""

import html
import re

from resemble.llm.htmltext import extract_main_text, main_text

SF = "/root/testdata/sf0.001"

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="menu"><a href=x>a</a></div>
<div class="content with-sidebar"><div><h2>Head &amp; line</h2><p>First paragraph, with a <a href="x">link</a> inside it and lots more of text to make it long.</p>
<p>Second&nbsp;one.
 long enough   to be main text of the page yes<br>broken</p></div></div><div class="sidebar-left"><p>Some side text, quite long, long, long</p></div>
<section id="comments"><p>I like it so much that I have to write a long comment here, so long, longer than all of the text.</p></section>
<form><label>Name</label></form><div class="cookie-notice">We use cookies</div><footer>c</footer></body></html>"""


def test_main_text_without_marked_article():
    assert main_text(PAGE) == ("Head & line First paragraph, with a link inside it and lots more of text to make it long. "
                               "Second one. long enough to be main text of the page yes broken")


def test_broken_and_empty_markup():
    assert main_text(None) == "" and main_text("") == "" and main_text("<p> \n</p>") == ""
    assert main_text("<p>One</p><![bad <p>Two</p>") == "One Two"
    assert main_text("plain & text &lt;b&gt; 1 < 2") == "plain & text <b> 1 < 2"
    assert main_text("<div>a<!-- x") == "a" and main_text("<script>x") == ""
    assert main_text("<p>a<p>b</b></i></div>c") == "a bc"
    assert main_text("<div>" * 3000 + "deep") == "deep"


def test_low_density_blocks_inside_the_article_stay():
    page = "<nav><a href=a>x</a></nav><article><h1>T</h1><p>" + "long text " * 80 + "</p><p>Er.</p><ul><li>i</li></ul></article><footer>f</footer>"
    assert main_text(page) == "T " + "long text " * 80 + "Er. i"


def test_comments_and_adverts_inside_the_article_go():
    page = ("<main class='sidebar-right'><article class='post sidebar-right'><header><h1>T</h1></header><p>" + "body text " * 30 + "</p>"
            "<aside>side</aside><div class='ad-slot'>Buy</div><div class='post-comment-list'><article class='comment'><p>" + "I say " * 60 + "</p></article></div>"
            "<p hidden>x</p><div role='alert'>y</div><p style='display: none'>z</p></article></main>")
    assert main_text(page) == "T " + ("body text " * 30).strip()


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in extract_main_text(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        expected = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[r["page_id"]]["text"] == expected and got[r["page_id"]]["n_chars"] == len(expected)


def test_nulls_repeats_clashing_names_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, "t", 3), (2, "<p>a</p>", "t", 3), (2, "<p>a</p>", "t", 3)], "page_id long, html string, text string, n_chars int")
    assert sorted(tuple(r) for r in extract_main_text(df).collect()) == [(1, "", 0), (2, "a", 1), (2, "a", 1)]
    assert extract_main_text(df.limit(0)).count() == 0
