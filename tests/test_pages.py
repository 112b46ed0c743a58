"""Fixtures B5, B6: URL text, meta, all text, selectors, empty html."""

import pytest
from pyspark.sql import functions as F

from resemble.functions.urltext import url_text
from resemble.operators import pages as P

HTML = ('<html><head><title>Red Shoes</title><meta name="Description" content="Cheap red shoes">'
        '<meta property="og:description" content="ignored"><meta name="keywords" content="shoes,red">'
        '<style>p{}</style><script>var t="</p>";</script></head><body><!-- ad --><div class="ad">Buy <b>now</b> '
        'today</div><p id="x">Hello</p></body></html>')
URL = "https://www.shop.example.com/gifts/red-shoes/index.html"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, URL, HTML), (2, "http://a.com/", "")], "page_id long, url string, html string")


def test_b5_url_text(spark):
    urls = {
        "https://www.teahouse.example.com/green/japan/sencha-first-flush": "teahouse green japan sencha first flush",
        "https://forum.example.org/threads/40219/why-does-rust-form": "forum threads 40219 why does rust form",
        "https://manual.example.net/4/tools/saw.html": "manual 4 tools",
        "http://a.com/": "a ",
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.t for r in df.select("url", url_text(F.col("url")).alias("t")).collect()}
    assert got == urls


def test_b6_meta_and_all_text(pages):
    meta = P.meta_parts(pages, P.page_nodes(pages)).where("page_id = 1").first()
    assert (meta.title, meta.description, meta.keywords, meta.url_text) == \
        ("Red Shoes", "Cheap red shoes", "shoes,red", "shop gifts red shoes")
    out = {r.page_id: r.content for r in P.extract(pages, "all_text").collect()}
    assert out[1] == "Red Shoes, Cheap red shoes, shoes,red, shop gifts red shoes, Buy, now, today, Hello"
    assert out[2] == "http://a.com/"


def test_b6_selectors(pages):
    css = {r.page_id: r.content for r in P.extract(pages, "selective", ".ad", "css").collect()}
    assert css[1] == "Buy  now "
    xp = {r.page_id: r.content for r in P.extract(pages, "selective", "//p", "xpath").collect()}
    assert xp[1] == "Hello "
    nested = {r.page_id: r.content for r in P.extract(pages, "selective", "body > div b", "css").collect()}
    assert nested[1] == "now "


def test_every_extractor_runs(pages):
    for name in P.EXTRACTORS:
        rows = P.extract(pages, name, "p" if name == "selective" else None).collect()
        assert len(rows) == 2


def test_unknown_extractor_raises(pages):
    with pytest.raises(ValueError):
        P.extract(pages, "nope")


def test_quirk_options(spark):
    html = '<html><head><meta property="description" content="P"></head><body><p></p></body></html>'
    pages = spark.createDataFrame([(1, "http://a.com/", html)], "page_id long, url string, html string")
    nodes = P.page_nodes(pages)
    assert P.page_meta(nodes).first().description is None
    assert P.page_meta(nodes, meta_property=True).first().description == "P"
    assert P.extract(pages, "selective", "p").first().content == ""
    assert P.extract(pages, "selective", "p", fallback_after_extract=True).first().content == "http://a.com/"


def test_selector_forms(spark):
    html = ('<html><body><div id="m" class="box wide"><p>one</p><section><p>two</p></section></div>'
            '<ul><li>a</li><li data-x="1">b</li><li>c</li></ul><p>three</p></body></html>')
    pages = spark.createDataFrame([(1, "http://a.com/", html)], "page_id long, url string, html string")
    nodes = P.page_nodes(pages)

    def sel(s, t="css"):
        return P.selective(pages, s, t, nodes).first().content

    assert sel("div p") == "one two "
    assert sel("div > p") == "one "
    assert sel("#m section p") == "two "
    assert sel(".wide > section") == "two "
    assert sel("li[data-x]") == "b "
    assert sel("li[data-x=1]") == "b "
    assert sel("//ul/li[2]", "xpath") == "b "
    assert sel("/html/body/p", "xpath") == "three "
    assert sel("//div[@class='box wide']//p", "xpath") == "one two "
    assert sel("//nav", "xpath") == ""


def test_selector_errors():
    for bad, kind in [("", "css"), ("a:hover", "css"), ("//a[last()]", "xpath"), ("p", "jquery")]:
        with pytest.raises(ValueError):
            P.selector_predicate(bad, kind)


def test_text_after_bad_markup_is_kept(spark):
    html = "<p>One</p><![bad <p>Two</p><![CDATA[x]]><p>Three</p><!bad><p>Four"
    pages = spark.createDataFrame([(1, "http://a.com/", html)], "page_id long, url string, html string")
    content = P.extract(pages, "all_text").first().content
    assert [w for w in ("One", "Two", "Three", "Four") if w in content] == ["One", "Two", "Three", "Four"]


SIBLINGS = ('<html><body><h1>Top</h1><p id="a" lang="en-US">one</p><p class="x note">two</p><div><p>three</p><p title="a,b">four <i>five</i></p>'
            '<p>six</p></div><ul><li>a</li><li data-x="file.pdf">b</li><li>c</li><li>d</li></ul><a href="http://q/p.html">link</a><p></p></body></html>')


@pytest.fixture(scope="module")
def sibling_nodes():
    from resemble.functions.html_nodes import parse_page

    return parse_page(1, SIBLINGS)


@pytest.mark.parametrize("selector,want", [
    ("h1 + p", "one "), ("h1 ~ p", "one two "), ("p + p", "two four  five six "), ("p, h1", "Top one two three four  five six "),
    ("li:nth-child(2)", "b "), ("li:nth-child(odd)", "a c "), ("li:nth-child(-n+2)", "a b "), ("li:nth-child(2n)", "b d "),
    ("li:first-child", "a "), ("li:last-child", "d "), ("p:not(.note)", "one three four  five six "), ("li:not([data-x], :first-child)", "c d "),
    ("p[lang|=en]", "one "), ("a[href^=http]", "link "), ("li[data-x$='.pdf']", "b "), ("a[href*='q/p']", "link "), ("p[class~=note]", "two "),
    ("p[title='a,b']", "four  five "), ("body > p:nth-of-type(2)", "two "), ("p:empty", ""), ("div p:first-of-type, i", "three five "),
    ("ul > li + li ~ li", "c d "), ("i:only-child", "five "), ("h1 > p", ""),
])
def test_css_forms(sibling_nodes, selector, want):
    assert P.compile_selector(selector, "css")(sibling_nodes) == want


@pytest.mark.parametrize("selector,want", [
    ("//li[@data-x]", "b "), ("//div[p]/p[2]", "four  five "), ("//p[contains(text(),'o')]", "one two four  five "), ("//p[contains(@title, ',')]", "four  five "),
    ("//p[not(@class) and not(@id)]", "three four  five six "), ("//p[contains(., 'five')]", "four  five "), ("//p[text()='six']", "six "),
    ("//li[position()>=3]", "c d "), ("//a[starts-with(@href,'http')]", "link "), ("//p[@id='a' or @class='x note']", "one two "),
    ("//li[@data-x][1]", "b "), ("//li[2][@data-x]", "b "), ("//li[1][@data-x]", ""), ("/html/body/ul/li[4]", "d "), ("//p[@class!='x']", "two "),
    ("//li/text()", "a b c d "), ("//div//i", "five "), ("//*[@data-x]", "b "),
])
def test_xpath_forms(sibling_nodes, selector, want):
    assert P.compile_selector(selector, "xpath")(sibling_nodes) == want


@pytest.mark.parametrize("bad,kind", [("p:hover", "css"), ("p >", "css"), (", p", "css"), ("p[", "css"), ("p:nth-child(x)", "css"), ("p..a", "css"),
                                      ("//p[last()]", "xpath"), ("p", "xpath"), ("//p[", "xpath"), ("//a/@href", "xpath"), ("//p[contains(@a)]", "xpath")])
def test_unsupported_selectors_raise(bad, kind):
    with pytest.raises(ValueError):
        P.compile_selector(bad, kind)


def test_deep_nesting_is_linear():
    import time

    from resemble.functions.html_nodes import parse_page

    html = "<div>" * 4_000 + "x" + "</div>" * 4_000
    start = time.perf_counter()
    rows = parse_page(1, "<p>" + html)
    assert len(rows) == 4_003 and time.perf_counter() - start < 2
    assert all(len(r) < 16 for r in rows)
    assert P.compile_selector("div div > div", "css")(rows).count("x") == 3_998


def test_recipes_have_no_shuffle_window_or_join(pages):
    for name in P.EXTRACTORS:
        plan = P.extract(pages, name, "p" if name == "selective" else None)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Window", "Join")), name
