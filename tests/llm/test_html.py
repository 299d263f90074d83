import html as references
import re

import pytest

from cambium.llm import html


def articles(page):
    """The article's lines of the driver's pages, which have no markup inside it but p, b, br and h1."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = (" ".join(references.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"<(?:/?p|/?h1)>", inner))
    return "\n".join(filter(None, blocks))


def test_driver_pages(spark, sf):
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    for r in html.extract(pages, ["page_id", "url", "html"]).collect():
        assert r["text"] == articles(r["html"]) and r["n_chars"] == len(r["text"])


PAGE = """<!doctype html><html><head><title>T &amp; x</title><style>p{}</style><script>if(a<b){"</p>"}</script></head><body class="menu"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><div id="ad-1" class="ad banner">Buy now</div><main><article><header><h1>Title</h1></header><p>First   para with <a href="x">link</a> and &eacute;&nbsp;ok a &lt; b.</p>
<figure><img alt="no"><figcaption>Cap</figcaption></figure><div>Second<br>line</div><aside>side</aside><ul><li>one<li>two</ul><section id="comments"><p>Great post!</p></section><form><input><p>Subscribe</p></form></article></main>
<div class="sidebar"><a href=1>aaa</a><a href=2>bbb</a></div><footer>foot</footer></body></html>"""
SOUP = """<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>About us</a></div><div><div><p>Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore.</p>
<p>Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo.</p></div><div><a href=5>Related one</a><a href=6>Related two</a></div></div><div>Copyright <a href=x>me</a></div></body>"""


def test_boilerplate_goes():
    assert html.main_text(PAGE) == "Title\nFirst para with link and é ok a < b.\nCap\nSecond line\none\ntwo"


def test_names_of_what_holds_the_article():
    page = "<body><div class='layout with-sidebar'><div id='menu-page'><div class='widget'><article><div class='entry-header'><h1>T</h1></div><p>Some words of the text.</p></article></div></div></div><div class='related'><article>Teaser</article></div><div class='side-bar'>x</div></body>"
    assert html.main_text(page) == "T\nSome words of the text."
    assert html.main_text("<body><nav><article>not this</article></nav><p>but this text here</p></body>") == "but this text here"


def test_a_layouts_name_does_not_hide_the_article():
    words = " ".join(f"<p>Paragraph {i} of the text, with some words more.</p>" for i in range(5))
    want = [f"Paragraph {i} of the text, with some words more." for i in range(5)]
    for name in ("elementor-widget-container", "content-sidebar-wrap", "social-page", "related"):
        page = f"<body><div class='site-menu'><a href=1>One</a></div><div class='{name}'>{words}</div><div class='sidebar'>aside text</div><div class='comments'>{'<p>Great words here, thanks for them.</p>' * 9}</div></body>"
        assert html.main_text(page).split("\n") == want
    page = "<body>" + "".join(f"<div class='widget'><div class='sidebar'>{p}</div></div>" for p in (words, "<p>side</p>")) + "</body>"
    assert html.main_text(page).split("\n") == want


def test_density_alone_finds_the_article():
    assert html.main_text(SOUP).split("\n")[0].startswith("Lorem") and html.main_text(SOUP).endswith("commodo.") and "Related" not in html.main_text(SOUP) and "Home" not in html.main_text(SOUP)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>", ""), ("<", "<"), ("<p>a", "a"), ("a<b", "a"), ("<!-- x", ""), ("<b>x</b>y <i>z</i>", "xy z"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("<p>x<script>alert(1)", "x"), ("<div><div><div>", ""), ("&#x41;&lt;b&gt;", "A<b>"), ("<div>" * 3000 + "x", "x"), ("<p>a<p>b</div></p>c", "a\nb\nc"), ("<P CLASS=x>A</P>", "A"), ("<p title='a>b'>c</p>", "c"),
    ("<body><p>a</p></body></html>", "a"), ("<script>x</script>", ""), ("<p hidden>a</p><p>b</p>", "b"), ("<p>one\ttwo\n three</p>", "one two three"),
])
def test_odd_pages(page, text):
    assert html.main_text(page) == text


def test_time_grows_with_the_page():
    import time

    for shape in (lambda n: "<div>" * n + "x" + "</div>" * n + "<p>a <b>b" * n, lambda n: "<b>" * n + "<td>x" * n, lambda n: "<b>" * n + "<li>x<p>y" * n, lambda n: "<table><tr><td><i>" * n + "<dd>x" * n):
        took = []
        for n in (10_000, 40_000):
            start = time.process_time()
            html.main_text(shape(n))
            took.append(time.process_time() - start)
        assert took[1] < 12 * took[0] + 1


def test_table_edges(spark):
    frame = spark.createDataFrame([(1, "u", None, 1), (1, "u", "<p>x", 2), (None, None, PAGE, 3)], "page_id long, url string, html string, tags int")
    got = html.extract(frame, ["page_id", "url", "tags"]).collect()
    assert [(r["tags"], r["n_chars"]) for r in sorted(got, key=lambda r: r["tags"])][:2] == [(1, 0), (2, 1)] and html.extract(frame.limit(0), ["page_id"]).count() == 0
