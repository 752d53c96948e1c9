import html
import re

import pytest

from eventide.llm import html_text as H
from eventide.llm.common import read
from eventide.llm.queries import QUERIES

LONG = "The committee met on Tuesday and, after a long debate, agreed to publish its findings in full before the year is out."
MORE = "Nobody in the room disagreed with the chair, who had prepared the report over many months of careful, patient work."
PAGE = """<!doctype html><html><head><title>T</title><style>.a{}</style><script>if (a<b) document.write("<p>x</p>")</script></head>
<body class="has-sidebar no-ads"><div id="cookie-notice">We use cookies to make this site better for you, as all sites do these days.</div>
<header><a href="/">Home</a> The Daily Site, news since 1901</header><div class="siteHeader">Another header line</div>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
%s
<aside><h3>Popular</h3><p>Something else that is long enough to look like text, with commas, and more words.</p></aside>
<form><label>Mail</label><input><button>Send me the newsletter every single week</button></form>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I read it all and liked it, though it was rather long for me, as such things go, and then some more.</p></article></section>
<footer>&copy; 2020 The Daily Site. All rights reserved, wherever you are.</footer></body></html>"""
ARTICLE = f"""<h1>A &lt;big&gt; day</h1><p>{LONG} <a href="/x">A link</a>.<div class="ad">Buy this now, it is cheap and good and yours</div>
<p>{MORE}<br>second   line &amp; &eacute;&#233;<ul><li>first point<li>second <b>point</b></ul><div class="related"><a href=1>More</a></div><blockquote>Quoted</blockquote>"""
WANT = ["A <big> day", LONG + " A link.", MORE + " second line & éé", "first point", "second point", "Quoted"]


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><div class='body'>%s</div></main>", "<div><div id=story>%s</div></div>",
                                  "<table><tr><td>%s</td></tr></table>"])
def test_article_without_its_surroundings(wrap):
    assert H.main_text(PAGE % (wrap % ARTICLE)).split("\n\n") == WANT


def test_densities():
    nodes = {n.tag: n for n in H.measure(H.parse("<body><div><p>aaaa aaaa</p><p>bb</p></div><ul><li><a>cc</a></li></ul></body>"))}
    assert (nodes["div"].chars, nodes["div"].tags) == (11, 2) and (nodes["ul"].link_chars, nodes["ul"].link_tags) == (2, 1)
    assert nodes["div"].density > nodes["ul"].density and nodes["div"].total > nodes["body"].total


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("just text", "just text"), ("<p>a<p>b", "a\n\nb"), ("<p>a &am", "a &am"),
    ("<article><p>x</article", "x"), ("<p>a<!-- b <p> --> c</p>", "a c"), ("<p>a</b></i>b</p></p>", "ab"), ("<script>x", ""),
    ("<p>a < b and c > d</p>", "a < b and c > d"), ("<p title='>'>q</p>", "q"), ("<p title=\"x>q</p>", "q"), ("<nav>only</nav>", ""),
    ("<div class=sidebar>all there is</div>", "all there is"), ("<p>a&nbsp;\t b</p>", "a b"), ("<P>UP<BR/>per</P>", "UP per"),
])
def test_odd_pages(page, want):
    assert H.main_text(page) == want


def test_long_and_deep_pages_in_time():
    assert H.main_text("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"
    assert len(H.main_text("<p>word word</p>" * 50_000)) == 50_000 * 11 - 2
    assert H.main_text('<a "' * 20_000) is not None and H.main_text("<" * 100_000 + "p") is not None


def test_query(spark, sf):
    got = {r.page_id: r for r in QUERIES["op7_html"](spark, sf).collect()}
    pages = read(spark, sf, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = re.sub(r"</article>.*|<footer>.*", "", p.html.split("<article>", 1)[1], flags=re.S).replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(x for x in parts if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


def test_edge_cases(spark):
    rows = [(1, None, "t"), (1, None, "t"), (None, "<p>x</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = H.extract(df)
    assert out.columns == ["page_id", "text", "n_chars"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "", 0), (1, "", 0), (None, "x", 1)], key=repr)
    assert H.extract(df.where("false")).count() == 0


def test_parts_of_an_article_stay_whatever_their_names():
    parts = ['<section id="discussion"><p>%s</p></section>', '<h2 id="related-work">Related work</h2><p>%s</p>', '<section id="feedback"><h2 id="search-results">Found</h2>%s</section>',
             '<p id="notice" class="alert">%s</p>', '<section class="related-work"><p>%s</p></section>', '<div class="thread">%s</div>']
    text = lambda x: " ".join(re.sub(r"<[^>]*>", " ", x).split())
    for wrap in ("<article>%s</article>", "<main><div>%s</div></main>", "<div role=main><div>%s</div></div>"):
        for part in parts:
            got = H.main_text(PAGE % (wrap % (f"<h1>Title</h1><p>{LONG}</p>" + part % MORE + f"<p>{LONG}</p>")))
            assert " ".join(got.split()) == text(f"Title {LONG} {part % MORE} {LONG}")
    plain = H.main_text(PAGE % f'<div><p>{LONG}</p><h2 id="related-work">Related work</h2><p>{MORE}</p><section id="discussion"><p>{LONG} {MORE}</p></section></div>')
    assert plain.split("\n\n") == [LONG, "Related work", MORE, f"{LONG} {MORE}"]
    shared = H.main_text(PAGE % f'<article><p>{LONG}</p><div class="share"><a href=1>Mail it</a> <a href=2>Print it</a></div></article>')
    assert shared == LONG


def test_all_articles_and_formulas():
    page = PAGE % f"<div><article><p>{LONG}</p></article><article><p>{MORE} {LONG}</p></article><article class=teaser><p>{MORE}</p></article></div>"
    assert H.main_text(page).split("\n\n") == [LONG, f"{MORE} {LONG}"]
    nested = PAGE % f"<article><p>{LONG}</p><article><p>{MORE} {LONG} {MORE}</p></article><p>{MORE}</p></article>"
    assert H.main_text(nested).split("\n\n") == [LONG, f"{MORE} {LONG} {MORE}", MORE]
    formula = '<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding="application/x-tex">x=2</annotation></semantics></math>'
    assert H.main_text(f"<article><p>Let {formula} hold.</p></article>") == "Let x=2 hold."


@pytest.mark.parametrize("name", ["rail-history", "menu-open", "sidebar-layout", "banner", "thread", "search", "promo"])
def test_a_name_around_the_whole_article(name):
    """What a name leaves out must not outweigh what is kept."""
    page = f'<body><p>short</p><div class="{name}"><h1>Title</h1><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p></div></body>'
    got = H.main_text(page)
    assert all(x in got.split("\n\n") for x in ("Title", LONG, MORE))
    comments = f'<body><article><p>{LONG}</p></article><div class="comments-list">{f"<p>{MORE}</p>" * 9}</div></body>'
    assert H.main_text(comments) == LONG  # comments may outweigh the article


@pytest.mark.parametrize("part", ['<div class="thread"><p>%s</p></div>', '<div class="social-history">%s</div>', '<div class="banner-text">%s</div>', '<p class="related">%s</p>',
                                  '<div class="search-results"><p>%s</p></div>', '<section class="feedback">%s</section>'])
def test_parts_with_plain_names_outside_an_article_element(part):
    got = H.main_text(PAGE % f"<div><h1>Title</h1><p>{LONG}</p>{part % MORE}<p>{LONG} {MORE}</p></div>")
    assert got.split("\n\n") == ["Title", LONG, MORE, f"{LONG} {MORE}"]


@pytest.mark.parametrize("noise", ['<div class="ad-text">%s</div>', '<div class="cookie-banner">%s</div>', '<div class="site-notice">%s</div>', '<div id="sidebar-left"><p>%s</p></div>',
                                   '<div class="comments-area"><p>%s</p></div>', '<div class="newsletter-box">%s</div>', '<div class="footer-wrapper">%s</div>'])
def test_named_noise_still_goes(noise):
    got = H.main_text(PAGE % f"<div><h1>Title</h1><p>{LONG}</p><p>{LONG} {MORE}</p></div>{noise % MORE}")
    assert got.split("\n\n") == ["Title", LONG, f"{LONG} {MORE}"]


def test_lists_of_links_and_words_in_buttons_stay_in_the_text():
    links = "<ul><li><a href=/a>First book</a></li><li><a href=/b>Second book</a></li></ul>"
    page = PAGE % f"<article><h1>Title</h1>{links}<p>{LONG}</p><h2>Further reading</h2>{links}<p>Press <button>Go</button> or <label>this</label> now.</p></article>"
    assert H.main_text(page).split("\n\n") == ["Title", LONG, "Further reading", "First book", "Second book", "Press Go or this now."]


def test_many_lists_in_time():
    links = "<ul><li><a href=/a>First book</a></li><li><a href=/b>Second book</a></li></ul>"
    assert H.main_text(f"<article><p>{LONG}</p>{links * 20_000}</article>").count("First book") == 20_000
