import html
import re
import time

from skein.llm import html as H
from skein.session import table


def test_query_against_the_marked_articles(spark, sf):
    want = {}
    for r in table(spark, sf, "pages").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", body))).split())
    got = {r.page_id: (r.text, r.n_chars) for r in H.op9_html(spark, sf).collect()}
    assert got == {p: (t, len(t)) for p, t in want.items()}


def test_boxes_go_and_text_stays():
    page = """<html class="has-sidebar"><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
    <main><h1>Head &amp; line</h1><p>First <b>bo</b>ld <a href="x">link</a>.<p>Unclosed one<div class="ad-slot">Buy</div><ul><li>item one<li>item two</ul>
    <aside>Side</aside><div id="comments"><p>Reader says</p></div><form>Search</form><div class="cookieNotice">We use</div><pre>a
      b</pre><p style="display:none">no</p><p hidden>no</p><noscript>no</noscript><p>Short.</p></main><div role="contentinfo">foot</div><footer>&copy;</footer><script>"</p>"</script></body></html>"""
    assert H.main_text(page) == "Head & line First bold link. Unclosed one item one item two a b Short."


def test_pages_without_a_marked_article():
    menu = "<div>" + "".join(f"<p><a href=/{i}>entry {i}</a></p>" for i in range(8)) + "</div>"
    body = "".join(f"<p>Sentence number {i} is a rather long one that carries the text of the page.</p>" for i in range(6))
    assert H.main_text(f"<body>{menu}<div>{body}<p>Ok.</p></div>{menu}</body>") == " ".join(f"Sentence number {i} is a rather long one that carries the text of the page." for i in range(6)) + " Ok."


def test_edge_cases(spark):
    cases = [(1, "u", None), (2, None, ""), (3, "u", "plain text"), (None, "u", "<p>a  b"), (4, "u", "<p>&lt;b&gt; &#x41;&#66; &nbsp;c"), (4, "u", "<script>x"), (5, "u", "<!-- x"), (6, "u", "<p title='a>b'>q</p>")]
    docs = spark.createDataFrame([(*c, 1, "t") for c in cases], "page_id long, url string, html string, n_chars int, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in H.extract_main_text(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "", 0), (2, "", 0), (3, "plain text", 10), (None, "a b", 3), (4, "<b> AB c", 8), (4, "", 0), (5, "", 0), (6, "q", 1)], key=str)
    assert H.extract_main_text(docs.limit(0)).count() == 0


def test_broken_markup_stays_fast():
    for bad in ('<a "' * 20_000, "<div>x " * 20_000 + "</p>" * 20_000, "<!--" * 20_000, "<" * 50_000, "<p>x " * 20_000, "&" * 50_000):
        began = time.time()
        H.main_text(bad)
        assert time.time() - began < 5


def test_names_of_boxes():
    def kept(attrs, tag="div"):
        return "box" in H.main_text(f"<body><article><p>The text of the article stands here.</p><{tag} {attrs}>box</{tag}></article></body>")

    for attrs in ('class="ad"', 'class="post ad-slot"', 'id="cookieNotice"', 'class="related-posts"', 'class="commentsection"', 'class="advertorial-box"', "class=sidebar", 'role="search"', 'aria-hidden="true"'):
        assert not kept(attrs), attrs
    for attrs in ('class="article-header"', 'class="lead"', 'class="commentary"', 'id="adaptation"', 'class="header"', 'class="navy shadow"', 'title="ad"', ""):
        assert kept(attrs), attrs
    assert not kept("", "aside") and not kept("", "footer") and kept("", "header")


def test_headings_of_unmarked_pages():
    page = '<body><div class="header">Site</div><div class="post-header"><h1>Title of it</h1></div><div class="post"><p>A long paragraph that is the text of this page.</p></div><div class="footer">End</div></body>'
    assert H.main_text(page) == "Title of it A long paragraph that is the text of this page."


LONG = "A sentence of the article that says at some length what there is to say about its matter, and then goes on."


def test_nothing_else_is_dropped():
    assert H.main_text(f"<div><p>{LONG}</p></div><nav>menu</nav><div><p>Short closing.</p></div>") == f"{LONG} Short closing."
    assert H.main_text(f"<div><p>{LONG}</p><p>See <a href=x>all of this linked sentence</a></p><p><a href=y>Only a link</a></p><p>{LONG}</p></div>") == f"{LONG} See all of this linked sentence Only a link {LONG}"
    for attrs in ('class="share-price"', 'class="search-results-analysis"', 'id="legal-history"', 'class="notice-theory x"'):
        assert H.main_text(f"<article><p>{LONG}</p><div {attrs}>Text of it.</div></article>") == f"{LONG} Text of it.", attrs


def test_windows_decide():
    # a run of lines without text of their own is a dive, a shorter one is not
    links = lambda n: "".join(f"<li><a href=/{i}>entry number {i}</a></li>" for i in range(n))
    assert H.main_text(f"<p>{LONG}</p><ul>{links(3)}</ul><p>{LONG}</p>") == f"{LONG} {LONG}"
    assert "entry number 1" in H.main_text(f"<p>{LONG}</p><ul>{links(2)}</ul><p>{LONG}</p>")
    assert H.main_text(f"<ul>{links(2)}</ul>") == ""
    # a hint in a name: what is flat goes, what surges stays
    page = "<body><div>" + f"<p>{LONG}</p>" * 4 + "<div class='price-alert'>{}</div></div></body>"
    assert H.main_text(page.format("Buy!")) == " ".join([LONG] * 4)
    assert H.main_text(page.format(f"<p>{LONG}</p><p>End.</p>")) == " ".join([LONG] * 5) + " End."
    assert H.main_text("<div class='with-sidebar'><p>Alone</p></div>") == "Alone"


def test_regions():
    assert H.regions([0, 0, 5, 0, 0, 0, 7, 0, 0]) == [(0, 3), (6, 9)]
    assert H.regions([0, 0]) == [] and H.regions([0, 4]) == [(0, 2)] and H.regions([]) == []


def test_unmarked_pages_of_the_same_articles(spark, sf):
    """The pages with their article element taken away give the same text: boxes and windows do without the mark."""
    pages = [(r.page_id, r.html) for r in table(spark, sf, "pages").collect()]
    same = sum(H.main_text(h) == H.main_text(h.replace("<article>", "<div>").replace("</article>", "</div>")) for _, h in pages)
    assert same == len(pages)
