import html as entities
import re

from stemma.llm import html

from .conftest import SMALL


def test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        text = re.sub(r"<(/?)(\w+)>", lambda m: "" if m[2] == "b" else " ", article)
        want[r.page_id] = " ".join(entities.unescape(text).split())
    got = html.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_kinds_of_boilerplate():
    page = """<html><head><title>x</title><style>p{}</style></head><body class="main-page"><div class="siteHeader"><a href=/>Home</a> menu</div>
    <div id="cookie-notice">We use cookies, and this sentence about them is as long as a paragraph of an article might be.</div>
    <main><header><h1>Title here</h1></header><p>First para &amp; text&nbsp;one<br>two.<div class="ad">Buy now</div><p>Second <a href=x>link</a> para.
    <ul><li>item one<li>item two</ul><form><label>Name</label><input></form><section class="comments"><article class="comment"><p>Nice post!</p></article></section>
    <script>if (a < b) { "</p>" }</script><!-- no > comment --></main><aside>side</aside><footer>foot</footer></body></html>"""
    assert html.main_text(page) == "Title here First para & text one two. Second link para. item one item two"


def test_pages_without_hints():
    words = lambda n: " ".join(["word"] * n)
    page = f"<body><table><tr><td><a href=1>One</a> <a href=2>Two</a></td></tr></table><p>{words(60)}</p><p>{words(45)}</p><div><a href=3>{words(9)}</a></div>"
    assert html.main_text(page) == words(105)


def test_broken_markup():
    for page in (None, "", "<", "<a", "<div class='", "<!--", "<script>a", "<p>", "</p></div>", "<title>t", "<article", "\x00"):
        assert html.main_text(page) == ""
    assert html.main_text("<article>a &lt;b&gt; &#x41;&bogus; &copy 1 < 2</article>") == "a <b> A&bogus; © 1 < 2"
    assert html.main_text("<article>" + "<div>" * 20_000 + "deep" + "<a href=\"" * 2000) == "deep"


def test_odd_rows(spark):
    rows = [(1, "u", None, 3), (None, None, "<article>x</article>", 4), (2, "u", "", 5), (2, "u", "", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted(map(tuple, html.extract(pages).collect()), key=repr) == sorted([(1, "u", "", 0), (None, None, "x", 1), (2, "u", "", 0), (2, "u", "", 0)], key=repr)
    assert html.extract(pages.where("false")).count() == 0


def prose(n, seed=0):
    return " ".join(f"word{(k * 7 + seed) % 97}" for k in range(n))


def test_attributes_that_only_look_like_hints():
    text = prose(50)
    for page in (
        f'<body><div class="overflow-hidden"><p>{text}</p></div></body>',
        f'<article title="The hidden valley"><p>{text}</p></article>',
        f'<article data-hidden="x" data-class="sidebar" xclass="ad"><p>{text}</p></article>',
        f"<article data-x='class=\"nav\" hidden'><p>{text}</p></article>",
        f'<body><form id="aspnetForm" action="/x"><article><p>{text}</p></article></form></body>',
        f'<body><form><main><p>{text}</p></main></form></body>',
        f'<body><div class="post has-sidebar with-ads"><p>{text}</p></div></body>',
        f'<body><div class="sidebar-layout article-body"><p>{text}</p></div></body>',
        f'<article aria-hidden="false"><p>{text}</p></article>',
    ):
        assert html.main_text(page) == text, page


def test_what_is_not_shown():
    for attrs in ("hidden", 'hidden=""', 'aria-hidden="true"', 'style="display: none"', 'class="x sr-only"', "HIDDEN"):
        for tag in ("b", "span", "div", "em"):
            got = html.main_text(f"<article><p>one <{tag} {attrs}>two <i>three</i></{tag}> four</p><p>five</p></article>")
            assert got == "one four five", (tag, attrs, got)
    assert html.main_text("<article><p>one <b hidden>two</p><p>three</p></article>") == "one three"


def test_several_templates():
    body = [prose(60, 1), prose(45, 2), prose(70, 3)]
    want = " ".join(body)
    paragraphs = "".join(f"<p>{x}</p>" for x in body)
    menu = "".join(f'<li><a href="/{k}">Item number {k}</a></li>' for k in range(8))
    pages = (
        f"<body><nav><ul>{menu}</ul></nav><main>{paragraphs}</main><footer>All rights reserved</footer></body>",
        f'<body><div id="menu"><ul>{menu}</ul></div><div class="content">{paragraphs}</div><div class="related"><ul>{menu}</ul></div></body>',
        f'<body><ul>{menu}</ul><div>{paragraphs}</div><ul>{menu}</ul></body>',
        f'<body><table><tr><td><a href="a">One</a> <a href="b">Two more</a></td><td>{paragraphs}</td></tr></table></body>',
        f'<body class="home"><header><a href="/">Site</a></header><div role="main">{paragraphs}<div class="comments"><p>{prose(40)}</p></div></div><div class="cookie-banner">{prose(30)}</div></body>',
        f'<body><div class="wrap"><div class="ad">{prose(25)}</div><section class="entry">{paragraphs}</section><form>{prose(12)} <input></form></div></body>',
    )
    for page in pages:
        assert html.main_text(page) == want, page
