"""HTML extraction: page layouts, broken markup, hosts of one and of many pages."""

import pytest

from postmill.llm import wrappers


def text_of(spark, *pages, url="http://h.example.org/{}"):
    rows = [(i, url.format(i), p) for i, p in enumerate(pages)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS wrapper"))
    return [r.text for r in sorted(got.collect(), key=lambda r: r.page_id)]


FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p><p>no</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><aside><p>Side</p></aside><div id="sidebar">Links</div>
<article><header><h1>Title {0}</h1></header><p>First   <b>bold</b> &amp; caf&eacute; {0}<br>next<p>Second
line {0}</p><div class="ad">Buy</div><ul><li>item {0}</li><li>more</li></ul><form><p>Mail</p><input><button>Go</button></form>
<section class="comments"><h2>Comments</h2><p>Nice {0}</p></section><footer>By me</footer></article>
<div class="comment">I say {0}</div><!-- <p>hidden</p> --><footer>&copy; all</footer></body></html>"""


def test_article(spark):
    want = "Title {0}\nFirst bold & café {0} next\nSecond line {0}\nitem {0}\nmore"
    assert text_of(spark, *(FULL.format(i) for i in "abcd")) == [want.format(i) for i in "abcd"]


@pytest.mark.parametrize("start, end", [
    ('<section id="side-effects">', "</section>"), ('<section id="discussion">', "</section>"), ('<h2 id="search-methods">', "</h2>"),
    ('<div class="full-side notice-period">', "</div>"), ('<h3 class="comments">', "</h3>"),
])
def test_names_of_topics_are_no_marks(spark, start, end):
    assert text_of(spark, *(f"<article><p>a{i}</p>{start}b{i}{end}</article>" for i in range(4))) == [f"a{i}\nb{i}" for i in range(4)]


@pytest.mark.parametrize("start", ['<div class="layout with-sidebar">', '<div class="sidebar">', '<div id="sidebar-right">', '<section class="comments">'])
def test_marked_box_around_an_article(spark, start):
    assert text_of(spark, *(f"{start}x{i}<article>a{i}</article></div>" for i in range(4))) == [f"a{i}" for i in range(4)]
    pages = (f"<main>m{i}<div class='comments-area'><article class='comment'>c{i}</article></div></main>{start.replace('layout with-', '')}<article>a{i}</article></div>" for i in range(4))
    assert [t.split("\n")[0] for t in text_of(spark, *pages)] == [f"m{i}" for i in range(4)]


def test_marks_and_hiding_still_count(spark):
    boxes = '<div class="ad-box">no</div><div class="left-sidebar">no</div><div hidden><article>no</article></div><aside><article>no</article></aside>'
    assert text_of(spark, *(f"<article>a{i}{boxes}</article>" for i in range(4))) == [f"a{i}" for i in range(4)]


def test_without_article_element_texts_that_vary_count(spark):
    page = "<body><div>Welcome to the site</div><div class=post><h2>Head {0}</h2><p>Words {0}</p></div><p><a href=x>All posts {0}</a></p></body>"
    assert text_of(spark, *(page.format(i) for i in range(4))) == [f"Head {i}\nWords {i}" for i in range(4)]


def test_copies_of_a_page_make_no_template(spark):
    page = "<body><h1>Title</h1><p>Only text</p><ul><li>same<li>same<li>same</ul></body>"
    want = "Title\nOnly text\nsame\nsame\nsame"
    for n in (1, 2, 3, 5):
        assert text_of(spark, *[page] * n) == [want] * n
    assert text_of(spark, *[page] * 3, *[page.replace("Only", "Other")] * 3) == [want] * 3 + [want.replace("Only", "Other")] * 3
    pages = [page.replace("Only", x) for x in ("a", "b", "c", "c")]
    assert text_of(spark, *pages) == [f"{x} text" for x in ("a", "b", "c", "c")]


def test_repeated_and_optional_groups(spark):
    pages = ["<main>" + "".join(f"<h2>h{i}{k}</h2><p>p{i}{k}</p>" for k in range(i)) + ("<blockquote>q</blockquote>" if i % 2 else "") + "</main>" for i in range(1, 6)]
    want = ["\n".join([x for k in range(i) for x in (f"h{i}{k}", f"p{i}{k}")] + ["q"] * (i % 2)) for i in range(1, 6)]
    assert text_of(spark, *pages) == want


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "</p></div>", "<!-- open", "<script>x", "<article></article>", "<nav>menu</nav>"])
def test_nothing_to_extract(spark, page):
    assert text_of(spark, page) in ([""], ["<"])


def test_odd_pages(spark):
    assert text_of(spark, "<article><p>cut off &am") == ["cut off &am"]
    assert text_of(spark, "plain 1 < 2 text") == ["plain 1 < 2 text"]
    assert text_of(spark, "<article><p>a" + " word" * 50_000 + "</article>")[0].count(" ") == 50_000
    assert text_of(spark, "<article>" + "<div>" * 200 + "deep" + "</div>" * 200 + "</article>") == ["deep"]
    assert text_of(spark, "<article><p title='a > b'>x</p></article>", url="no host {}") == ["x"]


def test_empty_table(spark):
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_wrapper_is_a_union_free_expression():
    one, two = (wrappers.skeleton(wrappers.parse(p)) for p in ("<ul><li>a<li>b<li>c</ul><p>x", "<h1>t</h1><ul><li>a</ul>"))
    both = wrappers.aligned(one[2], two[2])
    assert [(k[0], k[1]) for k in both] == [("h1", "?"), ("ul", ""), ("p", "?")]
    assert both[1][2][0][:2] == ["li", "+"]


def test_divs_that_differ_in_what_they_hold_keep_their_place(spark):
    page = "<article><div><h2>A{0}</h2></div><p>one{0}</p><div><h2>B{0}</h2></div><p>two{0}</p><ul><li>x{0}</li></ul><div><blockquote>z{0}</blockquote></div></article>"
    want = "A{0}\none{0}\nB{0}\ntwo{0}\nx{0}\nz{0}"
    for tag in ("div", "section"):
        pages = [page.format(i).replace("<div", f"<{tag}").replace("</div", f"</{tag}") for i in range(4)]
        assert text_of(spark, *pages) == [want.format(i) for i in range(4)]


def _texts(node):
    for kid in node.kids:
        if isinstance(kid, list):
            yield kid[1]
        else:
            yield from _texts(kid)


def test_every_text_of_a_page_comes_back():
    import random

    rng = random.Random(8)

    def block(depth):
        tag = rng.choice(["div", "section", "p", "ul", "blockquote", "h2"] if depth else ["p", "h2", "li"])
        inner = "".join(block(depth - 1) if rng.random() < 0.6 else f"t{rng.randrange(10**9)} " for _ in range(rng.randint(1, 4))) if depth else f"t{rng.randrange(10**9)}"
        return f"<{tag}>{inner}</{tag}>"

    trees = [wrappers.parse("<article>" + "".join(block(3) for _ in range(rng.randint(1, 4))) + "</article>") for _ in range(60)]
    whole = None
    for tree in trees[:40]:  # the others were not seen when the wrapper was made
        one = wrappers.skeleton(tree)
        whole = one if whole is None else wrappers._merge(whole, one)
    for tree in trees:
        for wrapper in (whole, wrappers.skeleton(tree), None):
            assert [t for _, t, _ in wrappers.located(tree, wrapper)] == list(_texts(tree))
        own = wrappers.skeleton(tree)
        assert all(slot is not None for slot, _, _ in wrappers.located(tree, own))
