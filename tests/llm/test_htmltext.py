import itertools
import random

from heliogrid.llm import htmltext
from tests.llm import common

RULE = htmltext.HtmlRule()
PAGES = "page_id long, url string, html string, text int, feature string, side int, n string"


def pages(spark, bodies):
    return spark.createDataFrame([(i, f"http://h/{i}", b, 1, "x", 2, "y") for i, b in enumerate(bodies)], PAGES)


def site(i, article, wrap="article"):
    open_, close = {"article": ("<article>", "</article>"), "main": ("<main id=m>", "</main>"), "div": ('<div class="post-content">', "</div>")}[wrap]
    return (
        f"<!doctype html><html lang=en><head><title>Title {i}</title><style>p{{x:1}}</style><script>if (a < b) write('<p>no</p>')</script></head>"
        f"<body class='home with-sidebar'><header><h1>Site</h1><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav></header>"
        f"<div id='cookie-notice'><p>We use cookies.</p></div><div class=\"ad\">Buy now.</div>{open_}{article}{close}"
        f"<aside><p>Related story that is long enough to look like text.</p></aside><form><label>Mail</label><input name=m><button>Go</button></form>"
        f"<section class='comments'><h2>Comments</h2><p>I liked this article a lot, it has many good sentences.</p></section>"
        f"<footer>&copy; Site &middot; <a href=/i>Imprint</a></footer></body></html>"
    )


ARTICLE = "<h1>Head &amp; line</h1><p>First   <b>bold</b>\n text&nbsp;here.<p>Second<br>line &lt;x&gt; &#233;&#x4e2d;<!-- no <p> --><ul><li>one<li>two</ul><p>1 < 2"
TEXT = "Head & line\nFirst bold text here.\nSecond line <x> é中\none\ntwo\n1 < 2"


def test_takes_the_article_only(spark):
    bodies = [site(i, ARTICLE, wrap) for i, wrap in enumerate(["article", "main", "div"])]
    for r in htmltext.extract(pages(spark, bodies), RULE).collect():
        assert r.text == TEXT and r.n_chars == len(TEXT) and r.url == f"http://h/{r.page_id}"


def test_trained_classifier_tells_pages_without_containers(spark):
    bodies = [site(i, "".join(f"<p>{common.prose(10 * i + j, 40)}.</p>" for j in range(4))) for i in range(60)]
    plain = "<html><body><div><a href=/a>Start</a> <a href=/b>News</a></div><div><a href=/c>More</a></div>" + "".join(
        f"<div><p>{common.prose(900 + j, 40)}.</p></div>" for j in range(4)
    ) + "<div><a href=/i>Imprint</a></div></body></html>"
    got = [r.text for r in htmltext.extract(pages(spark, [*bodies, plain]), RULE).orderBy("page_id").collect()]
    assert got[-1].split("\n") == [common.prose(900 + j, 40) + "." for j in range(4)]
    assert got[0].count("\n") == 3


def test_awkward_pages(spark):
    bodies = [None, "", "   ", "no tags at all", "<article>" * 300 + "deep" + "</article>" * 200, "<p", "<article><p class='x>unclosed quote", "</div></p>text",
              "<article><script>never closed", "<article>" + "<p>a b c. " * 20_000, "<article><p>\ud83d</article>".encode("utf-8", "replace").decode()]
    rows = pages(spark, bodies + [site(1, ARTICLE)] * 2).unionByName(spark.createDataFrame([(None, None, site(2, ARTICLE), None, None, None, None)], PAGES))
    got = htmltext.extract(rows, RULE).collect()
    by_id = {r.page_id: r.text for r in got}
    assert len(got) == 14 and by_id[0] == by_id[1] == by_id[2] == "" and by_id[4] == "deep" and by_id[9].count("a b c.") == 20_000
    assert by_id[11] == by_id[12] == by_id[None] == TEXT
    assert htmltext.extract(pages(spark, []), RULE).count() == 0


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 9)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        ties = [(a, b, rng.random() * 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(side):
            return sum(abs(o) for o, s in zip(odds, side) if s != (o > 0)) + sum(w for a, b, w in ties if side[a] != side[b])

        least = min(cost(side) for side in itertools.product([False, True], repeat=n))
        assert abs(cost(htmltext.label(odds, ties)) - least) < 1e-6
        assert abs(cost(htmltext.minimum_cut(odds, ties)) - least) < 1e-6


def test_ties_decide_open_blocks():
    assert htmltext.label([9.0, -0.5, 9.0], [(0, 1, 1.0), (1, 2, 1.0)]) == [True, True, True]
    assert htmltext.label([9.0, -0.5, -9.0], [(0, 1, 1.0), (1, 2, 1.0)]) == [True, False, False]


def test_classifier_and_cut_overrule_containers(spark):
    bodies = [site(i, "".join(f"<p>{common.prose(10 * i + j, 40)}.</p>" for j in range(4))) for i in range(60)]
    texts = [common.prose(900 + j, 40) + "." for j in range(4)]
    menu = "<div><a href=/a>Start</a> <a href=/b>News</a></div><div><a href=/c>More</a></div>"
    end = "<div><a href=/i>Imprint</a></div>"
    flow = "".join(f"<div><p>{x}</p></div>" for x in texts)
    inner = f"<div><p>{texts[0]}</p></div><div class=widget><p>{texts[1]}</p></div><div><p>{texts[2]}</p></div><div><p>{texts[3]}</p></div>"
    odd = [
        f"<html><body>{menu}<div class='post with-sidebar'>{flow}</div>{end}</body></html>",  # a layout's name
        f"<html><body><form id=aspnetForm>{menu}{flow}{end}</form></body></html>",  # a form around the whole page
        f"<html><body>{menu}<article>{inner}</article>{end}</body></html>",  # a part of the article with an odd name
        f"<html><body>{menu}<article>{flow}<p hidden>{texts[0]}</p></article>{end}</body></html>",
    ]
    got = [r.text.split("\n") for r in htmltext.extract(pages(spark, [*bodies, *odd]), RULE).orderBy("page_id").collect()]
    assert got[60:] == [texts] * 4
    assert all(len(x) == 4 for x in got[:60])


def test_prose_in_other_parts_stays_out(spark):
    """Text looks the same in the article and in what is around it, so the containers decide."""
    bodies = [site(i, "".join(f"<p>{common.prose(10 * i + j, 40)}.</p>" for j in range(4))) for i in range(60)]
    texts = [common.prose(900 + j, 40) + "." for j in range(4)]
    other = "".join(f"<p>{common.prose(950 + j, 40)}.</p>" for j in range(8))  # more than the article
    flow = "".join(f"<p>{x}</p>" for x in texts)
    parts = [
        ("<section class=comments>", "</section>"), ('<div class="sidebar">', "</div>"), ('<div class="cookie-notice">', "</div>"),
        ("<footer>", "</footer>"), ("<aside>", "</aside>"), ("<div class=ad>", "</div>"), ("<form action=/x>", "</form>"),
        ("<div id=comments><div class=comment>", "</div></div>"), ("<div class='comment-list'><article class=comment>", "</article></div>"),
        ("<div role=complementary>", "</div>"), ("<div class='x topNavigation'>", "</div>"), ("<header>", "</header>"),
    ]
    menu = "<div><a href=/a>Start</a> <a href=/b>News</a></div>"
    odd = [f"<html><body>{menu}<article>{flow}</article>{a}{other}{b}</body></html>" for a, b in parts]
    odd += [f"<html><body>{menu}<article>{flow}{a}{other}{b}</article></body></html>" for a, b in parts if a != "<header>"]
    odd += [f"<html><body>{menu}{a}{other}{b}<div class=story>{flow}</div></body></html>" for a, b in parts]
    got = [r.text.split("\n") for r in htmltext.extract(pages(spark, [*bodies, *odd]), RULE).orderBy("page_id").collect()]
    assert [g == texts for g in got[60:]] == [True] * len(odd)
    assert all(len(x) == 4 for x in got[:60])


def test_layouts_are_no_parts():
    """A name or form around nearly all text tells nothing, one beside an article does."""
    prose = "<p>" + "word " * 60 + "</p>"
    for inner, want in ((f"<form>{prose}</form>", False), (f"<form>{prose}</form>{prose}", True), (f"<div class=right-sidebar><div>{prose}</div><footer>x y</footer></div><p>a</p>", False),
                        (f"<form><div class=sidebar>{prose}</div>{prose}</form>", True), (f"<aside>{prose}</aside>", True), (f"<div class='post no-sidebar'>{prose}</div>", False)):
        page = htmltext.parse(f"<body>{inner}</body>")
        assert htmltext.outside(page, RULE)[page.blocks[0].node] is want


def test_containers_alone_stay_below_the_ties():
    page = htmltext.parse("<article>" * 30 + "<p>x</p>" + "</article>" * 30)
    odds = htmltext.log_odds(page, htmltext.Fitted([], 0.0, RULE.container), RULE)
    assert 0 < odds[0] <= 2 * (RULE.neighbour + RULE.sibling + RULE.sibling / 2)
