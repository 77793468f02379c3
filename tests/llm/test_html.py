"""Main text: the labelled pages' own article, and pages without one."""

import pytest

from rowloom.llm import html


def page(k: int, body: str) -> str:
    nav = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("home", "news", "about"))
    return f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body><nav><ul>{nav}</ul></nav><!-- ad --><div class=\"ad\">Buy these fine things today, all of them.</div>{body}<footer>&copy; site &middot; words that nobody reads at all</footer></body></html>"


def article(k: int) -> str:
    text = " ".join(f"word{k}x{j}" for j in range(30))
    return f"<article><h1>Head {k}</h1><p><b>{text} &amp; more.<br><p>Second  part\nof {k}.</p><aside>related stuff</aside><p>Last.</p></article>"


def expected(k: int) -> str:
    return f"Head {k}\n" + " ".join(f"word{k}x{j}" for j in range(30)) + f" & more.\nSecond part of {k}.\nLast."


def test_trained_extraction(spark):
    pages = spark.createDataFrame([(k, f"http://s/{k}", page(k, article(k))) for k in range(60)] + [(100, "u", None), (101, "u", ""), (102, "u", "<p>"), (103, "u", "<article><!-- no end"), (104, "u", "<script>x")], "page_id long, url string, html string")
    weights = html.train(pages)
    out = {r.page_id: r.text for r in html.main_text(pages, weights).collect()}
    assert all(out[k] == expected(k) for k in range(60))
    assert [out[k] for k in range(100, 105)] == [""] * 5
    plain = page(1, article(1).replace("article", "div"))
    assert expected(1).split("\n")[1] in html.extract(plain, weights)
    assert html.main_text(pages.limit(0), weights).count() == 0
    assert html.train(pages.limit(0)) == html.Weights() and html.train(pages.where("page_id >= 100")) == html.Weights()


def test_region_is_the_best_run():
    w = html.Weights(word=1.0, noise_word=-1.0, scale=1.0, tags={t: -5.0 for x in "xyz" for t in (x, f"/{x}")})
    found = html.tokens("<x>a b</x><y>c d e f g h i j k l</y><z>m</z>")
    best = max(((sum((len(v.split()) if k == "t" else w.tag(v)) for k, v, _ in found[i:j]), -i) for i in range(len(found)) for j in range(i + 1, len(found) + 1)))
    i, j = html.region(found, w)
    assert sum((len(v.split()) if k == "t" else w.tag(v)) for k, v, _ in found[i:j]) == best[0]


def test_long_broken_page():
    assert html.extract("<div>" * 20_000 + "text here" + "</p>" * 100, html.Weights()) == "text here"


WORDS = lambda p, n: " ".join(f"{p}{k}" for k in range(n))
INSIDE = {t: f"<{t}>mid</{t}>" for t in "a b em strong span i code sup h2 h3 blockquote pre div section figure x-own".split()} | {
    "ul": "<ul><li>mid</li></ul>", "ol": "<ol><li>mid</li></ol>", "table": "<table><tr><td>mid</td></tr></table>", "img": "<img src=x>", "hr": "<hr>", "aside": f"<aside>{WORDS('z', 20)}</aside>", "caption": "<figure><img src=x><figcaption>mid</figcaption></figure>",
}


@pytest.fixture(scope="module")
def weights(spark):
    """Learned from pages whose articles know only p, h1, br and b."""
    return html.train(spark.createDataFrame([(f"u{k}", page(k, article(k).replace("<aside>related stuff</aside>", ""))) for k in range(60)], "url string, html string"))


@pytest.mark.parametrize("tag", sorted(INSIDE))
def test_articles_stay_whole_around_any_tag(weights, tag):
    for a, b in ((60, 30), (30, 60), (5, 200), (200, 5)):
        for body in (f"<p>{WORDS('a', a)}</p>{INSIDE[tag]}<p>{WORDS('b', b)}</p>", f"<p>{WORDS('a', a)} {INSIDE[tag]} {WORDS('b', b)}</p>"):
            out = html.extract(page(1, f"<article><h1>Head</h1>{body}</article>"), weights).split()
            assert out[0] == "Head" and [w for w in out if w[0] in "ab"] == [*WORDS("a", a).split(), *WORDS("b", b).split()]
            assert ("mid" in out) == ("mid" in INSIDE[tag]) and not {"z0", "site", "Buy", "home"} & set(out)


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "social-science", "sidebar", "search", "nav", "wp-social"])
def test_wrappers_with_a_mark(weights, name):
    """Whatever an element around the article is called, the article stays, and only the article."""
    out = html.extract(page(1, f"<div class='{name}'><p>{WORDS('x', 3)}</p>{article(1).replace('<aside>related stuff</aside>', '')}</div>"), weights)
    assert out == expected(1)


@pytest.mark.parametrize("name", ["sidebar", "main-sidebar", "share-buttons", "comments", "comment-list", "site-footer", "ad-banner", "cookie-notice", "related-posts", "newsletter-signup"])
def test_marked_elements_go(weights, name):
    for body in (f"<div class='{name}'>{WORDS('n', 80)}</div>{article(1)}", f"{article(1)}<section id='{name}'><p>{WORDS('n', 80)}</p></section>"):
        assert html.extract(page(1, body), weights) == expected(1)
    assert html.extract(f"<div><p>{WORDS('a', 30)}</p></div><div class='{name}'>{WORDS('n', 90)}</div>", weights) == WORDS("a", 30)


def test_elements_that_are_never_closed(weights):
    text = WORDS("a", 30)
    assert html.extract(f"<p class=advert>Buy now<p>{text}", weights) == text
    assert html.extract(f"<article><p>{text}</p></article><footer>{WORDS('f', 50)}", weights) == text
    assert html.extract(f"<aside>{WORDS('f', 50)}<article><p>{text}</p></article>", weights) == text
    assert html.extract(f"<form action=x><p>{text}</p></form>", weights) == text
    assert html.extract(f"<header>{WORDS('s', 9)}</header><article><header><h1>Title</h1></header><p>{text}</p></article>", weights) == f"Title\n{text}"


def test_clashing_columns(spark, weights):
    df = spark.createDataFrame([(1, "<p>a b", "x", "y")], "page_id long, html string, Text string, n_chars string")
    out = html.main_text(df, weights)
    assert out.columns == ["page_id", "html", "n_chars", "text"] and out.first().text == "a b"
