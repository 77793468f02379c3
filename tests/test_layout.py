"""Pages as Euler tours: the same rows as from rows of elements, and space in proportion to the page."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from rowloom.operators import nodes, predicates, relations

PARTS = ["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<br>", " ", "x", "y z", "\n", "&nbsp;", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<a href='q'>", "</a>", "<script>", "</script>", "<h2>", "</h2>", "<hr>", "é", "<!-- c -->"]


def pages(spark):
    rng = random.Random(4)
    rows = [(k, f"http://a.test/{k}/", "<html><body>" + "".join(rng.choices(PARTS, k=rng.randint(0, 60)))) for k in range(120)] + [(500, None, None), (501, "", ""), (502, "u", "no elements"), (None, "http://n/", "<p>x<p>y")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def counted(df):
    return Counter(tuple(r) for r in df.collect())



def test_rows_are_those_of_each_page(spark):
    df = pages(spark)
    want = Counter(r for p in df.collect() for r in nodes.page_nodes(*p))
    assert counted(nodes.parse_nodes(df)) == want
    some = nodes.parse_nodes(df, lambda n: n["tag"] == "p", ["xpath", "text"])
    assert counted(some) == Counter((r[0], r[1], r[11], r[13]) for r in want.elements() if r[7] == "p")


def test_tables_and_paths_from_a_layout(spark):
    df = pages(spark).where("page_id is not null")
    layout, rows = nodes.page_layout(df), nodes.parse_nodes(df)
    specs = [
        relations.RelationSpec("li", "/html[1]/body[1]/ul[1]/li[*]", {"a": "", "b": "/b[1]", "c": "/a[1]/b[1]"}), relations.RelationSpec("p", "/html[1]/body[1]/p[*]", {"a": "/b[1]"}),
        relations.RelationSpec("td", "/html[1]/body[1]/table[1]/tr[*]/td[1]", {"a": "", "b": "/p[1]"}), relations.RelationSpec("top", "/html[*]", {"a": "/body[1]"}), relations.RelationSpec("none", "/nav[1]/ul[*]", {"a": ""}),
    ]
    found = 0
    for spec in specs:
        got, want = counted(relations.extract_rows(layout, spec)), counted(relations.extract_rows(rows, spec))
        assert got == want
        found += len(want)
    assert found > 60
    assert counted(relations.find_relations(layout)) == counted(relations.find_relations(rows))
    for cells in (["/html[1]/body[1]/ul[1]/li[1]/b[1]", "/html[1]/body[1]/ul[1]/li[1]/a[1]"], ["/html[1]/body[1]/p[2]"], ["/nav[1]"]):
        assert counted(relations.infer_row_selector(layout, cells)) == counted(relations.infer_row_selector(rows, cells))
    path = "/html[1]/body[1]/p[1]"
    assert counted(predicates.find_by_xpath(layout, path)) == counted(predicates.find_by_xpath(rows, path))
    snapshot, required = {"tag": "b", "depth": 3, "text": "x"}, {"link": None}
    a, b = predicates.find_by_similarity(layout, snapshot, required), predicates.find_by_similarity(rows, snapshot, required)
    assert counted(a.select(*b.columns)) == counted(b)


def test_features_without_windows(spark):
    df = pages(spark).where("page_id is not null")
    names = ["precedingText", "possibleHeading", "previousElementSiblingText", "childTag", "childText", "lastChildTag", "lastChildText"]
    by_windows = nodes.child_features(nodes.context_features(nodes.parse_nodes(df)))
    own = nodes.parse_nodes(df, columns=list(nodes.COLUMNS))
    # the windows take the first top element for no sibling of the others; compare below the top
    pick = lambda d: counted(d.where("parent_id is not null").select("page_id", "node_id", *names))
    assert pick(own) == pick(by_windows)
    assert "Window" not in own._jdf.queryExecution().toString() and "Exchange" not in own._jdf.queryExecution().toString()


def test_deep_pages_take_linear_space(spark):
    """Twice the depth gives about twice the bytes and time, and a node below 20,000 others is found by its path."""
    size, took = {}, {}
    for depth in (5_000, 10_000, 20_000):
        html = "<div>" * depth + "word " * 10_000 + "<b>found</b>"
        began = time.time()
        text, paths, found = nodes.page_layout_of("http://a.test", html)
        took[depth] = time.time() - began
        size[depth] = len(text) + len(paths) + sum(len(str(n[k])) for n in found for k in ("parent", "last", "depth", "start", "end", "chain", "at", "up", "jumps"))
        assert max(n["jumps"] for n in found) <= 2 and len(found) == depth + 1
    assert size[20_000] - size[10_000] < 2.3 * (size[10_000] - size[5_000]) and size[20_000] < 2_000_000
    assert took[20_000] < 10
    page = spark.createDataFrame([(1, "http://a.test", html)], "page_id long, url string, html string")
    began = time.time()
    out = nodes.parse_nodes(page, lambda n: n["tag"] == "b", ["xpath", "text"]).first()
    assert out.text == "found" and out.xpath == "/div[1]" * 20_000 + "/b[1]" and time.time() - began < 30
    # bushy trees leave their chains seldom
    html = "".join("<ul>" + "<li><p>x" * 1 for _ in range(300)) + "<i>" * 5
    assert max(n["jumps"] for n in nodes.page_layout_of(None, html)[2]) <= 12


def test_page_without_tables(spark):
    empty = pages(spark).limit(0)
    layout = nodes.page_layout(empty)
    assert nodes.select_nodes(layout).count() == 0 and relations.find_relations(layout).count() == 0
    assert relations.extract_rows(layout, relations.RelationSpec("x", "/a[*]", {"c": ""})).count() == 0
    assert [r.n_rows for r in relations.infer_row_selector(layout, ["/html[1]/b[1]"]).collect()] == [0, 0]
    assert nodes.select_nodes(nodes.page_layout(pages(spark)), lambda n: F.lit(False)).count() == 0


def test_deep_cells_take_as_long_as_their_steps(spark):
    """Each step of a cell's path is looked up once: ten steps ran for 4^10 look-ups before."""
    rows = [(k, "u", "<div>" * 10 + "".join(f"<ul><li><b>{i}" for i in range(3))) for k in range(20)]
    layout = nodes.page_layout(spark.createDataFrame(rows, "page_id long, url string, html string"))
    began = time.time()
    found = relations.infer_row_selector(layout, ["/div[1]" * 10 + "/ul[1]/li[1]/b[1]"]).collect()
    assert {r.n_rows for r in found} == {20} and len(found) == 13 and time.time() - began < 60
