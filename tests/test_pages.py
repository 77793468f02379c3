"""Nodes, tables, nesting and paging on small pages."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowloom.operators import nesting, nodes, paging, predicates, relations

SHOWS = [(1, "Scandal", "Awesome!", "2012", "2018"), (2, "Buffy the Vampire Slayer", "Awesome!", "1996", "2003"), (3, "Angel", "Not So Awesome", "1999", "2004")]
CAST = {1: ["Olivia Pope", "Abby Whelan"], 2: ["Buffy Summers", "Willow Rosenberg"], 3: ["Angel", "Wesley Wyndam-Pryce"]}


def stored(spark):
    rows = "".join(f"<tr><td><a href='/cast?id={i}'>{n}</a><td>{r}<td>{a}<td>{b}" for i, n, r, a, b in SHOWS)
    pages = [(0, "http://tv.test/list", f"<html><body><h1>Shows</h1><table><tr><th>Name<th>Rating<th>Start<th>End{rows}</table></body></html>")]
    pages += [(i, f"http://tv.test/cast?id={i}", "<html><body><ul>" + "".join(f"<li>{c}" for c in cast) + "</ul>") for i, cast in CAST.items()]
    return spark.createDataFrame(pages, "page_id long, url string, html string")


SPEC = relations.RelationSpec("shows", "/html[1]/body[1]/table[1]/tr[*]", {"name": "/td[1]/a[1]", "rating": "/td[2]"}, exclude_first=0)


def test_nested_shows(spark):
    found = nodes.parse_nodes(stored(spark))
    shows = relations.extract_rows(found, SPEC)
    assert [(r.name_text, r.rating_text) for r in shows.orderBy("row_idx").collect()] == [(n, r) for _, n, r, _, _ in SHOWS]
    people = relations.extract_rows(found, relations.RelationSpec("cast", "/html[1]/body[1]/ul[1]/li[*]", {"person": ""}))
    people = people.join(stored(spark).select("page_id", "url"), "page_id").withColumnRenamed("row_idx", "person_idx")
    top = nesting.add_position(shows, "row_idx")
    rows = nesting.add_position(nesting.nested_loop(top, people, "name_link", "url"), "person_idx")
    want = [(n, c) for i, n, *_ in SHOWS for c in CAST[i]]
    assert [(r.name_text, r.person_text) for r in nesting.row_order(rows).collect()] == want
    assert nesting.unstored_links(shows, stored(spark).where("page_id <> 2"), "name_link", "url").count() == 1
    assert nesting.linked_pages(stored(spark), shows, "name_link", "url", linked=False).count() == 1


def test_row_selector(spark):
    found = nodes.parse_nodes(stored(spark))
    cells = ["/html[1]/body[1]/table[1]/tr[2]/td[1]/a[1]", "/html[1]/body[1]/table[1]/tr[2]/td[2]"]
    assert relations.best_candidate(relations.infer_row_selector(found, cells)).first().selector == SPEC.row_selector


def test_broken_html():
    assert nodes.page_nodes(1, None, None) == [] and nodes.page_nodes(1, None, "") == []
    rows = nodes.page_nodes(1, "http://a.test/x/", "<p>One<p>Two &amp; <b>three<br>four</b><ul><li>a<li>b</ul><script>var t='</p>';</script><!-- c --><a href='y'>L</a>")
    assert [r[7] for r in rows] == ["p", "p", "b", "br", "ul", "li", "li", "script", "a"]
    assert rows[1][13] == "Two & three\nfour" and rows[4][13] == "a\nb" and rows[8][14] == "http://a.test/x/y"


def test_features(spark):
    found = nodes.child_features(nodes.context_features(nodes.parse_nodes(stored(spark))))
    row = found.where("page_id = 0 and xpath = '/html[1]/body[1]/table[1]/tr[2]'").first()
    assert row.possibleHeading == "Shows" and row.childTag == "td" and row.previousElementSiblingText.startswith("Name")
    best = predicates.find_by_similarity(nodes.parse_nodes(stored(spark)), {"tag": "li", "text": "Angel"}, {"depth": 3})
    assert {r.page_id: r.text for r in best.collect()}[3] == "Angel"
    assert spark.range(1).select(nodes.style_value(F.lit("color: red; background-color: #fff"), "background-color")).first()[0] == "#fff"


def test_edit_and_preview(spark):
    cells = spark.createDataFrame([(0, "/a[1]"), (0, "/a[2]")], "page_id long, xpath string")
    out = relations.edit_cells(cells, spark.createDataFrame([(0, "/a[3]"), (0, "/a[2]")], cells.schema), spark.createDataFrame([(0, "/a[1]")], cells.schema))
    assert sorted(r.xpath for r in out.collect()) == ["/a[2]", "/a[3]"]
    assert relations.preview(spark.range(10).toDF("n"), ["n"]).count() == 4
    assert relations.preview(spark.range(3).toDF("n"), ["n"]).count() == 3


def test_paging(spark):
    rows = spark.createDataFrame([("r", p, i, f"{i}") for p, n in ((1, 2), (2, 3), (3, 3)) for i in range(1, n + 1)], "rel string, page_no int, row_idx long, v string")
    assert sorted(r.position for r in paging.stitch_next(rows, ["rel"]).collect()) == list(range(1, 9))
    assert sorted((r.position, r.page_no) for r in paging.stitch_cumulative(rows, ["rel"]).collect()) == [(1, 1), (2, 1), (3, 2)]
    waits = spark.createDataFrame([("3",), ("-1",), ("x",), ("9",), (None,)], "w string").select(paging.cap_wait(F.col("w"), 2.0).alias("ms"))
    assert [r.ms for r in waits.collect()] == [3000, 2000, 2000, 5000, 2000]


def test_uploaded_first_row(spark):
    table = spark.createDataFrame([(1, "http://tv.test/cast?id=1"), (2, "http://tv.test/cast?id=2/")], "n int, u string")
    assert nesting.drive_by_uploaded_table(table, stored(spark), "u", "http://tv.test/cast?id=1", ["n"]).count() == 2
    with pytest.raises(ValueError):
        nesting.drive_by_uploaded_table(table, stored(spark), "u", "other", ["n"])


def test_page_layout_holds_few_pages(spark):
    class Pages:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    html = "<ul>" + "<li><b>x</b></li>" * 99 + "</ul>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(["http://a.test/"] * 300), pa.array([html] * 300)], names=["page_id", "url", "html"])
    sizes = [b.num_rows for b in nodes.page_layout(Pages())(iter([batch]))]
    assert max(sizes) <= 11 and sum(sizes) == 300
