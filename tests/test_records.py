"""Tables by structure: rows that lack parts, have extra ones, or stand among others."""

from rowloom.operators import nodes, relations


def rows(spark, html, **how):
    df = spark.createDataFrame([(1, "http://a.test/", html)], "page_id long, url string, html string")
    return relations.find_records(nodes.page_layout(df), **how).orderBy("table_no", "row_idx").collect()


def test_optional_and_extra_cells(spark):
    html = "<ul><li><a href='/1'>One</a><b class=p>1</b><li><a href='/2'>Two</a><li><i>ad</i><em>x</em><li><a href='/3'>Three</a><i>new</i><b class=p>3</b><b>extra</b><li><i>ad</i></ul>"
    found = [r for r in rows(spark, html) if r.parent_xpath == "/ul[1]"]
    table = [r for r in found if "a" in r.text]
    assert [(r.row_idx, r.text["a"], r.link["a"], r.text["b.p"], r.text["i"], r.text["b"], r.n_missing) for r in table] == [
        (1, "One", "http://a.test/1", "1", "", "", 2), (2, "Two", "http://a.test/2", "", "", "", 3), (3, "Three", "http://a.test/3", "3", "new", "extra", 0),
    ]
    assert [r.row_xpath for r in table] == ["/ul[1]/li[1]", "/ul[1]/li[2]", "/ul[1]/li[4]"]
    ads = [r for r in found if "a" not in r.text]
    assert [(r.text["i"], r.text["em"]) for r in ads] == [("ad", "x"), ("ad", "")]


def test_two_tables_below_one_element(spark):
    html = "<div>" + "".join(f"<p><b>n{k}</b><i>v{k}</i></p><p><u>t{k}</u></p>" for k in range(4)) + "<p><b>n4</b></p></div>"
    found = rows(spark, html)
    by = {}
    for r in found:
        by.setdefault(r.table_no, []).append(dict(r.text))
    assert sorted(map(len, by.values())) == [4, 5]
    assert [r for t in by.values() if len(t) == 5 for r in t] == [{"b": f"n{k}", "i": f"v{k}" if k < 4 else ""} for k in range(5)]


def test_nested_parts_and_repeats(spark):
    html = "<ol><li><p><a href=x>A</a> own</p><s>1</s><s>2</s><li><p><a href=y>B</a></p><s>3</s></ol>"
    a, b = (dict(r.text) for r in rows(spark, html) if r.parent_xpath == "/ol[1]")
    assert a == {"p": "own", "p/a": "A", "s": "1", "s[2]": "2"} and b == {"p": "", "p/a": "B", "s": "3", "s[2]": ""}


def test_plain_rows_and_no_rows(spark):
    assert [dict(r.text) for r in rows(spark, "<ul><li>a<li>b<li><b>c</b></ul>")] == [{"": "a"}, {"": "b"}]
    assert rows(spark, "") == [] and rows(spark, None) == [] and rows(spark, "<p>one") == []
    assert len(rows(spark, "<ul><li>a<li>b</ul>", least=3)) == 0


def test_records_of_stored_pages(spark):
    """Parsed and searched in one step, pages give the rows that their layouts give."""
    html = '<ul><li><a href="/1">One</a><b>x</b></li><li><em>Advert</em></li><li><a href="/2">Two</a></li></ul>'
    df = spark.createDataFrame([(1, "http://a.test/", html), (2, None, None), (3, "http://a.test/", html * 2)], "page_id long, url string, html string")
    rows = [sorted(map(repr, relations.find_records(x).collect())) for x in (df, nodes.page_layout(df))]
    assert rows[0] == rows[1] and len(rows[0]) == 6
