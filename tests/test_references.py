"""Character references without a semicolon: what the SQL of the page queries says is what the parser does."""

import duckdb
import pytest

from rowloom import plans

HTML = '<html><head><title>x &amp;&amp</title></head><body><nav><ul><li><a href="/a">a &quot</a></li><li><a href="/b">b&lt;&gt</a></li></ul></nav><article><h1>y&ltb&gt;z &amp</h1><p>one</p></article></body></html>'


@pytest.mark.parametrize("name", ["page_titles", "nav_item_features", "paragraph_headings", "similar_heading", "edited_cells", "nav_relation", "renamed_columns"])
def test_text_of_pages(spark, tmp_path, name):
    spark.createDataFrame([(1, "http://a.test/", HTML)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = plans.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({plans.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr) and want
