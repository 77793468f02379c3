"""Queries on what programs keep and edit: uploads, runs, selections, edits of tables, schedules; features of nodes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import cells
from ..operators import commits, nesting, nodes, paging, predicates, relations, runs, schedules, skip
from ..operators.base import number_rows, shared_folder
from .pages import NAV, _plain, _text
from .registry import query, table


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.page_layout(sources.read_pages(spark, f"{sf_dir}/pages.parquet"))


@query("SELECT CAST(doc_id AS VARCHAR) AS c0, coalesce(text, '') AS c1, coalesce(lang, '') AS c2 FROM documents")
def uploaded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV and uploaded."""
    path = _new_folder(spark)
    sources.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return sources.read_uploaded_table(spark, path)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def replaced_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: customers' names replace what was there."""
    path, customers = _new_folder(spark), table(spark, sf_dir, "customer")
    sources.replace_relation(customers.select("c_custkey", "c_mktsegment"), path)
    sources.replace_relation(customers.select("c_custkey", "c_name", "c_nationkey"), path)
    return spark.read.parquet(path)


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the dataset of three programs, the first half of the month their first run, which is written twice."""
    path, events = _new_folder(spark), table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    half = F.lit("2024-01-16").cast("timestamp")
    for program, kinds in ((1, ["click", "view"]), (2, ["purchase"])):
        for run, part in ((1, events.where(F.col("ts") < half)), (2, events.where(F.col("ts") >= half)), (1, events.where(F.col("ts") < half))):
            sources.append_run(part.where(F.col("event_type").isin(kinds)), path, program, run)
    sources.append_run(events.where(~F.col("event_type").isin("click", "view", "purchase")), path, 3, 1)
    return spark.read.parquet(path)


@query("SELECT event_id, user_id, event_type, CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END END AS run FROM events WHERE event_type IN ('click', 'view')")
def all_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows ever of a program."""
    return sources.dataset_all_runs(_dataset(spark, sf_dir), 1).select("event_id", "user_id", "event_type", F.col("run_id").cast("int").alias("run"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'view', 'purchase') AND ts >= TIMESTAMP '2024-01-16'")
def this_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run."""
    return sources.dataset_this_run(_dataset(spark, sf_dir), 2).select("event_id", "user_id", "event_type")


@query("""
SELECT event_id, user_id, event_type FROM events e WHERE ts >= TIMESTAMP '2024-01-10'
  AND NOT EXISTS (SELECT 1 FROM events h WHERE h.ts < TIMESTAMP '2024-01-10' AND h.user_id = e.user_id AND h.event_type = e.event_type)
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
""")
def resumed_after_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run commits what it kept, twice; a run that was not completed commits too, but does not count; the next one goes on."""
    path, events = _new_folder(spark), table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    keys, order, day = ["user_id", "event_type"], ["ts", "event_id"], F.lit("2024-01-10").cast("timestamp")
    kept = skip.skip_ever(events.where(F.col("ts") < day), None, keys, order)
    for run, rows in ((1, kept), (2, events.where(F.col("ts") >= day)), (1, kept)):
        skip.commit(rows, keys, path, 7, run)
    done = spark.createDataFrame([(7, 1, True, True), (7, 2, True, False)], "program_id long, run_id long, has_skip boolean, complete boolean")
    seen = skip.history(spark.read.parquet(path), done, 7)
    return runs.resume(events.where(F.col("ts") >= day), seen, keys, order).select("event_id", "user_id", "event_type")


@query("""
SELECT event_id, user_id, event_type, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 1 ELSE 2 END AS run_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
""")
def committed_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output and keys of two runs, each of which breaks off once before it is published and is done again; one is published twice."""
    path, events = _new_folder(spark), table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    keys, order, day = ["user_id", "event_type"], ["ts", "event_id"], F.lit("2024-01-10").cast("timestamp")
    schema = "user_id string, event_type string, ts timestamp"
    for run, rows in ((1, events.where(F.col("ts") < day)), (2, events.where(F.col("ts") >= day))):
        for published in (False, True, run == 2):
            seen = commits.committed_keys(spark, path, 7, schema).where(F.col("run_id") != run)
            attempt = commits.write_attempt(skip.skip_ever(rows, seen, keys, order), keys, path, 7, run)
            if published:
                commits.publish(spark, path, 7, run, attempt)
    return commits.committed_rows(spark, path, 7).select("event_id", "user_id", "event_type", F.col("run_id").cast("int").alias("run_id"))


@query("SELECT event_id, user_id, event_type FROM events")
def skip_never(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1."""
    return skip.skip_never(table(spark, sf_dir, "events")).select("event_id", "user_id", "event_type")


@query("SELECT page_id, url, contains(url, 'page=') AS paged FROM pages WHERE coalesce(contains(url, '/fr/') OR contains(url, '/de/'), false)")
def linked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by what their link contains."""
    url = F.col("url")
    found = predicates.where(table(spark, sf_dir, "pages"), predicates.link_contains(url, "/fr/") | predicates.link_contains(url, "/de/"))
    return found.select("page_id", "url", predicates.link_contains(url, "page=").alias("paged"))


_NAV = f"""
m AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS host, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS links, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS texts FROM pages),
r AS (SELECT page_id, host, unnest(range(1, len(links) + 1)) AS i, links, texts FROM m),
c AS (SELECT page_id, i, trim({_text("texts[i]")}) AS item_text, host || regexp_replace({_plain("links[i]")}, '[#?]$', '') AS item_link FROM r)
"""


@query(f"WITH {_NAV} SELECT page_id, i - 1 AS row_idx, item_text, item_link FROM c WHERE i > 1")
def nav_without_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row is a heading."""
    spec = relations.RelationSpec(NAV.name, NAV.row_selector, NAV.columns, exclude_first=1)
    return relations.extract_rows(_layout(spark, sf_dir), spec)


@query(f"WITH {_NAV} SELECT 'nav' AS relation, page_id, i AS row_idx, item_text AS text FROM c UNION ALL SELECT 'rows', page_id, i, item_text FROM c")
def two_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of the same pages: the links, and their rows as a whole."""
    found = relations.extract_relations(_layout(spark, sf_dir), [NAV, relations.RelationSpec("rows", NAV.row_selector, {"item": ""})])
    return found["nav"].select(F.lit("nav").alias("relation"), "page_id", "row_idx", F.col("item_text").alias("text")).unionByName(found["rows"].select(F.lit("rows").alias("relation"), "page_id", "row_idx", F.col("item_text").alias("text")))


@query(f"WITH {_NAV} SELECT page_id, i AS row_idx, item_text AS relation_1_item_1_text, item_link AS relation_1_item_1_link FROM c")
def renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default names for the columns of a table."""
    rows = relations.extract_rows(_layout(spark, sf_dir), NAV)
    return relations.rename(rows, dict(zip(NAV.columns, relations.default_names(1, len(NAV.columns)), strict=True)))


@query(f"""
WITH {_NAV}
SELECT page_id, '/html[1]/body[1]/nav[1]/ul[1]/li[' || i || ']/a[1]' AS xpath, item_text AS text FROM c WHERE i > 1
UNION ALL SELECT page_id, '/html[1]/head[1]/title[1]', trim(regexp_replace({_text("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '\\s+', ' ', 'g')) FROM pages
""")
def edited_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column of navigation links without each page's first one, with its title."""
    found = _layout(spark, sf_dir)
    links = nodes.select_nodes(found, lambda n: (n["tag"] == "a") & (n["depth"] == 5)).where(F.col("xpath").rlike(r"^/html\[1\]/body\[1\]/nav\[1\]/ul\[1\]/li\[\d+\]/a\[1\]$"))
    first = predicates.find_by_xpath(found, "/html[1]/body[1]/nav[1]/ul[1]/li[1]/a[1]")
    return relations.edit_cells(links, add=predicates.find_by_xpath(found, "/html[1]/head[1]/title[1]"), remove=first).select("page_id", "xpath", "text")


@query("(SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer ORDER BY customer.c_custkey LIMIT 3) UNION ALL SELECT '...', '...' WHERE (SELECT count(*) FROM customer) > 3")
def table_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6."""
    return relations.preview(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"])


@query("""
WITH k AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z0-9+.-]+://[^/?#]*')) AS head, regexp_replace(url, '^[A-Za-z0-9+.-]+://[^/?#]*', '') AS rest FROM pages),
n AS (SELECT page_id, url, head || regexp_replace(regexp_replace(rest, '#.*$', ''), '/(\\?|$)', '\\1') AS u FROM k)
SELECT a.url AS c0, b.page_id FROM n a JOIN n b USING (u)
""")
def driven_by_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uploaded list of URLs drives the loop over pages."""
    pages, path = sources.read_pages(spark, f"{sf_dir}/pages.parquet"), _new_folder(spark)
    sources.write_csv(pages.select("url"), path)
    urls = sources.read_uploaded_table(spark, path)
    first = urls.agg(F.min("c0")).first()[0]
    return nesting.drive_by_uploaded_table(urls, pages, "c0", first, ["c0"]).select("c0", "page_id")


@query("SELECT page_id, url FROM pages")
def listed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a list of URLs, which names each twice and others too."""
    pages = sources.read_pages(spark, f"{sf_dir}/pages.parquet")
    urls = pages.select("url").union(pages.select("url")).union(pages.select(F.concat("url", F.lit("/other"))))
    return paging.pages_from_url_list(urls, pages).select("page_id", "url")


@query("SELECT c_custkey, o_orderkey, row_number() OVER (ORDER BY c_custkey, o_orderkey) AS row_idx FROM customer JOIN orders ON o_custkey = c_custkey")
def rows_in_loop_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their orders, numbered in the order of the loops."""
    customers = nesting.add_position(table(spark, sf_dir, "customer"), "c_custkey")
    rows = nesting.add_position(nesting.nested_loop(customers, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", as_url=False), "o_orderkey")
    return number_rows(nesting.row_order(rows.select("c_custkey", "o_orderkey", "pos")), ["pos"]).select("c_custkey", "o_orderkey", "row_idx")


@query("SELECT o_orderpriority AS schedule, o_custkey AS prog_id FROM orders UNION ALL SELECT c_mktsegment, c_custkey FROM customer")
def added_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: orders as schedules of priorities; segments are added."""
    now = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("schedule"), F.col("o_custkey").alias("prog_id"))
    return schedules.add_scheduled_run(now, table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("schedule"), F.col("c_custkey").alias("prog_id")))


@query("""
SELECT o_orderpriority AS schedule, o_custkey AS prog_id FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM orders g WHERE g.o_orderstatus = 'F' AND g.o_orderpriority = o.o_orderpriority AND g.o_custkey = o.o_custkey)
""")
def removed_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: without the schedules of finished orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("schedule"), F.col("o_custkey").alias("prog_id"), "o_orderstatus")
    return schedules.remove_scheduled_run(orders.drop("o_orderstatus"), orders.where("o_orderstatus = 'F'"))


@query("""
SELECT event_id, round(value * pi(), 6) AS pi_value, round(value * exp(1), 6) AS e_value, round(value * (1 + sqrt(5)) / 2, 6) AS golden, round(value * sqrt(2), 6) AS root2, round(value * sqrt(0.5), 6) AS half_root, value < 'Infinity'::DOUBLE AS finite FROM events
""")
def cell_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13."""
    by = lambda x: F.round(F.col("value") * x, 6)
    return table(spark, sf_dir, "events").select("event_id", by(cells.PI).alias("pi_value"), by(cells.E).alias("e_value"), by(cells.GOLDEN_RATIO).alias("golden"), by(cells.SQRT2).alias("root2"), by(cells.SQRT1_2).alias("half_root"), (F.col("value") < cells.INFINITY).alias("finite"))


@query(f"""
WITH {_NAV}, t AS (SELECT page_id, trim(regexp_replace({_text("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '\\s+', ' ', 'g')) AS title FROM pages)
SELECT page_id, i AS sib_index, item_text AS text, lag(item_text) OVER (PARTITION BY page_id ORDER BY i) AS previous,
  coalesce(lag(nullif(item_text, '') IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i), nullif(title, '')) AS preceding, CAST(NULL AS VARCHAR) AS heading,
  'a' AS child_tag, item_text AS child_text, 'a' AS last_child_tag, item_text AS last_child_text
FROM c JOIN t USING (page_id)
""")
def nav_item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each navigation item: the item before, the text before, no heading yet, its children."""
    items = nodes.select_nodes(_layout(spark, sf_dir), lambda n: (n["tag"] == "li") & (n["depth"] == 4), list(nodes.COLUMNS)).where(F.col("xpath").rlike(r"^/html\[1\]/body\[1\]/nav\[1\]/ul\[1\]/li\[\d+\]$"))
    names = {"previousElementSiblingText": "previous", "precedingText": "preceding", "possibleHeading": "heading", "childTag": "child_tag", "childText": "child_text", "lastChildTag": "last_child_tag", "lastChildText": "last_child_text"}
    return items.select("page_id", F.col("sib_index").cast("long").alias("sib_index"), "text", *[F.col(a).alias(b) for a, b in names.items()])


_H1 = f"trim(regexp_replace({_text("regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_H1} AS heading, CAST(len(regexp_extract_all(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'), '<p[ >]')) AS BIGINT) AS n_paragraphs FROM pages WHERE regexp_matches(html, '<p[ >]')")
def paragraph_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs by the heading before them."""
    found = nodes.select_nodes(_layout(spark, sf_dir), lambda n: n["tag"] == "p", ["possibleHeading"])
    return found.groupBy("page_id", F.col("possibleHeading").alias("heading")).agg(F.count("*").alias("n_paragraphs"))


@query(f"SELECT page_id, {_H1} AS text, 3 AS score FROM pages WHERE regexp_matches(html, '<h1>')")
def similar_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the nodes outside links, on each page the one most like a recorded heading."""
    snapshot = {"tag": "h1", "sib_index": 1, "depth": 3}
    return predicates.find_by_similarity(_layout(spark, sf_dir), snapshot, {"link": None}).select("page_id", "text", "score")


@query("""
WITH s AS (SELECT doc_id, 'width: 10px; background-color: ' || coalesce(source, '') || '; color:' || coalesce(lang, '') AS style FROM documents)
SELECT doc_id, nullif(trim(regexp_extract(style, 'background-color: ([^;]*)', 1)), '') AS background, nullif(trim(regexp_extract(style, '; color:([^;]*)', 1)), '') AS color, CAST(NULL AS VARCHAR) AS image FROM s
""")
def style_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of inline styles."""
    style = F.concat(F.lit("width: 10px; background-color: "), F.coalesce("source", F.lit("")), F.lit("; color:"), F.coalesce("lang", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", nodes.style_value(style, "background-color").alias("background"), nodes.style_value(style, "color").alias("color"), nodes.style_value(style, "background-image").alias("image"))
