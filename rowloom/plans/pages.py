"""Queries on stored pages: nodes, tables, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nodes, paging, predicates, relations, skip
from ..sources import read_pages
from .registry import query, table

NAV = relations.RelationSpec("nav", "/html[1]/body[1]/nav[1]/ul[1]/li[*]", {"item": "/a[1]"})


def _plain(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _text(x: str) -> str:
    """SQL of text between tags with its references decoded: there the oldest ones also count without a semicolon, as browsers and the parser have it."""
    x = f"replace({x}, '&#x27;', '''')"
    for a, b in (("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&amp", "&")):
        x = f"regexp_replace({x}, '{a};?', '{b}', 'g')"
    return x


@query(f"""
WITH m AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS host, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS links, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS texts FROM pages
), r AS (
  SELECT page_id, host, unnest(range(1, len(links) + 1)) AS i, links, texts FROM m
), c AS (
  SELECT page_id, i AS row_idx, trim({_text("texts[i]")}) AS item_text, host || regexp_replace({_plain("links[i]")}, '[#?]$', '') AS item_link FROM r
)
SELECT page_id, row_idx, item_text, item_link FROM c QUALIFY row_number() OVER (PARTITION BY page_id, item_text, item_link ORDER BY row_idx) = 1
""")
def nav_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The navigation table of every page, each item once a page."""
    rows = relations.extract_rows(nodes.page_layout(read_pages(spark, f"{sf_dir}/pages.parquet")), NAV)
    return skip.skip_this_run(rows, ["item_text", "item_link"], ["row_idx"], run="page_id")


@query(f"""SELECT page_id, trim(regexp_replace({_text("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '\\s+', ' ', 'g')) AS title FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1 P2."""
    found = nodes.page_layout(read_pages(spark, f"{sf_dir}/pages.parquet"))
    return predicates.find_by_xpath(found, "/html[1]/head[1]/title[1]").select("page_id", F.col("text").alias("title"))


@query("""
SELECT page_id, '/html[1]/body[1]/nav[1]/ul[1]' AS parent_xpath, 'li' AS tag, len(regexp_extract_all(html, '<li><a ')) AS n_rows FROM pages WHERE len(regexp_extract_all(html, '<li><a ')) >= 2
""")
def nav_tables_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all tables found on the pages, those whose rows are list items."""
    return relations.find_relations(nodes.page_layout(read_pages(spark, f"{sf_dir}/pages.parquet"))).where("tag = 'li'")


@query()
def find_relations_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated group of elements."""
    return relations.find_relations(nodes.page_layout(read_pages(spark, f"{sf_dir}/pages.parquet")))


@query("""
SELECT '/html[1]/body[1]/nav[1]/ul[1]/li[*]' AS selector, CAST(4 AS INTEGER) AS seq, CAST(sum(len(regexp_extract_all(html, '<li><a '))) AS BIGINT) AS n_rows FROM pages
""")
def best_row_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest table that a demonstrated navigation link generalises to."""
    found = nodes.page_layout(read_pages(spark, f"{sf_dir}/pages.parquet"))
    return relations.best_candidate(relations.infer_row_selector(found, ["/html[1]/body[1]/nav[1]/ul[1]/li[1]/a[1]"])).select("selector", "seq", "n_rows")


@query("""
WITH o AS (SELECT o_custkey AS page_id, o_orderkey, CASE WHEN o_orderpriority < '3' THEN o_orderpriority ELSE '' END AS priority, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE '' END AS status FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY o_orderkey) AS row_idx, count(*) OVER (PARTITION BY page_id) AS n FROM o)
SELECT page_id, row_idx, 'Order ' || o_orderkey AS name, 'http://shop.test/order/' || o_orderkey AS link, priority, status FROM n WHERE n >= 2
""")
def records_by_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a list on a page. Items have a priority or a status, both or none, and adverts of the same tag stand among them."""
    order = F.struct(F.col("o_orderkey").alias("k"), F.concat(
        F.lit('<li><a href="/order/'), F.col("o_orderkey"), F.lit('">Order '), F.col("o_orderkey"), F.lit("</a>"), F.when(F.col("o_orderpriority") < "3", F.concat(F.lit('<span class="priority">'), "o_orderpriority", F.lit("</span>"))).otherwise(""),
        F.when(F.col("o_orderstatus") == "F", F.lit("<b>done</b>")).otherwise(""), F.lit("</li>"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("<li><em>Advert</em><i>buy</i></li>")).otherwise(""),
    ).alias("li"))
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x.li), "").alias("items"))
    stored = lists.select("page_id", F.lit("http://shop.test/").alias("url"), F.concat(F.lit("<html><body><h1>Orders</h1><ul>"), "items", F.lit("</ul></body></html>")).alias("html"))
    rows = relations.find_records(stored).where(F.map_contains_key("text", "a"))
    cell = lambda what, c: F.coalesce(F.col(what)[c], F.lit(""))
    return rows.select("page_id", "row_idx", cell("text", "a").alias("name"), cell("link", "a").alias("link"), cell("text", "span.priority").alias("priority"), cell("text", "b").alias("status"))


@query()
def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4-N10."""
    found = nodes.parse_nodes(read_pages(spark, f"{sf_dir}/pages.parquet"), columns=list(nodes.COLUMNS))
    return nodes.text_features(found).withColumn("background", nodes.style_value(F.col("style"), "background-color"))


@query()
def similar_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On each page the node most like a recorded heading."""
    found = nodes.page_layout(read_pages(spark, f"{sf_dir}/pages.parquet"))
    return predicates.find_by_similarity(found, {"tag": "h1", "xpath": "/html[1]/body[1]/article[1]/h1[1]", "depth": 3}, {"link": None}).select("page_id", "node_id", "xpath", "text", "score")


_PARTS = "SELECT p_partkey AS id, p_brand AS page, split_part(p_name, ' ', 1) AS colour, split_part(p_name, ' ', 2) AS thing, p_type AS type, CAST(p_size AS VARCHAR) AS size FROM part"


@query(f"""
WITH p AS ({_PARTS}), v AS (SELECT id, unnest(['colour', 'thing', 'type', 'size']) AS k, unnest([colour, thing, type, size]) AS v FROM p),
w AS (SELECT k, v, ln(1 + (SELECT count(*) FROM p)::DOUBLE / count(*)) AS w FROM v GROUP BY k, v),
s AS (SELECT p.*, a.w AS wa, b.w AS wb, c.w AS wc, d.w AS wd FROM p JOIN w a ON a.k = 'colour' AND a.v = colour JOIN w b ON b.k = 'thing' AND b.v = thing JOIN w c ON c.k = 'type' AND c.v = type JOIN w d ON d.k = 'size' AND d.v = size),
m AS (SELECT n.page AS page_id, s.id AS snapshot_id, n.id AS node_id, round(CASE WHEN n.colour = s.colour THEN wa ELSE 0 END + CASE WHEN n.thing = s.thing THEN wb ELSE 0 END + CASE WHEN n.type = s.type THEN wc ELSE 0 END + CASE WHEN n.size = s.size THEN wd ELSE 0 END, 6) AS score FROM s JOIN p n ON n.thing = s.thing)
SELECT page_id, snapshot_id, node_id, score FROM m QUALIFY row_number() OVER (PARTITION BY page_id, snapshot_id ORDER BY score DESC, node_id) = 1
""")
def similar_to_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes, brands as pages, and every part as a snapshot whose thing is required: the likest node of each brand, however little it is like."""
    name = F.split("p_name", " ")
    cells = F.create_map(*[x for k, v in (("colour", name[0]), ("thing", name[1]), ("type", F.col("p_type")), ("size", F.col("p_size").cast("string"))) for x in (F.lit(k), v)])
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", cells.alias("props"))
    snapshots = parts.select(F.col("p_partkey").alias("snapshot_id"), "props", F.array(F.lit("thing")).alias("required"))
    found = predicates.find_snapshots(parts.select(F.col("p_brand").alias("page_id"), F.col("p_partkey").alias("node_id"), "props"), snapshots, least=0.0, digits=6)
    return found.select("page_id", "snapshot_id", "node_id", F.round("score", 6).alias("score"))


@query("""
SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page_arg, regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) AS utm_source FROM pages
""")
def url_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty without the argument."""
    arg = lambda n: F.coalesce(paging.url_argument(F.col("url"), n), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", arg("page").alias("page_arg"), arg("utm_source").alias("utm_source"))


_W = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')"


@query(f"""
SELECT doc_id, array_to_string({_W}[1:1], ' ') AS first_word, array_to_string({_W}[1:3], ' ') AS first_three, coalesce({_W}[-1], '') AS last_word,
  CASE WHEN contains(text, ':') THEN split_part(text, ':', 1) END AS pre_colon, CAST(length(text) AS INTEGER) AS n
FROM documents
""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4 N5 F2."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", nodes.first_words(t, 1).alias("first_word"), nodes.first_words(t, 3).alias("first_three"), nodes.last_word(t).alias("last_word"), nodes.pre_colon_text(t).alias("pre_colon"), F.length(t).alias("n"))


@query("""
SELECT doc_id, CASE WHEN text IS NULL THEN 'null' WHEN text = '' THEN 'EMPTY' WHEN length(text) > 200 THEN left(text, 50) || '...' || right(text, 50) ELSE text END AS shown,
  coalesce(contains(text, 'the'), false) AS has_the, coalesce(text, '') = 'Les.' AS is_les
FROM documents
""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 P8."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", predicates.display_value(t).alias("shown"), predicates.text_contains(t, "the").alias("has_the"), predicates.text_is(t, "Les.").alias("is_les"))


@query("""
WITH p AS (SELECT DISTINCT user_id, event_type AS prop FROM events UNION SELECT DISTINCT user_id, unnest(['id', 'textContent', 'childTag', 'lastChildText', 'odd']) FROM events),
s AS (SELECT *, CASE WHEN prop = 'error' THEN 20 WHEN prop = 'textContent' THEN 12 WHEN prop = 'id' THEN 9 WHEN prop LIKE 'child%' THEN 6 WHEN prop LIKE 'lastChild%' THEN 5 ELSE 0 END AS score FROM p)
SELECT user_id, prop, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, prop) AS INTEGER) AS rank FROM s
""")
def ranked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7."""
    events = table(spark, sf_dir, "events")
    named = F.explode(F.array(*map(F.lit, ("id", "textContent", "childTag", "lastChildText", "odd"))))
    props = events.select("user_id", F.col("event_type").alias("prop")).union(events.select("user_id").distinct().select("user_id", named)).distinct()
    return predicates.rank_features(props.withColumn("chosen", F.col("prop") == "error"), ["user_id"]).drop("chosen")


@query("""
WITH u AS (SELECT user_id, event_type, dayname(ts) AS suggested, count(*) AS uses FROM events GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY uses DESC, suggested) AS k FROM u)
SELECT user_id AS site, event_type AS row_selector, suggested FROM b WHERE k = 1
""")
def suggested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user and kind of event as a table, named by the weekday most used."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.col("event_type").alias("row_selector"), F.date_format("ts", "EEEE").alias("name"))
    return relations.suggest_names(events.select("site", "row_selector").distinct(), events)


@query("""
SELECT CAST(ts AS DATE) AS day, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 100
""")
def run_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows of each day's run."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return relations.output_preview(rows, "day", ["ts", "event_id"]).select("day", "event_id", "user_id")
