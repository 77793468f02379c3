"""Queries on nested rows, skip rules, paging, delivery."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sources
from ..operators import nesting, paging, skip
from .registry import query, table

DAY = 86_400


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of daily runs: run_no counts days."""
    return table(spark, sf_dir, "events").withColumn("run_no", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")))


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS order_idx FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_idx FROM lineitem)
SELECT c_custkey, c_name, o_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(order_idx AS INTEGER) AS order_idx, CAST(line_idx AS INTEGER) AS line_idx,
  c_custkey || ',' || order_idx || ',' || line_idx AS pos
FROM customer JOIN o ON o_custkey = c_custkey JOIN l ON l_orderkey = o_orderkey
""")
def nested_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, their orders, their lines."""
    orders = nesting.positions(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "order_idx")
    lines = nesting.positions(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "line_idx")
    top = nesting.add_position(table(spark, sf_dir, "customer"), "c_custkey")
    second = nesting.add_position(nesting.nested_loop(top, orders, "c_custkey", "o_custkey", as_url=False), "order_idx")
    third = nesting.add_position(nesting.nested_loop(second, lines, "o_orderkey", "l_orderkey", as_url=False), "line_idx")
    return nesting.output_row(third, ["c_custkey", "c_name", "o_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "order_idx", "line_idx", F.array_join(F.col("pos").cast("array<string>"), ",").alias("pos")])


@query("""
SELECT o_orderkey, n_nationkey, n_name FROM orders JOIN nation ON n_nationkey = CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey % 25 END
""")
def nested_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 where a third of all parents and more link to one page."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.lit(0)).otherwise(F.col("o_custkey") % 25).cast("long").alias("nation"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return nesting.nested_loop(orders, nations, "nation", "n_nationkey", as_url=False, hub_share=0.1).select("o_orderkey", F.col("nation").alias("n_nationkey"), "n_name")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1
""")
def first_child_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    return nesting.drop_relation(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label row belongs to."""
    return nesting.unstored_links(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "doc_id", as_url=False).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9."""
    return nesting.linked_pages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "doc_id", as_url=False).select("doc_id", "source")


@query("SELECT c_custkey, c_name || ' birth year' AS search, 'test.com/search?q=' || replace(c_name, 'Customer', 'Person') AS url FROM customer")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 J6."""
    name = F.col("c_name")
    url = nesting.parameterize(F.lit("test.com/search?q=Jane"), "Jane", nesting.parameterize(name, "Customer", F.lit("Person")))
    return table(spark, sf_dir, "customer").select("c_custkey", nesting.build_query(name, " birth year").alias("search"), url.alias("url"))


@query("""
SELECT event_id, user_id, event_type FROM events e WHERE ts >= TIMESTAMP '2024-01-04'
  AND NOT EXISTS (SELECT 1 FROM events h WHERE h.ts < TIMESTAMP '2024-01-04' AND h.user_id = e.user_id AND h.event_type = e.event_type)
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
""")
def skip_ever(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: objects that the first three days did not have."""
    events = _events(spark, sf_dir)
    seen, new = (events.where(F.col("ts") < F.lit("2024-01-04").cast("timestamp")), events.where(F.col("ts") >= F.lit("2024-01-04").cast("timestamp")))
    return skip.skip_ever(new, seen, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""
WITH committed AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS run_no FROM events),
h AS (SELECT DISTINCT user_id, event_type FROM committed WHERE run_no < 15 AND run_no <> 7)
SELECT event_id, user_id, event_type FROM committed c WHERE run_no >= 15 AND NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = c.user_id AND h.event_type = c.event_type)
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
""")
def skip_ever_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against committed runs; the run that was not completed does not count."""
    events = _events(spark, sf_dir)
    old = events.where("run_no < 15").select("user_id", "event_type", "ts", F.lit(1).alias("program_id"), F.col("run_no").alias("run_id"))
    runs = old.select("program_id", "run_id").distinct().withColumns({"has_skip": F.lit(True), "complete": F.col("run_id") != 7})
    seen = skip.compact(skip.history(old, runs, 1), ["user_id", "event_type"])
    return skip.skip_ever(events.where("run_no >= 15"), seen, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""
SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id, event_type ORDER BY ts, event_id) = 1
""")
def skip_this_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: a run a day."""
    rows = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return skip.skip_this_run(rows, ["user_id", "event_type"], ["ts", "event_id"], run="day").select("event_id", "user_id", "event_type", "day")


def _greedy(at: str, limit: str, user: str = "user_id") -> str:
    """SQL of the greedy rule: from each kept position to the first one beyond the limit."""
    return f"""
WITH RECURSIVE e AS (SELECT event_id, {user} AS user_id, event_type, {at} AS t, ts FROM events),
k AS (
  SELECT user_id, event_type, min(t) AS t FROM e GROUP BY ALL
  UNION ALL
  SELECT k.user_id, k.event_type, min(e.t) FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.t > k.t + {limit} GROUP BY k.user_id, k.event_type, k.t
)
SELECT e.event_id, e.user_id, e.event_type FROM e JOIN k USING (user_id, event_type, t) QUALIFY row_number() OVER (PARTITION BY e.user_id, e.event_type, e.t ORDER BY e.ts, e.event_id) = 1
"""


WITHIN_SQL = _greedy("epoch_us(ts)", "10 * 86400000000")


@query(_greedy("date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))", "3"))
def skip_last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: committed in this run or the three before."""
    return skip.skip_last_runs(_events(spark, sf_dir), ["user_id", "event_type"], 3, ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query(WITHIN_SQL)
def skip_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: committed within ten days."""
    return skip.skip_within(_events(spark, sf_dir), ["user_id", "event_type"], 10 * DAY, ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query(f"SELECT event_id, event_type FROM ({_greedy('epoch_us(ts)', '5400000000', '0')})")
def skip_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 with few keys: a kind of event counts as seen for an hour and a half; each kind's events spread over several parts."""
    return skip.skip_within(table(spark, sf_dir, "events"), ["event_type"], 5400, ["ts", "event_id"], parts=16).select("event_id", "event_type")


@query("""
WITH g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events)
SELECT event_id, user_id, event_type FROM g WHERE gap IS NULL OR gap > 86400000000
""")
def skip_within_sighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, since the last sighting: within a day."""
    return skip.skip_within(_events(spark, sf_dir), ["user_id", "event_type"], DAY, ["ts", "event_id"], since="sighting").select("event_id", "user_id", "event_type")


@query("""
WITH p AS (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) = 1)
SELECT o_orderkey, o_custkey, c_name, o_orderpriority FROM orders JOIN p ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_name, o_orderpriority ORDER BY o_orderkey) = 1
""")
def skip_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6 K7: customers by nation and segment; of those kept, orders by the customer's name and priority."""
    customers = table(spark, sf_dir, "customer")
    parents, orders = skip.skip_hierarchical(
        customers, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey",
        lambda p: skip.skip_ever(p, None, ["c_nationkey", "c_mktsegment"], ["c_custkey"]),
        lambda c: skip.skip_ever(nesting.nested_loop(c, customers, "o_custkey", "c_custkey", as_url=False), None, ["c_name", "o_orderpriority"], ["o_orderkey"]),
    )
    return orders.select("o_orderkey", "o_custkey", "c_name", "o_orderpriority")


@query("""
WITH g AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, event_type FROM g WHERE before IS NULL OR before <> event_type
""")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10."""
    return skip.changed_rows(table(spark, sf_dir, "events"), ["user_id"], ["event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


def _report(name: str, cols: str, empty: str) -> str:
    return f"""SELECT '{name}' AS key_name, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(n) - count(*) AS BIGINT) AS n_dropped, CAST(coalesce(sum(CASE WHEN {empty} THEN n END), 0) AS BIGINT) AS n_empty, max(n) AS largest
FROM (SELECT {cols}, count(*) AS n FROM documents GROUP BY ALL)"""


@query(" UNION ALL ".join((_report("text", "coalesce(text, '') AS a", "a = ''"), _report("source", "coalesce(source, '') AS a", "a = ''"), _report("source_length", "coalesce(source, '') AS a, coalesce(CAST(n_chars AS VARCHAR), '') AS b", "a = '' AND b = ''"))))
def key_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K11."""
    return skip.key_report(table(spark, sf_dir, "documents"), {"text": ["text"], "source": ["source"], "source_length": ["source", "n_chars"]})


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
_SETS = [c for n in (1, 2, 3) for c in itertools.combinations(_LINE, n)]


@query("WITH k AS (" + " UNION ALL ".join(f"SELECT {list(c)} AS key, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(c)} FROM lineitem)) = (SELECT count(*) FROM lineitem) AS good" for c in _SETS) + """)
SELECT array_to_string(key, ',') AS key, (SELECT count(*) FROM lineitem) AS n_rows FROM k WHERE good AND NOT EXISTS (SELECT 1 FROM k s WHERE s.good AND len(s.key) < len(k.key) AND len(list_intersect(s.key, k.key)) = len(s.key))
""")
def minimal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns tell order lines apart."""
    return skip.minimal_keys(table(spark, sf_dir, "lineitem"), _LINE, most=3).select(F.array_join("key", ",").alias("key"), "n_rows")


@query("""
SELECT (SELECT count(*) FROM (SELECT 1 FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(DISTINCT c_custkey) > 1)) AS false_merges,
  (SELECT count(*) FROM (SELECT 1 FROM (SELECT DISTINCT c_custkey, c_nationkey, c_mktsegment FROM customer) GROUP BY c_custkey HAVING count(*) > 1)) AS missed_merges
""")
def key_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation and segment do not tell customers apart."""
    return skip.key_quality(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("""
WITH s AS (SELECT event_id, event_type || '_' || user_id || CASE WHEN event_type = 'click' THEN props ELSE CAST(user_id AS VARCHAR) END AS item_id, CASE WHEN event_type = 'click' THEN props ELSE CAST(user_id AS VARCHAR) END AS v FROM events)
SELECT event_id AS seq, item_id, arg_max(v, event_id) OVER (PARTITION BY item_id) AS shown FROM s
""")
def recorded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks recorded by their link, all else by its text."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("xpath"), F.col("user_id").alias("source_url"), F.col("props").alias("link"), F.col("user_id").cast("string").alias("text"), (F.col("event_type") == "click").alias("link_scraping"))
    return skip.recording_dedupe(rows)


@query("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-30 00:00:00'")
def last_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7."""
    return sources.dataset_last_hours(table(spark, sf_dir, "events"), "2024-01-30 00:00:00").select("event_id", "user_id")


@query("""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS row_idx FROM documents)
SELECT doc_id, lang, row_idx, (row_idx - 1) // 10 AS slice_no FROM r
""")
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language as a run, delivered ten rows at a time."""
    return sources.write_in_slices(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], ["lang"])


def _csv(c: str) -> str:
    t = f"coalesce(CAST({c} AS VARCHAR), '')"
    return f"""CASE WHEN regexp_matches({t}, '[\\n\\r",]') THEN '"' || replace({t}, '"', '""') || '"' ELSE {t} END"""


@query(f"SELECT doc_id, {_csv('doc_id')} || ',' || {_csv('text')} || ',' || {_csv('lang')} AS line FROM documents")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9."""
    return table(spark, sf_dir, "documents").select("doc_id", sources.csv_line(["doc_id", "text", "lang"]).alias("line"))


@query("SELECT o_orderkey, o_orderpriority AS name, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS date FROM orders")
def program_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as saved programs."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("name"), F.unix_timestamp("o_orderdate").alias("date"))
    shown = sources.program_catalogue(rows.select(F.struct("o_orderkey", "name").alias("name"), "date"))
    return shown.select("name.o_orderkey", "name.name", "date")


@query("SELECT c_custkey, c_name || ', ' || c_mktsegment AS label, c_mktsegment AS segment, 'page' AS kind FROM customer")
def program_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters written as one text, read back, with a default."""
    blob = F.concat(F.lit("label='"), "c_name", F.lit("\\, "), "c_mktsegment", F.lit("',segment='"), "c_mktsegment", F.lit("'"))
    given = sources.with_defaults(sources.parse_params(blob), F.create_map(F.lit("kind"), F.lit("page"), F.lit("segment"), F.lit("none")))
    return table(spark, sf_dir, "customer").select("c_custkey", given.alias("p")).select("c_custkey", *[F.col("p")[k].alias(k) for k in ("label", "segment", "kind")])


@query("""
WITH r AS (SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role, conv_id ORDER BY turn) AS row_idx FROM conversations)
SELECT role, conv_id, turn, row_idx, row_number() OVER (PARTITION BY role ORDER BY conv_id, row_idx) AS position FROM r
""")
def stitch_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: each role's turns as a table, each conversation one of its pages."""
    rows = table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", F.row_number().over(Window.partitionBy("role", "conv_id").orderBy("turn")).cast("long").alias("row_idx"))
    return paging.stitch_next(rows, ["role"], "conv_id")


@query("""
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS row_idx FROM (SELECT DISTINCT conv_id, turn FROM conversations))
SELECT conv_id, row_idx AS page_no, row_idx, turn, row_idx AS position FROM r
""")
def stitch_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page k of a conversation shows its first k turns."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().withColumn("row_idx", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))
    longest = rows.groupBy("conv_id").agg(F.max("row_idx").alias("n"))
    shown = rows.join(longest, "conv_id").select("conv_id", F.explode(F.sequence("row_idx", "n")).alias("page_no"), "row_idx", "turn")
    return paging.stitch_cumulative(shown, ["conv_id"])


@query("""
WITH i AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS nth FROM i WHERE event_type = 'error')
SELECT user_id, event_id FROM d WHERE nth = 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
""")
def list_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as attempts without new rows; the second in a row ends the list."""
    attempts = table(spark, sf_dir, "events").withColumn("has_new", F.col("event_type") != "error")
    return paging.list_ended(attempts, ["user_id"], ["ts", "event_id"], tries=2).select("user_id", "event_id")


@query("""
SELECT o_orderkey, coalesce(min(l_shipdate) <= any_value(o_orderdate) + INTERVAL 30 DAY, false) AS has_new FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def attempt_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as attempts; their first shipment within thirty days or none."""
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("ts_rows"))
    attempts = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts_click")).join(first, "o_orderkey", "left")
    return paging.attempt_timeout(attempts, 30 * DAY).select("o_orderkey", "has_new")


@query("""
WITH w AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'soon' ELSE CAST(round(value - 20, 2) AS VARCHAR) END AS typed FROM events)
SELECT event_id, CASE WHEN try_cast(typed AS DOUBLE) >= 0 THEN least(try_cast(typed AS DOUBLE), 5) ELSE 2 END * 1000 AS wait_ms FROM w
""")
def waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some waits are no numbers, some negative, some too long."""
    typed = F.when(F.col("event_type") == "error", "soon").otherwise(F.round(F.col("value") - 20, 2).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", paging.cap_wait(typed, 2.0).alias("wait_ms"))
