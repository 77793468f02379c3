"""Queries on computed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as c
from ..operators import lists
from .registry import query, table


@query("""
SELECT p_partkey, p_name || '-' || p_size AS joined, length(p_name) AS len, instr(p_name, 'e') - 1 AS first_e, CASE WHEN contains(p_name, 'e') THEN length(p_name) - instr(reverse(p_name), 'e') ELSE -1 END AS last_e,
  right(p_name, 1) AS last_char, substr(p_name, 3, 1) AS third, substr(p_name, 2, 4) AS middle, upper(p_name) AS up, lower(p_type) AS low, trim('  ' || p_name || '  ') AS trimmed, p_name = '' AS is_empty, split_part(p_name, ' ', 1) AS head,
  replace(p_name, ' ', '|') AS rejoined
FROM part
""")
def cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F10 F19."""
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", c.concat(n, F.lit("-"), F.col("p_size")).alias("joined"), c.length(n).cast("long").alias("len"), c.text_index_of(n, "e").cast("long").alias("first_e"), c.text_index_of(n, "e", last=True).cast("long").alias("last_e"),
        c.text_char_at(n, "last").alias("last_char"), c.text_char_at(n, "from_start", 2).alias("third"), c.text_substring(n, 1, 4).alias("middle"), c.upper(n).alias("up"), c.lower(F.col("p_type")).alias("low"),
        c.trim(F.concat(F.lit(" \t"), n, F.lit("\n "))).alias("trimmed"), c.text_is_empty(n).alias("is_empty"), c.list_get(c.list_split(n, " "), "first").alias("head"), c.list_join(c.list_split(n, " "), "|").alias("rejoined"),
    )


@query("""
SELECT p_partkey, CAST(p_size AS DOUBLE) + p_retailprice AS plus, round(p_retailprice / nullif(CAST(p_size AS DOUBLE), 0), 6) AS quotient, CAST(p_partkey - 7 * floor(p_partkey / 7.0) AS DOUBLE) AS modulo, CAST(-p_size - 5 * floor(-p_size / 5.0) AS DOUBLE) AS negative_modulo,
  round(sqrt(p_size), 6) AS root, floor(p_retailprice + 0.5) AS rounded, ceil(p_retailprice) AS up, round(sin(radians(p_size)), 6) AS sine, p_size % 2 = 0 AS is_even,
  p_size >= 2 AND NOT EXISTS (SELECT 1 FROM range(2, 51) d(d) WHERE d.d < p_size AND p_size % d.d = 0) AS is_prime, p_partkey % 3 = 0 AS by_three, least(greatest(p_size, 10), 40) AS held, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class
FROM part
""")
def cell_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11-F15 F20."""
    s, p, k = F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", c.arithmetic(s, "+", p).alias("plus"), F.round(c.arithmetic(p, "/", s), 6).alias("quotient"), c.arithmetic(k, "%", F.lit(7)).alias("modulo"), c.arithmetic(-s, "%", F.lit(5)).alias("negative_modulo"),
        F.round(c.single("sqrt", s), 6).alias("root"), c.single("round", p).alias("rounded"), c.single("up", p).alias("up"), F.round(c.single("sin", s), 6).alias("sine"), c.number_is(s, "even").alias("is_even"),
        c.number_is(s, "prime").alias("is_prime"), c.number_is(k, "divisible_by", 3).alias("by_three"), c.constrain(s, 10, 40).alias("held"), c.choose([(c.compare(s, "LT", F.lit(10)), F.lit("small")), (c.compare(s, "LT", F.lit(30)), F.lit("medium"))], F.lit("large")).alias("class"),
    )


@query("""
WITH l AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS q FROM lineitem GROUP BY l_orderkey),
m AS (SELECT l_orderkey, q, list_transform(list_distinct(q), lambda x: len(list_filter(q, lambda y: y = x))) AS counts FROM l)
SELECT l_orderkey, list_sum(q) AS total, list_min(q) AS low, list_max(q) AS high, round(list_avg(q), 6) AS mean, list_median(q) AS median, round(list_stddev_pop(q), 6) AS spread, len(q) AS n, CAST(coalesce(list_position(q, 25.0), 0) - 1 AS INTEGER) AS at_25, q[-1] AS last,
  array_to_string(list_transform(list_sort(q), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS sorted,
  array_to_string(list_transform(list_filter(list_filter(q, lambda x, i: list_position(q, x) = i), lambda x: len(list_filter(q, lambda y: y = x)) = list_max(counts)), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS modes
FROM m
""")
def cell_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantities of each order as a list."""
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")))
    q = F.col("q")
    whole = lambda a: c.list_join(F.transform(a, lambda x: x.cast("long")), ",")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(items, lambda x: x.l_quantity).alias("q"))
    return rows.select(
        "l_orderkey", c.list_sum(q).alias("total"), c.list_min(q).alias("low"), c.list_max(q).alias("high"), F.round(c.list_average(q), 6).alias("mean"), c.list_median(q).alias("median"), F.round(c.list_stddev(q), 6).alias("spread"),
        c.list_length(q).cast("long").alias("n"), c.list_index_of(q, F.lit(25.0)).alias("at_25"), c.list_get(q, "last").alias("last"), whole(c.list_sort(q, "NUMERIC")).alias("sorted"), whole(c.list_modes(q)).alias("modes"),
    )


@query("""
SELECT event_id, value > 20 AND event_type = 'click' AS both_hold, value > 20 OR event_type = 'click' AS either_holds, NOT (value > 20) AS negated, CASE WHEN event_type = 'error' THEN 0 WHEN value > 100 THEN 2 ELSE 1 END AS level FROM events
""")
def cell_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20."""
    big, click = c.compare(F.col("value"), "GT", F.lit(20)), c.compare(F.col("event_type"), "EQ", F.lit("click"))
    level = c.choose([(F.col("event_type") == "error", F.lit(0)), (F.col("value") > 100, F.lit(2))], F.lit(1))
    return table(spark, sf_dir, "events").select("event_id", c.both(big, click).alias("both_hold"), c.either(big, click).alias("either_holds"), c.negate(big).alias("negated"), level.alias("level"))


@query("""SELECT event_id, '{"k":' || (props->>'k') || '}' AS canonical FROM events""")
def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21."""
    return table(spark, sf_dir, "events").select("event_id", c.canonical_json(F.col("props"), "map<string,int>").alias("canonical"))


@query("""
SELECT event_id, '{"a":{"list":[3,1,{"p":' || (props->>'k') || ',"q":null}],"u":' || user_id || '},"b":{"kind":"' || event_type || '"}}' AS from_text,
  '{"kind":"' || event_type || '","more":{"ids":[' || user_id || ',' || event_id || ']' || CASE WHEN event_type = 'error' THEN ',"k":' || (props->>'k') ELSE '' END || '}}' AS from_value FROM events
""")
def canonical_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nested objects whose keys come in any order, as text and as values with missing fields."""
    k, user = F.get_json_object("props", "$.k"), F.col("user_id")
    text = F.concat(F.lit('{ "b": {"kind": "'), "event_type", F.lit('"}, "a": {"u": '), user, F.lit(', "list": [3, 1, {"q": null, "p": '), k, F.lit("}]}}"))
    value = F.struct(F.struct(F.when(F.col("event_type") == "error", k.cast("int")).alias("k"), F.array(user, F.col("event_id")).alias("ids")).alias("more"), F.col("event_type").alias("kind"))
    return table(spark, sf_dir, "events").select("event_id", c.canonical_text(text).alias("from_text"), c.canonical_value(value).alias("from_value"))


@query("""
WITH n AS (SELECT l_suppkey % 3 AS grp, l_quantity AS v, row_number() OVER (PARTITION BY l_suppkey % 3 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem),
c AS (SELECT grp, v, count(*) AS n, min(seq) AS first FROM n GROUP BY grp, v), m AS (SELECT *, max(n) OVER (PARTITION BY grp) AS most FROM c)
SELECT grp, count(*) AS n, sum(v) AS total, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS spread,
  (SELECT string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY first) FROM m WHERE m.grp = n.grp AND m.n = m.most) AS modes FROM n GROUP BY grp
""")
def grouped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16 over three groups of all order lines."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").withColumn("grp", F.col("l_suppkey") % 3)
    found = lists.grouped_stats(rows, ["grp"], "l_quantity", order)
    return found.select("grp", "n", "total", "low", "high", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("spread", 6).alias("spread"), F.array_join(F.transform("modes", lambda v: v.cast("long").cast("string")), ",").alias("modes"))


@query("""
WITH t AS (SELECT event_id, value AS v, least(greatest(value / 100 - 0.2, -1.5), 1.5) AS u, event_type || ' o''neil 2nd  x' AS s FROM events)
SELECT event_id, abs(u) AS a, -v AS minus, round(CASE WHEN v > 0 THEN ln(v) END, 6) AS log_e, round(CASE WHEN v > 0 THEN log10(v) END, 6) AS log_10, round(exp(u), 6) AS power_e, round(power(10, u), 6) AS power_10, floor(v + 0.5) AS nearest, ceil(v) AS above, floor(v) AS below,
  round(cos(radians(v)), 6) AS cosine, round(tan(radians(u)), 6) AS tangent, round(CASE WHEN u BETWEEN -1 AND 1 THEN degrees(asin(u)) END, 6) AS arc_sine, round(CASE WHEN u BETWEEN -1 AND 1 THEN degrees(acos(u)) END, 6) AS arc_cosine, round(degrees(atan(v)), 6) AS arc_tangent,
  CASE WHEN u >= 0 THEN round(sqrt(u), 6) END AS root, event_id % 2 = 1 AS is_odd, v > 20 AS is_above, u < 0 AS is_negative, floor(v) = v AS is_whole,
  array_to_string(list_transform(regexp_split_to_array(s, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS titled, s[1] AS first_char, s[length(s) - 2] AS third_last, ltrim('   ' || s) AS left_trimmed, rtrim(s || '   ') AS right_trimmed, s[length(s) - 3:] AS tail
FROM t
""")
def cell_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the queries above leave out."""
    v = F.col("value")
    u = F.least(F.greatest(v / 100 - 0.2, F.lit(-1.5)), F.lit(1.5))
    s, six = F.concat("event_type", F.lit(" o'neil 2nd  x")), lambda x: F.round(x, 6)
    return table(spark, sf_dir, "events").select(
        "event_id", c.single("abs", u).alias("a"), c.single("neg", v).alias("minus"), six(c.single("ln", v)).alias("log_e"), six(c.single("log10", v)).alias("log_10"), six(c.single("exp", u)).alias("power_e"), six(c.single("pow10", u)).alias("power_10"),
        c.single("round", v).alias("nearest"), c.single("up", v).alias("above"), c.single("down", v).alias("below"), six(c.single("cos", v)).alias("cosine"), six(c.single("tan", u)).alias("tangent"), six(c.single("asin", u)).alias("arc_sine"),
        six(c.single("acos", u)).alias("arc_cosine"), six(c.single("atan", v)).alias("arc_tangent"), six(c.single("sqrt", u)).alias("root"), c.number_is(F.col("event_id"), "odd").alias("is_odd"), c.number_is(v - 20, "positive").alias("is_above"),
        c.number_is(u, "negative").alias("is_negative"), c.number_is(v, "whole").alias("is_whole"), c.title(s).alias("titled"), c.text_char_at(s, "first").alias("first_char"), c.text_char_at(s, "from_end", 2).alias("third_last"),
        c.trim(F.concat(F.lit(" \t\n"), s), "left").alias("left_trimmed"), c.trim(F.concat(s, F.lit(" \t\n")), "right").alias("right_trimmed"), c.text_substring(s, -4, -1).alias("tail"),
    )


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, w, list_transform(w, lambda x, i: {'x': x, 'i': i, 'low': lower(x), 'num': coalesce(try_cast(x AS DOUBLE), 0)}) AS e FROM w)
SELECT doc_id, coalesce(len(w), 0) = 0 AS nothing, array_to_string(w[1:3], ',') AS head, array_to_string(w[-2:], ',') AS tail, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 2 THEN 'NEW' ELSE x END), ',') AS replaced,
  array_to_string(list_transform(list_sort(list_transform(e, lambda y: {'a': encode(y.x), 'b': y.i, 'x': y.x})), lambda y: y.x), ',') AS by_text, array_to_string(list_transform(list_sort(list_transform(e, lambda y: {'a': encode(y.low), 'b': y.i, 'x': y.x})), lambda y: y.x), ',') AS any_case,
  array_to_string(list_reverse(list_transform(list_sort(list_transform(e, lambda y: {'a': y.num, 'b': -y.i, 'x': y.x})), lambda y: y.x)), ',') AS by_number_down,
  CAST(coalesce(list_position(w, 'the'), 0) - 1 AS INTEGER) AS first_the, CAST(CASE WHEN list_contains(w, 'the') THEN len(w) - list_position(list_reverse(w), 'the') ELSE -1 END AS INTEGER) AS last_the, w[2] AS second, w[-2] AS last_but_one
FROM k
""")
def list_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of words: empty ones, parts, replaced items, all orders and their ties."""
    w, comma = F.col("w"), lambda x: c.list_join(x, ",")
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.filter(F.split("text", "[^A-Za-z0-9]+"), lambda x: x != "").alias("w"))
    return rows.select(
        "doc_id", c.lists_is_empty(w).alias("nothing"), comma(c.list_sublist(w, 0, 2)).alias("head"), comma(c.list_sublist(w, -2, -1)).alias("tail"), comma(c.list_set(w, 1, F.lit("NEW"))).alias("replaced"), comma(c.list_sort(w)).alias("by_text"),
        comma(c.list_sort(w, "IGNORE_CASE")).alias("any_case"), comma(c.list_sort(w, "NUMERIC", descending=True)).alias("by_number_down"), c.list_index_of(w, F.lit("the")).alias("first_the"), c.list_index_of(w, F.lit("the"), last=True).alias("last_the"),
        c.list_get(w, "from_start", 1).alias("second"), c.list_get(w, "from_end", 1).alias("last_but_one"),
    )
