"""Selecting nodes and rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut
from .nodes import COLUMNS, NODE_COLUMNS, at_xpath, element, select_nodes

# How readable a property is for people.
READABLE = {
    "textContent": 12, "preColonText": 11, "preceding-text": 10, "previousElementSiblingText": 10, "firstWord": 10, "firstTwoWords": 10, "firstThreeWords": 10, "lastWord": 10, "possibleHeading": 10,
    "id": 9, "tagName": 9, "className": 9, "xpath": 8, "background-color": 7, "background-image": 7,
}
CHOSEN, CHILD, LAST_CHILD = 20, 6, 5
#: Kinds of sets of properties that nodes are looked up by as a whole; others go by one property.
MOST_SETS = 32
#: Properties not required of a snapshot whose sets are all counted, to see whether their kinds are few enough.
MOST_FREE = 8


def require_features(nodes: DataFrame, required: Mapping[str, object]) -> DataFrame:
    """Nodes that have all required values; a required null matches null."""
    return reduce(lambda df, p: df.where(F.col(p[0]).eqNullSafe(F.lit(p[1]))), required.items(), nodes)


def find_by_xpath(nodes: DataFrame, xpath: str | DataFrame) -> DataFrame:
    """The nodes at one xpath, or at the (page_id, xpath) pairs of a table. At one xpath, `nodes` may be a layout of pages."""
    if isinstance(xpath, str) and "nodes" in nodes.columns:
        return select_nodes(nodes, at_xpath(xpath))
    return nodes.where(F.col("xpath") == xpath) if isinstance(xpath, str) else nodes.join(xpath.select("page_id", "xpath").distinct(), ["page_id", "xpath"], "left_semi")


def find_by_similarity(nodes: DataFrame, snapshot: Mapping[str, object], required: Mapping[str, object] | None = None) -> DataFrame:
    """Each page's node with the most properties equal to the snapshot, among those with all required ones; ties go to the first.

    `nodes` is a layout of pages (no shuffle: scores are compared page by page, texts and paths made for the best ones and compared properties only) or rows of elements.
    """
    if "nodes" in nodes.columns:
        equal = lambda n, props: [COLUMNS[p](n).eqNullSafe(F.lit(v)) for p, v in props.items()]
        good = F.filter("nodes", lambda n: reduce(and_, equal(n, required or {}), F.lit(True)))
        best = F.array_max(F.transform(good, lambda n: F.struct(reduce(add, [e.cast("int") for e in equal(n, snapshot)], F.lit(0)).alias("score"), (-n["n"]).alias("back"))))
        chosen = nodes.withColumn("_rl_best", best).where("_rl_best is not null")
        node = element(-F.col("_rl_best.back"))
        return chosen.select("page_id", "url", *[COLUMNS[c](node).alias(c) for c in NODE_COLUMNS], F.col("_rl_best.score").alias("score"))
    score = reduce(add, [F.col(p).eqNullSafe(F.lit(v)).cast("int") for p, v in snapshot.items()], F.lit(0))
    scored = require_features(nodes, required or {}).withColumn("score", score)
    best = scored.groupBy("page_id").agg(F.max_by(F.struct(*[c for c in scored.columns if c != "page_id"]), F.struct(F.col("score"), -F.col("doc_order"))).alias("n"))
    return best.select("page_id", "n.*")


def node_properties(layout: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(page_id, node_id, props): the elements of pages with some of their columns (`nodes.COLUMNS`) as a map of texts; nulls are left out."""
    rows = select_nodes(layout, columns=["node_id", *[c for c in columns if c != "node_id"]])
    return rows.select("page_id", "node_id", _map_of({c: F.col(c).cast("string") for c in columns}).alias("props"))


def _map_of(cells: Mapping[str, Column]) -> Column:
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in cells.items()]), lambda e: e["v"].isNotNull()))


def find_snapshots(nodes: DataFrame, snapshots: DataFrame, least: float = 0.5, k: int = 1, digits: int = 9) -> DataFrame:
    """P3 for a table of snapshots: on each page the k nodes most like each recorded node: page_id, snapshot_id, node_id, score, rank.

    `nodes` has page_id, node_id and props (a map of texts, see `node_properties`), `snapshots` has snapshot_id, props and, if wanted, required (names of
    properties that have to be equal). An equal property counts by how rare its value is among the nodes, ln(1 + nodes / nodes with it); a node needs
    `least` of the snapshot's whole weight (above 0); ties, of scores rounded to `digits`, go to the smaller node_id.

    Not every pair is scored. Snapshots of equal properties are one class, and so are the nodes of a page with equal properties (its k smallest node_ids stand for them).
    Where the sets of properties that make a hit are of at most `MOST_SETS` kinds (sets of names), a page keeps the k smallest node_ids for each set of values of such a kind, and a
    snapshot looks its sets up: a node that equals it in just one set and is among the k likest is among the k smallest that have this set, as all that have it are as like or liker.

    Otherwise an index leads from sets of (property, value) to classes of snapshots. Properties that a hit cannot miss (required ones, and those without which the others weigh too little)
    are in every set; if they do not make a hit by themselves, each of the rarest others is added in turn, as many as it takes until the rest weigh too little. A node
    meets a class at the first set that it has, so each pair comes up once. `MOST_SETS` kinds of sets are looked up whole, the rest by their rarest property. Null and empty maps match nothing.
    """
    entries = lambda c: F.array_sort(F.map_entries(c))
    required = (F.coalesce("required", F.array()) if "required" in snapshots.columns else F.array()).cast("array<string>")
    recorded = snapshots.where(F.size("props") > 0).select("snapshot_id", entries("props").alias("own"), F.array_sort(F.array_distinct(required)).alias("required"))
    classes = recorded.groupBy("own", "required").agg(F.min("snapshot_id").alias("class_id"))
    wanted = classes.select(F.explode("own").alias("e")).select("e.*").distinct()
    seen = nodes.select(F.explode("props").alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))
    weights = wanted.join(seen, ["key", "value"], "left").select("key", "value", F.log1p(F.lit(float(nodes.count())) / F.coalesce("n", F.lit(1))).alias("w"))
    weighed = classes.select("class_id", "required", F.explode("own").alias("e")).select("class_id", "required", "e.*").join(weights, ["key", "value"])
    # the rarest properties first
    each = weighed.groupBy("class_id").agg(F.first("required").alias("required"), F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "key", "value"))).alias("p"))
    weight_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s - x["w"])
    kept = each.where(F.size(F.filter("p", lambda x: F.array_contains("required", x["key"]))) == F.size("required")).withColumn("whole", weight_of(F.col("p")))
    kept = cut(kept.withColumn("need", F.round(least * F.col("whole"), 9)))
    # compared by so many digits, so that equal sums are ties; given as they are, so that they are rounded once
    nine, shown = F.round("score", 9), F.round("score", digits)
    named = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(x["key"], x["value"])))
    names = lambda c: F.transform(c, lambda x: x["key"])
    key_of = lambda c: F.concat(names(c), F.transform(c, lambda x: x["value"]))
    # the nodes of a page that are alike, by their smallest ids
    alike = nodes.where(F.size("props") > 0).select("page_id", "node_id", entries("props").alias("own"))
    alike = alike.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "own").orderBy("node_id"))).where(F.col("k") <= k)
    part = lambda kind: F.filter("own", lambda x: x["key"].isin(kind))
    keys_of = lambda kinds: F.array(*[F.when(F.size(part(kind)) == len(kind), key_of(part(kind))) for kind in kinds])
    best = Window.partitionBy("page_id", "class_id").orderBy(shown.desc(), "node_id")
    members = recorded.join(classes, ["own", "required"]).select("snapshot_id", "class_id")

    free = F.filter("p", lambda x: ~F.array_contains("required", x["key"]))
    if (kept.agg(F.max(F.size(free))).first()[0] or 0) <= MOST_FREE:
        needed = F.filter("p", lambda x: F.array_contains("required", x["key"]))
        every = F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), F.size(free)).cast("int") - 1), lambda n: F.concat(needed, F.filter(free, lambda _, i: F.call_function("shiftright", n, i) % 2 == 1)))
        sets = kept.select("class_id", "need", F.explode(every).alias("set")).withColumn("score", weight_of(F.col("set"))).where((nine >= F.col("need")) & (nine > 0))
        sets = sets.select("class_id", "score", named(F.col("set")).alias("set"))
        kinds = [r[0] for r in sets.select(names("set").alias("names")).distinct().limit(MOST_SETS + 1).collect()]
        if len(kinds) <= MOST_SETS:
            held = alike.select("page_id", "node_id", F.explode(F.filter(keys_of(kinds), lambda x: x.isNotNull())).alias("key"))
            held = held.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "key").orderBy("node_id"))).where(F.col("k") <= k).drop("k")
            met = sets.select("class_id", "score", key_of(F.col("set")).alias("key")).join(held, "key")
            scored = met.groupBy("page_id", "class_id", "node_id").agg(F.max("score").alias("score"))
            ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            return ranked.join(members, "class_id").select("page_id", "snapshot_id", "node_id", "score", "rank")

    sure = lambda x: F.array_contains("required", x["key"]) | (F.col("whole") + x["w"] < F.col("need") - 1e-9)
    kept = kept.withColumns({"sure": F.filter("p", sure), "rest": F.filter("p", lambda x: ~sure(x))}).withColumn("given", weight_of(F.col("sure")))
    enough = F.filter(F.sequence(F.lit(1), F.size("rest")), lambda n: F.col("given") + weight_of(F.slice("rest", n + 1, F.size("rest"))) < F.col("need") - 1e-9)
    tried = F.when((F.size("sure") > 0) & (F.col("given") >= F.col("need") - 1e-9), F.array().cast(kept.schema["rest"].dataType)).otherwise(F.when(F.size("rest") > 0, F.slice("rest", 1, F.coalesce(F.get(enough, F.lit(0)), F.size("rest")))).otherwise(F.col("rest")))
    sets = F.when((F.size("tried") > 0), F.transform("tried", lambda x, k: F.struct((k + 1).alias("at"), named(F.concat("sure", F.array(x))).alias("all"), named(F.array(x)).alias("one"))))
    sets = sets.when(F.col("given") >= F.col("need") - 1e-9, F.array(F.struct(F.lit(0).alias("at"), named(F.col("sure")).alias("all"), named(F.slice("sure", 1, 1)).alias("one"))))
    index = cut(kept.withColumn("tried", tried).select("class_id", "p", "need", "sure", "tried", F.inline(sets)))
    kinds = [r[0] for r in index.groupBy(names("all").alias("names")).count().orderBy(F.desc("count"), "names").limit(MOST_SETS + 1).collect()]
    whole, others = kinds[:MOST_SETS], len(kinds) > MOST_SETS
    if others:
        index = index.withColumn("all", F.when(names("all").isin([F.array(*map(F.lit, k)) for k in whole]), F.col("all")).otherwise(F.col("one")))
    alike = alike.groupBy("page_id", "own").agg(F.sort_array(F.collect_list(F.struct("node_id"))).alias("ids"))
    found = keys_of(whole) if whole else F.array().cast("array<array<string>>")
    found = F.array_distinct(F.concat(found, F.transform("own", lambda x: F.array(x["key"], x["value"])))) if others else found
    rows = alike.select("page_id", "ids", F.map_from_entries("own").alias("props"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("key"))
    same = lambda x: F.coalesce(F.try_element_at("props", x["key"]) == x["value"], F.lit(False))
    met = rows.join(index.withColumn("key", key_of(F.col("all"))).drop("all", "one"), "key")
    first = F.coalesce(F.array_position(F.transform("tried", same), F.lit(True)).cast("int"), F.lit(0))
    met = met.where(F.forall("sure", same) & (first == F.col("at")))
    scored = met.select("page_id", "class_id", "ids", weight_of(F.filter("p", same)).alias("score"), "need").where((nine >= F.col("need")) & (nine > 0))
    scored = scored.select("page_id", "class_id", "score", F.inline("ids"))
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(members, "class_id").select("page_id", "snapshot_id", "node_id", "score", "rank")


def text_contains(a: Column, b: Column | str) -> Column:
    """A substring test that minds case; a missing text contains nothing but the empty text."""
    return F.contains(F.coalesce(a, F.lit("")), b if isinstance(b, Column) else F.lit(b))


def text_is(a: Column, b: Column | str) -> Column:
    return F.coalesce(a, F.lit("")) == (F.coalesce(b, F.lit("")) if isinstance(b, Column) else F.lit(b))


def link_contains(link: Column, part: str) -> Column:
    """P5: false without a link."""
    return F.coalesce(F.contains(link, F.lit(part)), F.lit(False))


def where(rows: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate holds; put it before the joins with inner loops."""
    return rows.where(predicate)


def rank_features(props: DataFrame, by: list[str], prop: str = "prop", chosen: str = "chosen") -> DataFrame:
    """Properties of each node with score and rank: chosen ones first, then the most readable; ties by name."""
    known = F.create_map(*[F.lit(x) for k, v in READABLE.items() for x in (k, v)])
    score = F.when(F.col(chosen), CHOSEN).otherwise(F.coalesce(known[F.col(prop)], F.when(F.startswith(F.col(prop), F.lit("child")), CHILD).when(F.startswith(F.col(prop), F.lit("lastChild")), LAST_CHILD).otherwise(0)))
    scored = props.withColumn("score", score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), prop)))


def display_value(value: Column) -> Column:
    """Long values by their ends, EMPTY and null by name."""
    return F.when(value.isNull(), "null").when(value == "", "EMPTY").when(F.length(value) > 200, F.concat(F.substring(value, 1, 50), F.lit("..."), F.right(value, F.lit(50)))).otherwise(value)
