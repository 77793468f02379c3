"""A Merkle manifest of a table: a digest for each row, a tree for each source, a tree of sources, and a proof for each row.

Levels are built bottom up, 16 nodes at a time, and stored as node rows that name their parent. One recursive query then climbs from the
leaves to the root: it appends the siblings of each level to the proof, and folds the (possibly tampered) digest with them. The 16 leaves of a
node differ in their own digests and in their siblings of the first level only, so they climb as one row with their folded digests
side by side; each leaf's first siblings are put in front at the end.

Nothing is gathered by source: leaves are numbered by ranges, a node has 16 parts at most, and a node row is copied to each block of
65,536 leaves below it (and each 16 sources), so that no join key has more rows than a block has runs. All of it is Spark's own expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.base import cut, number_rows
from .common import TMP, discard, stored

WIDTH = 16
#: Leaves of one block; the table of nodes has one copy of a node for each block below it.
BLOCK = WIDTH**4
#: The tree whose leaves are the subroots.
TOP = -1


def digest(parts: Column) -> Column:
    """32 bytes of the hash of a binary of digests, as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(parts)), 256))


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field `-` if null, else its length in bytes, a colon and its value."""
    texts = [c.cast("string") for c in fields]
    each = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]
    return F.unhex(F.sha2(F.concat(*each), 256))


def _above(n: Column) -> Column:
    """The number of levels above n leaves."""
    return reduce(lambda a, b: a + b, [(n > F.lit(WIDTH**k)).cast("int") for k in range(16)])


def _numbered(leaves: DataFrame, sources: DataFrame) -> DataFrame:
    """`leaves` with their source's tree and number of leaves, and their place in it (pos) from 0, by id and digest.

    They are dealt out by range and numbered within each part; only counts of parts are summed up, so no source meets in one task.
    """
    part, n, before = f"{TMP}part", f"{TMP}n", f"{TMP}before"
    dealt = cut(leaves.repartitionByRange("source", "id", "leaf").withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy("source", part).agg(F.count("*").alias(n))
    earlier = Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).alias("o").join(sources.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select(F.col("o.source").alias(f"{TMP}s"), F.col(part).alias(f"{TMP}p"), before, "tree", "n")
    within = F.row_number().over(Window.partitionBy("source", part).orderBy("id", "leaf"))
    found = dealt.withColumn(n, within).join(offsets, (F.col(part) == F.col(f"{TMP}p")) & F.col("source").eqNullSafe(F.col(f"{TMP}s")))
    return found.select("id", "leaf", "folded", "tree", "n", (F.col(n) + F.col(before) - 1).alias("pos"))


def _level(below: DataFrame) -> DataFrame:
    """The nodes above the nodes (tree, n, pos, hash) of one level: kids is the digests of their parts, in order."""
    each = F.sort_array(F.collect_list(F.struct("pos", F.lower(F.hex("hash")).alias("h"))))
    kids = F.unhex(F.array_join(F.transform(each, lambda x: x.h), ""))
    found = below.groupBy("tree", F.floor(F.col("pos") / WIDTH).alias("pos")).agg(F.first("n").alias("n"), kids.alias("kids"))
    return found.withColumn("hash", digest(F.col("kids")))


def _linked(level: DataFrame, number: int, sources: int) -> DataFrame:
    """Node rows of one level, with the node above and the place in it; the topmost of a source is a leaf of the tree of sources."""
    top, inside = _above(F.col("n")) == number, F.col("tree") != TOP
    ends, many = top & inside, F.lit(sources > 1)
    up = F.when(~top, F.col("tree")).when(ends & many, F.lit(TOP))
    pos = F.when(~top, F.col("pos")).when(ends, F.col("tree"))
    return level.select(
        "tree", F.lit(number).alias("level"), "pos", "n", "kids", "hash", ends.alias("ends"), up.alias("up_tree"), F.when(up.isNotNull(), F.when(top, F.lit(1)).otherwise(F.lit(number + 1))).alias("up_level"),
        F.floor(pos / WIDTH).alias("up_pos"), (pos % WIDTH).cast("int").alias("place"),
    )


def _copied(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Node rows for each block of leaves below them: by part of the source, in the tree of sources also by each 16 sources."""
    size = F.pow(F.lit(float(WIDTH)), F.col("level")).cast("long")
    last = F.least((F.col("pos") + 1) * size, F.col("n")) - 1
    inside = nodes.where(F.col("tree") != TOP).select(F.lit(0).cast("long").alias("of"), F.explode(F.sequence(F.floor(F.col("pos") * size / BLOCK), F.floor(last / BLOCK))).alias("part"), *nodes.columns)
    parts = sources.groupBy(F.floor(F.col("tree") / WIDTH).alias("of")).agg(F.floor((F.max("n") - 1) / BLOCK).alias("m"))
    over = nodes.where(F.col("tree") == TOP).select(F.explode(F.sequence(F.floor(F.col("pos") * size / WIDTH), F.floor(last / WIDTH))).alias("of"), *nodes.columns)
    over = over.join(parts, "of").select("of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("part"), *nodes.columns)
    return inside.unionByName(over)


_CLIMB = """
WITH RECURSIVE climb AS (
  SELECT tree, part, ids, kids, folded, above, hash, subroot, up_tree, up_of, up_level, up_pos, place FROM {start}
  UNION ALL
  SELECT c.tree, c.part, c.ids, c.kids,
    unhex(array_join(transform(sequence(0, size(c.ids) - 1), i -> sha2(lower(hex(concat(substring(n.kids, 1, 32 * c.place), substring(c.folded, 32 * i + 1, 32), substring(n.kids, 32 * c.place + 33)))), 256)), '')),
    concat(c.above, substring(n.kids, 1, 32 * c.place), substring(n.kids, 32 * c.place + 33)),
    n.hash, CASE WHEN n.ends THEN n.hash ELSE c.subroot END,
    n.up_tree, CASE WHEN n.up_tree = -1 THEN c.tree div 16 ELSE CAST(0 AS BIGINT) END, n.up_level, n.up_pos, n.place
  FROM climb c JOIN {nodes} n ON n.tree = c.up_tree AND n.level = c.up_level AND n.pos = c.up_pos AND n.of = c.up_of AND n.part = c.part
)
SELECT ids, kids, folded, above, subroot, hash FROM climb WHERE up_tree IS NULL
"""


def _climbed(start: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of `start` at the root. The limit on the rows of recursive queries is lifted meanwhile."""
    spark = start.sparkSession
    limit, before = "spark.sql.cteRecursionRowLimit", spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    spark.conf.set(limit, "-1")
    try:
        return stored(spark.sql(_CLIMB, start=start, nodes=nodes))
    finally:
        if before is None:
            spark.conf.unset(limit)
        else:
            spark.conf.set(limit, before)


def manifest(df: DataFrame, id_col: str, source_col: str, fields: list[str], tampered: dict[str, Column] | None = None) -> DataFrame:
    """(id_col, leaf, subroot, root, proof_sha256, folded_root, verified): one row for each row of `df`.

    A leaf is the digest of `fields`. Leaves of a source ascend by `id_col` (null first; ties by digest, so repeated rows are equal leaves side
    by side), sources by their text's bytes (null first). `tampered` replaces fields by expressions (null: the field as it is) in the digest that is
    folded; `verified` tells whether it still gives the root. proof_sha256 is the digest of the siblings, level by level. An
    empty table gives no rows; other columns are dropped. The table is read once; its rows of digests are stored, so it may be any DataFrame.
    """
    spark = df.sparkSession
    own = leaf([F.col(c) for c in fields])
    changed = own if not tampered else leaf([F.coalesce(tampered[c], F.col(c)) if c in tampered else F.col(c) for c in fields])
    differs = F.lit(False) if not tampered else reduce(lambda a, b: a | b, [F.coalesce(t.isNotNull() & (t != F.col(c)), F.lit(False)) for c, t in tampered.items()])
    leaves = stored(df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), own.alias("leaf"), F.when(differs, changed).alias("folded")))
    counted = leaves.groupBy("source").agg(F.count("*").alias("n"))
    sources = stored(number_rows(counted, ["source"], out="tree").withColumn("tree", F.col("tree") - 1))
    size, most = sources.agg(F.count("*"), F.max("n")).first()

    # runs of 16 leaves, which are the nodes of the first level of the sources with more than one leaf
    each = F.sort_array(F.collect_list(F.struct("pos", "id", "leaf", "folded")))
    runs = _numbered(leaves, sources).groupBy("tree", F.floor(F.col("pos") / WIDTH).alias("pos")).agg(F.first("n").alias("n"), each.alias("l"))
    runs = runs.withColumn("kids", F.unhex(F.array_join(F.transform("l", lambda x: F.lower(F.hex(x.leaf))), "")))
    runs = stored(runs.withColumn("hash", F.when(F.col("n") > 1, digest(F.col("kids"))).otherwise(F.col("kids"))))
    made, levels, lone = [], [], runs.where("n = 1").select("tree", "hash")

    def climb_to(level: DataFrame, number: int, n: int) -> DataFrame:
        """Stores the levels above nodes (tree, n, pos, hash) of this number; the topmost of each tree."""
        tops = None
        while True:
            top = level.where(_above(F.col("n")) == number).select("tree", "hash")
            tops = top if tops is None else tops.unionByName(top)
            if n <= WIDTH**number:
                return tops
            number += 1
            level = stored(_level(level.where(_above(F.col("n")) >= number).select("tree", "n", "pos", "hash")))
            made.append(level)
            levels.append(_linked(level, number, size))

    if size:
        first = runs.where("n > 1").select("tree", "pos", "n", "kids", "hash")
        tops = climb_to(first, 1, max(most, 2)).unionByName(lone)
        if size > 1:
            climb_to(tops.select(F.lit(TOP).cast("long").alias("tree"), F.lit(size).cast("long").alias("n"), F.col("tree").alias("pos"), "hash"), 0, size)
    linked = _linked(runs.select("tree", "pos", "n", "kids", "hash").where("n > 1"), 1, size).unionByName(_linked(runs.where("n = 1").select("tree", "pos", "n", "kids", "hash"), 0, size))
    at = F.col("tree").alias("t"), F.col("pos").alias("p")
    start = runs.join(linked.select(*at, "ends", "up_tree", "up_level", "up_pos", "place"), (F.col("tree") == F.col("t")) & (F.col("pos") == F.col("p")))
    folded = F.unhex(F.array_join(F.transform("l", lambda x, i: F.hex(_fold(F.col("kids"), i, F.coalesce(x.folded, x.leaf), F.col("n")))), ""))
    start = start.select(
        "tree", F.floor(F.col("pos") * WIDTH / BLOCK).alias("part"), F.col("l.id").alias("ids"), "kids", folded.alias("folded"), F.lit(b"").alias("above"), "hash",
        F.when(F.col("ends"), F.col("hash")).alias("subroot"), "up_tree", F.when(F.col("up_tree") == TOP, F.floor(F.col("tree") / WIDTH)).otherwise(F.lit(0).cast("long")).alias("up_of"), "up_level", "up_pos", "place",
    )
    nodes = stored(_copied(reduce(DataFrame.unionByName, levels), sources)) if levels else None
    done = _climbed(start, nodes) if nodes is not None else start.where("up_tree is null")
    text = lambda c: F.lower(F.hex(c))
    rows = done.select("kids", "folded", "above", "subroot", "hash", F.posexplode("ids").alias("i", "id"))
    one = lambda c: F.substring(c, 32 * F.col("i") + 1, F.lit(32))
    out = rows.select(
        F.col("id").alias(id_col), text(one("kids")).alias("leaf"), text("subroot").alias("subroot"), text("hash").alias("root"),
        F.sha2(text(F.concat(_others(F.col("kids"), F.col("i")), "above")), 256).alias("proof_sha256"), text(one("folded")).alias("folded_root"), (one("folded") == F.col("hash")).alias("verified"),
    )
    if nodes is not None:
        discard(leaves, runs, nodes, *made)
    return out


def _others(kids: Column, i: Column) -> Column:
    """The digests of a node's parts without the one at place i."""
    return F.concat(F.substring(kids, F.lit(1), 32 * i), F.substring(kids, 32 * i + 33, F.lit(32 * WIDTH)))


def _fold(kids: Column, i: Column, one: Column, n: Column) -> Column:
    """The node's digest with another one at place i; a lone leaf is no node."""
    return F.when(n == 1, one).otherwise(digest(F.concat(F.substring(kids, F.lit(1), 32 * i), one, F.substring(kids, 32 * i + 33, F.lit(32 * WIDTH)))))
