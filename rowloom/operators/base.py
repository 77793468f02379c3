"""Small pieces that several operators share."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Prefix of columns that exist only inside an operator.
TMP = "_rl_"


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that driver and executors share: Spark's checkpoint folder.

    It is the one already set, or that of spark.checkpoint.dir. Only a local master, which has no other machine, may do without.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rowloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` materialised in the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def blank(c: str | Column) -> Column:
    """The cell as text; a missing cell is the empty cell, and all empty cells are equal."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def key(cols: Sequence[str]) -> Column:
    return F.struct(*[blank(c).alias(f"k{i}") for i, c in enumerate(cols)])


def seconds(c: str | Column) -> Column:
    """An instant as seconds since 1970; times without a zone are those of the session's zone."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp").cast("double")


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def number_rows(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "row_idx") -> DataFrame:
    """`rows` with their number from 1 in `order`, within each value of `by`, however large that is.

    Rows are dealt out by range and numbered within each part; only the parts' counts are summed up, so
    one huge group, or none at all (`by` empty), does not meet in one task. `order` has to be total.
    """
    part, n = f"{TMP}part", f"{TMP}n"
    dealt = cut(rows.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(*by, part).agg(F.count("*").alias(n))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"{TMP}b{i}") for i, c in enumerate(by)], F.col(part).alias(f"{TMP}p"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{TMP}before"))
    same = F.col(part) == F.col(f"{TMP}p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"{TMP}b{i}"))
    within = F.row_number().over(Window.partitionBy(*by, part).orderBy(*order))
    numbered = dealt.withColumn(n, within).join(offsets, same)
    return numbered.withColumn(out, (F.col(n) + F.col(f"{TMP}before")).cast("long")).select(*[c for c in rows.columns if c != out], out)


def first_by(rows: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in `order` (total): ranks are cut off before the exchange, so a hot key sends one row a task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(f"{TMP}rank", rank).where(F.col(f"{TMP}rank") == 1).drop(f"{TMP}rank")


def _dealt(rows: DataFrame, by: Sequence[str], order: Sequence[str], parts: int, more: dict[str, Column]) -> DataFrame:
    """`rows` dealt out by ranges of `by` and `order`, with the number of their range."""
    dealt = rows.withColumns(more).repartitionByRange(parts, *by, *order)
    return cut(dealt.withColumn(f"{TMP}part", F.spark_partition_id()))


def _joined_ends(dealt: DataFrame, ends: DataFrame, by: Sequence[str], taken: Sequence[str]) -> DataFrame:
    """`dealt` with what the parts before hold of the same key: a row for each part of those keys that several parts share, twice the parts at most."""
    part = f"{TMP}part"
    found = F.broadcast(ends.select(*[F.col(c).alias(f"{TMP}b{i}") for i, c in enumerate(by)], F.col(part).alias(f"{TMP}p"), *taken))
    same = F.col(part) == F.col(f"{TMP}p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"{TMP}b{i}"))
    return dealt.join(found, same, "left")


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """`rows` with sums (of whole numbers) over the rows of their key up to each, in `order` (total).

    With `parts`, keys of any number of rows are summed in so many ranges at once, and only the ranges' sums are added up; else a key's rows meet in a window.
    """
    if not parts:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(x).over(w) for n, x in sums.items()})
    part, each = f"{TMP}part", {f"{TMP}x{k}": x for k, x in enumerate(sums.values())}
    dealt = _dealt(rows, by, order, parts, each)
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy(*by, part).agg(*[F.sum(x).alias(x) for x in each]).select(*by, part, *[F.sum(x).over(before).alias(f"{x}b") for x in each])
    some = reduce(lambda a, b: a | b, [F.col(f"{x}b").isNotNull() for x in each])
    w = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = _joined_ends(dealt, ends.where(some), by, [f"{x}b" for x in each])
    return found.select(*[c for c in rows.columns if c not in sums], *[(F.sum(x).over(w) + F.coalesce(f"{x}b", F.lit(0))).alias(n) for n, x in zip(sums, each, strict=True)])


def neighbour(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out: str, following: bool = False, parts: int | None = None) -> DataFrame:
    """`rows` with the value of the row of their key before (`following`: after) each, in `order` (total); null for the first (last).

    With `parts`, keys of any number of rows are taken in so many ranges at once, and a range gets the last (first) value of the one beside it; else a key's rows meet in a window.
    """
    if not parts:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn(out, (F.lead(value) if following else F.lag(value)).over(w))
    part, x = f"{TMP}part", f"{TMP}x"
    dealt = _dealt(rows, by, order, parts, {x: F.struct(value.alias("v"))})
    edge = (F.min_by if following else F.max_by)(x, F.struct(*order))
    beside = Window.partitionBy(*by).orderBy(part)
    ends = dealt.groupBy(*by, part).agg(edge.alias("e")).select(*by, part, (F.lead("e") if following else F.lag("e")).over(beside).alias(f"{TMP}e"))
    w = Window.partitionBy(*by, part).orderBy(*order)
    own = (F.lead(x) if following else F.lag(x)).over(w)
    found = _joined_ends(dealt, ends.where(F.col(f"{TMP}e").isNotNull()), by, [f"{TMP}e"]).withColumn(f"{TMP}o", own)
    return found.select(*[c for c in rows.columns if c != out], F.coalesce(f"{TMP}o", f"{TMP}e")["v"].alias(out))


def hub_keys(rows: DataFrame, key: str, share: float) -> list:
    """The values of a column (not null) that at least about `share` of the rows have: 1 / share of them at most.

    They come from a mergeable sketch of frequent items, one pass with partial aggregation; its counts are off by less than half of the share.
    """
    tracked = max(100, math.ceil(20 / share))
    found = rows.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {math.ceil(1 / share)}, {tracked})").alias("top")).first()
    return [x[0] for x in found["top"] or [] if x[1] >= share * found["n"]]


def hub_join(left: DataFrame, right: DataFrame, on_left: str, on_right: str, share: float = 0.02, copies: int | None = None) -> DataFrame:
    """The inner join of `left` and `right` on one column each, with the rows of `left` that share a hub key spread over several tasks.

    The rows of a hub are dealt by a hash of all their cells to `copies` parts (by default as many as shuffle partitions, 64 at most), and the right
    side's rows of hubs are copied to each of them; other keys are joined as ever. A repeated computation deals the same way.
    """
    hubs = hub_keys(left, on_left, share)
    if not hubs:
        return left.join(right, F.col(on_left) == F.col(on_right))
    copies = copies or min(64, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = [F.col(f"`{f.name}`") for f in left.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    salt = F.when(F.col(on_left).isin(hubs), F.pmod(F.xxhash64(*cells), F.lit(copies))).otherwise(0)
    parts = F.when(F.col(on_right).isin(hubs), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    a, b = left.withColumn(f"{TMP}salt", salt), right.withColumn(f"{TMP}part", F.explode(parts))
    return a.join(b, (F.col(on_left) == F.col(on_right)) & (F.col(f"{TMP}salt") == F.col(f"{TMP}part"))).drop(f"{TMP}salt", f"{TMP}part")
