"""Statistics of lists that are groups of rows: no group's values meet in one place."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import TMP, cut, number_rows


def _same(by: Sequence[str], suffix: str) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"{TMP}{suffix}{i}")) for i, c in enumerate(by)], F.lit(True))


def _renamed(df: DataFrame, by: Sequence[str], suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{TMP}{suffix}{i}") for i, c in enumerate(by)], *[c for c in df.columns if c not in by])


def grouped_stats(rows: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """F16 by group: `by`, n, total, low, high, mean, median, spread (of the whole population) and modes.

    Only numbers count (texts are read as numbers; others and nulls are left out); a group without any has n and total 0 and nulls. The median is exact
    and found by selection: values are numbered over ranges of all rows, where only the ranges' counts are summed, and the middle ones are picked. modes are the values that occur most
    often, in the order of their first rows in `order`: values are counted as a plain aggregate, and only the most frequent ones become a list.
    """
    number = F.col(value).try_cast("double")
    plain = rows.groupBy(*by).agg(
        F.count(number).alias("n"), F.coalesce(F.sum(number), F.lit(0.0)).alias("total"), F.min(number).alias("low"), F.max(number).alias("high"), F.avg(number).alias("mean"), F.stddev_pop(number).alias("spread")
    )
    plain = cut(plain)
    values = rows.select(*by, number.alias(f"{TMP}v"), F.struct(*order).alias(f"{TMP}o")).where(F.col(f"{TMP}v").isNotNull())
    numbered = number_rows(values.select(*by, f"{TMP}v"), [f"{TMP}v"], by, out=f"{TMP}i")
    sizes = _renamed(plain.select(*by, F.col("n").alias(f"{TMP}n")), by, "s")
    middle = numbered.join(sizes, _same(by, "s")).where(F.col(f"{TMP}i").isin(F.floor((F.col(f"{TMP}n") + 1) / 2), F.floor(F.col(f"{TMP}n") / 2) + 1))
    medians = _renamed(middle.groupBy(*by).agg(F.avg(f"{TMP}v").alias("median")), by, "m")
    counted = values.groupBy(*by, f"{TMP}v").agg(F.count("*").alias(f"{TMP}c"), F.min(f"{TMP}o").alias(f"{TMP}first"))
    most = _renamed(counted.groupBy(*by).agg(F.max(f"{TMP}c").alias(f"{TMP}most")), by, "t")
    top = counted.join(most, _same(by, "t") & (F.col(f"{TMP}c") == F.col(f"{TMP}most")))
    modes = _renamed(top.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(f"{TMP}first", f"{TMP}v"))), lambda x: x[f"{TMP}v"]).alias("modes")), by, "o")
    out = plain.join(medians, _same(by, "m"), "left").join(modes, _same(by, "o"), "left")
    return out.select(*by, "n", "total", "low", "high", "mean", "median", "spread", F.coalesce("modes", F.array().cast("array<double>")).alias("modes"))
