"""Tables that go on over several pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import first_by, running_sums
from .base import seconds as seconds_of

NEXT_NONE, NEXT_BUTTON, NEXT_MORE, NEXT_SCROLL = 1, 2, 3, 4


def _before(rows: DataFrame, relation: Sequence[str], page: str, fn) -> DataFrame:
    """What fn (sum or max) makes of the row counts of a relation's earlier pages; one row a page."""
    counts = rows.groupBy(*relation, page).agg(F.count("*").alias("_rl_n"))
    w = Window.partitionBy(*relation).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*relation, page, F.coalesce(fn("_rl_n").over(w), F.lit(0)).alias("_rl_before"))


def stitch_next(rows: DataFrame, relation: Sequence[str], page: str = "page_no", idx: str = "row_idx") -> DataFrame:
    """G1: each page replaces the last one: position = idx + rows of earlier pages. Only counts are windowed."""
    return rows.join(_before(rows, relation, page, F.sum), [*relation, page]).withColumn("position", F.col(idx) + F.col("_rl_before")).drop("_rl_before")


def stitch_cumulative(rows: DataFrame, relation: Sequence[str], page: str = "page_no", idx: str = "row_idx") -> DataFrame:
    """Each page repeats the rows of those before it: only what goes beyond the longest earlier page is new."""
    return rows.join(_before(rows, relation, page, F.max), [*relation, page]).where(F.col(idx) > F.col("_rl_before")).withColumn("position", F.col(idx)).drop("_rl_before")


def list_ended(attempts: DataFrame, relation: Sequence[str], order: Sequence[str], has_new: str = "has_new", tries: int = 3, parts: int | None = None) -> DataFrame:
    """The attempt at which each list ended: the first that is the `tries`-th in a row without new rows. `parts` splits lists with very many attempts."""
    islands = running_sums(attempts, list(relation), order, {"_rl_island": F.col(has_new).cast("int")}, parts)
    dry = running_sums(islands.where(~F.col(has_new)), [*relation, "_rl_island"], order, {"_rl_nth": F.lit(1)}, parts)
    return first_by(dry.where(F.col("_rl_nth") == tries), list(relation), order).drop("_rl_island", "_rl_nth")


def attempt_timeout(attempts: DataFrame, seconds: float, clicked: str = "ts_click", arrived: str = "ts_rows") -> DataFrame:
    """has_new: rows came within the wait."""
    wait = seconds_of(arrived) - seconds_of(clicked)
    return attempts.withColumn("has_new", F.coalesce(wait <= seconds, F.lit(False)))


def cap_wait(value: Column, default_seconds: float, most: float = 5.0) -> Column:
    """A wait in milliseconds: negative or unreadable is the default, above five seconds is five."""
    seconds = value.try_cast("double")
    return F.when(seconds >= 0, F.least(seconds, F.lit(most))).otherwise(F.lit(default_seconds)) * 1000


def pages_from_url_list(urls: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """The stored pages of a list of URLs."""
    return pages.join(urls.select(F.col(url).alias("url")).distinct(), "url", "left_semi")


def url_argument(url: Column, name: str) -> Column:
    """An argument of the URL's query; null without it."""
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))
