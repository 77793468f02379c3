"""Nested loops over linked pages, and the rows that they output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import blank, first_by, hub_join


def normal_url(url: Column) -> Column:
    """A URL as join key: without fragment and trailing slash, scheme and host in lower case; null stays null."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.regexp_replace(F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare))), r"/(?=$|\?)", "")


def nested_loop(parent: DataFrame, child: DataFrame, link: str, url: str, as_url: bool = True, hub_share: float | None = None) -> DataFrame:
    """Each parent row with each row of the page that its link opens; parents without children give nothing.

    An equi-join on one key made before the exchange; adaptive execution splits hub pages. With `hub_share`, pages that this share of all
    parents or more link to are found first, by a pass over the links, and their parents spread over tasks (`hub_join`). `as_url`
    false compares the cells as they are (ids). Columns that both sides have keep the parent's value.
    """
    norm = normal_url if as_url else (lambda c: c)
    left = parent.withColumn("_rl_link", norm(F.col(link)))
    right = child.select(norm(F.col(url)).alias("_rl_url"), *[c for c in child.columns if c not in parent.columns])
    joined = hub_join(left, right, "_rl_link", "_rl_url", hub_share) if hub_share else left.join(right, F.col("_rl_link") == F.col("_rl_url"))
    return joined.drop("_rl_link", "_rl_url")


def add_position(rows: DataFrame, idx: str, pos: str = "pos") -> DataFrame:
    """One more loop level: its index goes to the end of `pos` (array<int>)."""
    level = F.array(F.col(idx).cast("int"))
    return rows.withColumn(pos, F.concat(F.col(pos), level) if pos in rows.columns else level)


def drop_relation(rows: DataFrame, parent: Sequence[str], order: Sequence[str]) -> DataFrame:
    """No loop at this level: only the first row under each parent."""
    return first_by(rows, list(parent), list(order))


def drive_by_uploaded_table(table: DataFrame, pages: DataFrame, column: str, demonstrated: str, order: Sequence[str]) -> DataFrame:
    """The uploaded rows with the stored page of each row's URL. The first row's cell has to be the demonstrated one."""
    first = table.orderBy(*order).select(column).first()
    if first is None or first[0] != demonstrated:
        raise ValueError(f"the first row of the table has {first[0] if first else None!r}, not the demonstrated {demonstrated!r}")
    return nested_loop(table, pages.withColumnRenamed("url", "page_url"), column, "page_url")


def parameterize(template: Column, demonstrated: str, value: Column) -> Column:
    """The row's value in place of the demonstrated one."""
    return F.replace(template, F.lit(demonstrated), blank(value)) if demonstrated else template


def build_query(value: Column, suffix: str) -> Column:
    """J6."""
    return F.concat(blank(value), F.lit(suffix))


def output_row(rows: DataFrame, cells: Sequence[str | Column] | Mapping[str, str | Column]) -> DataFrame:
    """The output cells in their declared order."""
    if isinstance(cells, Mapping):
        return rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cells.items()])
    return rows.select(*cells)


def row_order(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Loop order, outer to inner; a global sort, for export only."""
    return rows.orderBy(pos)


def unstored_links(rows: DataFrame, pages: DataFrame, link: str, url: str, as_url: bool = True) -> DataFrame:
    """Rows whose link opens no stored page; rows without a link too."""
    norm = normal_url if as_url else (lambda c: c)
    return rows.join(pages.select(norm(F.col(url)).alias("_rl_url")).distinct(), norm(F.col(link)) == F.col("_rl_url"), "left_anti")


def linked_pages(pages: DataFrame, rows: DataFrame, link: str, url: str, linked: bool = True, as_url: bool = True) -> DataFrame:
    """Stored pages that some row links to, or (`linked` false) none."""
    norm = normal_url if as_url else (lambda c: c)
    return pages.join(rows.select(norm(F.col(link)).alias("_rl_link")).distinct(), norm(F.col(url)) == F.col("_rl_link"), "left_semi" if linked else "left_anti")


def positions(rows: DataFrame, parent: Sequence[str], order: Sequence[str], out: str = "idx") -> DataFrame:
    """A row's number from 1 under its parent."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*parent).orderBy(*order)).cast("int"))
