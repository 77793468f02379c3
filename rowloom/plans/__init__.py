"""Registered queries over the driver's tables and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cells, datasets, live, pages, programs, workers
from .registry import ORACLES, QUERIES

__all__ = ["cells", "datasets", "live", "pages", "programs", "workers"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
