"""Operators on ordered rows give the same by ranges as by windows, also where one key has most rows."""

import random
from collections import Counter

import pytest

from rowloom.operators import base, paging, runs, schedules, skip


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    made = [(i, rng.choice(["hot"] * 6 + ["b", "c", None, f"k{i}"]), rng.choice(["x", "y", None]), rng.random() < 0.6, float(rng.randrange(500))) for i in range(1500)]
    return spark.createDataFrame(made, "n long, k string, v string, failed boolean, t double").cache()


def same(a, b):
    assert Counter(tuple(r) for r in a.select(*b.columns).collect()) == Counter(tuple(r) for r in b.collect())


def test_by_ranges_as_by_windows(rows):
    order = ["t", "n"]
    same(skip.changed_rows(rows, ["k"], ["v"], order, parts=7), skip.changed_rows(rows, ["k"], ["v"], order))
    for split in (1, 7):
        same(skip.skip_last_runs(rows, ["k"], 2, order, "t", since="sighting", parts=split), skip.skip_last_runs(rows, ["k"], 2, order, "t", since="sighting"))
    same(runs.retry_status(rows, ["k"], order, parts=7), runs.retry_status(rows, ["k"], order))
    attempts = rows.withColumnRenamed("failed", "has_new")
    same(paging.list_ended(attempts, ["k"], order, parts=7), paging.list_ended(attempts, ["k"], order))
    timed = rows.selectExpr("k as machine", "n as run_id", "timestamp_seconds(t) as start_ts", "timestamp_seconds(t + n % 40) as end_ts")
    same(schedules.preempt(timed, parts=7), schedules.preempt(timed))
    same(runs.retry_status(rows.limit(0), ["k"], order, parts=3), runs.retry_status(rows.limit(0), ["k"], order))


def test_values_that_are_null(rows):
    """A null value of the row before is a value; only the first row has none."""
    from pyspark.sql import functions as F

    a, b = (base.neighbour(rows, ["k"], ["t", "n"], F.struct("v"), "before", parts=p).select("n", F.col("before").isNull().alias("first"), "before.v") for p in (5, None))
    same(a, b)
    assert a.where("first").count() == rows.select("k").distinct().count()


def test_ranges_spread_a_hot_key(rows):
    from pyspark.sql import functions as F

    out = base.running_sums(rows, ["k"], ["t", "n"], {"s": F.lit(1)}, parts=8)
    assert max(r.s for r in out.where("k = 'hot'").collect()) == rows.where("k = 'hot'").count()
    assert out.columns == [*rows.columns, "s"]
