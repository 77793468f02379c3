"""The greedy rule with keys that several parts share, against a plain loop."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.operators import skip


def loop(rows, limit, before):
    last, want = dict(before), []
    for i, (k, t) in sorted(enumerate(rows), key=lambda x: (x[1][1] is not None, x[1][1] or 0, x[0])):
        k = k or ""
        if t is not None and (k not in last or t - last[k] > limit):
            want.append(i)
            last[k] = t
    return sorted(want)


@pytest.mark.parametrize("few", [0, skip.FEW])
@pytest.mark.parametrize("case", range(8))
def test_against_a_loop(spark, case, few, monkeypatch):
    monkeypatch.setattr(skip, "FEW", few)  # 0: by joins, whatever the number of groups
    rng = random.Random(case)
    n, limit, span = [(3000, 10, 5000), (3000, 100, 5000), (2000, 0.1, 100), (2000, 1000, 5000), (1500, 3, 200), (1500, 0, 50), (5, 3, 50), (2500, 40, 1000)][case]
    rows = [(rng.choice(["a"] * 5 + ["b", "", None, "c"]), None if rng.random() < 0.02 else rng.randrange(span) / (10 if limit == 0.1 else 1)) for _ in range(n)]
    before = {"a": rng.randrange(-50, 600) * 1.0, "zz": 3.0} if case % 2 else {}
    df = spark.createDataFrame([(i, k, None if t is None else float(t)) for i, (k, t) in enumerate(rows)], "i int, k string, t double")
    seen = spark.createDataFrame(list(before.items()), "k string, kept_at double") if before else None
    got = sorted(r.i for r in skip.greedy(df, ["k"], df.t, limit, ["t", "i"], seen, parts=16).collect())
    assert got == loop(rows, limit, before)


def test_a_hot_key_spreads_over_tasks(spark):
    """Half of all rows have one key; no task marks more than a few parts' rows, and chains that never meet are told apart."""
    n = 60_000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))).alias("k"), F.col("id").cast("double").alias("t"))
    out = skip.greedy(df, ["k"], F.col("t"), 1001, ["id"], parts=16)
    per_task = [r["count"] for r in out.withColumn("p", F.spark_partition_id()).where("k = 'hot'").groupBy("p").count().collect()]
    assert len(per_task) >= 7 and max(per_task) <= 3 * np.median(per_task)
    assert sorted(r.id for r in out.where("k = 'hot'").collect()) == list(range(0, n, 1002))


def test_no_job_of_parts_for_keys_within_one(spark):
    df = spark.createDataFrame([(1, "a", 1.0)], "i int, k string, t double")
    assert skip._entries(df.select(F.col("k").alias("_rl_k"), F.col("t").alias("_rl_at"), F.lit(0).alias("_rl_part")), 1, None) == []


def test_times_are_exact(spark):
    """A gap of exactly the period is within it, at any fraction of a second."""
    start = dt.datetime(2024, 1, 1, 0, 0, 0, 100_001)
    rows = [(i, "x", start + dt.timedelta(seconds=0.3) * i) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, k string, ts timestamp")
    assert sorted(r.i for r in skip.skip_within(df, ["k"], 0.9, ["ts"], parts=5).collect()) == list(range(0, 50, 4))
    seen = spark.createDataFrame([("x", 1704067200.100001)], "k string, kept_at double")
    assert min(r.i for r in skip.skip_within(df, ["k"], 0.9, ["ts"], last_kept=seen, parts=5).collect()) == 4
