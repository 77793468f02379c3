"""Overlapping runs of very different lengths against all pairs."""

import datetime as dt
import random
from collections import Counter

import pytest


from rowloom.operators import schedules

SCHEMA = "machine string, run_id long, start_ts timestamp, end_ts timestamp"
START = dt.datetime(2020, 1, 1)


def runs(n, seed, longest=3 * 365 * 86400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a = START + dt.timedelta(seconds=rng.choice([0, 3600, rng.uniform(-1e8, 1e8)]))
        length = rng.choice([0, 1e-6, 1, 60, 3600, rng.uniform(0, 86400), rng.uniform(0, longest)])
        rows.append((rng.choice(["m", "m", "n", None]), k // 2 if k < 6 else k, a if rng.random() > 0.03 else None, a + dt.timedelta(seconds=length)))
    return rows


@pytest.mark.parametrize(("n", "cell"), [(150, None), (150, 3600), (150, 0.5), (3, None), (0, None)])
def test_against_all_pairs(spark, n, cell):
    rows = runs(n, n)
    want = Counter()
    for i, (m, r, a, b) in enumerate(rows):
        for m2, r2, a2, b2 in rows[i + 1 :]:
            if m is not None and m == m2 and r != r2 and None not in (a, a2) and a < b and a2 < b2 and a < b2 and a2 < b:
                want[(m, min(r, r2), max(r, r2), max(a, a2), min(b, b2))] += 1
    got = Counter(tuple(r) for r in schedules.overlapping_runs(spark.createDataFrame(rows, SCHEMA), cell_seconds=cell).collect())
    assert got == want and (len(want) > 400) == (n > 100)


def test_rows_exchanged_grow_with_the_logarithm(spark):
    """Years and seconds together: a run takes two pieces a level at most, not one for each hour."""
    rows = [("m", k, START + dt.timedelta(minutes=k), START + dt.timedelta(minutes=k, seconds=20 if k % 100 else 5 * 365 * 86400)) for k in range(2000)]
    df = schedules.overlapping_runs(spark.createDataFrame(rows, SCHEMA))
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert df.count() == sum(2000 - k - 1 for k in range(0, 2000, 100))
