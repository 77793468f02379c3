"""The skip rule on streams whose batches hold very many rows of one key."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest

from rowloom import streaming
from rowloom.operators import skip
from rowloom.plans import live

SCHEMA = "n long, k string, ts timestamp"


def stream(spark, path, folder, **options):
    live_rows = streaming.stream_rows(spark, path, SCHEMA, **options)
    streaming.stream_skip_within_to(live_rows, ["k"], 3600, ["ts", "n"], f"{folder}/out", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return {r.n for r in spark.read.parquet(f"{folder}/out").collect()}


@pytest.mark.parametrize("options", [{}, {"files_per_trigger": 1}])
def test_equals_the_batch_rule(spark, tmp_path, options):
    rng = np.random.default_rng(2)
    start = dt.datetime(2024, 1, 1)
    minutes = np.sort(rng.integers(0, 4000, 300))
    for part in range(3):
        some = [(i, [None, "", "a", "b"][i % 4], start + dt.timedelta(minutes=int(minutes[i]))) for i in range(100 * part, 100 * part + 100)]
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their times
    want = {r.n for r in skip.skip_within(spark.read.parquet(str(tmp_path / "in")), ["k"], 3600, ["ts", "n"]).collect()}
    assert stream(spark, str(tmp_path / "in"), tmp_path / "live", **options) == want and len(want) > 60


def test_the_query_collects_no_key(spark, tmp_path, monkeypatch):
    """The registered query goes without the stateful rule, which holds a key's rows of a batch at once."""

    def never(*_, **__):
        raise AssertionError("collects a key")

    monkeypatch.setattr(pd, "concat", never)
    monkeypatch.setattr(streaming, "stream_skip_within", never)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, 1, "view", start + dt.timedelta(hours=i)) for i in range(500)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r.event_id for r in live.stream_skip_within(spark, str(tmp_path)).collect()) == [0, 241, 482]
