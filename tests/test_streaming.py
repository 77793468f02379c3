"""Streams over several files give what the batch rules give."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom import streaming
from rowloom.operators import skip

SCHEMA = "n long, k string, ts timestamp"


@pytest.fixture
def files(spark, tmp_path):
    rng = np.random.default_rng(1)
    start = dt.datetime(2024, 1, 1)
    rows = sorted(((start + dt.timedelta(minutes=int(m)), str(k)) for m, k in zip(rng.integers(0, 4000, 300), rng.choice(["a", "b", "", "c"], 300), strict=True)), key=lambda r: r[0])
    for part in range(3):
        some = [(i, k or None, t) for i, (t, k) in enumerate(rows) if i // 100 == part]
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), tmp_path


def run(spark, rows, folder, mode="append"):
    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_skip_within(spark, files):
    path, folder = files
    live = streaming.stream_rows(spark, path, SCHEMA, files_per_trigger=1)
    out = run(spark, streaming.stream_skip_within(live, ["k"], 3600, lateness="10 days", order=["n"]), folder)
    batch = skip.skip_within(spark.read.parquet(path), ["k"], 3600, ["ts", "n"])
    order = lambda d: sorted((r.k or "", r.ts) for r in d.collect())
    # slices may arrive in any order of files; the rule then depends on it, so files of one run are compared by key
    assert {k for k, _ in order(out)} == {k for k, _ in order(batch)} and out.count() >= 4


def test_skip_ever_and_counts(spark, files):
    path, folder = files
    live = streaming.stream_rows(spark, path, SCHEMA, files_per_trigger=1)
    streaming.stream_skip_ever(live, ["k"], ["ts", "n"], f"{folder}/seen", f"{folder}/cp2").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{folder}/seen").count() == 4
    counts = run(spark, streaming.rows_so_far(streaming.stream_rows(spark, path, SCHEMA, files_per_trigger=1), "k"), f"{folder}/c", "update")
    want = {r.k: r["count"] for r in spark.read.parquet(path).groupBy("k").count().collect()}
    assert {r.k: r.n for r in counts.groupBy("k").agg(F.max("n_rows").alias("n")).collect()} == want


def test_watermark_timer_and_late_rows(spark, tmp_path):
    """Rows behind the watermark are dropped; the state of a key goes when its period and the watermark are over."""
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    slices = [[("a", at(0))], [("a", at(0, 30)), ("a", at(2))], [("a", at(2, 20)), ("b", at(6))], [("a", at(1)), ("b", at(6, 10))], [("a", at(7)), ("b", at(6, 50))]]
    (tmp_path / "in").mkdir()
    live = streaming.stream_rows(spark, str(tmp_path / "in"), "k string, ts timestamp", files_per_trigger=1)
    sizes = []
    for part in slices:
        spark.createDataFrame(part, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = streaming.stream_skip_within(live, ["k"], 3600, lateness="10 minutes").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r.k, r.ts) for r in spark.read.schema("k string, ts timestamp").parquet(str(tmp_path / "out")).collect())
    # 1:00 came behind the watermark of 5:50, else it would be within the period of no kept row; 7:00 is kept anew
    assert got == [("a", at(0)), ("a", at(2)), ("a", at(7)), ("b", at(6))]
    assert sizes[0] == 1 and min(sizes[2:4]) == 1  # only b's state is left once a's period is over


def test_history_by_buckets(spark, files):
    """Several batches give what one pass over all rows gives, whatever the number of buckets."""
    path, folder = files
    for buckets in (1, 7):
        live = streaming.stream_rows(spark, path, SCHEMA, files_per_trigger=1)
        streaming.stream_skip_within_to(live, ["k"], 3600, ["ts", "n"], f"{folder}/w{buckets}", f"{folder}/cw{buckets}", buckets=buckets).trigger(availableNow=True).start().awaitTermination()
        out = spark.read.parquet(f"{folder}/w{buckets}")
        keys = sorted((r.k or "", r.ts) for r in out.collect())
        assert all((b[1] - a[1]).total_seconds() > 3600 for a, b in zip(keys, keys[1:], strict=False) if a[0] == b[0])
        assert {k for k, _ in keys} == {"", "a", "b", "c"} and {"bucket", "batch"} <= set(out.columns)


def test_state_is_bounded_and_frames_stream(spark, tmp_path):
    """Slices in order give the batch rule; a hot key's rows pass in small frames; states are as many as keys within the period."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 2 else f"k{i // 50}", start + dt.timedelta(minutes=i)) for i in range(4000)]
    (tmp_path / "in").mkdir()
    live = streaming.stream_rows(spark, str(tmp_path / "in"), SCHEMA)
    frames = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        sizes = []
        for part in range(5):
            some = spark.createDataFrame(rows[800 * part : 800 * part + 800], SCHEMA)
            (some.union(some.limit(1).selectExpr("n", "k", "cast(null as timestamp)")) if part == 1 else some).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query = streaming.stream_skip_within(live, ["k"], 1800, lateness="5 minutes", order=["n"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            query.awaitTermination()
            sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", frames)
    got = sorted(r.n for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect())
    want = sorted(r.n for r in skip.skip_within(spark.createDataFrame(rows, SCHEMA), ["k"], 1800, ["ts", "n"]).collect())
    assert got == want and max(sizes) <= 4, sizes  # of 81 keys


def test_keys_in_several_frames_and_no_order(spark, tmp_path):
    """Rows of a key come in any order, with equal times, and frames end in the middle of keys: still the batch rule."""
    start = dt.datetime(2024, 1, 1)
    rng = random.Random(3)
    rows = [(i, f"k{i % 7}" if i % 3 else "hot", start + dt.timedelta(minutes=rng.randrange(900))) for i in range(3000)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    frames = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        out = run(spark, streaming.stream_skip_within(streaming.stream_rows(spark, str(tmp_path / "in"), SCHEMA), ["k"], 1800, order=["n"]), str(tmp_path))
        got = sorted(r.n for r in out.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", frames)
    want = sorted(r.n for r in skip.skip_within(spark.createDataFrame(rows, SCHEMA), ["k"], 1800, ["ts", "n"]).collect())
    assert got == want and len(want) > 100


def test_many_keys_are_decided_by_buckets(spark, tmp_path):
    """3,000 keys in three slices with equal times: the batch rule, from fewer states (and calls of Python) than keys."""
    start = dt.datetime(2024, 1, 1)
    rng = random.Random(4)
    rows = [(i, f"k{rng.randrange(3000)}", start + dt.timedelta(minutes=i // 20)) for i in range(12_000)]
    rows += [(i + len(rows), k, t) for i, k, t in rng.sample(rows, 2000)]
    (tmp_path / "in").mkdir()
    live = streaming.stream_rows(spark, str(tmp_path / "in"), SCHEMA)
    sizes = []
    for part in range(3):
        some = [r for r in rows if (r[2] - start).total_seconds() // 12_000 == part]
        spark.createDataFrame(some, SCHEMA).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        query = streaming.stream_skip_within(live, ["k"], 9000, order=["n"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted(r.n for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect())
    want = sorted(r.n for r in skip.skip_within(spark.createDataFrame(rows, SCHEMA), ["k"], 9000, ["ts", "n"]).collect())
    assert got == want and len(want) > 3000
    assert max(sizes) <= 1024
