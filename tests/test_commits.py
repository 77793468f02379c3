"""Runs that break off between their writes, and slices that go on across batches."""

import datetime as dt

import pytest

from rowloom import sources, streaming
from rowloom.operators import commits, skip

ROWS, KEYS = "n long, k string, ts double", "k string, ts double"


def test_a_run_that_breaks_off_is_repeated_and_loses_nothing(spark, tmp_path, monkeypatch):
    path, runs = str(tmp_path / "program"), [[(1, "a", 1.0), (2, "b", 2.0), (3, "a", 3.0)], [(4, "b", 4.0), (5, "c", 5.0)], [(6, "c", 6.0)]]

    def do(run):
        seen = commits.committed_keys(spark, path, 7, KEYS)
        kept = skip.skip_ever(spark.createDataFrame(runs[run], ROWS), seen, ["k"], ["n"])
        commits.commit_run(kept, ["k"], path, 7, run)

    def visible():
        return sorted((r.n, r.run_id) for r in commits.committed_rows(spark, path, 7, ROWS).collect()), sorted(r.k for r in commits.committed_keys(spark, path, 7, KEYS).collect())

    assert visible() == ([], [])
    for broken in ("publish", "committed_part"):  # after both writes, between them
        with monkeypatch.context() as m:
            m.setattr(commits, broken, lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
            with pytest.raises(RuntimeError):
                do(0)
        assert visible() == ([], [])
    do(0)
    assert visible() == ([(1, 0), (2, 0)], ["a", "b"])
    with monkeypatch.context() as m:
        m.setattr(commits, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            do(1)
    assert visible() == ([(1, 0), (2, 0)], ["a", "b"])
    do(1)
    do(2)  # nothing new: an empty run is complete too
    assert visible() == ([(1, 0), (2, 0), (5, 1)], ["a", "b", "c"])
    assert sorted((r.run_id, r.n_rows, r.n_keys) for r in commits.runs_table(spark, path).collect()) == [(0, 2, 2), (1, 1, 1), (2, 0, 0)]
    # the first run again, with other rows: they replace the old ones at once
    commits.commit_run(spark.createDataFrame([(9, "z", 9.0)], ROWS), ["k"], path, 7, 0)
    assert visible() == ([(5, 1), (9, 0)], ["c", "z"])
    # another program starts with an empty history
    assert commits.committed_keys(spark, path, 8, KEYS).count() == 0
    commits.commit_run(spark.createDataFrame([(1, "q", 1.0)], ROWS), ["k"], path, 8, 0, has_skip=False)
    assert commits.committed_keys(spark, path, 8, KEYS).count() == 0 and commits.committed_rows(spark, path, 8).count() == 1


def test_slices_go_on_across_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, ["a", "b", None][i % 3 if i % 7 else 0], start + dt.timedelta(minutes=i)) for i in range(200)]
    schema, done = "n long, run string, ts timestamp", []
    (tmp_path / "in").mkdir()

    def go(name):
        live = streaming.stream_rows(spark, str(tmp_path / "in"), schema)
        streaming.stream_slices(live, ["ts", "n"], ["run"], str(tmp_path / name), str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()

    for part in (rows[:90], rows[90:91], rows[91:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        go("out")
        done.append(part)
    want = sorted((r.n, r.run or "", r.row_idx, r.slice_no) for r in sources.write_in_slices(spark.createDataFrame(rows, schema), ["ts", "n"], ["run"]).collect())
    read = lambda: sorted((r.n, r.run or "", r.row_idx, r.slice_no) for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect())
    assert read() == want
    # the last batch again: its commit is lost, so the stream runs it once more and writes the same slices
    last = max((tmp_path / "cp-out" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    go("out")
    assert read() == want
