"""The same rules on live rows: counts so far, throughput, and skip rules with state or history."""

from __future__ import annotations

import itertools
import pickle
import tempfile
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.base import TMP, blank, key, number_rows
from ..operators.base import seconds as seconds_of
from ..operators.skip import skip_ever, skip_within

#: Bytes of frames of a bucket that wait in memory, before a file is made.
SPOOL = 16_000_000


def stream_rows(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Rows of running programs as their slices arrive."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def rows_so_far(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows of each run so far (update or complete mode)."""
    return rows.groupBy(run).agg(F.count("*").alias("n_rows"))


def stream_skip_within(rows: DataFrame, keys: Sequence[str], seconds: float, ts: str = "ts", lateness: str = "1 hour", order: Sequence[str] = (), buckets: int = 1024) -> DataFrame:
    """The greedy rule of skip_within on a stream. The state of a key is one number, the time of its last kept row in microseconds. Keys are dealt out to
    `buckets`, which are decided as a whole (a call of Python for each key costs some milliseconds) and hold the numbers of their keys together; a stream that goes on from a
    checkpoint needs the same number of buckets. An event-time timer evicts a key when no later row can be within the period, so there are as many numbers as keys
    kept within the period and the lateness.

    Within a batch a key's rows are taken in order of time, in whatever order they come. Spark hands them over in frames of spark.sql.execution.arrow.maxRecordsPerBatch rows, and
    ends a frame in the middle of any key; of a bucket in several frames only keys and times are held (sixteen bytes a row), the frames wait in a temporary file. Rows behind
    the watermark and rows without a time are dropped; a row before the last kept one of its key, of an earlier batch, counts as within its period. For batches
    with so many rows of one key that their times are too many for a task see stream_skip_within_to.
    """
    schema, limit = rows.schema, round(seconds * 1_000_000)

    def decide(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, last = [], np.zeros(0, np.int64)
        if state.exists:
            packed, numbers = state.get
            known, last = zlib.decompress(bytes(packed)).decode().split("\n"), np.frombuffer(bytes(numbers), np.int64)
        if not state.hasTimedOut:
            code, codes, times = {k: n for n, k in enumerate(known)}, [], []
            with tempfile.SpooledTemporaryFile(SPOOL) as waiting:
                frame, following = next(frames), next(frames, None)
                for part in itertools.chain([frame], [] if following is None else [following], frames):
                    numbered, names_of = pd.factorize(part[f"{TMP}k"])
                    codes.append(np.array([code.setdefault(k, len(code)) for k in names_of], np.int64)[numbered])
                    times.append(part[ts].to_numpy().astype("datetime64[us]").astype("int64"))
                    if following is not None:
                        pickle.dump(part[names], waiting, pickle.HIGHEST_PROTOCOL)
                ends = np.cumsum([len(c) for c in codes])
                pairs, chosen, last = _greedy(np.concatenate(codes), np.concatenate(times), last, len(code), limit)
                keep, found = np.isin(pairs, chosen), []
                waiting.seek(0)
                for end, size in zip(ends, map(len, codes), strict=True):
                    some = keep[end - size : end]
                    if following is not None:
                        frame = pickle.load(waiting)
                    if some.any():
                        found.append(frame.loc[some, names].assign(**{f"{TMP}pair": pairs[end - size : end][some]}))
                    if sum(map(len, found)) > 2 * len(chosen) + 10_000:
                        found = [first(pd.concat(found))]
            known = list(code)
            if found:
                out = first(pd.concat(found) if len(found) > 1 else found[0])[names]
                yield from (out.iloc[n : n + 10_000] for n in range(0, len(out), 10_000))
        stays = np.flatnonzero(last + limit >= state.getCurrentWatermarkMs() * 1000)
        if len(stays):
            last = last[stays]
            state.update((zlib.compress("\n".join([known[n] for n in stays]).encode(), 1), last.tobytes()))
            state.setTimeoutTimestamp(max((int(last.min()) + limit) // 1000 + 2, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    def first(some: pd.DataFrame) -> pd.DataFrame:
        """Of the rows of a key at a chosen time the first in order."""
        return some if some[f"{TMP}pair"].is_unique else some.sort_values([ts, *order], kind="stable").drop_duplicates(f"{TMP}pair")

    names = rows.columns
    keyed = rows.where(F.col(ts).isNotNull()).withWatermark(ts, lateness).withColumn(f"{TMP}k", F.to_json(key(keys)))
    keyed = keyed.withColumn(f"{TMP}bucket", F.pmod(F.xxhash64(f"{TMP}k"), F.lit(buckets)).cast("int"))
    return keyed.groupBy(f"{TMP}bucket").applyInPandasWithState(decide, schema, "keys binary, kept binary", "append", GroupStateTimeout.EventTimeTimeout)


def _greedy(codes: np.ndarray, at: np.ndarray, last: np.ndarray, n: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy rule for `n` keys at once, of rows with a key's number and a time; `last` has the last kept times of the first keys. The number of each row's pair of
    key and time, the numbers of the kept pairs in order, and the last kept times of all keys."""
    times = np.unique(at)
    width = len(times) + 1
    of_rows = codes * width + np.searchsorted(times, at)
    pairs = np.unique(of_rows)
    key_of, time_of = pairs // width, times[pairs % width]

    def after(c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The first pair of each key more than the limit after its time, or -1."""
        found = np.searchsorted(pairs, c * width + np.searchsorted(times, t + limit, side="right"))
        return np.where(np.append(key_of, -1)[found] == c, found, -1)

    following = after(key_of, time_of)
    some, now = np.unique(key_of, return_index=True)
    old = some < len(last)
    now[old] = after(some[old], last[some[old]])
    now = now[now >= 0]
    keep = np.zeros(len(pairs), bool)
    while len(now):
        keep[now] = True
        now = following[now]
        now = now[now >= 0]
    kept = np.concatenate([last, np.zeros(n - len(last), np.int64)])
    kept[key_of[keep]] = time_of[keep]  # in order of time, so the last one stays
    return of_rows, pairs[keep], kept


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    """The part of the history that a key is in."""
    return F.pmod(F.xxhash64(*[blank(k) for k in keys]), F.lit(buckets)).cast("int")


def _history(batch: DataFrame, number: int, keys: Sequence[str], out: str, buckets: int) -> DataFrame | None:
    """The rows that earlier batches wrote to those buckets that this batch has keys of."""
    if not number:
        return None
    some = [r[0] for r in batch.select(_bucket(keys, buckets)).distinct().collect()]  # at most `buckets` numbers
    schema = T.StructType([*batch.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])
    return batch.sparkSession.read.schema(schema).parquet(out).where(F.col("bucket").isin(some) & (F.col("batch") < number))


def _append(kept: DataFrame, number: int, keys: Sequence[str], out: str, buckets: int) -> None:
    tagged = kept.withColumns({"bucket": _bucket(keys, buckets), "batch": F.lit(number).cast("long")})
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(out)


def stream_skip_within_to(rows: DataFrame, keys: Sequence[str], seconds: float, order: Sequence[str], out: str, checkpoint: str, ts: str = "ts", buckets: int = 64):
    """T3 for batches of any size: each batch goes through the greedy rule of skip_within, which thins and streams sorted
    rows and collects no key. The last kept time of each key comes from the rows that earlier batches wrote.

    Rows are kept by bucket of their key and by batch, so a batch reads the history of its own buckets only; it writes
    under its own number and reads only smaller ones, so a batch that is run again
    gives the same rows once. No row is dropped as late: one before the last kept row of its key is within the period.
    """

    def one(batch: DataFrame, number: int) -> None:
        seen = _history(batch, number, keys, out, buckets)
        last = None if seen is None else seen.groupBy(*[blank(k).alias(k) for k in keys]).agg(F.max(seconds_of(ts)).alias("kept_at"))
        _append(skip_within(batch, keys, seconds, order, ts, last_kept=last), number, keys, out, buckets)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def stream_skip_ever(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, checkpoint: str, buckets: int = 64):
    """T4: each batch against the keys kept by earlier batches, which grow in the table `out` and not in memory.

    The table has one row for each key, by bucket of the key and by batch: a batch reads the keys of its own buckets only. It
    writes under its own number and reads only smaller ones, so a batch that is run again gives the same rows once.
    """

    def one(batch: DataFrame, number: int) -> None:
        _append(skip_ever(batch, _history(batch, number, keys, out, buckets), keys, order), number, keys, out, buckets)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def stream_slices(rows: DataFrame, order: Sequence[str], by: Sequence[str], out: str, checkpoint: str, batch_size: int = 10):
    """Rows as they arrive, numbered within each run (`by`) across all batches, and delivered in slices of `batch_size`.

    A batch's rows are numbered in `order` (as write_in_slices does, over ranges) and go on from the run's high mark. The rows and the new marks are kept by the
    batch's number, and a batch reads the marks of the batch before it alone, so a batch that is run again writes the same slices again: out/rows has row_idx,
    slice_no and batch, out/marks one row for each run and batch. When rows arrive in `order`, batch by batch, numbers are those of write_in_slices.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fields = [batch.schema[c] for c in by]
        schema = T.StructType([*fields, T.StructField("high", T.LongType())])
        before = spark.read.schema(schema).parquet(f"{out}/marks/batch={number - 1}") if number else spark.createDataFrame([], schema)
        old = before.select(*[F.col(c).alias(f"{TMP}{i}") for i, c in enumerate(by)], F.col("high").alias(f"{TMP}high"))
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{TMP}{i}")) for i, c in enumerate(by)], F.lit(True))
        high = F.coalesce(F.col(f"{TMP}high"), F.lit(0))
        numbered = number_rows(batch, order, by).join(old, same, "left").withColumn("row_idx", F.col("row_idx") + high)
        numbered = numbered.withColumn("slice_no", F.floor((F.col("row_idx") - 1) / batch_size).cast("long")).select(*[c for c in batch.columns if c not in ("row_idx", "slice_no")], "row_idx", "slice_no")
        numbered.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        counts = batch.groupBy(*by).agg(F.count("*").alias("high")).unionByName(before)
        counts.groupBy(*by).agg(F.sum("high").alias("high")).write.mode("overwrite").parquet(f"{out}/marks/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def throughput(rows: DataFrame, width: str = "1 hour", run: str = "run_id", ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """T5: rows of each run in each tumbling window."""
    counted = rows.withWatermark(ts, lateness).groupBy(F.window(ts, width), run).agg(F.count("*").alias("n_rows"))
    return counted.select(F.col("window.start").alias("window_start"), run, "n_rows")
