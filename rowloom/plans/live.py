"""Queries that run as streams over the event files until all is read; their results equal those of the batch rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import streaming
from ..operators.base import shared_folder
from .datasets import DAY, WITHIN_SQL
from .registry import query, table


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files as a stream; a pattern stands for one file as well as for a folder of files."""
    return streaming.stream_rows(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema)


def _done(rows: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream has written once all input is read."""
    spark, folder = rows.sparkSession, _folder(rows.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/out")


@query("SELECT user_id, count(*) AS n_rows FROM events GROUP BY user_id")
def stream_rows_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last update of each user's count."""
    updates = _done(streaming.rows_so_far(_events(spark, sf_dir), "user_id"), "update")
    return updates.groupBy("user_id").agg(F.max("n_rows").alias("n_rows"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n_rows FROM events GROUP BY ALL")
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the last update of each hour and kind of event."""
    updates = _done(streaming.throughput(_events(spark, sf_dir), "1 hour", "event_type"), "update")
    return updates.groupBy("window_start", "event_type").agg(F.max("n_rows").alias("n_rows"))


@query(WITHIN_SQL)
def stream_skip_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equals skip_within."""
    folder = _folder(spark)
    streaming.stream_skip_within_to(_events(spark, sf_dir), ["user_id", "event_type"], 10 * DAY, ["ts", "event_id"], f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "event_type")


@query(WITHIN_SQL)
def stream_skip_within_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one number of state for each key, by buckets of keys. The month's events arrive in three slices; the stream starts again for each and goes on from its state."""
    events, folder = table(spark, sf_dir, "events"), _folder(spark)
    days = [None, "2024-01-11", "2024-01-21", None]
    for a, b in zip(days, days[1:], strict=False):
        part = events.where((F.lit(True) if a is None else F.col("ts") >= F.lit(a).cast("timestamp")) & (F.lit(True) if b is None else F.col("ts") < F.lit(b).cast("timestamp")))
        part.write.mode("append").parquet(f"{folder}/in")
        live = streaming.stream_rows(spark, f"{folder}/in", events.schema).select("event_id", "user_id", "event_type", "ts")
        kept = streaming.stream_skip_within(live, ["user_id", "event_type"], 10 * DAY, order=["event_id"]).select("event_id", "user_id", "event_type")
        kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{folder}/out")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def stream_skip_ever(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4."""
    folder = _folder(spark)
    streaming.stream_skip_ever(_events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"], f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "event_type")


@query("""
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS row_idx FROM events)
SELECT event_id, event_type, row_idx, (row_idx - 1) // 10 AS slice_no FROM r
""")
def stream_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of event as a run whose rows arrive in three batches and are delivered ten at a time."""
    events, folder = table(spark, sf_dir, "events"), _folder(spark)
    days = [None, "2024-01-11", "2024-01-21", None]
    for a, b in zip(days, days[1:], strict=False):
        part = events.where((F.lit(True) if a is None else F.col("ts") >= F.lit(a).cast("timestamp")) & (F.lit(True) if b is None else F.col("ts") < F.lit(b).cast("timestamp")))
        part.write.mode("append").parquet(f"{folder}/in")
        live = streaming.stream_rows(spark, f"{folder}/in", events.schema).select("event_id", "event_type", "ts")
        streaming.stream_slices(live, ["ts", "event_id"], ["event_type"], f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out/rows").select("event_id", "event_type", "row_idx", "slice_no")
