"""Queries on runs, workers, failures and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations, runs, schedules
from .registry import query, table


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


@query("""
SELECT CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT % 8 AS INTEGER) AS worker, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY 1
""")
def hash_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of eight workers."""
    orders = table(spark, sf_dir, "orders").withColumn("worker", runs.slice_of(["o_orderkey"], 8))
    return orders.groupBy("worker").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT % 8 = 3")
def hash_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fourth of eight workers does."""
    return runs.hash_slice(table(spark, sf_dir, "orders"), ["o_orderkey"], 8, 3).select("o_orderkey", "o_custkey")


@query("SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_type, event_id) = 1")
def claim_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as objects, kinds of events as workers; the first claim of a day."""
    claims = _by_day(spark, sf_dir).withColumn("worker", F.struct("event_type", "event_id"))
    return runs.claim_first(claims, ["user_id"], run="day", claim="ts").select("event_id", "user_id", "day")


@query("""
SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events
QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_type, event_id) = 1
""")
def merge_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of three workers under one run a day; several workers have the same users."""
    rows = _by_day(spark, sf_dir).withColumn("worker", F.struct("event_type", "event_id"))
    parts = [rows.where(F.col("event_id") % 3 == w) for w in range(3)]
    return runs.merge_workers(parts, ["user_id"], run="day", claim="ts").select("event_id", "user_id", "day")


@query("""
WITH r AS (SELECT event_type AS program, CAST(ts AS DATE) AS day, count(*) AS n_rows, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS scrape_ms FROM events GROUP BY ALL)
SELECT *, CAST(sum(n_rows) OVER (PARTITION BY program) AS BIGINT) AS dataset_length FROM r
""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as programs, days as runs."""
    return runs.run_summary(_by_day(spark, sf_dir).withColumnRenamed("event_type", "program"), "program", "day")


@query("""
WITH w AS (SELECT CAST(ts AS DATE) AS day, user_id, max(ts) AS end_ts FROM events GROUP BY ALL), m AS (SELECT *, min(end_ts) OVER (PARTITION BY day) + INTERVAL 20 HOUR AS cut_limit FROM w)
SELECT day, user_id, end_ts > cut_limit AS cut, CASE WHEN end_ts > cut_limit THEN cut_limit END AS cut_at FROM m
""")
def straggler_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as workers that end with their last event of the day; cut twenty hours after the first."""
    workers = _by_day(spark, sf_dir).groupBy("day", "user_id").agg(F.max("ts").alias("end_ts"))
    return runs.straggler_cutoff(workers, 20 * 3600, run="day").select("day", "user_id", "cut", "cut_at")


@query("SELECT n_nationkey, 23.0 * 3600 / (n_regionkey + 1) AS budget_s, n_nationkey * 3600 > 23.0 * 3600 / (n_regionkey + 1) AS timed_out FROM nation")
def time_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """23 hours over some machines."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") + 1).alias("machines"), (F.col("n_nationkey") * 3600).alias("seconds"))
    return runs.time_budget(rows, 23).select("n_nationkey", "budget_s", "timed_out")


@query("""
WITH i AS (SELECT *, sum(CASE WHEN event_type IN ('error', 'view', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
n AS (SELECT *, CAST(sum(CASE WHEN event_type IN ('error', 'view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS failures FROM i)
SELECT event_id, failures, CASE WHEN event_type NOT IN ('error', 'view', 'click') THEN 'ok' WHEN failures < 3 THEN 'retry' WHEN failures < 10 THEN 'new_driver' ELSE 'give_up' END AS status FROM n
""")
def retry_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of events as failures."""
    attempts = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type").isin("error", "view", "click"))
    return runs.retry_status(attempts, ["user_id"], ["ts", "event_id"]).select("event_id", "failures", "status")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'shop' ELSE 'orders' END AS program, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_custkey % 97 AS INTEGER) END AS threads,
  CASE o_orderstatus WHEN 'O' THEN 'lockBased' WHEN 'P' THEN 'distributed_lockBased' END AS mode, CASE WHEN o_orderstatus = 'F' THEN 'escope' END AS variant,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey % 3 AS INTEGER) END AS location, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 5 AS INTEGER) END AS round
FROM orders
""")
def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all three forms, read back."""
    workers, place, turn = ((F.col(c) % n).cast("string") for c, n in (("o_custkey", 97), ("o_custkey", 3), ("o_orderkey", 5)))
    name = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("orders_"), workers, F.lit("_noprofile_lockBased"))).when(F.col("o_orderstatus") == "P", F.concat(F.lit("orders_"), workers, F.lit("_distributed_lockBased")))
    name = name.otherwise(F.concat(F.lit("shop+escope+loc"), place, F.lit("+run"), turn))
    return runs.with_run_names(table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))).drop("name")


@query("""
WITH m AS (SELECT l_returnflag AS program, l_linenumber AS n, avg(l_extendedprice) AS mean_s FROM lineitem GROUP BY ALL)
SELECT program, n, round(mean_s, 3) AS mean_s, round(max(CASE WHEN n = 1 THEN mean_s END) OVER (PARTITION BY program) / mean_s, 6) AS speedup FROM m
""")
def speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as numbers of workers, prices as seconds."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("program"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("seconds"))
    return runs.speedup(rows).select("program", "n", F.round("mean_s", 3).alias("mean_s"), F.round("speedup", 6).alias("speedup"))


@query("""
WITH v AS (SELECT event_type AS program, dayofweek(ts) + 1 AS location, CASE WHEN hour(ts) < 6 THEN 'naive' WHEN hour(ts) < 12 THEN 'skip' WHEN hour(ts) < 18 THEN 'ideal_skip' ELSE 'ideal' END AS variant, value AS seconds FROM events),
m AS (SELECT program, location, avg(CASE WHEN variant = 'naive' THEN seconds END) AS naive, avg(CASE WHEN variant = 'skip' THEN seconds END) AS skip, avg(CASE WHEN variant = 'ideal_skip' THEN seconds END) AS ideal_skip, avg(CASE WHEN variant = 'ideal' THEN seconds END) AS ideal FROM v GROUP BY ALL)
SELECT program, CAST(location AS INTEGER) AS location, round(naive, 6) AS naive, round(skip, 6) AS skip, round(ideal_skip, 6) AS ideal_skip, round(ideal, 6) AS ideal, round(naive / ideal, 6) AS naive_ratio, round(skip / ideal, 6) AS skip_ratio, round(ideal_skip / ideal, 6) AS ideal_skip_ratio FROM m
""")
def recovery_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays as error locations, times of day as variants."""
    hour = F.hour("ts")
    variant = F.when(hour < 6, "naive").when(hour < 12, "skip").when(hour < 18, "ideal_skip").otherwise("ideal")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("program"), F.dayofweek("ts").alias("location"), variant.alias("variant"), F.col("value").alias("seconds"))
    return (df := runs.recovery_compare(rows)).select("program", "location", *[F.round(c, 6).alias(c) for c in df.columns if c not in ("program", "location")])


@query("""
SELECT l_returnflag, CAST(sum(CASE WHEN (l_orderkey, l_linenumber) < (500, 3) THEN 1 ELSE 0 END) AS BIGINT) AS redone, CAST(sum(CASE WHEN (l_orderkey, l_linenumber) < (500, 3) THEN 0 ELSE 1 END) AS BIGINT) AS remaining,
  count(DISTINCT CASE WHEN (l_orderkey, l_linenumber) < (500, 3) THEN l_partkey END) AS skipped_objects
FROM lineitem GROUP BY l_returnflag
""")
def recovery_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error at order 500, line 3."""
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", F.array(F.col("l_orderkey").cast("int"), "l_linenumber"))
    return runs.recovery_work(rows, [500, 3], ["l_returnflag"], ["l_partkey"])


@query("""
WITH cur AS (SELECT DISTINCT o_orderpriority AS schedule, o_custkey AS prog_id FROM orders), act AS (SELECT DISTINCT o_orderpriority AS schedule, c_custkey AS prog_id FROM customer, (SELECT DISTINCT o_orderpriority FROM orders) WHERE c_nationkey % 5 = ascii(o_orderpriority) % 5)
SELECT schedule, prog_id, 'start' AS action FROM (SELECT * FROM cur EXCEPT SELECT * FROM act) UNION ALL SELECT schedule, prog_id, 'cancel' FROM (SELECT * FROM act EXCEPT SELECT * FROM cur)
""")
def schedule_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: priorities as schedules, customers as programs; orders are wanted, and by nation each customer's one schedule is active."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("schedule"), F.col("o_custkey").alias("prog_id"))
    names = wanted.select("schedule", (F.ascii("schedule") % 5).alias("n")).distinct()
    active = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("prog_id"), (F.col("c_nationkey") % 5).alias("n")).join(names, "n").select("schedule", "prog_id")
    return schedules.schedule_diff(wanted, active)


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 60).cast("long") * 1_000_000)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("machine"), F.col("ts").alias("start_ts"), end.alias("end_ts"))


_INTERVALS = "WITH e AS (SELECT event_id AS run_id, user_id AS machine, ts AS start_ts, ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS end_ts FROM events)"


@query(f"""
{_INTERVALS}
SELECT a.machine, a.run_id AS run_a, b.run_id AS run_b, greatest(a.start_ts, b.start_ts) AS from_ts, least(a.end_ts, b.end_ts) AS to_ts
FROM e a JOIN e b ON a.machine = b.machine AND a.run_id < b.run_id AND a.start_ts < b.end_ts AND b.start_ts < a.end_ts AND a.start_ts < a.end_ts AND b.start_ts < b.end_ts
""")
def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: events as runs of some minutes, users as machines."""
    return schedules.overlapping_runs(_intervals(spark, sf_dir))


@query(f"""
{_INTERVALS}, n AS (SELECT *, lead(start_ts) OVER (PARTITION BY machine ORDER BY start_ts, run_id) AS next_ts FROM e)
SELECT run_id, machine, least(end_ts, next_ts) AS stopped_at, coalesce(next_ts < end_ts, false) AS preempted FROM n
""")
def preempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3."""
    return schedules.preempt(_intervals(spark, sf_dir)).select("run_id", "machine", "stopped_at", "preempted")


@query("""
SELECT user_id, CAST(floor(value) AS BIGINT) AS n_rows, event_id AS seq FROM events WHERE value >= 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(value) DESC, event_id DESC) = 1
""")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as candidate tables of each user, their whole values as lengths."""
    rows = table(spark, sf_dir, "events").select("user_id", F.floor("value").alias("n_rows"), F.col("event_id").alias("seq"))
    return relations.best_candidate(rows, ["user_id"])


@query("""
WITH r AS (SELECT o_custkey AS machine, o_orderkey AS run_id, epoch_us(o_orderdate) AS a, epoch_us(o_orderdate) + 1000000 * CAST(floor(power(o_totalprice / 500000, 6) * 31536000) AS BIGINT) AS b FROM orders)
SELECT x.machine, x.run_id AS run_a, y.run_id AS run_b, (least(x.b, y.b) - greatest(x.a, y.a)) // 1000000 AS seconds FROM r x JOIN r y ON x.machine = y.machine AND x.run_id < y.run_id AND x.a < y.b AND y.a < x.b AND x.a < x.b AND y.a < y.b
""")
def overlaps_of_long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: orders as runs on their customer's machine, from a second to years."""
    length = F.floor(F.pow(F.col("o_totalprice") / 500000, 6) * 31536000).cast("long")
    start = F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("machine"), F.col("o_orderkey").alias("run_id"), start.alias("start_ts"), F.timestamp_micros(F.unix_micros(start) + length * 1_000_000).alias("end_ts"))
    found = schedules.overlapping_runs(rows)
    return found.select("machine", "run_a", "run_b", F.floor((F.unix_micros("to_ts") - F.unix_micros("from_ts")) / 1_000_000).alias("seconds"))
