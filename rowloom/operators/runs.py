"""Runs, workers and failures, as data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import blank, first_by, key, micros, running_sums
from .base import seconds as seconds_of
from .skip import skip_ever


def slice_of(keys: Sequence[str], n: int) -> Column:
    """The worker (0 to n - 1) that a key falls to: the first 60 bits of the md5 of its cells, joined by unit separators, modulo n."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[blank(k) for k in keys])), 1, 15), 16, 10).cast("long"), F.lit(n)).cast("int")


def hash_slice(rows: DataFrame, keys: Sequence[str], n: int, i: int) -> DataFrame:
    """Worker i's share of the rows; the shares of 0 to n - 1 are disjoint and cover all."""
    return rows.where(slice_of(keys, n) == i)


def claim_first(attempts: DataFrame, keys: Sequence[str], run: str = "run_id", claim: str = "claim_ts", worker: str = "worker") -> DataFrame:
    """One worker for each object of a run: the first claim, ties by worker."""
    return first_by(attempts, [F.col(run), *[blank(k) for k in keys]], [claim, worker])


def merge_workers(parts: Sequence[DataFrame], keys: Sequence[str], run: str = "run_id", claim: str = "claim_ts", worker: str = "worker") -> DataFrame:
    """The rows that several workers wrote under one run id, each object once."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return claim_first(rows, keys, run, claim, worker)


def run_summary(rows: DataFrame, program: str = "program_id", run: str = "run_id", ts: str = "ts") -> DataFrame:
    """For each run its rows and milliseconds from first to last row, and its program's rows in all runs."""
    by_run = rows.groupBy(program, run).agg(F.count("*").alias("n_rows"), (micros(F.max(ts)) - micros(F.min(ts))).alias("_rl_us"))
    return by_run.select(program, run, "n_rows", F.floor(F.col("_rl_us") / 1000).cast("long").alias("scrape_ms"), F.sum("n_rows").over(Window.partitionBy(program)).alias("dataset_length"))


def straggler_cutoff(workers: DataFrame, seconds: float = 1200, run: str = "run_id", end: str = "end_ts") -> DataFrame:
    """Cut: the worker ended more than the cut-off after its run's first; cut_at: where it would have been stopped."""
    limit = F.min(seconds_of(end)).over(Window.partitionBy(run)) + F.lit(float(seconds))
    late = seconds_of(end) > limit
    return workers.withColumns({"cut": F.coalesce(late, F.lit(False)), "cut_at": F.when(late, F.timestamp_micros((limit * 1e6).cast("long")))})


def time_budget(runs: DataFrame, hours: float, machines: str = "machines", taken: str = "seconds") -> DataFrame:
    """Each machine's share of the hours, in seconds, and whether the run took longer."""
    share = F.lit(hours * 3600) / F.col(machines)
    return runs.withColumns({"budget_s": share, "timed_out": F.col(taken) > share})


def retry_status(attempts: DataFrame, worker: Sequence[str], order: Sequence[str], failed: str = "failed", parts: int | None = None) -> DataFrame:
    """Failures in a row up to each attempt, and what follows: ok, retry (below 3), new_driver (below 10), give_up. `parts` splits workers with very many attempts."""
    islands = running_sums(attempts, list(worker), order, {"_rl_island": (~F.col(failed)).cast("int")}, parts)
    counted = running_sums(islands, [*worker, "_rl_island"], order, {"failures": F.col(failed).cast("int")}, parts)
    status = F.when(~F.col(failed), "ok").when(F.col("failures") < 3, "retry").when(F.col("failures") < 10, "new_driver").otherwise("give_up")
    return counted.withColumn("status", status).drop("_rl_island")


def parse_run_name(name: Column) -> dict[str, Column]:
    """Program, threads, mode, variant, location and round of a run's name; null where a name has none."""
    some = lambda c: F.when(c != "", c)
    plain = r"^(.*?)_(\d+)_(?:noprofile_)?(.*)$"
    tagged = r"^(.*?)\+(.*)\+loc(\d+)\+run(\d+)$"
    is_tagged = F.rlike(name, F.lit(tagged))
    return {
        "program": F.when(is_tagged, F.regexp_extract(name, tagged, 1)).otherwise(F.coalesce(some(F.regexp_extract(name, plain, 1)), name)),
        "threads": F.when(~is_tagged, some(F.regexp_extract(name, plain, 2)).cast("int")),
        "mode": F.when(~is_tagged, some(F.regexp_extract(name, plain, 3))),
        "variant": F.when(is_tagged, F.regexp_extract(name, tagged, 2)),
        "location": some(F.regexp_extract(name, tagged, 3)).cast("int"),
        "round": some(F.regexp_extract(name, tagged, 4)).cast("int"),
    }


def speedup(runs: DataFrame, program: str = "program", workers: str = "n", seconds: str = "seconds") -> DataFrame:
    """Mean time by number of workers, and the time of one worker divided by it; null without a run of one worker."""
    mean = runs.groupBy(program, workers).agg(F.avg(seconds).alias("mean_s"))
    one = F.max(F.when(F.col(workers) == 1, F.col("mean_s"))).over(Window.partitionBy(program))
    return mean.withColumn("speedup", one / F.col("mean_s"))


def recovery_compare(runs: DataFrame, variants: Sequence[str] = ("naive", "skip", "ideal_skip", "ideal"), ideal: str = "ideal") -> DataFrame:
    """Mean seconds over the rounds of each program and error location, by variant, and their ratios to the ideal."""
    means = runs.groupBy("program", "location").pivot("variant", list(variants)).agg(F.avg("seconds"))
    return means.withColumns({f"{v}_ratio": F.col(v) / F.col(ideal) for v in variants if v != ideal})


def recovery_work(rows: DataFrame, error: Column | Sequence[int], by: Sequence[str], keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """After an error at a loop position: rows that a plain restart does again, and rows that remain; objects committed before it, which a skip block leaves out."""
    at = error if isinstance(error, Column) else F.array(*[F.lit(int(x)) for x in error])
    before = F.col(pos) < at
    return rows.groupBy(*by).agg(F.sum(before.cast("long")).alias("redone"), F.sum((~before).cast("long")).alias("remaining"), F.count_distinct(F.when(before, key(keys))).alias("skipped_objects"))


def resume(rows: DataFrame, committed: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows still to do: committed objects are not done again."""
    return skip_ever(rows, committed, keys, order)


def with_run_names(runs: DataFrame, name: str = "name") -> DataFrame:
    parsed: Mapping[str, Column] = parse_run_name(F.col(name))
    return runs.withColumns(dict(parsed))
