"""K9: a run's output and its keys become visible together, by one row of the runs table that is written last.

Under one folder stand `output` and `keys`, partitioned by program, run and attempt, and `runs`, one small file for each completed attempt. An attempt
writes its output and its keys under a name of its own, and only then its row of `runs`: to a file beside the folder first, which a
rename, one step for the file system, puts in place. Readers go by that table, so what an attempt wrote before it broke off is never seen,
and doing a run again replaces nothing that readers may be reading; the last completed attempt of a run counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import TMP, blank, first_by

RUNS = "program_id long, run_id long, attempt string, has_skip boolean, n_rows long, n_keys long, committed long"


def write_attempt(kept: DataFrame, keys: Sequence[str], path: str, program_id: int, run_id: int, ts: str = "ts") -> str:
    """Writes the output and the keys of a run, for nobody to see yet; the name of the attempt."""
    attempt = f"a{uuid.uuid4().hex}"
    tags = {"program_id": F.lit(program_id).cast("long"), "run_id": F.lit(run_id).cast("long"), "attempt": F.lit(attempt)}
    parts = ["program_id", "run_id", "attempt"]
    kept.withColumns(tags).write.mode("append").partitionBy(*parts).parquet(f"{path}/output")
    if not _exists(kept.sparkSession, f"{path}/output", program_id, run_id, attempt):
        return attempt  # no rows, no keys
    # keys come from what was written, so both are of the same rows
    written = committed_part(kept.sparkSession, f"{path}/output", program_id, run_id, attempt)
    written.select(*[blank(k).alias(k) for k in keys], F.col(ts), *parts).write.mode("append").partitionBy(*parts).parquet(f"{path}/keys")
    return attempt


def committed_part(spark: SparkSession, path: str, program_id: int, run_id: int, attempt: str) -> DataFrame:
    found = spark.read.option("basePath", path).parquet(f"{path}/program_id={program_id}/run_id={run_id}/attempt={attempt}")
    return found.withColumns({"program_id": F.col("program_id").cast("long"), "run_id": F.col("run_id").cast("long"), "attempt": F.col("attempt").cast("string")})


def publish(spark: SparkSession, path: str, program_id: int, run_id: int, attempt: str, has_skip: bool = True) -> None:
    """Makes an attempt the run's: its row of the runs table, put in place by a rename. An attempt without rows left no files, and counts as 0 rows."""
    n = [_rows_of(spark, f"{path}/{what}", program_id, run_id, attempt) for what in ("output", "keys")]
    before = runs_table(spark, path).where((F.col("program_id") == program_id) & (F.col("run_id") == run_id)).agg(F.max("committed")).first()[0]
    row = (program_id, run_id, attempt, has_skip, *n, (before or 0) + 1)
    beside = f"{path}/_pending-{attempt}"
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("overwrite").parquet(beside)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    fs = hadoop.Path(path).getFileSystem(conf)
    fs.mkdirs(hadoop.Path(f"{path}/runs"))
    file = next(f.getPath() for f in fs.listStatus(hadoop.Path(beside)) if f.getPath().getName().startswith("part-"))
    if not fs.rename(file, hadoop.Path(f"{path}/runs/{program_id}-{run_id}-{attempt}.parquet")):
        raise RuntimeError(f"attempt {attempt} could not be published")
    fs.delete(hadoop.Path(beside), True)


def _exists(spark: SparkSession, path: str, program_id: int, run_id: int, attempt: str) -> bool:
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    folder = hadoop.Path(f"{path}/program_id={program_id}/run_id={run_id}/attempt={attempt}")
    return folder.getFileSystem(conf).exists(folder)


def _rows_of(spark: SparkSession, path: str, program_id: int, run_id: int, attempt: str) -> int:
    return committed_part(spark, path, program_id, run_id, attempt).count() if _exists(spark, path, program_id, run_id, attempt) else 0


def commit_run(kept: DataFrame, keys: Sequence[str], path: str, program_id: int, run_id: int, ts: str = "ts", has_skip: bool = True) -> None:
    """K9: a run's kept rows and their keys, both or none. Doing it again replaces the run."""
    attempt = write_attempt(kept, keys, path, program_id, run_id, ts)
    publish(kept.sparkSession, path, program_id, run_id, attempt, has_skip)


def runs_table(spark: SparkSession, path: str) -> DataFrame:
    """The completed runs, each with its last completed attempt; no rows before the first."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    folder = hadoop.Path(f"{path}/runs")
    if not folder.getFileSystem(conf).exists(folder):
        return spark.createDataFrame([], RUNS)
    return first_by(spark.read.schema(RUNS).parquet(f"{path}/runs"), ["program_id", "run_id"], [F.desc("committed"), "attempt"])


def _visible(spark: SparkSession, path: str, what: str, program_id: int | None, runs: DataFrame, schema: str | None) -> DataFrame:
    good = runs if program_id is None else runs.where(F.col("program_id") == program_id)
    if not good.where("n_rows > 0").limit(1).count():
        if schema is None:
            raise ValueError("no run is complete yet: give the columns")
        return spark.createDataFrame([], f"{schema}, program_id long, run_id long")
    found = spark.read.parquet(f"{path}/{what}")
    found = found.withColumns({"program_id": F.col("program_id").cast("long"), "run_id": F.col("run_id").cast("long"), "attempt": F.col("attempt").cast("string")})
    found = found if program_id is None else found.where(F.col("program_id") == program_id)
    marked = good.select("program_id", "run_id", F.col("attempt").alias(f"{TMP}a"))
    return found.join(marked, (found.program_id == marked.program_id) & (found.run_id == marked.run_id) & (found.attempt == F.col(f"{TMP}a")), "left_semi").drop("attempt")


def committed_rows(spark: SparkSession, path: str, program_id: int | None = None, schema: str | None = None) -> DataFrame:
    """The output of all complete runs. `schema` is that of the empty result before the first run."""
    return _visible(spark, path, "output", program_id, runs_table(spark, path), schema)


def committed_keys(spark: SparkSession, path: str, program_id: int, schema: str | None = None) -> DataFrame:
    """K8: the history of a program: the keys of its complete runs that had a skip block."""
    return _visible(spark, path, "keys", program_id, runs_table(spark, path).where("has_skip"), schema)
