"""Stored pages, uploaded tables, datasets by run, CSV delivery, catalogue and parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import blank, number_rows


def read_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Stored pages (page_id, url, html); `kind` is parquet, json, or text (one file a page, its path the url)."""
    if kind == "text":
        files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("url"))
        return files.select(F.xxhash64("url").alias("page_id"), "url", F.col("value").alias("html"))
    return spark.read.format(kind).load(path).select("page_id", "url", "html")


def read_uploaded_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV without a header; all cells are text, quoted cells may have newlines and doubled quotes; columns c0, c1, ..."""
    rows = spark.read.csv(path, header=False, inferSchema=False, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", nullValue="\0")
    cells = [blank(c) for c in rows.columns]
    cells[-1] = F.regexp_replace(cells[-1], r"\r\z", "")  # of lines that end with CRLF
    return rows.select(*[c.alias(f"c{k}") for k, c in enumerate(cells)])


def replace_relation(rows: DataFrame, path: str) -> None:
    """S3: new contents under the same name."""
    rows.write.mode("overwrite").parquet(path)


def append_run(rows: DataFrame, path: str, program_id: int, run_id: int) -> None:
    """Adds one run to a program's dataset. Writing the same run again replaces it, so a retried job is safe."""
    tagged = rows.withColumns({"program_id": F.lit(program_id).cast("long"), "run_id": F.lit(run_id).cast("long")})
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("program_id", "run_id").parquet(path)


def dataset_this_run(dataset: DataFrame, run_id: int) -> DataFrame:
    """S5."""
    return dataset.where(F.col("run_id") == run_id)


def dataset_all_runs(dataset: DataFrame, program_id: int) -> DataFrame:
    """All rows ever, duplicates kept."""
    return dataset.where(F.col("program_id") == program_id)


def dataset_last_hours(dataset: DataFrame, as_of: str, hours: int = 24, ts: str = "ts") -> DataFrame:
    """Rows later than `hours` before `as_of`, and not after it."""
    end = F.lit(as_of).cast("timestamp")
    return dataset.where((F.col(ts) > end - F.make_dt_interval(hours=F.lit(hours))) & (F.col(ts) <= end))


def write_in_slices(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), batch_size: int = 10) -> DataFrame:
    """Rows with row_idx (from 1, in `order`, by run) and the number (from 0) of the slice they are delivered in."""
    return number_rows(rows, order, by).withColumn("slice_no", F.floor((F.col("row_idx") - 1) / batch_size).cast("long"))


def csv_line(cols: Sequence[str | Column], separator: str = ",") -> Column:
    """One CSV line without its end: null is empty, quotes are doubled, and only cells that need them are quoted."""
    cells = [blank(c) for c in cols]
    return F.concat_ws(separator, *[F.when(c.rlike(f'[\\n\\r"{separator}]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells])


def write_csv(rows: DataFrame, path: str, line_end: str = "\n") -> None:
    """CSV without a header; line ends inside cells stay as they are."""
    rows.select(csv_line(rows.columns).alias("value")).write.option("lineSep", line_end).text(path)


def program_catalogue(programs: DataFrame, name: str = "name", date: str = "date") -> DataFrame:
    """Names, and dates (epoch seconds) as dd/MM/yyyy HH:mm in the session's time zone."""
    return programs.select(name, F.date_format(F.timestamp_seconds(F.col(date)), "dd/MM/yyyy HH:mm").alias(date))


def parse_params(blob: Column) -> Column:
    """k='v',k2='v2' as a map. Commas escaped by a backslash are part of a value; a value loses its first and last
    character, quotes or not; the last of repeated names counts. Null and empty blobs give an empty map."""
    parts = F.filter(F.split(F.coalesce(blob, F.lit("")), r"(?<!\\),"), lambda p: F.instr(p, "=") > 0)
    name = lambda p: F.trim(F.substring_index(p, "=", 1))
    value = lambda p: F.replace(F.substring(p, F.instr(p, "=") + 1, F.length(p)), F.lit("\\,"), F.lit(","))
    last = F.filter(parts, lambda p, k: ~F.exists(F.slice(parts, k + 2, F.size(parts)), lambda q: name(q) == name(p)))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(name(p), F.substring(value(p), F.lit(2), F.greatest(F.length(value(p)) - 2, F.lit(0))))))


def with_defaults(supplied: Column, defaults: Column) -> Column:
    """Program parameters: supplied values win over defaults."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(supplied, k)), supplied)
