"""The corpus pipeline: each stage reads what the one before it kept.

Language identification drops documents in no known language; line deduplication removes repeated
lines (and documents that have nothing else); the n-gram Jaccard join keeps one document of each group;
decontamination removes benchmark passages (and documents that are mostly such); the last stage encodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import bpe, decontam, jaccard, lang, lines
from rowloom.llm.common import cut, held_out, table
from rowloom.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that op1 learns from, so decisions agree with that query. Null texts and texts without
    a letter go; without any labelled text all others stay. Repeated rows stay."""
    learn = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    return lang.keep_known(docs, lang.train(learn))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of five words or more. A document goes if it is blank only now; documents that were blank or null before stay. Rows
    that repeat id and text count as one document and lose the same lines."""
    was = docs.withColumn("_rl_blank", F.coalesce(F.trim("text") == "", F.lit(True)))
    out = lines.dedupe(was, candidates="grams")
    return _counted(out.where(F.col("_rl_blank") | (F.trim("text") != ""))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, also of groups of null or repeated ids; null and blank texts are in no group, and of them
    rows that repeat id and text stay once."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go, and documents that are mostly such; null and empty texts, and an empty benchmark, change nothing."""
    return _counted(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids (little-endian 32-bit), their number and digest, and the digest of the decoded text; one row for each row,
    null texts as empty ones."""
    found = bpe.encode(docs, vocabulary(), decoded_col="decoded")
    return found.select("doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("line_dedup", line_dedup), ("near_copies", near_copies), ("decontaminate", decontaminate), ("encode", encode),
]

#: SQL can't express the stages; tests/llm/test_queries.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
