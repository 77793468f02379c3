"""Links that very many rows share: the same rows as from a plain join, spread over tasks."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rowloom.operators import base, nesting, skip


def test_a_hub_spreads_over_tasks(spark):
    """One link in half of all rows: no task has more than a few times the median, and no row is lost or doubled."""
    n = 40_000
    parents = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "hub").otherwise(F.concat(F.lit("p"), (F.col("id") % 1999).cast("string"))).alias("link"))
    children = spark.createDataFrame([("hub", "x"), ("hub", "y")] + [(f"p{k}", "z") for k in range(0, 1999, 2)] + [(None, "none")], "url string, cell string")
    keep = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        out = nesting.nested_loop(parents, children, "link", "url", as_url=False, hub_share=0.05)
        per_task = [r["count"] for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
        assert len(per_task) >= 10 and max(per_task) <= 5 * np.median(per_task)
        plain = nesting.nested_loop(parents, children, "link", "url", as_url=False)
        assert Counter(tuple(r) for r in out.collect()) == Counter(tuple(r) for r in plain.collect())
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)


def test_keys_found(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 300, "a").when(F.col("id") < 420, "b").when(F.col("id") < 430, None).otherwise(F.col("id").cast("string")).alias("k"))
    assert sorted(base.hub_keys(df, "k", 0.1)) == ["a", "b"] and base.hub_keys(df, "k", 0.5) == [] and base.hub_keys(df.limit(0), "k", 0.1) == []


def test_repeated_items(spark):
    rows = [(i, "/a", "page", None, f"t{0 if i % 2 else i % 50}", False) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, xpath string, source_url string, link string, text string, link_scraping boolean")
    assert Counter(tuple(r) for r in skip.recording_dedupe(df, hub_share=0.2).collect()) == Counter(tuple(r) for r in skip.recording_dedupe(df).collect())
