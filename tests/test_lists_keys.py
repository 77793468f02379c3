"""Grouped statistics, minimal keys and nested canonical texts against plain Python."""

import itertools
import json
import random
import statistics
from collections import Counter

from pyspark.sql import functions as F

from rowloom.functions import cells
from rowloom.operators import lists, skip


def test_grouped_statistics(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["1", "2", "2.5", "x", None, "-3", "7"]), k) for k in range(400)] + [("none", "x", 1), ("none", None, 2), ("one", "5", 3), ("two", "5", 4), ("two", "6", 5)]
    got = {r.g: r for r in lists.grouped_stats(spark.createDataFrame(rows, "g string, v string, k int"), ["g"], "v", ["k"]).collect()}
    for g in {r[0] for r in rows}:
        v = [float(x) for h, x, _ in rows if h == g and x not in ("x", None)]
        r = got[g]
        assert (r.n, r.total) == (len(v), sum(v))
        if not v:
            assert (r.low, r.high, r.mean, r["median"], r.spread, r.modes) == (None, None, None, None, None, [])
            continue
        assert (r.low, r.high, r["median"], r.modes) == (min(v), max(v), statistics.median(v), statistics.multimode(v))
        assert abs(r.mean - statistics.fmean(v)) < 1e-9 and abs(r.spread - statistics.pstdev(v)) < 1e-9
    assert lists.grouped_stats(spark.createDataFrame([], "g string, v string, k int"), ["g"], "v", ["k"]).count() == 0


def test_a_group_larger_than_a_task(spark):
    """One group holds all rows; no aggregate of the plan keeps its values."""
    n = 50_001
    rows = spark.range(n).select(F.lit("hot").alias("g"), ((F.col("id") * 7919) % n).alias("v"), "id")
    r = lists.grouped_stats(rows, ["g"], "v", ["id"]).first()
    assert (r.n, r["median"], r.low, r.high, len(r.modes), r.modes[:2]) == (n, (n - 1) / 2, 0, n - 1, n, [0.0, 7919.0])


def test_minimal_keys_against_all_sets(spark):
    rng = random.Random(2)
    rows = [(k // 4, k % 4, rng.randrange(40), rng.choice(["", None, "x"]), k % 2, "same") for k in range(160)]
    names = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame(rows, "a int, b int, c int, d string, e int, f string")
    text = lambda v: "" if v is None else str(v)
    want = []
    for size in range(1, 5):
        for c in itertools.combinations(range(6), size):
            if not any(set(k) <= set(c) for k in want) and len({tuple(text(r[i]) for i in c) for r in rows}) == len(rows):
                want.append(c)
    got = {tuple(r.key) for r in skip.minimal_keys(df, names, at_once=3).collect()}
    assert got == {tuple(names[i] for i in c) for c in want} and ("a", "b") in got
    assert {tuple(r.key) for r in skip.minimal_keys(df, names, most=1).collect()} == set()
    assert [list(r.key) for r in skip.minimal_keys(df.limit(0), names).collect()] == [[]]
    assert skip.minimal_keys(df.union(df), names).count() == 0


def test_key_report_exchanges_no_texts(spark):
    df = spark.createDataFrame([(k, f"long text {k % 3} " * 50, None if k % 2 else "") for k in range(20)], "k int, t string, e string")
    report = skip.key_report(df, {"t": ["t"], "e": ["e"], "both": ["t", "e"]})
    got = {r.key_name: (r.n_rows, r.n_keys, r.n_dropped, r.n_empty, r.largest) for r in report.collect()}
    assert got == {"t": (20, 3, 17, 0, 7), "e": (20, 1, 19, 20, 20), "both": (20, 3, 17, 0, 7)}
    exchange = [line for line in report._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]
    assert exchange and not any("t#" in line.split("Exchange")[1].split("plan_id")[0].replace("count#", "").replace("first#", "") for line in exchange if "key" in line)


def test_nested_canonical_texts(spark):
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(7 if depth else 4)
        return {0: None, 1: rng.randrange(-5, 10**6), 2: rng.choice(["", "é", 'q"\\\n', "x" * 300]), 3: True}.get(kind, None) if kind < 4 else [value(depth - 1) for _ in range(rng.randrange(4))] if kind < 5 else {rng.choice("abcdefgh é") + str(k): value(depth - 1) for k in range(rng.randrange(5))}

    values = [value(5) for _ in range(300)]

    def shuffled(v):
        if isinstance(v, dict):
            items = list(v.items())
            rng.shuffle(items)
            return {k: shuffled(x) for k, x in items}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    rows = [(k, json.dumps(shuffled(v), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))) for k, v in enumerate(values)]
    got = {r.k: r.c for r in spark.createDataFrame(rows, "k int, t string").select("k", cells.canonical_text(F.col("t")).alias("c")).collect()}
    assert Counter(map(type, got.values())) == {str: 300}
    for k, v in enumerate(values):
        assert got[k] == json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    odd = spark.createDataFrame([(1, "bad"), (2, None), (3, '{"a":1,"a":2}'), (4, "[1.50, 2]")], "k int, t string").select("k", cells.canonical_text(F.col("t")).alias("c"))
    assert {r.k: r.c for r in odd.collect()} == {1: None, 2: None, 3: None, 4: "[1.5,2]"}
    nested = spark.range(1).select(cells.canonical_value(F.struct(F.lit(None).cast("int").alias("z"), F.array(F.struct(F.lit(2).alias("y"), F.lit(None).cast("string").alias("b"), F.lit("t").alias("a"))).alias("m"))).alias("c"))
    assert nested.first().c == '{"m":[{"a":"t","y":2}]}'


def test_sorting_lists_compares_in_no_lambda(spark, capsys):
    from pyspark.sql import functions as F

    from rowloom.functions import cells

    df = spark.createDataFrame([(["b", "2", "B", "a", "10", "b", "x"],)], "w array<string>")
    out = df.select(*[cells.list_sort(F.col("w"), kind, descending=down).alias(f"{kind}_{down}") for kind in ("TEXT", "IGNORE_CASE", "NUMERIC") for down in (False, True)])
    assert [",".join(x) for x in out.first()] == ["10,2,B,a,b,b,x", "x,b,b,a,B,2,10", "10,2,a,b,B,b,x", "x,b,B,b,a,2,10", "b,B,a,b,x,2,10", "10,2,b,B,a,b,x"]
    out.explain()
    assert "array_sort" not in capsys.readouterr().out
