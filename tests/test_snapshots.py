"""A table of snapshots against every node, by brute force."""

import math
import random
from collections import Counter

import pytest

from rowloom import plans
from rowloom.operators import nodes, predicates

NODES, SNAPSHOTS = "page_id long, node_id long, props map<string,string>", "snapshot_id long, props map<string,string>, required array<string>"


def made(n, seed):
    rng = random.Random(seed)
    props = lambda: {p: rng.choice(v) for p, v in (("tag", ["a"] * 8 + ["b", "h1"]), ("id", [str(k) for k in range(40)]), ("class", ["x", "y", "z"]), ("text", [f"t{k}" for k in range(15)])) if rng.random() < 0.9}
    rows = [(rng.randrange(9), k, props()) for k in range(n)]
    snaps = [(k, rng.choice([props(), {**props(), "id": "unseen"}, rows[k % max(1, len(rows))][2] if rows else {}]), rng.choice([None, [], ["tag"], ["id", "tag"], ["absent"]])) for k in range(40)] + [(98, None, None), (99, {}, [])]
    return rows, snaps


def brute(rows, snaps, least, k):
    seen = Counter((p, v) for _, _, props in rows for p, v in props.items())
    out = Counter()
    for s, own, required in snaps:
        if not own:
            continue
        weight = {(p, v): math.log1p(len(rows) / max(1, seen[p, v])) for p, v in own.items()}
        need = round(least * sum(weight.values()), 9)
        by = {}
        for page, n, props in rows:
            if all(r in own and props.get(r) == own[r] for r in required or []):
                score = round(sum(weight[p, v] for p, v in own.items() if props.get(p) == v), 9)
                if score > 0 and score >= need:
                    by.setdefault(page, []).append((-score, n))
        for page, found in by.items():
            for rank, (score, n) in enumerate(sorted(found)[:k], 1):
                out[(page, s, n, round(-score, 6), rank)] += 1
    return out


@pytest.mark.parametrize(("least", "k"), [(0.5, 1), (0.5, 3), (0.9, 1), (0.0, 2)])
def test_against_every_pair(spark, least, k):
    rows, snaps = made(400, 7)
    found = predicates.find_snapshots(spark.createDataFrame(rows, NODES), spark.createDataFrame(snaps, SNAPSHOTS), least, k)
    got = Counter((r.page_id, r.snapshot_id, r.node_id, round(r.score, 6), r["rank"]) for r in found.collect())
    want = brute(rows, snaps, least, k)
    assert got == want and len(want) > 10


def test_no_nodes_or_snapshots(spark):
    rows, snaps = made(5, 1)
    none, some = spark.createDataFrame([], NODES), spark.createDataFrame(rows, NODES)
    assert predicates.find_snapshots(none, spark.createDataFrame(snaps, SNAPSHOTS)).count() == 0
    assert predicates.find_snapshots(some, spark.createDataFrame([], SNAPSHOTS)).count() == 0


def test_pages_as_nodes(spark):
    pages = spark.createDataFrame([(k, "http://a.test", f"<h1>Head {k}</h1><p class=x>one<p>two<a href=/q>more</a>") for k in range(4)], "page_id long, url string, html string")
    found = predicates.node_properties(nodes.page_layout(pages), ["tag", "class", "text", "link"])
    snaps = spark.createDataFrame([(1, {"tag": "h1", "text": "Head 2"}, None), (2, {"tag": "p", "class": "x"}, ["class"])], SNAPSHOTS)
    got = {(r.page_id, r.snapshot_id): r.node_id for r in predicates.find_snapshots(found, snaps, 0.3).collect()}
    assert got == {**{(k, 1): 0 for k in range(4)}, **{(k, 2): 1 for k in range(4)}}


@pytest.mark.parametrize("most", [0, 2])
def test_sets_by_their_rarest_property(spark, monkeypatch, most):
    monkeypatch.setattr(predicates, "MOST_SETS", most)
    test_against_every_pair(spark, 0.5, 3)
    test_against_every_pair(spark, 0.9, 1)


def test_copies_are_scored_once(spark):
    """300 copies of a node on two pages and 300 copies of it as snapshots: their 180,000 pairs are one of each page, not rows of a join."""
    rows = [(n % 2, n, {"tag": "a", "id": "x"}) for n in range(600)] + [(0, 1000 + n, {"tag": "b", "id": str(n)}) for n in range(50)]
    snaps = [(n, {"id": "x", "tag": "a"}, ["tag"]) for n in range(300)]
    found = predicates.find_snapshots(spark.createDataFrame(rows, NODES).repartition(3), spark.createDataFrame(snaps, SNAPSHOTS), 0.9)
    assert {(r.page_id, r.snapshot_id, r.node_id) for r in found.collect()} == {(p, s, p) for p in (0, 1) for s in range(300)}
    plan = found._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "own" in text and text.count("Window") >= 2


@pytest.mark.parametrize(("free", "least", "k"), [(-1, 0.5, 3), (-1, 0.0, 2), (8, 0.0, 1), (8, 0.3, 4)])
def test_by_sets_and_by_index(spark, monkeypatch, free, least, k):
    monkeypatch.setattr(predicates, "MOST_FREE", free)
    test_against_every_pair(spark, least, k)


def test_parts_little_alike_are_found(spark, tmp_path):
    """Every part is looked for on every page that has its thing, however unlike the likest node is there."""
    rng = random.Random(5)
    parts = [(k, f"{rng.choice(['red', 'blue', 'hot'])} {rng.choice(['ring', 'bolt', 'nut'])}", f"Brand#{rng.randrange(4)}", rng.choice(["LARGE", "SMALL"]), rng.randrange(30)) for k in range(90)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    props = lambda p: {"colour": p[1].split()[0], "thing": p[1].split()[1], "type": p[3], "size": str(p[4])}
    want = {key[:4] for key in brute([(p[2], p[0], props(p)) for p in parts], [(p[0], props(p), ["thing"]) for p in parts], 0.0, 1)}
    got = {(r.page_id, r.snapshot_id, r.node_id, r.score) for r in plans.queries()["similar_to_snapshots"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 4 * 90
