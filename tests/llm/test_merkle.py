"""The manifest against a plain Merkle tree."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowloom.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def levels(h):
    found = [h]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][k : k + 16])) for k in range(0, len(found[-1]), 16)])
    return found


def brute(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(field, (r[0], r[3], r[2], r[4], t))))
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    trees = []
    for s in sorted(sources, key=lambda x: (x is not None, (x or "").encode())):
        mine = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((mine, levels([leaf(r, r[1]) for r in mine])))
    up, out = levels([t[1][-1][0] for t in trees]), Counter()
    for k, (mine, tree) in enumerate(trees):
        for i, r in enumerate(mine):
            t = r[1]
            if r[0] is not None and t is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            h, proof = leaf(r, t), []
            for found, p in ((tree, i), (up, k)):
                for level in found[:-1]:
                    run, q = level[p // 16 * 16 : p // 16 * 16 + 16], p % 16
                    proof += run[:q] + run[q + 1 :]
                    h = sha("".join([*run[:q], h, *run[q + 1 :]]))
                    p //= 16
            root = up[-1][0]
            out[(r[0], tree[0][i], tree[-1][0], root, sha("".join(proof)), h, h == root)] += 1
    return out


def made(sources, n, rng):
    rows = []
    for k in range(n):
        source = None if sources > 3 and rng.random() < 0.1 else f"é{rng.randrange(sources)}" if rng.random() < 0.5 else f"s{min(rng.randrange(sources), rng.randrange(sources))}"
        rows.append((None if rng.random() < 0.02 else k * 7, rng.choice([None, "", "Abc Ü", "x" * 50 + "Y", "lower only"]), rng.choice([None, "en"]), source, rng.choice([None, 3])))
    return rows + rows[:5] * (n > 17)


@pytest.mark.parametrize(("sources", "n"), [(20, 2000), (290, 700), (1, 1), (1, 17), (3, 3), (17, 40), (0, 0)])
def test_query_against_a_plain_tree(spark, tmp_path, sources, n):
    rows = made(sources, n, random.Random(n))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("clash"), "POS": F.lit(1), "tree": F.lit(2)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert Counter(tuple(r) for r in queries.op12_merkle(spark, str(tmp_path)).collect()) == brute(rows)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_nodes_above_several_blocks(spark, tmp_path, monkeypatch):
    """With blocks of 256 leaves, upper nodes have many copies, and none is joined twice."""
    monkeypatch.setattr(merkle, "BLOCK", 256)
    rng = random.Random(9)
    rows = [(k, f"Text {k}", "en", "hot" if rng.random() < 0.7 else f"s{rng.randrange(40)}", k) for k in range(6000)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(tuple(r) for r in queries.op12_merkle(spark, str(tmp_path)).collect()) == brute(rows)


def test_only_changed_rows_fail(spark):
    df = spark.createDataFrame([(k, "A" if k % 2 else "a", None, f"s{k % 3}", 1) for k in range(200)], SCHEMA)
    out = merkle.manifest(df, "doc_id", "source", ["doc_id", "text"], {"text": F.lower("text")}).collect()
    assert len(out) == 200 and all(r.verified == (r.doc_id % 2 == 0) for r in out)
    assert all(r.verified for r in merkle.manifest(df, "doc_id", "source", ["doc_id", "text"]).collect())
