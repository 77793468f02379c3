"""Periodic runs against their definition, word by word."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from rowloom.llm import periods, queries


def plain_runs(w, least=24, times=3):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - a + q
            if i > a and n >= max(least, times * q) and not any(w[a : a + n - p] == w[a + p : a + n] for p in range(1, q)):
                out.append((a, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(24, 3), (10, 3), (40, 4)])
def test_runs_against_the_definition(least, times):
    rng, total = random.Random(5), 0
    for _ in range(700):
        w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            if len(w) > 30:
                a, q, n = rng.randrange(len(w)), rng.randint(1, 45), rng.randint(10, 140)
                for x in range(a + q, min(len(w), a + n)):
                    w[x] = w[x - q]
        want = plain_runs(w, least, times)
        total += len(want)
        assert [tuple(r) for r in periods.runs(np.array(w, np.int64), least, times).tolist()] == want
    assert total > 50


def test_long_documents():
    assert periods.runs(np.zeros(300_000, np.int64)).tolist() == [[0, 300_000, 1]]
    assert periods.runs(np.tile(np.arange(30_000), 4)).tolist() == [[0, 120_000, 30_000]]
    assert not len(periods.runs(np.arange(100_000)))


def row(i, t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    h = None if i is None else zlib.crc32(str(i).encode())
    if h is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices("a b c dd e f g h".split(), k=rng.randint(0, 300)))) for i in range(150)]
    docs += [(200 + i, "\n".join(["one two three four five six seven eight nine ten"] * i)) for i in range(8)]
    docs += [(None, None), (None, "x " * 30), (301, None), (302, ""), (303, " \n\t "), (304, "x " * 3000), (305, "x " * 23), (306, "x " * 24), (307, "É 日本 😀 " * 9), (308, "a\x85b " * 30), (309, "same"), (309, "same"), (310, "w\x00v " * 25)]
    spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, period int, Runs_Sha256 string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.op11_periods(spark, str(tmp_path)).collect())
    assert got == Counter(row(i, t) for i, t in docs)


def test_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "x " * 30, "keep", "gone")], "id int, t string, other string, Start string")
    out = periods.detect(df, "t").first()
    assert (out.id, out.other, out.start, out.length, out.period, out.exponent_milli, out.collapsed) == (1, "keep", 0, 30, 1, 30000, "x")
    assert periods.detect(df.limit(0), "t").count() == 0
