"""Joins and searches against brute force."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from rowloom.llm import jaccard, lines, vectors
from rowloom.llm.common import connected_components, word_hashes


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    real = [p for p in pairs if p[0] != p[1]]
    want = union(real, {x for p in real for x in p})
    out = connected_components(spark.createDataFrame([*pairs, (None, 1), (5000, 5000)], "a long, b long"))
    assert {r.node: r.root for r in out.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_in_pieces():
    data = b"  ab cd\nef " + b"x" * 50 + b" " + b"gh " * 40 + b"y" * 30
    for piece in (5, 16, 64, 1 << 20):
        starts, hashes = word_hashes(data, piece)
        want = [(m.start(), m[0]) for m in __import__("re").finditer(rb"[^ \n]+", data)]
        assert starts.tolist() == [a for a, _ in want] and len(set(hashes.tolist())) == len({w for _, w in want})
    assert len(word_hashes(b"")[0]) == len(word_hashes(b" \n")[0]) == 0


def variants(rng, n, vocabulary=3000):
    """Texts with exact copies, near copies of all degrees, shared passages and odd cases."""
    base = [" ".join(f"w{x}" for x in rng.integers(0, vocabulary, rng.integers(1, 80))) for _ in range(n)]
    out = list(base)
    for t in base:
        w = t.split()
        for _ in range(3):
            v = list(w)
            for k in rng.integers(0, len(v), max(1, len(v) // int(rng.integers(15, 60)))):
                v[k] = f"w{rng.integers(0, vocabulary)}"
            out.append(" ".join(v))
    passage = " ".join(f"p{k}" for k in range(60))
    out += [f"{passage} {t}" for t in base[:25]] + [passage.replace("p7 ", f"q{k} ") for k in range(40)] + [base[0]] * 30
    return [*out, "A b\tC  d e", "a B c D E", None, "", " \n", "one", "One", "x y", "ñ Ñ", "word " * 3000]


def test_jaccard(spark):
    texts = variants(np.random.default_rng(2), 60)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    out = jaccard.links(spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")))

    def grams(t):
        w = (t or "").encode().lower().split()
        n = min(4, len(w))
        return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()

    sets = [grams(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = union(pairs, range(len(sets)))
    got = out.collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]) for r in got)
    assert len({want[i] for i in want}) < len(texts) - 60
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_jaccard_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.links(none).count() == 0
    assert jaccard.links(spark.createDataFrame([(1, None), (None, None)], "doc_id long, text string")).count() == 2


def test_edit_distance():
    rng = np.random.default_rng(4)
    a = [rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint32) for _ in range(800)]
    b = [np.delete(x, rng.integers(0, len(x), len(x) // 8)) if len(x) and rng.random() < 0.7 else rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint32) for x in a]
    want = [lines.edit_similarity(x.tolist(), y.tolist()) >= 0.8 - 1e-9 for x, y in zip(a, b, strict=True)]
    assert lines.edit_similar(a, b, 0.8).tolist() == want and 0 < sum(want) < 800


def test_pigeonhole_is_complete():
    rng = np.random.default_rng(6)
    for blocks, agree in ((4, 1), (5, 2), (6, 3)):
        masks = lines._masks(blocks, agree)
        for _ in range(200):
            x = sum(1 << int(k) for k in rng.choice(64, 3, replace=False))
            assert any(x & m == 0 for m in masks)


def test_lines(spark):
    rng = np.random.default_rng(7)
    base = [" ".join(f"word{x}" for x in rng.integers(0, 900, rng.integers(1, 60))) for _ in range(150)]
    near = [t.upper() + "!" if k % 3 else t.replace(" ", ", ", 2) + f" extra{k}" for k, t in enumerate(base)]
    pool = base + near
    docs = [(i, "\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(0, 9)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "\n\n"), (3, docs[3][1]), (503, "a b c\na b c"), (None, docs[5][1])]
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, n_lines int")
    occurrences = {}
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            if len(w := tuple(lines.words(line))) >= 5:
                occurrences.setdefault(w, set()).add((-1 if i is None else i, n))
    keys = list(occurrences)
    sims = np.array([lines.simhash(h := word_hashes(b" ".join(w))[1], np.array([0]), np.array([len(h)]))[0] for w in keys], np.uint64)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(keys)), 2) if np.bitwise_count(sims[i] ^ sims[j]) <= 3 and lines.edit_similarity(list(keys[i]), list(keys[j])) >= 0.8 - 1e-9]
    assert pairs
    groups = {}
    for k, r in union(pairs, range(len(keys))).items():
        groups.setdefault(r, set()).update(occurrences[keys[k]])
    gone = {x for g in groups.values() for x in sorted(g)[1:]}
    out = lines.dedupe(df, report=True).collect()
    assert len(out) == len(docs)
    for r in out:
        i, t = (-1 if r.doc_id is None else r.doc_id), dict(docs)[r.doc_id]
        lost = [n for n in range(len((t or "").split("\n"))) if (i, n) in gone]
        assert list(r.removed) == lost and r.n_removed == len(lost)
        assert r.text == (t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in lost))
    assert lines.dedupe(df).columns == df.columns and lines.dedupe(df.limit(0)).count() == 0


def test_chunked_lines(spark, monkeypatch):
    """Block values with very many lines, dealt out as pairs of chunks, give the same links."""
    rng = np.random.default_rng(8)
    sims = [int(x) for x in rng.integers(0, 1 << 40, 40)] + [(1 << 62) + (1 << int(k)) for k in rng.integers(0, 60, 300)]
    rows = [(k, s, bytes(np.arange(6, dtype="<u4"))) for k, s in enumerate(sims)]
    df = spark.createDataFrame(rows, "h long, sim long, seq binary")

    def roots():
        links = [(r.a, r.b) for r in lines._links(df.select("h", "sim"), df.select("h", "seq"), 0.8).collect()]
        return union(links, range(len(sims)))

    want = roots()
    monkeypatch.setattr(lines, "CHUNK", 25)
    assert roots() == want == union([(i, j) for i, j in itertools.combinations(range(len(sims)), 2) if (sims[i] ^ sims[j]).bit_count() <= 3], range(len(sims)))


def vectors_of(rng):
    centres = rng.standard_normal((60, 16))
    x = np.repeat(centres, 12, axis=0) + rng.standard_normal((720, 16)) * 0.08
    return np.concatenate([x, x[:5], x[:1].repeat(40, axis=0), 3 * x[:3], np.zeros((1, 16))]).astype(np.float32)


def brute(x):
    n = np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    u = x.astype(float) / np.where(n == 0, 1, n)
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    return near.sum(axis=1), union([(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)], range(len(x)))


def check_vectors(spark, **options):
    x = vectors_of(np.random.default_rng(9))
    odd = [None, [], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] * 16, [1.0, 0.0]]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + k, v, 1) for k, v in enumerate(odd)] + [(None, x[0].tolist(), 1), (7, x[7].tolist(), 2)]
    out = vectors.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int"), **options).collect()
    assert len(out) == len(rows)
    count, root = brute(x)
    got = {r.vec_id: r for r in out if r.vec_id is not None}
    assert all(got[i].n_links <= count[i] for i in range(len(x)))
    found = sum(got[i].n_links for i in range(len(x))) / count.sum()
    assert all((got[1000 + k].n_links, got[1000 + k].component_id, got[1000 + k].kept) == (0, 1000 + k, True) for k in range(len(odd)))
    assert found >= 0.9
    return found, all(got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in root)


def test_vectors(spark):
    assert check_vectors(spark, leaf=64) == (1.0, True)


def test_vectors_in_chunks(spark):
    """Leaves above the limit are dealt out as pairs of chunks; the links are the same."""
    assert check_vectors(spark, leaf=400, max_leaf=50) == (1.0, True)


def test_vectors_empty(spark):
    assert vectors.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert vectors.links(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first().kept
