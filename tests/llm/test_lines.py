"""Line deduplication without a SimHash filter, against brute-force edit similarity."""

import itertools

import numpy as np
import pytest

from rowloom.llm import lines, queries
from rowloom.llm.common import word_hashes


def made(rng):
    """Lines of 5 to 120 words from few and from many words, each with copies of 0 to 25 % edits."""
    out = []
    for k in range(70):
        base = [f"w{x}" for x in rng.integers(0, 12 if k % 7 == 0 else 3000, rng.integers(5, 120 if k % 3 == 0 else 25))]
        out.append(base)
        for _ in range(3):
            new = list(base)
            for _ in range(int(rng.integers(0, len(base) // 4 + 1))):
                at, kind = int(rng.integers(0, len(new))), rng.integers(0, 3)
                new[at : at + (kind != 1)] = [] if kind == 2 else [f"n{rng.integers(0, 9999)}"]
            out.append(new)
    return [x for x in out if len(x) >= 5]


def groups_of(words, similarity=0.8):
    root = list(range(len(words)))
    for i, j in itertools.combinations(range(len(words)), 2):
        longest = max(len(words[i]), len(words[j]))
        if min(len(words[i]), len(words[j])) >= similarity * longest - 1e-9 and lines.edit_similarity(words[i], words[j]) >= similarity - 1e-9:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("group", [32, 2])
def test_all_similar_lines_go(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(lines, "GROUP", group)
    words = made(np.random.default_rng(3))
    root = groups_of(words)
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id for r in queries.op7_lines(spark, str(tmp_path)).where("n_removed = 1").collect()}
    assert got == {i for i, r in enumerate(root) if r != i} and len(got) > 60


@pytest.mark.parametrize("chunk", [20_000, 30])
def test_lines_of_one_key_meet_in_no_join(spark, monkeypatch, chunk):
    """A long passage in very many lines: its lines are compared where they are, and connected ones are not compared again."""
    monkeypatch.setattr(lines, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    passage, words = [f"p{x}" for x in range(9)], []
    for k in range(150):
        own = [f"v{k % 5}.{x}" for x in range(11)] if k % 3 else [f"o{k}.{x}" for x in range(rng.integers(2, 14))]
        for at in rng.integers(0, len(own), k % 4):
            own[at] = f"n{rng.integers(0, 9999)}"
        words.append(passage + own)
    root = groups_of(words)
    hashed = [(word_hashes(" ".join(w).encode())[1] >> np.uint64(32)).astype("<u4").tobytes() for w in words]
    df = spark.createDataFrame([(k * (1 << 20) + 7, bytearray(x)) for k, x in enumerate(hashed)], "h long, seq binary").repartition(3)
    joins = []
    monkeypatch.setattr(lines, "_verified", (lambda old: lambda pairs, *rest: joins.append(pairs.count()) or old(pairs, *rest))(lines._verified))
    links = [((r.a - 7) >> 20, (r.b - 7) >> 20) for r in lines._gram_links(df, 0.8, 5).collect()]
    got = list(range(len(words)))
    for a, b in links:
        got = [min(got[a], got[b]) if r in (got[a], got[b]) else r for r in got]
    assert got == root and len(set(root)) < 120
    assert len(joins) == 1  # only the pairs with a key's first line and those of keys of few lines are joined


def test_gram_size():
    assert lines.gram_size(0.8, 5) == 2 and lines.gram_size(0.5, 5) == 1


def test_order_of_words_counts_all_lines(spark, monkeypatch):
    seq = np.array([7 << 14, 9 << 14], "<u4").tobytes().hex()
    df = spark.range(600_000).selectExpr("id * 1048576 AS h", f"unhex('{seq}') AS seq")
    monkeypatch.setattr(lines, "share", lambda _, order: (_ for _ in ()).throw(LookupError(order[7], order[9], order[8])))
    with pytest.raises(LookupError) as found:
        lines._gram_links(df, 0.8, 5)
    assert found.value.args == (round(8 * np.log2(600_000)),) * 2 + (0,)


@pytest.mark.parametrize("vocabulary", [8, 60, 3000])
def test_similar_lines_share_a_key_at_near_places(vocabulary):
    """Fewer keys than twice the edits where rare pairs lie apart, and still one in common for all similar lines."""
    rng = np.random.default_rng(vocabulary)
    counts, texts, pairs = rng.integers(0, 200, 1 << lines.WORDS_LOG2).astype(np.uint8), [], 0
    numbers = rng.integers(0, 1 << 32, vocabulary).astype(np.uint32)
    for _ in range(400):
        base = list(numbers[rng.integers(0, vocabulary, rng.integers(5, 700 if len(texts) % 30 == 0 else 90))])
        new, kind = list(base), rng.integers(0, 4)
        for at in sorted(rng.choice(len(base), len(base) // 5, replace=False).tolist(), reverse=True):
            what = kind if kind < 3 else rng.integers(0, 3)
            new[at : at + (what != 1)] = [] if what == 2 else [numbers[rng.integers(0, vocabulary)]]
        texts += [base, new]
    n = np.array([len(x) for x in texts])
    at = np.concatenate([[0], np.cumsum(n)])
    line, key, place = lines._gram_keys(np.concatenate(texts).astype(np.uint32), at, counts, 0.8, 2)
    for k in range(0, len(texts), 2):
        a, b = ({int(x): p for x, p in zip(key[line == j], place[line == j], strict=True)} for j in (k, k + 1))
        longest = np.array([max(n[k], n[k + 1])])
        if abs(n[k] - n[k + 1]) <= lines._limits(longest, 0.8)[0] and lines.edit_similarity(texts[k], texts[k + 1]) >= 0.8:
            pairs += 1
            shared = [(a[x], b[x]) for x in a.keys() & b.keys()]
            assert any(lines._near(*(np.array([z]) for z in (x, y, n[k], n[k + 1])), lines._limits(longest, 0.8))[0] for x, y in shared), (n[k], n[k + 1])
    assert pairs > 150
    if vocabulary == 3000:
        full = (2 * lines._limits(n, 0.8) + 1).sum()
        assert len(line) < 0.9 * full


def test_unlike_long_lines_are_told_apart_by_counts(monkeypatch):
    """Long lines whose parities say nothing are not compared one by one; counts never say less than what two lines share."""
    rng = np.random.default_rng(9)
    texts = [(rng.zipf(1.3, rng.integers(1900, 2100)) % 30_000 * 2_654_435_761 % (1 << 32)).astype(np.uint32) for _ in range(40)]
    texts += [np.concatenate([t[:900], t[950:]]) for t in texts[:5]]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    p, q = np.triu_indices(len(texts), 1)
    shared = np.array([np.minimum(*(np.bincount(np.searchsorted(np.unique(np.concatenate([texts[a], texts[b]])), t), minlength=len(np.union1d(texts[a], texts[b]))) for t in (texts[a], texts[b]))).sum() for a, b in zip(p, q, strict=True)])
    assert lines._may_share(np.concatenate(texts), at, p, q, shared).all()
    seen = []
    monkeypatch.setattr(lines, "_long_similar", (lambda old: lambda a, b, limit: seen.append(len(a)) or old(a, b, limit))(lines._long_similar))
    good = lines.edit_similar([texts[a] for a in p], [texts[b] for b in q], 0.8)
    assert {(a, b) for a, b in zip(p[good].tolist(), q[good].tolist(), strict=True)} == {(k, 40 + k) for k in range(5)}
    assert sum(seen) <= 5, seen
