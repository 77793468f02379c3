"""Leaves where most vectors are linked are not compared pair by pair, and links count once over leaves and blocks."""

import numpy as np
import pyarrow as pa

from rowloom.llm import vectors


def test_dense_leaves(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal(32) + 0.1 * rng.standard_normal((600, 32)), rng.standard_normal((200, 32))]).astype("<f4")
    x[790:] = x[700:710] + np.float32(0.01)
    n = rng.integers(1, 4, len(x))
    # leaf 5 of an earlier block holds the first 100, then the block's leaves 1, 2 and 3
    leaves = [[5] * (i < 100) + [k for k in (1, 2, 3) if (i + k) % 3 or i >= 700] for i in range(len(x))]
    since = np.array([int(i < 100) for i in range(len(x))], np.int32)
    zero = np.zeros(len(x), np.int64)
    table = pa.table({
        "key": zero, "i": zero, "j": zero, "chunk": zero, "id": np.arange(len(x)), "n": n, "v": pa.array([v.tobytes() for v in x], pa.binary()),
        "keys": pa.array([np.array(k, "<i8").tobytes() for k in leaves], pa.binary()), "since": since, "till": np.array([len(k) for k in leaves], np.int32),
    })
    seen, first = [], vectors._first_shared
    monkeypatch.setattr(vectors, "_first_shared", lambda p, q: seen.append(len(p)) or first(p, q))
    got = vectors._comparer(32, 0.95, "<f4")(table)
    u = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    here = np.array([[k in own for k in (1, 2, 3)] for own in leaves], float)
    near &= here @ here.T > 0
    assert np.array_equal(np.unique(np.nonzero(near)[0]), np.sort(got["id"].to_numpy()))
    counted = near.copy()
    counted[:100, :100] = False
    assert dict(zip(got["id"].to_pylist(), got["links"].to_pylist(), strict=True)) == {i: int(counted[i] @ n) for i in np.flatnonzero(near.any(axis=1))}
    assert set(got["root"].to_pylist()[:600]) == {0} and sum(seen) < 1000 < near.sum()
