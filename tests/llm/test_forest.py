"""Recall of the projection forest as op6_vectors uses it (64 dimensions, its trees, overlap and sample), ten splits deep."""

import numpy as np

from rowloom.llm import vectors


def test_recall_at_depth(spark):
    rng = np.random.default_rng(12)
    base = rng.standard_normal((13_000, 64))
    # copies at cosines around the threshold: noise of this length gives cosines from 0.94 up
    noise = rng.standard_normal((3_400, 64)) * rng.uniform(0.15, 0.35, (3_400, 1))
    x = np.concatenate([base, base[:3_400] + noise]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    degree = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 1_000):  # brute force in blocks
        degree[at : at + 1_000] = (u[at : at + 1_000] @ u.T >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    leaf = 16  # 16,400 vectors in leaves of 16: ten splits
    found = {r.vec_id: r.n_links for r in vectors.links(df, leaf=leaf).select("vec_id", "n_links").collect()}
    got = np.array([found[i] for i in range(len(x))])
    assert (got <= degree).all() and degree.sum() > 3_000
    print("recall", got.sum() / degree.sum())
    assert got.sum() >= 0.9 * degree.sum()
