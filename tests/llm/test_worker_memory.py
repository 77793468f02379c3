"""What a Python worker holds while it cuts texts into words, and after: several workers share an executor."""

import tracemalloc

import numpy as np

from rowloom.llm import common, jaccard


def test_words_are_taken_by_small_pieces():
    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(500)]
    texts = [" ".join(words[k] for k in rng.integers(0, 500, size)) for size in (*[500] * 200, 60_000)] + ["", None]
    common._POWERS.clear()
    tracemalloc.start()
    got = jaccard.shingle_sets(texts, 5)
    kept, peak = sum(x.nbytes for x in common._POWERS), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept <= 4 << 20 and peak < 25e6, (kept, peak)
    data = " ".join(x for x in texts if x).encode()
    for whole, parts in zip(common.word_hashes(data, 1 << 24), common.word_hashes(data), strict=True):
        assert np.array_equal(whole, parts)
    assert [len(x) for x in got[-2:]] == [0, 0] and all(len(x) == 496 for x in got[:200])


def test_filter_and_next_step_share_a_worker(spark, capsys):
    rows, values = spark.range(100), spark.createDataFrame([(k,) for k in (3, 5, 8)], "v long")
    found = common.may_be_in(rows, "id", values, lambda batches: (b.rename_columns(["x"]) for b in batches), "x long")
    found.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    assert {3, 5, 8} <= {r.x for r in found.collect()} and found.count() < 100
