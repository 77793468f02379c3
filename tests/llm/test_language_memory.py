"""Predicting languages holds little more than a piece of the texts, and pieces change no result."""

import tracemalloc

import numpy as np

from rowloom.llm import lang


def test_predict_takes_texts_by_small_pieces():
    rng = np.random.default_rng(2)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(500)]
    texts = [" ".join(words[k] for k in rng.integers(0, 500, size)) for size in (*[700] * 300, 90_000)] + ["", None, "12 34"]
    masks = rng.integers(0, 16, (1, 1 << lang.ROWS_LOG2)).astype(np.uint8)
    filters, letters = lang.Filters(list("abcd"), masks, np.full(4, 0.125)), lang._letters()
    whole = filters.predict(texts, letters, piece=10_000_000)
    tracemalloc.start()
    got = filters.predict(texts, letters)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == whole
    assert peak < 25e6, peak
