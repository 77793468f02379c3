"""Periodic runs of words: maximal stretches that repeat with their smallest period, at least three times and 24 words.

A run of period q and length n >= max(24, 3q) holds n - q words that equal the word q further on: a diagonal of at least
max(24 - q, 2q) matches, so of k = 16 for periods up to 16, and of k = 2^j for periods above 2^(j-1) up to 2^j. That minimum
is the length of the k-grams in the index of each class of periods. As k is at least the period, k words of a run come again a
period later and no sooner, so consecutive occurrences of a k-gram in a document are all the seeds that are needed: never more than
its words, also where one word fills a document. Each seed is extended along its diagonal in both directions, unless its
lag's table of the furthest position covered has it already. k-grams are named exactly: those of 2k words by the pair of
names of their halves, and only where k-grams repeat.

Documents are independent, so this is one pass over Arrow batches without a shuffle; memory follows the longest document. A
document of n words takes O(n log n) steps for each doubling of k that still has repeats.
"""

from __future__ import annotations

import hashlib
import re
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TMP, map_columns

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LEAST, TIMES = 24, 3


def repeat_tail(codes: np.ndarray, h: int) -> np.ndarray:
    """The words (as numbers) with the tail that starts at g % n made periodic, g = h // 10."""
    n, g = len(codes), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([codes[:a], codes[a + np.arange(n - a) % p]])


def _extended(codes: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The stretch [a, b) around i of positions whose word equals the one q further on."""
    b, step, n = i, 64, len(codes) - q
    while b < n:
        same = codes[b : min(b + step, n)] == codes[b + q : min(b + step, n) + q]
        if not same.all():
            b += int(np.argmin(same))
            break
        b, step = b + len(same), 2 * step
    a, step = i, 64
    while a > 0:
        same = codes[max(0, a - step) : a] == codes[max(0, a - step) + q : a + q]
        if not same.all():
            a -= int(np.argmin(same[::-1]))
            break
        a, step = a - len(same), 2 * step
    return a, b


def runs(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of every run, by start, then period. `codes`: the words as numbers from 0. `times` is 3 or more."""
    n = len(codes)
    k = 1
    while 2 * k * times <= least * (times - 1):  # the guaranteed overlap of periods up to k: a power of two
        k *= 2
    found: list[tuple[int, int, int]] = []
    if n < least:
        return np.zeros((0, 3), np.int64)
    names, at, width = codes.astype(np.int64), np.arange(n), 1
    furthest: dict[int, int] = {}
    low = 1
    while len(at):
        # names of grams of twice the width, at the positions where both halves repeat
        while width < k and len(at):
            there = np.full(n, -1, np.int64)
            there[at] = names
            at = at[at + 2 * width <= n]
            at = at[there[at + width] >= 0]
            pair = there[at] * n + there[at + width]
            _, names, count = np.unique(pair, return_inverse=True, return_counts=True)
            at, names = at[count[names] > 1], names[count[names] > 1]
            width *= 2
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        i, lag = at[order[:-1]][same], (at[order[1:]] - at[order[:-1]])[same]
        seeds = (lag >= low) & (lag <= k) & (times * lag <= n)
        i, lag = i[seeds], lag[seeds]
        by = np.lexsort((i, lag))
        i, lag = i[by], lag[by]
        # seeds of one lag whose grams touch lie on one diagonal: the first stands for them
        fresh = np.concatenate([[True], (lag[1:] != lag[:-1]) | (i[1:] > i[:-1] + k)])[: len(i)]
        for x, q in zip(i[fresh].tolist(), lag[fresh].tolist(), strict=True):
            if x < furthest.get(q, -1):
                continue
            a, b = _extended(codes, x, q)
            furthest[q] = b
            if b - a + q >= max(least, times * q):
                found.append((a, b - a + q, q))
        low, k = k + 1, 2 * k
        if times * low > n:
            break
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def describe(text: str | None, h: int | None) -> tuple:
    """(number of runs, start, length, period, exponent in thousandths of the run with most repeats, digest of the runs, the text without repeats)."""
    words = WORDS.findall(text or "")
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    if h is not None and h % 10 == 0 and len(codes):
        codes = repeat_tail(codes, h)
        table = list(number)
        words = [table[c] for c in codes.tolist()]
    found = runs(codes)
    if not len(found):
        return 0, None, None, None, None, hashlib.sha256().hexdigest(), " ".join(words)
    start, length, period = max(found.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    gone = np.cumsum(edges)[:-1] > 0
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in found.tolist())
    return len(found), start, length, period, 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest(), " ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def detect(df: DataFrame, text_col: str = "text", repeat: Column | None = None, collapsed_col: str = "collapsed") -> DataFrame:
    """`df` with n_runs, start, length, period, exponent_milli, runs_sha256 and `collapsed_col`: each row's whole text.

    The four columns in the middle describe the run with the greatest ratio of length to period (ties: smallest start, then
    period), null without a run. `collapsed_col` is the text's words without those that any run holds after its first period, joined by one space.
    `repeat` is a number h for each row: if h % 10 is 0, the words from word g % n on are first made periodic (g = h // 10), a planted case; null
    plants nothing. Null and empty texts have no words; repeated rows stay, an empty table gives no rows, clashing columns are replaced.
    """
    h = (F.lit(None) if repeat is None else repeat).cast("long")
    long = ["n_runs", "start", "length", "period", "exponent_milli"]
    fields = [*(T.StructField(c, T.LongType()) for c in long), T.StructField("runs_sha256", T.StringType()), T.StructField(collapsed_col, T.StringType())]

    def run(texts: list[str | None], hs: list[int | None]) -> list[list]:
        return [list(c) for c in zip(*(describe(t, x) for t, x in zip(texts, hs, strict=True)), strict=True)] or [[] for _ in fields]

    kept = [c for c in df.columns if c.lower() not in {f.name.lower() for f in fields}]
    return map_columns(df.withColumns({f"{TMP}t": F.col(text_col).cast("string"), f"{TMP}h": h}), [f"{TMP}t", f"{TMP}h"], fields, run, keep=kept)
