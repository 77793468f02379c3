"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: shapes of words (letters and digits reduced to their kind,
punctuation kept) alone, in pairs and in threes, and runs of one repeated word. Each indicator is
scaled by its class log-count ratio; on the scaled indicators a linear hinge-loss model is fitted by
dual coordinate descent. Margins become probabilities by a logistic fit on rows kept out of the fit.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled, map_columns, share, stored

BITS = 18
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"[a-z]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    """Kinds of a word's characters: Xx (capitalised), X (capitals), x (other letters), 9 (digits); the rest stays, three of a kind at most."""
    out = _UPPER.sub(lambda m: ("X" if len(m[0]) == 1 else "Xx" if m[0][1:].islower() else "XX") if m[0][0].isupper() else "x", word)
    return re.sub(r"(\W)\1{2,}", r"\1\1\1", _DIGIT.sub("9", out))


def features(text: str, cache: dict[str, str]) -> np.ndarray:
    """The distinct indicators of a whole text, as buckets of a 2^18 table, sorted."""
    words = text.split()
    shapes = []
    for w in words:
        if (s := cache.get(w)) is None:
            if len(cache) > 200_000:
                cache.clear()
            s = shape(w)
            if len(w) <= 64:  # longer words are rare, and would fill the memory
                cache[w] = s
        shapes.append(s)
    found = {*shapes, *zip(shapes, shapes[1:], strict=False), *zip(shapes, shapes[1:], shapes[2:], strict=False)}
    same = list(map(eq, words, words[1:]))
    repeats = sum(same)
    longest = run = 0
    if repeats:
        for x in same:
            run = run + 1 if x else 0
            longest = max(longest, run)
    keys = ["\0".join(x) if isinstance(x, tuple) else x for x in found]
    keys += [f"\1run{min(k, 4)}" for k in range(1, min(longest, 4) + 1)]
    keys += [f"\1words{int(math.log2(len(words) + 1))}", f"\1repeats{round(4 * repeats / max(1, len(words)))}"]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64) & np.uint64((1 << BITS) - 1)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        z = self.slope * (self.weights[found].sum() + self.bias) + self.shift
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 0.1, rounds: int = 30, alpha: float = 1.0, seed: int = 7) -> Model:
    """The model of indicator rows with labels 0 and 1; one row in five only calibrates."""
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:  # one class: its prior alone
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, 50.0 if len(labels) and labels[0] else -50.0 if len(labels) else 0.0)
    counts = [np.full(1 << BITS, alpha) for _ in range(2)]
    for x, y in zip(rows, labels, strict=True):
        counts[int(y)][x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    apart = order[: len(rows) // 5] if len(rows) >= 50 else order
    used = order[len(rows) // 5 :] if len(rows) >= 50 else order
    w, b = np.zeros(1 << BITS), 0.0
    dual, sign = np.zeros(len(rows)), np.where(labels > 0, 1.0, -1.0)
    square = [float((ratio[x] ** 2).sum()) + 1.0 for x in rows]
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(used):
            x = rows[i]
            g = sign[i] * ((w[x] * ratio[x]).sum() + b) - 1
            new = min(max(dual[i] - g / square[i], 0.0), c)
            if (step := (new - dual[i]) * sign[i]) != 0.0:
                w[x] += step * ratio[x]
                b += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < 1e-4 * c:
            break
    weights = (w * ratio).astype(np.float32)
    m = np.array([weights[rows[i]].sum() + b for i in apart])
    a, s = logistic(m, labels[apart])
    return Model(weights, b, a, s)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope (positive) and shift of p(y = 1) = 1 / (1 + exp(-(slope x + shift))), lightly regularised."""
    scale = float(np.abs(x).max()) or 1.0
    a, b, x = 1.0, 0.0, x / scale
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return max(a, 1e-6) / scale, b


def train(docs: DataFrame, labels: DataFrame, label_col: str, text_col: str = "text", id_col: str = "doc_id", sample: int = 6000, indicators: int = 20_000_000) -> Model:
    """A model from about `sample` rows of each label in `labels` (the bound of the fit), picked by a hash of their ids; fewer
    if they have more than `indicators` indicators in all, which is what the driver has to hold. Without rows of both labels, the prior alone."""
    some = labelled(docs, labels, label_col, text_col, id_col, sample)
    cache: dict[str, str] = {}

    def run(texts: list) -> list:
        return [[features(t, cache) for t in texts]]

    rows = stored(map_columns(some, ["t"], [T.StructField("x", T.ArrayType(T.IntegerType()))], run, keep=["y", "id"]))
    total = rows.agg(F.sum(F.size("x").cast("long"))).first()[0] or 0
    part = min(1.0, indicators / max(1, total))
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000)) / 1e6 < part).orderBy(F.xxhash64("id"), "id", "y", "x").select("y", "x").toPandas()
    return fit([np.asarray(x, np.int32) for x in picked.x], picked.y.to_numpy())


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """`docs` with the probability (0 to 1) that each whole text has label 1; null counts as empty.

    Rows stay one to one, repeated ones too; an empty table gives no rows. Other columns pass through; one that clashes with `out_col` is replaced.
    """
    shared, cache = share(docs.sparkSession, model), {}

    def run(texts: list) -> list:
        m = shared()
        return [[m.score(features(t or "", cache)) for t in texts]]

    return map_columns(docs, [text_col], [T.StructField(out_col, T.DoubleType())], run)
