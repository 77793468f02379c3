"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are words, and beginnings of words, that tell toxic from clean texts in the training rows;
their value is log(1 + number of distinct words of the text that have them). One weight vector serves all
thresholds: P(grade <= k) = sigmoid(threshold_k - w x), with ordered thresholds. The output is the expected grade.

Labels that only say toxic or not are graded by how many different words of a toxic text have a marker
(the features most tied to toxic texts): none or one 1, two or three 2, more 3. Clean texts have grade 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled, map_columns, share, stored

GRADES = 4
_WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7, 8)


def features(word: str) -> list[str]:
    """A word and its beginnings: "^word$", "^word"."""
    return [f"^{word}$", *(f"^{word[:k]}" for k in STEMS if len(word) >= k)]


def known(text: str, vocabulary: dict[str, int], seen: dict[str, list[int]]) -> Counter:
    """How many distinct words of a text have each feature of the vocabulary; `seen` keeps words met before."""
    found: Counter = Counter()
    if len(seen) > 500_000:
        seen.clear()
    for w in set(_WORD.findall(text.lower())):
        if (ks := seen.get(w)) is None:
            ks = seen[w] = [vocabulary[f] for f in features(w) if f in vocabulary]
        if ks:
            found.update(ks)
    return found


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, text: str, seen: dict[str, list[int]] | None = None) -> np.ndarray:
        """The probability of each grade."""
        z = sum(self.weights[k] * np.log1p(n) for k, n in known(text, self.vocabulary, {} if seen is None else seen).items())
        below = 1 / (1 + np.exp(-np.clip(self.thresholds - z, -50, 50)))
        return np.diff(np.concatenate([[0.0], below, [1.0]]))


def fit(rows: list[dict[int, float]], grades: np.ndarray, width: int, rounds: int = 400, rate: float = 0.1, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient steps (Adam) on the mean log-likelihood.

    Thresholds are t0, t0 + exp(d1), ... so they stay ordered whatever the steps.
    """
    doc = np.array([i for i, r in enumerate(rows) for _ in r], np.int64)
    col = np.array([c for r in rows for c in r], np.int64)
    val = np.array([v for r in rows for v in r.values()], float)
    y = np.asarray(grades, np.int64)
    share_ = np.clip(np.cumsum(np.bincount(y, minlength=GRADES))[:-1] / max(1, len(y)), 1e-3, 1 - 1e-3)
    start = np.log(share_ / (1 - share_))
    p = np.concatenate([np.zeros(width), [start[0]], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, rounds + 1):
        w, d = p[:width], np.exp(p[width + 1 :])
        theta = np.concatenate([[-np.inf], p[width] + np.concatenate([[0.0], np.cumsum(d)]), [np.inf]])
        z = np.bincount(doc, weights=w[col] * val, minlength=len(y))
        hi, lo = (1 / (1 + np.exp(-np.clip(theta[y + s] - z, -50, 50))) for s in (1, 0))
        like = np.maximum(hi - lo, 1e-12)
        gh, gl = hi * (1 - hi) / like, lo * (1 - lo) / like
        gz = (gh - gl) / len(y)
        up = np.bincount(y, weights=gh, minlength=GRADES)[: GRADES - 1] - np.bincount(y, weights=gl, minlength=GRADES)[1:]
        gt = -up / len(y)
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([np.bincount(col, weights=gz[doc] * val, minlength=width) + penalty * w, [tail[0]], tail[1:] * d])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return p[:width], p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, label_col: str, text_col: str = "text", id_col: str = "doc_id", sample: int = 8000, words: int = 2000, min_docs: int = 5) -> Model:
    """A model from about `sample` rows of each label in `labels` (the bound of the fit), picked by a hash of their ids.

    The vocabulary is at most `words` features, each in `min_docs` toxic texts or more and at least four
    times as frequent in toxic as in clean ones; they and the rows' counts of them come to the driver.
    """
    some = stored(labelled(docs, labels, label_col, text_col, id_col, sample))
    n = {r.y: r.n for r in some.groupBy("y").agg(F.count("*").alias("n")).collect()}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c: Counter = Counter()
            for y, t in zip(batch.column("y").to_pylist(), batch.column("t").to_pylist(), strict=True):
                c.update((y, f) for f in {f for w in set(_WORD.findall(t.lower())) for f in features(w)})
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in c], pa.int32()), pa.array([w for _, w in c], pa.string()), pa.array(list(c.values()), pa.int64())], names=["y", "w", "n"])

    by_word = some.select("y", "t").mapInArrow(spread, "y int, w string, n long").groupBy("w").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("toxic"), F.sum(F.expr("if(y = 0, n, 0)")).alias("clean"))
    odds = F.log(((F.col("toxic") + 0.5) / (n.get(1, 0) + 1)) / ((F.col("clean") + 0.5) / (n.get(0, 0) + 1)))
    top = by_word.where(F.col("toxic") >= min_docs).select("w", odds.alias("odds"), "toxic").where("odds > ln(4)").orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "w").limit(words).collect()
    vocabulary = {r.w: k for k, r in enumerate(top)}
    strength = [r.odds * r.toxic**0.5 for r in top]
    markers = {k for k, s in enumerate(strength) if s >= 0.5 * strength[0]}

    def run(texts: list) -> list:
        marked = [sum(any(vocabulary.get(f) in markers for f in features(w)) for w in set(_WORD.findall(t.lower()))) for t in texts]
        seen: dict[str, list[int]] = {}
        return [["".join(f"{k}:{n} " for k, n in sorted(known(t, vocabulary, seen).items())) for t in texts], marked]

    rows = map_columns(some, ["t"], [T.StructField("x", T.StringType()), T.StructField("marked", T.IntegerType())], run, keep=["y", "id"]).orderBy(F.xxhash64("id"), "id", "y", "x").select("y", "x", "marked").collect()
    counts = [{int(k): int(v) for k, v in (e.split(":") for e in r.x.split())} for r in rows]
    hits = np.array([r.marked for r in rows], int)
    grades = np.where(np.array([r.y for r in rows], int) == 0, 0, np.where(hits <= 1, 1, np.where(hits <= 3, 2, 3)))
    if not vocabulary or len(set(grades.tolist())) < 2:
        return Model({}, np.zeros(0), np.full(GRADES - 1, 50.0))
    weights, thresholds = fit([{k: float(np.log1p(v)) for k, v in c.items()} for c in counts], grades, len(vocabulary))
    return Model(vocabulary, weights, thresholds)


def severity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with severity (expected grade, 0 to 3), p_toxic (of grade 1 or more) and toxic (p_toxic >= 0.5).

    Whole texts; null counts as empty. Rows stay one to one, repeated ones too; an empty table gives no rows.
    Other columns pass through, clashing ones are replaced.
    """
    shared = share(docs.sparkSession, model)
    seen: dict[str, list[int]] = {}

    def run(texts: list) -> list:
        m = shared()
        p = np.array([m.grades(t or "", seen) for t in texts]).reshape(-1, GRADES)
        toxic = 1 - p[:, 0]
        return [(p @ np.arange(GRADES)).tolist(), toxic.tolist(), (toxic >= 0.5).tolist()]

    return map_columns(docs, [text_col], [T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())], run)
