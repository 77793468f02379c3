"""Personal data: candidates from high-recall generators, chosen by gradient-boosted trees.

Rules find the base spans (email, ip, card, phone), which always stay. Generators propose further,
overlapping candidates: failed base matches, obfuscated addresses, local phone numbers, account
numbers, and secrets. Each candidate is described by its format and its context; boosted trees score
it, and a threshold for each kind, calibrated for precision on rows kept out of the fit, selects it.
Chosen candidates that overlap a base span or a better one are dropped.

The trees learn from the corpus itself: a candidate with a strong proof (a checksum, a full format with
a cue word) is a positive, a failed one a negative.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, share, stored
from .quality import logistic

#: Order of kinds among spans with one start.
KINDS = ("email", "ip", "card", "phone", "account", "secret")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"[ ]?[\[(][ ]?at[ ]?[\])][ ]?", re.I)
_DOTTED = re.compile(r"[A-Za-z0-9-]+(?:[ ]?(?:[\[(][ ]?dot[ ]?[\])]|\.)[ ]?[A-Za-z0-9-]+)+", re.I)
_NATIONAL = re.compile(r"(?<![\w+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"[=:][ ]{0,3}[\"']?([A-Za-z0-9+/_-]{16,}={0,2})")
_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])")
_DIGIT = re.compile(r"[0-9]")
#: Cue words in the context before a candidate, by kind.
CUES = {
    "email": re.compile(r"mail|contact|write to", re.I), "ip": re.compile(r"\bip\b|host|server|address", re.I), "card": re.compile(r"card|visa|credit|payment", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|dial", re.I), "account": re.compile(r"iban|account|bank", re.I), "secret": re.compile(r"token|secret|passw|api.?key|access.?key|credential|auth", re.I),
}


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _before(text: str, end: int, least: int, allowed: frozenset) -> int:
    while end > least and text[end - 1] in allowed:
        end -= 1
    return end


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, bool | None]]]:
    """The base spans, and the other candidates (kind, start, end, proof: True, False or unknown)."""
    base: list[tuple[str, int, int]] = []
    more: list[tuple[str, int, int, bool | None]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = _before(text, at, last, _LOCAL)
        m = _DOMAIN.match(text, at + 1)
        if m and start < at:
            base.append(("email", start, m.end()))
            last = m.end()
        elif start < at:
            more.append(("email", start, at + 1, False))
        at = text.find("@", max(at + 1, last))
    for m in _AT.finditer(text) if "at" in text or "AT" in text and ("(" in text or "[" in text) else ():
        start, d = _before(text, m.start(), 0, _LOCAL), _DOTTED.match(text, m.end())
        if start < m.start():
            more.append(("email", start, d.end() if d else m.end(), None if d else False))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            good = all(len(p) < 10 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))
            (base.append(("ip", *m.span())) if good else more.append(("ip", *m.span(), False)))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                base.append(("card", *m.span()))
            elif len(d) >= 9:
                more.append(("card", *m.span(), False))
        for m in _PHONE.finditer(text) if "+" in text else ():
            good = 9 <= len(_digits(m[0])) <= 15
            (base.append(("phone", *m.span())) if good else more.append(("phone", *m.span(), False)))
        for m in _NATIONAL.finditer(text):
            cue = bool(CUES["phone"].search(text, max(0, m.start() - 24), m.start()))
            more.append(("phone", *m.span(), True if cue else None))
        for m in _IBAN.finditer(text):
            s = m[0].replace(" ", "")
            more.append(("account", *m.span(), int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1))
    for m in _SECRET.finditer(text) if "=" in text or ":" in text else ():
        cue = CUES["secret"].search(text, max(0, m.start() - 24), m.start())
        more.append(("secret", *m.span(1), bool(cue) and entropy(m[1]) >= 3 if cue or entropy(m[1]) < 3 else None))
    for m in _HEX.finditer(text):
        more.append(("secret", *m.span(), None))
    return base, more


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate, as numbers."""
    s, left, right = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    d = _digits(s)
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(d)), len(d) / max(1, len(s)), sum(c.isalpha() for c in s) / max(1, len(s)), entropy(s),
        float(sum(not c.isalnum() for c in s)), float(len(re.split(r"[^0-9A-Za-z]+", s))), float(len(d) > 1 and luhn(d)), float(s[:1] == "+"), float("." in s),
        float(bool(CUES[kind].search(left))), float(bool(re.search(r"[=:]\s*[\"']?$", left))), float(left[-1:].isalnum()), float(right[:1].isalnum()),
        float(bool(re.search(r"[=:\"'(\[]$", left.rstrip()))), float(max((len(p) for p in re.split(r"[^0-9]+", s)), default=0)),
    ]


@dataclass
class Trees:
    """Boosted trees: for each, (feature, cut, left, right, value) of its nodes; thresholds by kind."""

    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)
    start: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            at = np.zeros(len(x), int)
            feature, cut, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
            for _ in range(8):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, kinds: list[str], rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, precision: float = 0.95, seed: int = 7) -> Trees:
    """Trees on two thirds of the rows; the others calibrate the probability and the thresholds."""
    model = Trees()
    if len(set(y.tolist())) < 2:
        return model
    apart = np.random.default_rng(seed).random(len(y)) < 1 / 3
    if len(set(y[~apart].tolist())) < 2 or len(set(y[apart].tolist())) < 2:
        apart = np.zeros(len(y), bool)
    learn = ~apart
    xs, ys = x[learn], y[learn].astype(float)
    cuts = [np.unique(np.quantile(xs[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(xs.shape[1])]
    binned = np.stack([np.searchsorted(c, xs[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    mean = np.clip(ys.mean(), 1e-3, 1 - 1e-3)
    model.start = float(np.log(mean / (1 - mean)))
    z = np.full(len(ys), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = ys - p, p * (1 - p) + 1e-6
        tree: list = [None]
        todo = [(0, np.arange(len(ys)), 0)]
        while todo:
            node, idx, level = todo.pop()
            gs, hs = g[idx].sum(), h[idx].sum()
            best = (1e-3, -1, 0)
            if level < depth and len(idx) >= 10:
                for f, c in enumerate(cuts):
                    if len(c):
                        gl = np.cumsum(np.bincount(binned[idx, f], weights=g[idx], minlength=len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[idx, f], weights=h[idx], minlength=len(c) + 1))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        k = int(gain.argmax())
                        best = max(best, (float(gain[k]), f, k))
            _, f, k = best
            if f < 0:
                value = rate * gs / (hs + 1)
                tree[node] = (-1, 0.0, 0, 0, float(value))
                z[idx] += value
                continue
            go = binned[idx, f] <= k
            tree[node] = (f, float(cuts[f][k]), len(tree), len(tree) + 1, 0.0)
            todo += [(len(tree), idx[go], level + 1), (len(tree) + 1, idx[~go], level + 1)]
            tree += [None, None]
        model.trees.append(tree)
    rest = apart if apart.any() else learn
    model.slope, model.shift = logistic(model.margin(x[rest]), y[rest])
    p, names = model.probability(x[rest]), np.array(kinds)[rest]
    for kind in KINDS:
        score, right = p[names == kind], y[rest][names == kind]
        order = np.argsort(-score, kind="stable")
        exact = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(exact >= precision)
        model.thresholds[kind] = max(0.5, float(score[order][good[-1]])) if len(good) and right[order][good[0]] else 0.95
    return model


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = 5000, candidates: int = 100_000) -> Trees:
    """Trees from the candidates of about `sample` texts picked by a hash of their ids; about `candidates` of them, picked by
    a hash of text and place for each kind and verdict alike, come to the driver. Without candidates, or of one verdict only, there are no trees."""
    n = docs.count()
    if not n:
        return Trees()
    rank = F.pmod(F.xxhash64(F.col(id_col), F.lit("pii")), F.lit(1_000_000)) / 1e6
    some = docs.where(F.col(text_col).isNotNull() & (rank < min(1.0, sample / n))).select(F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("t"))

    def run(texts: list) -> list:
        out = []
        for t in texts:
            base, more = scan(t)
            found = [(k, a, b, True) for k, a, b in base] + [c for c in more if c[3] is not None]
            out.append([[float(y), *describe(t, k, a, b)] for k, a, b, y in found])
        return [out]

    rows = stored(map_columns(some, ["t"], [T.StructField("x", T.ArrayType(T.ArrayType(T.DoubleType())))], run, keep=["h"]).select("h", F.posexplode("x").alias("at", "x")))
    counts = {(r.y, r.k): r.n for r in rows.groupBy(F.col("x")[0].alias("y"), F.col("x")[1].alias("k")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Trees()
    share_of = min(1.0, candidates / sum(counts.values()))
    least = {yk: max(share_of, min(1.0, candidates / (20 * len(counts) * n))) for yk, n in counts.items()}  # rare ones are not thinned out
    shares = F.create_map(*[F.lit(x) for (y, k), v in least.items() for x in (f"{y:.0f} {k:.0f}", v)])[F.concat_ws(" ", F.col("x")[0].cast("int"), F.col("x")[1].cast("int"))]
    picked = rows.where(F.pmod(F.xxhash64("h", "at"), F.lit(1_000_000)) / 1e6 < shares).orderBy("x").select("x").collect()
    if not picked:
        return Trees()
    data = np.array([r.x for r in picked])
    return fit(data[:, 1:], data[:, 0].astype(int), [KINDS[int(k)] for k in data[:, 1]])


def choose(text: str, model: Trees) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans and all chosen spans, each by start, then kind."""
    base, more = scan(text)
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    chosen: list[tuple[str, int, int]] = []
    if more and model.trees:
        p = model.probability(np.array([describe(text, k, a, b) for k, a, b, _ in more]))
        starts, ends = _united((a, b) for _, a, b in base)
        for score, (k, a, b, _) in sorted(zip(p.tolist(), more, strict=True), key=lambda x: (-x[0], x[1][1], x[1][2])):
            at = bisect_left(ends, a + 1)  # the first taken span that ends after this one starts
            if score >= model.thresholds.get(k, 0.95) and (at == len(starts) or starts[at] >= b):
                chosen.append((k, a, b))
                starts.insert(at, a)
                ends.insert(at, b)
    return sorted(base, key=order), sorted(base + chosen, key=order)


def _united(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans, those that overlap as one."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def find(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """`docs` with base (spans by rules) and spans (all), as kind:start:end joined by commas, n_<kind> of the base spans,
    n_account and n_secret (which only the trees add) and n_spans, the number of all spans.

    Positions are code points of the whole text, ends exclusive; null counts as empty. Rows stay one to one, repeated ones too; an
    empty table gives no rows. Other columns pass through, clashing ones are replaced.
    """
    shared = share(docs.sparkSession, model)

    def run(texts: list) -> list:
        m, out = shared(), tuple([] for _ in range(3 + len(KINDS)))
        for t in texts:
            base, spans = choose(t or "", m)
            counts = [sum(s[0] == k for s in (base if k in KINDS[:4] else spans)) for k in KINDS]
            for rows, value in zip(out, (",".join(f"{k}:{a}:{b}" for k, a, b in base), ",".join(f"{k}:{a}:{b}" for k, a, b in spans), *counts, len(spans)), strict=True):
                rows.append(value)
        return list(out)

    fields = [T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())] + [T.StructField(f"n_{k}", T.LongType()) for k in (*KINDS, "spans")]
    return map_columns(docs, [text_col], fields, run)


def redact(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """`docs` with the chosen spans of the text replaced by [KIND]; overlapping spans become one, named by the first. Null stays null."""
    shared = share(docs.sparkSession, model)

    def run(texts: list) -> list:
        m = shared()
        return [[None if t is None else _redacted(t, choose(t, m)[1]) for t in texts]]

    return map_columns(docs, [text_col], [T.StructField("_rl_text", T.StringType())], run).select(*[F.col("_rl_text" if c == text_col else c).alias(c) for c in docs.columns])


def _redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
