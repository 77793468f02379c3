"""Benchmark decontamination with a generalised suffix automaton over the items' words.

The automaton holds every run of words of the benchmark items. Documents are streamed through it word
by word; the longest match ending at each word is tracked, capped at the window length, so a document
costs time in proportion to its words whatever the benchmark holds. The automaton's size follows the
benchmark, not the documents: it is built for blocks of items of at most `block_words` words (a
parameter), each block broadcast by itself; further blocks take further passes over the documents.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TMP, cut, map_columns, share

#: Bytes that belong to words, A-Z as a-z; all others are white space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.symbols: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.symbols.setdefault(w, len(self.symbols)) for w in ws]) for i, ws in items if ws]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, seq in coded:
            state = size = 0
            for c in seq:
                state, size = self._step(state, size, c)
                if size == window:
                    self.items.setdefault(state, set()).add(item)
            if len(seq) < window:
                self.short.setdefault(state, []).append((len(seq), item))
        #: States with a short item among their suffixes.
        self.has_short = [False] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.has_short[s] = s in self.short or (self.link[s] >= 0 and self.has_short[self.link[s]])

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, edges: dict[int, int], length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """The longest match, of at most `window` words, after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        state = self.next[state].get(c, 0)
        if not state:
            return 0, 0
        size += 1
        if size >= self.window:
            size = self.window
            while self.length[self.link[state]] >= size:
                state = self.link[state]
        return state, size

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs [start, end) of hit words, and the items with occurring windows."""
        runs: list[tuple[int, int]] = []
        found: set[str] = set()
        get, step, window, has_short = self.symbols.get, self._step, self.window, self.has_short
        state = size = 0
        for p, c in enumerate(map(get, seq)):
            if c is None:
                state = size = 0
                continue
            state, size = step(state, size, c)
            if size == window:
                found |= self.items[state]
                _add(runs, p + 1 - window, p + 1)
            if has_short[state]:
                s = state
                while s > 0:
                    for n, item in self.short.get(s, ()):
                        if n <= size:
                            found.add(item)
                            _add(runs, p + 1 - n, p + 1)
                    s = self.link[s]
        return runs, found


def _add(runs: list[tuple[int, int]], start: int, end: int) -> None:
    """Adds a run that ends last; it merges with those it meets or touches."""
    while runs and runs[-1][1] >= start:
        start = min(start, runs.pop()[0])
    runs.append((start, end))


def scan(df: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = 100_000) -> DataFrame:
    """`df` with n_words, hit_runs (array<long>: start, end, start, end ... in words) and items (sorted).

    A window is `window` consecutive words of an item; an item with fewer words, but not none, is one
    window. Words inside an occurrence are hit. Null text has no words; a null item id counts as "";
    items that share an id count as one. An empty benchmark hits nothing. Columns of `df` with these
    names are replaced, all others pass through; rows stay one to one.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.size(F.split("t", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_words))
    spark = df.sparkSession
    names = {"n_words", "hit_runs", "items"}
    out = df.select(*[c for c in df.columns if c.lower() not in names], F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("hit_runs"), F.array().cast("array<string>").alias("items"))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_runs", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        shared = share(spark, Automaton([(r.i, words(r.t)) for r in part.collect()], window))

        def run(texts: list, runs: list, found: list, shared=shared) -> list:
            a = shared()
            rows: tuple[list, list, list] = ([], [], [])
            for text, old, seen in zip(texts, runs, found, strict=True):
                seq = words(text)
                hits, items = a.scan(seq)
                if old:
                    hits = _merged(sorted([*hits, *zip(old[::2], old[1::2], strict=True)]))
                rows[0].append(len(seq))
                rows[1].append([x for h in hits for x in h])
                rows[2].append(sorted(items | set(seen)))
            return list(rows)

        out = map_columns(cut(out) if block else out, [text_col, "hit_runs", "items"], fields, run)
    return out


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in runs:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """`df` without the passages that it shares with the benchmark.

    Hit runs (each at least a whole window) are cut out of the text, with the white space after them;
    a row of which at least `max_coverage` of the words are hit goes as a whole. Rows without hits,
    null and empty texts stay exactly as they are; columns are those of `df`.
    """
    out = scan(df.withColumnsRenamed({c: f"{TMP}x_{c}" for c in df.columns}), benchmark, window, f"{TMP}x_{text_col}", **options)
    hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda a, x: x - a)  # ends less starts
    out = out.where((F.col("n_words") == 0) | (hit < F.col("n_words") * F.lit(max_coverage)))

    def clean(texts: list, runs: list) -> list:
        return [[_without(t, r) if r else t for t, r in zip(texts, runs, strict=True)]]

    out = map_columns(out, [f"{TMP}x_{text_col}", "hit_runs"], [T.StructField(f"{TMP}clean", T.StringType())], clean)
    return out.select(*[F.col(f"{TMP}clean" if c == text_col else f"{TMP}x_{c}").alias(c) for c in df.columns])


def _without(text: str, runs: list[int]) -> str:
    spans = [m.span() for m in _WORD.finditer(text)]
    keep, at = [], 0
    for s, e in zip(runs[::2], runs[1::2], strict=True):
        keep.append(text[at : spans[s][0]])
        at = spans[e - 1][1]
        at += len(text[at:]) - len(text[at:].lstrip())
    return "".join([*keep, text[at:]])


def hit_words(runs: list[int]) -> int:
    a = np.array(runs, np.int64)
    return int((a[1::2] - a[::2]).sum())
