"""Language identification with bit-sliced Bloom filters over character n-grams.

One Bloom filter for each language, all with the same hash functions, stored side by side: row p of
the table is a bit mask of the languages whose filter has bit p set. The AND of an n-gram's rows is
the mask of all languages that contain it. Over a text, each language's bit is counted; the counts are
corrected for that filter's false positives, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TMP, chunks, hash_sample, map_columns, merged_pieces, mix, pieces_of, share, slices, tidy

N, ROWS_LOG2, HASHES = 4, 20, 3
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For every code point: is it a letter?"""
    return np.strings.isalpha(np.arange(0x110000, dtype=np.uint32).view("U1"))


def ngrams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of lower-cased letters and single spaces; how many each text has; which texts have a letter."""
    low = [t.lower() for t in texts]
    flat = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 2 for t in low])
    starts = ends - [len(t) + 2 for t in low]
    known = letters[flat]
    keep = known.copy()
    keep[1:] |= known[:-1]
    keep[starts] = True
    size = np.add.reduceat(keep, starts, dtype=np.int64)
    some = np.logical_or.reduceat(known, starts)
    h = _hashes(np.where(known, flat, 32)[keep].astype(np.uint64))
    grams = np.maximum(size - N + 1, 0)
    place = np.cumsum(size) - size
    inside = np.ones(len(h) + N, bool)
    for s, g, n in zip(place, grams, size, strict=True):  # n-grams don't reach from one text into the next
        inside[s + g : s + n] = False
    return mix(h[inside[: len(h)]]), grams, some


def _hashes(chars: np.ndarray) -> np.ndarray:
    h = np.zeros(max(0, len(chars) - N + 1), np.uint64)
    for k in range(N):
        h = h * np.uint64(0x9E3779B97F4A7C15) + chars[k : k + len(h)]
    return h


def long_ngrams(text: str, letters: np.ndarray, piece: int) -> Iterator[tuple[np.ndarray, bool]]:
    """What `ngrams` gives for one text, in pieces of about `piece` characters: (hashes, whether there is a letter).

    The last characters of a piece go on into the next, so no n-gram is lost or made up. Pieces end at a space where there is one.
    """
    tail, carry, at = np.full(1, 32, np.uint64), False, 0
    while at < len(text):
        end = at + piece
        if end < len(text):
            end = text.rfind(" ", at, end) + 1 or end
        flat = np.frombuffer(text[at:end].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letters[flat]
        keep = known.copy()
        keep[1:] |= known[:-1]
        keep[:1] |= carry
        chars = np.concatenate([tail, np.where(known, flat, 32)[keep].astype(np.uint64)])
        yield mix(_hashes(chars)), bool(known.any())
        tail, carry, at = chars[-(N - 1) :], bool(known[-1]), end
    if carry:
        yield mix(_hashes(np.append(tail, np.uint64(32)))), False


def pieces_of_texts(texts: list[str | None], letters: np.ndarray, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All n-grams of the texts (null as empty) in bounded runs: (texts' numbers, hashes, how many each has, which have a letter)."""
    short = [k for k, t in enumerate(texts) if len(t or "") <= piece]
    at = 0
    for run in chunks((texts[k] for k in short), piece):
        of = np.array(short[at : at + len(run)])
        at += len(run)
        yield of, *ngrams(run, letters)
    for k, t in enumerate(texts):
        if len(t or "") > piece:
            for hashes, some in long_ngrams(t, letters, piece):
                yield np.array([k]), hashes, np.array([len(hashes)]), np.array([some])


@dataclass
class Filters:
    """Row p of `masks` has the languages whose filter has bit p set, 64 languages or fewer to each of its words."""

    languages: list[str]
    masks: np.ndarray
    false_positives: np.ndarray

    def rows(self, hashes: np.ndarray, word: int = 0) -> np.ndarray:
        cut, masks = np.uint64((1 << ROWS_LOG2) - 1), self.masks[word]
        found = masks[hashes & cut]
        for k in range(1, HASHES):
            found = found & masks[(hashes >> np.uint64(k * 64 // HASHES)) & cut]
        return found

    def predict(self, texts: list[str | None], letters: np.ndarray, piece: int = 200_000) -> tuple[list[str], list[float]]:
        """Languages and scores. Some 40 bytes a character of `piece` are held, whatever the texts' length; it changes no result."""
        hits, grams, some = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        bits = 8 * self.masks.itemsize
        for of, hashes, n, letter in pieces_of_texts(texts, letters, piece):
            ends = np.concatenate([[0], np.cumsum(n)])
            np.add.at(grams, of, n)
            np.logical_or.at(some, of, letter)
            for k in range(len(self.languages)):
                if k % bits == 0:
                    found = self.rows(hashes, k // bits)
                total = np.concatenate([[0], np.cumsum((found >> found.dtype.type(k % bits)) & found.dtype.type(1), dtype=np.int64)])
                np.add.at(hits[:, k], of, total[ends[1:]] - total[ends[:-1]])
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        real = (hits - grams[:, None] * self.false_positives) / (1 - self.false_positives)
        best = real.argmax(axis=1)
        part = np.clip(real[np.arange(len(texts)), best] / np.maximum(grams, 1), 0, 1)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], [float(x) if s else 0.0 for x, s in zip(part, some, strict=True)]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = 4000, min_rate: float = 1e-5, min_share: float = 0.3) -> Filters:
    """Filters from about `sample` rows of each language (the bound of the fit), picked by a hash of their ids.

    A language's filter holds the n-grams that make up `min_rate` of its n-grams or more, and whose
    rate is `min_share` of their highest rate in any language or more. Rates sum to 1, so a filter
    holds at most 1 / min_rate n-grams. Filters are filled on the executors; what comes to the driver has a fixed size.
    Without any labelled text there are no languages, and every text is `und`. Repeated rows count as often as they are there.
    """
    some = hash_sample(docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t")), "l", id_col, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in slices(batches):
            langs, texts = batch.column("l").to_pylist(), batch.column("t").to_pylist()
            for lang in set(langs):
                for _, hashes, _, _ in pieces_of_texts([t for t, x in zip(texts, langs, strict=True) if x == lang], letters, 1_000_000):
                    grams, n = np.unique(hashes.view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n, pa.int64())], names=["l", "gram", "n"])

    counts = some.select("l", "t").mapInArrow(tidy(count), "l string, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    totals = {r.l: r.n for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Filters([], np.zeros((1, 1 << ROWS_LOG2), np.uint8), np.zeros(0))
    languages = sorted(totals, key=lambda k: (-totals[k], k))
    width = next((k for k in (8, 16, 32) if len(languages) <= k), 64)
    words, kind = -(-len(languages) // width), np.dtype(f"u{width // 8}")
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])[F.col("l")]
    rate = F.col("n") / F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, v)])[F.col("l")]
    by_gram = counts.select("gram", number.alias("l"), rate.alias("r")).where(F.col("r") >= min_rate).groupBy("gram").agg(F.collect_list(F.struct("l", "r")).alias("x"), F.max("r").alias("top"))
    kept = by_gram.select("gram", F.explode(F.expr(f"transform(filter(x, e -> e.r >= {min_share} * top), e -> e.l)")).alias("l"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, cut = np.zeros((words, 1 << ROWS_LOG2), kind), np.uint64((1 << ROWS_LOG2) - 1)
        for batch in batches:
            hashes, lang = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for k in range(HASHES):
                np.bitwise_or.at(masks, (lang // width, (hashes >> np.uint64(k * 64 // HASHES)) & cut), kind.type(1) << (lang % width).astype(kind))
        yield from pieces_of(masks.ravel(), 1 << 16)

    found = merged_pieces(kept.mapInArrow(tidy(fill), "piece int, data binary"), words * kind.itemsize << ROWS_LOG2, kind, np.bitwise_or, lambda x: x.view(np.uint8))
    masks = found.view(kind).reshape(words, 1 << ROWS_LOG2)
    share_ = np.array([((masks[k // width] >> kind.type(k % width)) & kind.type(1)).mean() for k in range(len(languages))])
    return Filters(languages, masks, share_**HASHES)


def identify(docs: DataFrame, filters: Filters, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """`docs` with the language of each whole text and its score.

    The score (0 to 1) is the share of the text's n-grams that the language has, corrected for false
    positives. Null texts and texts without a letter are `und` with score 0, and so is every text if `filters` has no language;
    equal counts go to the language with the most training text. Rows stay one to one, repeated ones too; an empty table gives
    no rows. Other columns pass through, clashing ones are replaced.
    """
    shared = share(docs.sparkSession, filters)
    held: list[np.ndarray] = []

    def run(texts: list) -> list:
        if not held:
            held.append(_letters())
        return list(shared().predict(texts, held[0]))

    return map_columns(docs, [text_col], [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())], run)


def keep_known(docs: DataFrame, filters: Filters, text_col: str = "text", min_score: float = 0.05) -> DataFrame:
    """The rows whose text is in a known language: not `und`, and with a score that may well be `min_score` or more.

    The score of a text of n characters is a share among about n; a row goes if the upper end of its 95 % interval (Wilson's, two
    deviations) is below `min_score`, so the less a text says, the more it takes. Where `filters` has no language, texts with a letter stay.
    Repeated rows stay, an empty table gives no rows. Columns stay as they are.
    """
    if not filters.languages:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    found = identify(docs, filters, text_col, f"{TMP}lang", f"{TMP}score")
    s, n = F.col(f"{TMP}score"), F.greatest(F.length(text_col), F.lit(1)).cast("double")
    upper = (s + 2 / n + 2 * F.sqrt(s * (1 - s) / n + 1 / (n * n))) / (1 + 4 / n)
    return found.where((F.col(f"{TMP}lang") != UNKNOWN) & (upper >= min_score)).select(*docs.columns)
