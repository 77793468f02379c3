"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, in Arrow batches.

Encoding is the vocabulary's own rule: all adjacent symbols whose joined text is a piece wait in an agenda ordered by score (ties:
the leftmost), the best pair is merged, its new neighbours enter the agenda. No merge crosses a place where the two characters stand
side by side in no piece, so a batch of texts is cut there, each distinct unit of the batch is encoded once, and its ids are put in
every place where it stands. Short units take their agendas in step, the best pair of each at a time, as arrays; longer ones have
a heap each, so a text without any place to cut takes n log n steps. Memory follows the batch (a text at least).

The ids of every distinct unit are checked against the sentencepiece library in the same batch; a difference stops the job.
"""

from __future__ import annotations

import codecs
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TMP, map_columns, ragged, run_hashes, share

SPACE = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Units of more symbols have a heap of their own.
IN_STEP = 40


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message: whole numbers, or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}[tag & 7] if tag & 7 in (1, 5) else number()
        yield tag >> 3, data[at : at + size]
        at += size


class Vocabulary:
    """The pieces of a model file, and what encoding needs of them."""

    def __init__(self, model: bytes):
        self.model = model
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for n, value in _fields(model):
            if n == 1:
                f = dict(_fields(value))
                self.pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif n in (2, 3):
                (trainer if n == 2 else normalizer).update(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or normalizer.get(1, b"") != b"identity" or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or {k for _, _, k in self.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type vocabularies with byte fallback, a dummy prefix and no normalisation are supported")
        words = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        long = [p for p in words if len(p) > 1]
        chars = sorted({c for p in words for c in p} | {SPACE})
        # symbols: all ids, then characters that stand only inside pieces
        self.symbol = {c: words.get(c, -1) for c in chars}
        for c in (c for c in chars if self.symbol[c] < 0):
            self.symbol[c] = len(self.pieces) + sum(s >= len(self.pieces) for s in self.symbol.values())
        self.n_symbols = len(self.pieces) + sum(s >= len(self.pieces) for s in self.symbol.values())
        known = {**words, **self.symbol}
        scores = np.array([s for _, s, _ in self.pieces])
        rank = np.unique(-scores, return_inverse=True)[1]
        pairs = {(known[p[:k]], known[p[k:]]): words[p] for p in long for k in range(1, len(p)) if p[:k] in known and p[k:] in known}
        keys = np.array([a * self.n_symbols + b for a, b in pairs] or [-1], np.int64)
        by = np.argsort(keys)
        self.keys, self.merged = keys[by], np.array(list(pairs.values()) or [0], np.int64)[by]
        self.rank = rank.astype(np.int64)
        self.pair = {k: (int(rank[m]), m) for k, m in pairs.items()}
        # places to cut: characters as numbers (0: in no longer piece), and which two stand side by side in a piece
        inner = sorted({c for p in long for c in p})
        self.inner = np.zeros(0x110000, np.int32)
        self.inner[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        number = {c: k + 1 for k, c in enumerate(inner)}
        self.beside = np.zeros((len(inner) + 1,) * 2, bool)
        for p in long:
            for a, b in zip(p, p[1:]):
                self.beside[number[a], number[b]] = True
        self.symbols = np.full(0x110000, -1, np.int32)
        self.symbols[[ord(c) for c in self.symbol]] = list(self.symbol.values())
        self.bytes = np.array([next(i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE and p == f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.apart = next(chr(c) for c in range(1, 0x110000) if chr(c) not in known and chr(c) != " ")
        unknown = next(i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN)
        surface = trainer.get(44, " ⁇ ".encode())
        byte = {i: bytes([b]) for b, i in enumerate(self.bytes.tolist())}
        self.decoded = [surface if i == unknown else b"" if k == CONTROL else byte.get(i) or p.replace(SPACE, " ").encode() for i, (p, _, k) in enumerate(self.pieces)]
        self.opens = np.array([k == NORMAL and p.startswith(SPACE) for p, _, k in self.pieces])
        self.silent = np.array([k == CONTROL for _, _, k in self.pieces])
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, -1 where it makes none."""
        key = a * self.n_symbols + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], -1)


def agenda(symbols: list[int], pair: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """One unit's symbols after all merges: a heap of (rank of the score, position, the two symbols), stale entries passed over."""
    right = list(range(1, len(symbols) + 1))
    left = list(range(-1, len(symbols) - 1))
    heap = [(pair[p][0], k, *p) for k, p in enumerate(zip(symbols, symbols[1:])) if p in pair]
    heapq.heapify(heap)
    symbols = [*symbols]
    while heap:
        _, k, a, b = heapq.heappop(heap)
        r = right[k]
        if symbols[k] != a or r == len(symbols) or symbols[r] != b:
            continue
        symbols[k], symbols[r] = pair[a, b][1], -2
        right[k] = right[r]
        if right[k] < len(symbols):
            left[right[k]] = k
        for x in (left[k], k):
            if x >= 0 and right[x] < len(symbols) and (p := (symbols[x], symbols[right[x]])) in pair:
                heapq.heappush(heap, (pair[p][0], x, *p))
    return [s for s in symbols if s != -2]


def in_step(symbols: np.ndarray, sizes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of many units after all merges, and the units' new sizes: each round merges the best pair of every unit that has one."""
    unit = np.repeat(np.arange(len(sizes)), sizes)
    out_symbols, out_units = [], []
    none = np.int64(1) << 60

    def ranked(made: np.ndarray) -> np.ndarray:
        return np.where(made >= 0, v.rank[made], none)

    same = np.concatenate([unit[1:] == unit[:-1], [False]])[: len(unit)]
    made = np.full(len(unit), -1)
    made[same] = v.lookup(symbols[:-1][same[:-1]], symbols[1:][same[:-1]])
    key = ranked(made)
    while len(unit):
        heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        best = np.minimum.reduceat(key, heads)
        lengths = np.diff(np.append(heads, len(unit)))
        open_ = best < none
        if not open_.all():
            done = ~np.repeat(open_, lengths)
            out_symbols.append(symbols[done])
            out_units.append(unit[done])
            symbols, unit, made, key = symbols[~done], unit[~done], made[~done], key[~done]
            if not len(unit):
                break
            lengths, best = lengths[open_], best[open_]
            heads = np.cumsum(lengths) - lengths
        hits = np.flatnonzero(key == np.repeat(best, lengths))
        at = hits[np.concatenate([[True], unit[hits[1:]] != unit[hits[:-1]]])]  # the leftmost of each unit
        symbols[at] = made[at]
        keep = np.ones(len(unit), bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))
        symbols, unit, made, key = symbols[keep], unit[keep], made[keep], key[keep]
        made[at], key[at] = -1, none
        for x in (at - 1, at):
            x = x[(x >= 0) & (x + 1 < len(unit))]
            x = x[unit[x] == unit[x + 1]]
            made[x] = v.lookup(symbols[x], symbols[x + 1])
            key[x] = ranked(made[x])
    if not out_units:
        return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    symbols, unit = np.concatenate(out_symbols), np.concatenate(out_units)
    by = np.argsort(unit, kind="stable")
    return symbols[by], np.bincount(unit, minlength=len(sizes))


def encode_texts(texts: list[str], v: Vocabulary, check: bool = True) -> list[np.ndarray]:
    """The ids of each text."""
    found = [np.zeros(0, np.uint32)] * len(texts)
    some = [k for k, t in enumerate(texts) if t]
    if not some:
        return found
    codes = np.frombuffer("".join(" " + texts[k] for k in some).encode("utf-32-le"), np.int32).copy()
    codes[codes == ord(" ")] = ord(SPACE)
    firsts = np.cumsum([0, *(len(texts[k]) + 1 for k in some)])
    inner = v.inner[codes]
    cut = np.concatenate([[True], ~v.beside[inner[:-1], inner[1:]]])
    cut[firsts[:-1]] = True
    del inner
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, len(codes)))
    _, first, which = np.unique(run_hashes(codes, starts, starts + sizes), return_index=True, return_inverse=True)
    if (sizes != sizes[first][which]).any() or (codes != codes[ragged(starts[first][which], sizes)]).any():
        # two units with one hash: told apart by their text
        held: dict[bytes, int] = {}
        which = np.array([held.setdefault(codes[a : a + n].tobytes(), len(held)) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        first = np.unique(which, return_index=True)[1]
    ids, lengths = _units(codes, starts[first], sizes[first], v)
    if check:
        _check(codes, starts[first], sizes[first], ids, lengths, v)
    ends = np.cumsum(lengths)
    all_ids = ids[ragged((ends - lengths)[which], lengths[which])].astype(np.uint32)
    until = np.concatenate([[0], np.cumsum(lengths[which])])[np.searchsorted(starts, firsts)]
    for n, k in enumerate(some):
        found[k] = all_ids[until[n] : until[n + 1]]
    return found


def _units(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units of characters, one after the other, and their numbers."""
    chars = codes[ragged(starts, sizes)]
    symbols = v.symbols[chars].astype(np.int64)
    symbols = np.where(symbols < 0, -chars - 3, symbols)  # a character of no piece stands for itself
    long = sizes > IN_STEP
    out, lengths = in_step(symbols[np.repeat(~long, sizes)], sizes[~long], v)
    if long.any():
        at, parts, counts = np.cumsum(sizes) - sizes, [], np.zeros(len(sizes), np.int64)
        counts[~long] = lengths
        for k in np.flatnonzero(long).tolist():
            parts.append(np.array(agenda(symbols[at[k] : at[k] + sizes[k]].tolist(), v.pair), np.int64))
            counts[k] = len(parts[-1])
        both = np.empty(counts.sum(), np.int64)
        spread = np.repeat(long, counts)
        both[~spread], both[spread] = out, np.concatenate(parts)
        out, lengths = both, counts
    # characters without a piece become their bytes
    plain = (out >= 0) & (out < len(v.pieces))
    if plain.all():
        return out, lengths
    lone = {n: c for c, n in v.symbol.items() if n >= len(v.pieces)}
    bare = np.flatnonzero(~plain)
    as_bytes = [(lone[s] if s >= 0 else chr(-s - 3)).encode() for s in out[bare].tolist()]
    width = np.ones(len(out), np.int64)
    width[bare] = [len(b) for b in as_bytes]
    filled = np.repeat(out, width)
    filled[np.repeat(~plain, width)] = v.bytes[np.frombuffer(b"".join(as_bytes), np.uint8)]
    upto = np.concatenate([[0], np.cumsum(width)])
    ends = np.cumsum(lengths)
    return filled, upto[ends] - upto[ends - lengths]


def _check(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, v: Vocabulary, at_once: int = 300) -> None:
    """The units against the library: some hundred at a time, parted by a character that merges with nothing."""
    ends = np.cumsum(lengths)
    apart = v.bytes[np.frombuffer(v.apart.encode(), np.uint8)].tolist()
    lone = v.library.encode(v.apart)
    for k in range(0, len(starts), at_once):
        a, n = starts[k : k + at_once], sizes[k : k + at_once]
        chars = codes[ragged(a, n)]
        joined = np.insert(chars, np.cumsum(n) - n, ord(v.apart)).astype("<u4").tobytes().decode("utf-32-le")
        own = ids[ends[k] - lengths[k] : ends[min(k + at_once, len(starts)) - 1]]
        m = lengths[k : k + at_once]
        want = np.insert(own, np.repeat(np.cumsum(m) - m, len(apart)), np.tile(apart, len(m))).tolist()
        got = v.library.encode(joined.replace(SPACE, " "), num_threads=1)
        if got != lone[: len(lone) - len(apart)] + want:
            raise RuntimeError("the ids differ from the library's")


def _each_byte(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


def decode_ids(ids: list[np.ndarray], v: Vocabulary) -> list[str]:
    """The text of each sequence of ids: pieces joined, the dummy prefix taken off, bytes that are no UTF-8 as U+FFFD each; ids beyond the vocabulary are an error."""
    codecs.register_error("rowloom_each_byte", _each_byte)
    sizes = np.array([len(b) for b in v.decoded], np.int64)
    data, starts = np.frombuffer(b"".join(v.decoded), np.uint8), np.cumsum(sizes) - sizes
    out = []
    for x in ids:
        x = x.astype(np.int64)
        text = data[ragged(starts[x], sizes[x])].tobytes()
        spoken = np.flatnonzero(~v.silent[x]) if v.silent[x[:1]].any() else np.zeros(min(1, len(x)), np.int64)
        if len(spoken) and v.opens[x[spoken[0]]]:
            text = text[1:]
        out.append(text.decode("utf-8", "rowloom_each_byte"))
    return out


def encode(df: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, check: bool = True) -> DataFrame:
    """`df` with `ids_col` (array of int): each row's whole text as ids, without begin or end ids; null and empty texts have none.

    `model` is the model file's content. With `decoded_col`, also the text that the ids decode to (empty for null). Rows stay one to one, in
    their partitions: no shuffle; repeated rows stay, an empty table gives no rows, clashing columns are replaced. `check` holds each
    distinct unit of each batch against the library.
    """
    shared, text = share(df.sparkSession, model), f"{TMP}t"
    held: list[Vocabulary] = []

    def run(texts: list[str | None]) -> list[list]:
        if not held:
            held.append(Vocabulary(shared()))
        ids = encode_texts([t or "" for t in texts], held[0], check)
        upto = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
        found = [pa.ListArray.from_arrays(pa.array(upto), pa.array(flat))]
        return [*found, decode_ids(ids, held[0])] if decoded_col else found

    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])]
    kept = [c for c in df.columns if c.lower() not in {f.name.lower() for f in fields}]
    return map_columns(df.withColumn(text, F.col(text_col).cast("string")), [text], fields, run, keep=kept)


def decode(df: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """`df` with `out_col`, the text of `ids_col` (array of int); null gives null. Rows stay one to one, clashing columns are replaced."""
    shared, held = share(df.sparkSession, model), []

    def run(rows: list[list[int] | None]) -> list[list]:
        if not held:
            held.append(Vocabulary(shared()))
        texts = decode_ids([np.array(r or [], np.int64) for r in rows], held[0])
        return [[None if r is None else t for r, t in zip(rows, texts, strict=True)]]

    return map_columns(df, [ids_col], [T.StructField(out_col, T.StringType())], run)
