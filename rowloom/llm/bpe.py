"""Byte-level BPE encoding through a distinct-word table, and decoding through an id-to-piece join.

Encoding splits texts into words (the vocabulary's own pre-tokenisation) and works on blocks: runs of
documents of one partition with a bounded number of words. A block keeps each of its distinct words
once, and its documents as numbers of these words. One exchange deals both: words by their hash, so that
every distinct word meets one task, which encodes it once; documents by block. The ids return to the block
and are put back by position. A frequent word counts once for each block, however often it occurs, so no
word makes a large group.

Decoding takes runs of rows; the distinct ids of each run are joined with the id-to-piece table, and the pieces
put in place of the ids. That table has one row for each id of the vocabulary file (50,257 here), a bound that
does not depend on the data, so the join broadcasts it; an id counts once for each run, so none is hot.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import TMP, mix, ragged, release, slices, tidy

# Latin-1 letters, numbers and white space, as \p{L}, \p{N} and \s have them.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = r"\t\n\x0b\x0c\r \x85\xa0"
#: The byte-level word pattern over Latin-1; other texts go through the tokenizer's own splitter.
WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")

BLOCK_WORDS, BLOCK_TOKENS = 100_000, 1_200_000


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Splitter:
    """Words of a text, special tokens whole, as the tokenizer's pre-tokenisation gives them."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        kind = json.loads(vocabulary)
        pre = kind["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or kind["normalizer"] is not None or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in kind["added_tokens"]):
            raise ValueError("only plain byte-level vocabularies are supported")
        special = sorted((t["content"] for t in kind["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.hints = special
        self.bytes = byte_symbols()

    def words(self, text: str) -> list[str]:
        if any(s in text for s in self.hints):
            parts = self.special.split(text)
            return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [bytes(map(self.bytes.__getitem__, piece)).decode("utf-8") for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return WORDS.findall(text)


def _blocks(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[tuple[int, list, list[np.ndarray], list[str]]]:
    """(block id, document ids, each document's word numbers, the block's distinct words).

    The block id is a digest of the block's texts in order, each with its length and whether it is null.
    """
    split = Splitter(vocabulary).words
    ids: list = []
    codes: list[np.ndarray] = []
    numbers: defaultdict[str, int] = defaultdict(itertools.count().__next__)
    digest, tokens = xxhash.xxh3_64(), 0
    for batch in slices(batches):
        for doc, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = split(text or "")
            data = (text or "").encode()
            digest.update(b"%d " % (-1 if text is None else len(data)))
            digest.update(data)
            ids.append(doc)
            codes.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            tokens += len(words)
            if len(numbers) > BLOCK_WORDS or tokens > BLOCK_TOKENS:
                yield digest.intdigest() - (1 << 63), ids, *_by_frequency(codes, list(numbers))
                ids, codes, numbers = [], [], defaultdict(itertools.count().__next__)
                digest, tokens = xxhash.xxh3_64(), 0
    if ids:
        yield digest.intdigest() - (1 << 63), ids, *_by_frequency(codes, list(numbers))


def _by_frequency(codes: list[np.ndarray], table: list[str]) -> tuple[list[np.ndarray], list[str]]:
    """Numbers the words anew, the most frequent first: small numbers compress well."""
    counts = np.zeros(len(table), np.int64)
    for c in codes:
        np.add.at(counts, c, 1)
    order = np.argsort(-counts, kind="stable")
    new = np.empty(len(table), np.uint32)
    new[order] = np.arange(len(table), dtype=np.uint32)
    return [new[c] for c in codes], [table[k] for k in order]


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """(id_col, ids binary): each row's whole text as BPE ids, little-endian 32-bit integers; null and empty texts have none.

    `vocabulary` is the tokenizer file's content. Rows stay one to one: repeated and null ids are
    kept, other columns are dropped, an empty table gives no rows. Each partition is taken in order of id and text, so it gives
    the same blocks when a lost part of it is computed again. With `decoded_col`, also the text that `decode` gives for the ids.
    """
    docs = df.select(F.col(id_col).alias(f"{TMP}id"), F.col(text_col).cast("string").alias(f"{TMP}text"))
    docs = docs.sortWithinPartitions(F.xxhash64(f"{TMP}id", f"{TMP}text"), f"{TMP}text")
    id_type = docs.schema[0].dataType
    buckets = max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names, kinds = ["key", "block", "n", "lengths", "words", "codes"], [pa.int64(), pa.int64(), *[pa.binary()] * 4]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, codes, table in _blocks(batches, vocabulary):
            deal: list[list[int]] = [[] for _ in range(buckets)]
            for n, w in enumerate(table):
                deal[xxhash.xxh3_64_intdigest(w) % buckets].append(n)
            rows = [(b, block, packed(np.diff(part, prepend=0)), packed([len(table[n]) for n in part]), squeeze("".join(table[n] for n in part).encode()), None) for b, part in enumerate(deal) if part]
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), pa.nulls(len(rows), ids[0].type)], names=[*names, f"{TMP}id"])
            for k in range(0, len(ids), 500):
                part = [packed(c) for c in codes[k : k + 500]]
                rows = [[block] * len(part), [block] * len(part), *[[None] * len(part)] * 3, part]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(rows, kinds, strict=True)), pa.array([i.as_py() for i in ids[k : k + 500]], ids[0].type)], names=[*names, f"{TMP}id"])

    both = docs.mapInArrow(tidy(split), T.StructType([*(T.StructField(n, T.LongType() if k == pa.int64() else T.BinaryType()) for n, k in zip(names, kinds, strict=True)), T.StructField(f"{TMP}id", id_type)])).repartition("key")
    # both readers take all columns and rows of the exchange, so it runs once
    found = both.mapInArrow(tidy(_encoder(vocabulary)), "key long, n binary, sizes binary, ids binary")

    def join(docs: pa.Table, found: pa.Table) -> pa.Table:
        joined = _join(docs.select([f"{TMP}id", "codes"]).filter(docs.column("codes").is_valid()), found).rename_columns([id_col, "ids"])
        if decoded_col and joined.num_rows:  # as rows of runs, for decoding
            key = np.array([docs.column("key")[0].as_py()]).view(np.uint64)
            parts = list(slices(joined.combine_chunks().to_batches()))
            joined = pa.Table.from_batches([r for k, part in enumerate(parts) for r in _run_rows(int(mix(key + np.uint64(k)).view(np.int64)[0]), part, "ids")])
        elif decoded_col:
            joined = RUNS.empty_table()
        release()
        return joined

    out = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.BinaryType())])
    if not decoded_col:
        return both.groupBy("key").cogroup(found.groupBy("key")).applyInArrow(join, out)
    runs = both.groupBy("key").cogroup(found.groupBy("key")).applyInArrow(join, RUN_FIELDS)
    return _with_pieces(runs, vocabulary, out, "ids", decoded_col)


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + zstandard.compress(data, 1)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.decompress(data[8:], int.from_bytes(data[:8], "little")) if data[:8].strip(b"\0") else b""


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 with all low bytes first, then the next bytes, and so on, compressed."""
    return squeeze(np.asarray(numbers).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueeze(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _encoder(vocabulary: str):
    """Encodes the words of the buckets of a partition, each distinct word once; rows of documents are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        table: dict[str, bytes] = {}
        for batch in batches:
            batch = batch.filter(batch.column("codes").is_null())
            for at in range(0, batch.num_rows, 200):
                blocks, n, lengths, data = (batch.column(c)[at : at + 200] for c in ("block", "n", "lengths", "words"))
                sizes, ids = [], []
                for size, text in zip(lengths.to_pylist(), data.to_pylist(), strict=True):
                    text, ends = unsqueeze(text).decode(), np.cumsum(unpacked(size), dtype=np.int64).tolist()
                    words = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                    new = [w for w in words if w not in table]
                    for w, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                        table[w] = np.array(e.ids, "<u4").tobytes()
                    found = [table[w] for w in words]
                    sizes.append(packed(np.fromiter(map(len, found), np.uint32, len(found)) // 4))
                    ids.append(packed(np.frombuffer(b"".join(found), "<u4")))
                    if len(table) > 300_000:
                        table.clear()
                yield pa.RecordBatch.from_arrays([blocks, n, pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=["key", "n", "sizes", "ids"])

    return run


def _join(docs: pa.Table, found: pa.Table) -> pa.Table:
    """Puts the ids of a block's words back at their positions in its documents (id, codes)."""
    if docs.num_rows == 0 and found.num_rows:
        raise RuntimeError(OTHER)
    numbers = np.concatenate([np.zeros(0, np.uint32), *(np.cumsum(unpacked(x), dtype=np.uint32) for x in found.column("n").to_pylist())])
    sizes, ids = (np.concatenate([np.zeros(0, np.uint32), *map(unpacked, found.column(c).to_pylist())]) for c in ("sizes", "ids"))
    ends = np.cumsum(sizes, dtype=np.int64)
    if len(ids) != (ends[-1] if len(ends) else 0) or len(sizes) != len(numbers):
        raise RuntimeError(OTHER)
    size_of, start_of = np.full(len(numbers), -1, np.int64), np.zeros(len(numbers), np.int64)
    if len(numbers) and numbers.max() >= len(numbers):
        # the same block twice (equal partitions): its words came twice, and one copy serves both
        every = numbers
        numbers, first, at = np.unique(numbers, return_index=True, return_inverse=True)
        same = sizes == sizes[first][at]
        if not same.all() or (ids[ragged(ends - sizes, sizes)] != ids[ragged((ends - sizes)[first][at], sizes)]).any() or len(every) % len(numbers):
            raise RuntimeError(OTHER)
        sizes, ends = sizes[first], ends[first]
        size_of, start_of = np.full(int(numbers.max()) + 1, -1, np.int64), np.zeros(int(numbers.max()) + 1, np.int64)
    size_of[numbers], start_of[numbers] = sizes, ends - sizes
    out = []
    for data in docs.column("codes").to_pylist():
        words = unpacked(data)
        if len(words) and (words.max() >= len(size_of) or (size_of[words] < 0).any()):
            raise RuntimeError(OTHER)
        out.append(ids[ragged(start_of[words], size_of[words])].astype("<u4").tobytes())
    return pa.Table.from_arrays([docs.column(0), pa.array(out, pa.binary())], names=[docs.schema.names[0], "ids"])


OTHER = "the input gave other rows when it was read again; write it to a table first"


def pieces(vocabulary: str) -> list[bytes]:
    """The id-to-piece table: the bytes of each id; unused ids are empty."""
    kind, symbols = json.loads(vocabulary), byte_symbols()
    found = {i: bytes(map(symbols.__getitem__, p)) for p, i in kind["model"]["vocab"].items()}
    found |= {t["id"]: t["content"].encode() for t in kind["added_tokens"]}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """`df` with `out_col`, the text of `ids_col` (binary as `encode` gives it); null gives null, unknown ids nothing.

    Bytes that are no UTF-8 become U+FFFD. Other columns pass through, a clashing one is replaced; repeated rows stay,
    an empty table gives no rows.
    """
    kept = [c for c in df.columns if c.lower() != out_col.lower()]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, batch in enumerate(slices(batches)):
            yield from _run_rows(run, batch, ids_col)

    rows = df.select(*dict.fromkeys([*kept, ids_col]))
    return _with_pieces(rows.mapInArrow(tidy(runs), RUN_FIELDS), vocabulary, rows.schema, ids_col, out_col)


#: A run of rows as one row (run, number of its distinct ids, the rows themselves), and one row for each of these ids.
RUN_FIELDS = "run long, id long, n long, held binary"
RUNS = pa.schema([("run", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("held", pa.binary())])


def _run_rows(run: int, batch: pa.RecordBatch, ids_col: str) -> Iterator[pa.RecordBatch]:
    ids = np.unique(np.frombuffer(b"".join(x for x in batch.column(ids_col).to_pylist() if x), "<u4")).astype(np.int64)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    held = pa.array([sink.getvalue().to_pybytes()], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.nulls(1, pa.int64()), pa.array([len(ids)], pa.int64()), held], schema=RUNS)
    for k in range(0, len(ids), 10_000):
        part = pa.array(ids[k : k + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), run, np.int64)), part, pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary())], schema=RUNS)


def _with_pieces(runs: DataFrame, vocabulary: str, schema: T.StructType, ids_col: str, out_col: str) -> DataFrame:
    """The rows of the runs, of this schema, with the text of their ids, through a join of the runs' ids with the id-to-piece table."""
    kept = [f for f in schema.fields if f.name.lower() != out_col.lower()]
    names = [f.name for f in kept]
    p = pieces(vocabulary)
    table = runs.sparkSession.createDataFrame(pa.table({"id": pa.array(range(len(p)), pa.int64()), "piece": pa.array(p, pa.binary())}))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each run, once its ids and pieces are there (the join keeps a run's rows in their partition)."""
        waiting: dict[int, list] = {}
        for batch in batches:
            run = batch.column("run").to_numpy()
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(run[1:] != run[:-1]) + 1):
                if not len(part):
                    continue
                rows = batch.slice(int(part[0]), len(part))
                state = waiting.setdefault(int(run[part[0]]), [None, 0, []])
                if rows.column("n").null_count < len(part):
                    first = rows.filter(rows.column("n").is_valid())
                    state[0] = (first.column("n")[0].as_py(), first.column("held")[0].as_py())
                    rows = rows.filter(rows.column("n").is_null())
                state[1] += rows.num_rows
                state[2].append(rows.select(["id", "piece"]))
                if state[0] and state[0][0] == state[1]:
                    yield from _filled(state[0][1], state[2])
                    del waiting[int(run[part[0]])]
        if waiting:
            raise RuntimeError("a run of rows lost some of its ids")

    def _filled(held: bytes, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([x.column(0).to_numpy() for x in parts])
        found = [x or b"" for p in parts for x in p.column(1).to_pylist()]
        by = np.argsort(ids)
        ids, sizes = ids[by], np.array([len(x) for x in found], np.int64)[by]
        data, starts = np.frombuffer(b"".join(found[k] for k in by.tolist()), np.uint8), np.cumsum(sizes) - sizes
        for batch in pa.ipc.open_stream(held):
            texts = []
            for x in batch.column(ids_col).to_pylist():
                if x is None:
                    texts.append(None)
                    continue
                at = np.searchsorted(ids, np.frombuffer(x, "<u4"))
                texts.append(data[ragged(starts[at], sizes[at])].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, out_col])

    joined = runs.join(F.broadcast(table), "id", "left").select("run", "id", "n", "held", "piece")
    return joined.mapInArrow(tidy(fill), T.StructType([*kept, T.StructField(out_col, T.StringType())]))
