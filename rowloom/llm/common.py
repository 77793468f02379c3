"""Shared pieces of the corpus operators: Arrow column helpers, checkpoints, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.base import cut, shared_folder

#: Prefix of columns that exist only inside an operator.
TMP = "_rl_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves `part` modulo `parts`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives `value` in every task; each Python worker unpacks it once."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get() -> object:
        if not hasattr(shared, "unpacked"):
            shared.unpacked = pickle.loads(shared.load_from_path(shared._path) if shared._path else shared.value)  # the packed form is not kept
        return shared.unpacked

    return get


def release() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks, and several of them share an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` over the batches of a task, with its memory given back at the end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def merged_pieces(parts: DataFrame, width: int, kind: type, join: Callable[[np.ndarray, np.ndarray], np.ndarray], finish: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """One array of `width` (fixed by the caller, so bounded) from the tasks' arrays: rows (piece, data) of zstd-packed pieces,
    joined piece by piece on the executors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = np.frombuffer(zstandard.decompress(data), kind)
                sums[n] = join(sums[n], one) if n in sums else one
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zstandard.compress(finish(x).tobytes(), 1) for x in sums.values()], pa.binary())], names=["piece", "data"])

    out = None
    for r in parts.repartition("piece").mapInArrow(tidy(add), "piece int, data binary").collect():
        one = np.frombuffer(zstandard.decompress(r.data), np.uint8)
        out = np.zeros(width, np.uint8) if out is None else out
        out[r.piece * len(one) : (r.piece + 1) * len(one)] = one
    return np.zeros(width, np.uint8) if out is None else out


def pieces_of(total: np.ndarray, piece: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(total), piece):
        if total[k : k + piece].any():
            yield pa.RecordBatch.from_arrays([pa.array([k // piece], pa.int32()), pa.array([zstandard.compress(total[k : k + piece].tobytes(), 1)], pa.binary())], names=["piece", "data"])


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a Parquet table in the shared checkpoint folder and read again: smaller than `cut` for wide rows."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._rl_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `stored` that nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._rl_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def reclaim(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now: it does so when the driver collects garbage, which may be much later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], fn: Callable[..., list], keep: list[str] | None = None, arrow: bool = False) -> DataFrame:
    """`df` with computed columns, one Arrow batch at a time.

    fn takes one Python list (`arrow`: one Arrow array) for each of `inputs` and returns one list or
    Arrow array for each of `fields`. Other columns pass through unchanged (`keep`: only those); a column whose name clashes
    with a computed one (case-insensitively) is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    kinds = [to_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = fn(*(batch.column(c) if arrow else batch.column(c).to_pylist() for c in inputs))
            made = [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=kept + [f.name for f in fields])

    return df.select(*dict.fromkeys([*kept, *inputs])).mapInArrow(tidy(run), schema)


def slices(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes, a row at least."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(size, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of the runs [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def members(values: DataFrame) -> np.ndarray:
    """A Bloom filter (one hash) of a column of longs: 16 bits for each, 2^27 bits (16 MB) at most."""
    n = max(1, values.count())
    width = 1 << min(24, max(16, math.ceil(math.log2(2 * n))))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint8)
        for batch in batches:
            x = mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(8 * width - 1)
            np.bitwise_or.at(total, (x >> np.uint64(3)).astype(np.int64), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8))
        yield from pieces_of(total, 1 << 16)

    return merged_pieces(values.mapInArrow(tidy(mark), "piece int, data binary"), width, np.uint8, np.bitwise_or, lambda x: x)


def may_be_in(rows: DataFrame, key: str, values: DataFrame, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str | None = None) -> DataFrame:
    """`rows` (key a long, not null) without most of those whose key is not in the one column of `values`; none of the others is lost.

    A filter before an exact join, which spares rows the exchange; it has a bounded size, so it lets more rows pass as `values` grow.
    `then` (to rows of `schema`) takes the rest on in the same Python worker.
    """
    shared, at = share(rows.sparkSession, members(values)), rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared()
        for batch in batches:
            x = mix(batch.column(at).to_numpy().view(np.uint64)) & np.uint64(8 * len(bits) - 1)
            yield batch.filter(pa.array(((bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)))

    return rows.mapInArrow(tidy(run), rows.schema) if then is None else rows.mapInArrow(tidy(lambda batches: then(run(batches))), schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    simple = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}
    return pa.list_(to_arrow(kind.elementType)) if isinstance(kind, T.ArrayType) else simple[type(kind)]


def chunks(texts: Iterable[str | None], limit: int) -> Iterator[list[str]]:
    """Texts (null as empty) in runs of about `limit` characters; a longer text stands alone."""
    run: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 values, vectorised."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_P = 0x9E3779B97F4A7C15
_KEPT = 1 << 17
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2^64 and their inverses; the first 2^17 are kept by the worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        found = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, _KEPT) - 1, b, np.uint64)]), dtype=np.uint64) for b in (_P, pow(_P, -1, 1 << 64))]
        if n > _KEPT:
            return found[0], found[1]
        _POWERS[:] = found
    return _POWERS[0][:n], _POWERS[1][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run values[start:end], that depends on the run's elements and order alone.

    Runs come in order of their starts. They are taken by stretches of values, so memory follows the longest run.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, first + _KEPT // 2)))
        while to > at + 1 and int(ends[at:to].max()) - first >= _KEPT:
            to = at + (to - at) // 2
        last = int(ends[at:to].max())
        up, down = powers(last - first + 1)
        total = np.zeros(last - first + 1, np.uint64)
        np.cumsum((values[first:last].astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=total[1:])
        a, b = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


def word_hashes(data: bytes, piece: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of bytes in which words are parted by spaces and newlines.

    Long data is taken in pieces that end between words, so memory follows the piece (or a longer word).
    """
    found_starts, found, at = [], [], 0
    while at < len(data) or not found:
        end = len(data)
        if end - at > piece:
            end = max(data.rfind(b" ", at, at + piece), data.rfind(b"\n", at, at + piece)) + 1
            if not end:
                after = [k for k in (data.find(b" ", at + piece), data.find(b"\n", at + piece)) if k >= 0]
                end = min(after) + 1 if after else len(data)
        b = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ((b != 32) & (b != 10)).view(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2]
        found.append(run_hashes(b, starts, ends))
        found_starts.append(starts + at)
        at = end
    return np.concatenate(found_starts), np.concatenate(found)


def text_words(texts: list[str], table: bytes, limit: int = 1 << 18) -> Iterator[tuple[int, int, list[bytes], np.ndarray, np.ndarray]]:
    """Runs of texts as bytes translated by `table` and joined by newlines: (first, last + 1, the bytes of each, word starts, word hashes)."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        held.append((t or "").encode("utf-8", "replace").translate(table))
        size += len(held[-1]) + 1
        if size >= limit or k == len(texts) - 1:
            yield first, k + 1, held, *word_hashes(b"\n".join(held))
            first, held, size = k + 1, [], 0


def hash_sample(df: DataFrame, group: str, id_col: str, bound: int, most: int = 10_000) -> DataFrame:
    """About `bound` rows of each value of `group`, picked by a hash of the id; groups below it stay whole.

    The counts come from one aggregate over all rows; the picking is a filter, so no group has to
    meet in one task. Groups are class labels or languages; more than `most` of them are an error.
    """
    counts = df.where(F.col(group).isNotNull()).groupBy(group).count().limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"{group} has more than {most} values")
    shares = {r[0]: min(1.0, bound / r[1]) for r in counts}
    if not shares:
        return df.limit(0)
    share = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, v)])
    rank = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_000)) / 1e6
    return df.where(rank < share[F.col(group)])


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, text_col: str, id_col: str, bound: int) -> DataFrame:
    """(id, y, t): about `bound` texts of each label 0 and 1, picked among the labels before any text is read.

    The picked labels are at most about 2 x bound rows, whatever the tables hold, and are broadcast.
    """
    picked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    picked = hash_sample(picked, "y", "id", bound)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return texts.join(F.broadcast(picked), "id")


def merge_sets(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of all pairs (a, b); root holds each member's smallest position."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root[:] = root[root]


def local_forest(edges: DataFrame, a: str = "a", b: str = "b", at_once: int = 200_000, most: int = 1_000_000) -> DataFrame:
    """Within each partition, the edges (long, long) as stars around each component's smallest node; at most about `most` nodes are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
        size = reduced = 0

        def contract() -> np.ndarray:
            x, y = np.concatenate(held, axis=1)
            nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            root = np.arange(len(nodes))
            merge_sets(root, at[: len(x)], at[len(x) :])
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            return np.stack([nodes[moved], nodes[root[moved]]])

        def flush(stars: np.ndarray) -> Iterator[pa.RecordBatch]:
            if stars.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(stars[0]), pa.array(stars[1])], names=[a, b])

        for batch in batches:
            held.append(np.stack([batch.column(a).to_numpy(), batch.column(b).to_numpy()]))
            size += batch.num_rows
            if size - reduced >= at_once:
                stars = contract()
                size = reduced = stars.shape[1]
                held[:] = [stars]
                if size >= most:
                    yield from flush(stars)
                    size = reduced = 0
                    held[:] = [stars[:, :0]]
        yield from flush(contract())

    return edges.select(a, b).mapInArrow(tidy(run), f"{a} long, {b} long")


def attach(rows: DataFrame, key: str, aggregates: dict[str, Column], limit: int = 20_000) -> DataFrame:
    """`rows` (key not null) with aggregates over all rows of their key.

    Rows of a key with more than `limit` rows stay where they are and get the aggregates by a broadcast, so a hot key
    meets in no task. The broadcast holds 50,000 keys at most: the limit rises with the rows.
    """
    n = f"{TMP}n"
    limit = max(limit, (total := rows.count()) // 50_000)
    per = rows.groupBy(key).agg(F.count("*").alias(n), *[c.alias(k) for k, c in aggregates.items()])
    hot = cut(per.where(F.col(n) > limit).drop(n)) if total > limit else None
    if hot is None or hot.isEmpty():
        return rows.join(per.drop(n), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per.where(F.col(n) <= limit).drop(n), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def connected_components(edges: DataFrame, max_rounds: int = 50, limit: int = 20_000) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the undirected edges (a, b).

    Edges are contracted to stars inside each partition, then large-star and small-star rounds run
    until no edge changes. A node's neighbourhood is only ever reduced to its minimum, and the edges of a hub
    don't meet in one task (`attach`). Nulls and self-loops are ignored.
    """
    edges = cut(local_forest(edges.where("a is not null and b is not null and a != b")))
    edges = edges.coalesce(max(1, edges.count() // 50_000))
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = attach(both, "a", {"m": F.min("b")}, limit).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut(small.where("a != b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected_components did not converge; raise max_rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b", "b")).distinct()
