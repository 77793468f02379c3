"""Near-duplicate embeddings by a random-projection tree forest with spill.

Each tree splits the vectors by the median of a random direction, again and again; vectors near a
split go to both sides, so near pairs seldom part. Vectors are compared within leaves, in double
precision, and pairs at or above the threshold are links. The splits are fitted on a bounded sample;
every vector is indexed and compared.

Vectors travel by blocks, the leaves below one node of a tree: a block gets a vector once, with the
numbers of the leaves that it goes to, and is compared leaf by leaf. A pair that meets in several blocks
counts in the first of them only (each row carries all its leaves, by block), so a block gives its members'
link counts and a spanning forest of its links, never its pairs. Leaves where many are linked are compared
together, and what their vectors share is found by products of matrices, not pair by pair. Equal vectors are one row with a number
of copies. Blocks of more than 8 times `max_leaf` vectors are dealt out as pairs of chunks of about that
size, so they are compared whole, by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, merge_sets, mix, release, share, tidy


@dataclass
class Tree:
    """Inner nodes have a direction, a threshold and two children; a leaf has a list of further splits."""

    directions: list[np.ndarray | None] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    further: list[list[tuple[int, float]]] = field(default_factory=list)
    shared: np.ndarray | None = None  # directions of further splits, by level

    def route(self, x: np.ndarray, overlap: float, depth: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf code, block code) of every leaf that each row of x goes to. A block has the leaves below one node of that depth."""
        rows, codes, blocks, shared = [], [], [], {}
        todo = [(0, np.arange(len(x)), 0, np.uint64(0))]
        while todo:
            node, idx, at, block = todo.pop()
            if not len(idx):
                continue
            block = np.uint64(node) if at <= depth else block
            if self.directions[node] is not None:
                p = x[idx] @ self.directions[node]
                a, b = self.children[node]
                todo += [(a, idx[p <= self.thresholds[node] + overlap], at + 1, block), (b, idx[p > self.thresholds[node] - overlap], at + 1, block)]
                continue
            parts = [(np.uint64(node), idx, block)]
            for level, t in self.further[node]:
                if level not in shared:
                    shared[level] = x @ self.shared[level]
                p, at, split = shared[level], at + 1, []
                for code, i, block in parts:
                    for side, some in ((0, i[p[i] <= t + overlap]), (1, i[p[i] > t - overlap])):
                        if len(some):
                            own = code * np.uint64(2) + np.uint64((1 << 20) + side)
                            split.append((own, some, own if at <= depth else block))
                parts = split
            for code, i, block in parts:
                rows.append(i)
                codes.append(np.full(len(i), code))
                blocks.append(np.full(len(i), block))
        return np.concatenate(rows), np.concatenate(codes), np.concatenate(blocks)


def grow(sample: np.ndarray, total: int, leaf: int, seed: int, least: int = 64) -> Tree:
    """A tree for `total` vectors of which `sample` is a part: leaves of about `leaf` vectors.

    Where the sample gets too thin for medians of its own, splits go on with directions that all
    leaves of a level share.
    """
    rng, tree = np.random.default_rng(seed), Tree()
    levels = max(0, math.ceil(math.log2(max(1, total / leaf)))) + 4
    tree.shared = _unit(rng.standard_normal((levels, sample.shape[1])))
    todo = [(_node(tree), np.arange(len(sample)))]
    weight = total / max(1, len(sample))
    while todo:
        node, idx = todo.pop()
        if len(idx) * weight <= leaf:
            continue
        if len(idx) < 2 * least:
            more = min(levels, math.ceil(math.log2(len(idx) * weight / leaf)))
            tree.further[node] = [(k, float(np.median(sample[idx] @ tree.shared[k]))) for k in range(more)] if len(idx) else []
            continue
        d = _unit(rng.standard_normal((1, sample.shape[1])))[0]
        p = sample[idx] @ d
        t = float(np.median(p))
        if not ((p <= t).any() and (p > t).any()):
            continue
        a, b = _node(tree), _node(tree)
        tree.directions[node], tree.thresholds[node], tree.children[node] = d, t, (a, b)
        todo += [(a, idx[p <= t]), (b, idx[p > t])]
    return tree


def _node(tree: Tree) -> int:
    tree.directions.append(None)
    tree.thresholds.append(0.0)
    tree.children.append((0, 0))
    tree.further.append([])
    return len(tree.directions) - 1


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, trees: int = 6, leaf: int = 256, overlap: float = 0.02, sample: int = 20_000, max_leaf: int = 4096, seed: int = 11, block: int = 8192) -> DataFrame:
    """One row per vector: id, n_links, component_id (the smallest id reachable by links), kept.

    n_links counts the other vectors linked directly, copies included. Vectors that are null, zero, or
    hold null or non-finite components, and rows without an id, link with nothing; so do vectors of
    different lengths. Repeated rows of one id and vector are one vector. `sample` bounds the vectors
    that the splits are fitted on. Found pairs are exact; pairs may be missed (recall is measured in the
    tests), and more trees or a wider overlap miss fewer.
    """
    kind = "<f4" if df.schema[vec_col].dataType == T.ArrayType(T.FloatType(), df.schema[vec_col].dataType.containsNull) else "<f8"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    valid = F.coalesce(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0), F.lit(False))
    marked = rows.select("id", F.when(valid, F.col("v")).alias("v")).select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit("2"), "v").alias("g"))
    known = marked.where("v is not null")
    copies = known.select("id", "h", "g").distinct().groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    firsts = cut(known.join(copies.select("h", "g", F.col("rep").alias("id")), ["id", "h", "g"], "left_semi").dropDuplicates(["h", "g"]).join(copies.select("h", "g", "n"), ["h", "g"]).select("id", "v", "n", F.size("v").alias("d")))
    sizes = {r.d: r.n for r in firsts.groupBy("d").agg(F.count("*").alias("n")).collect()}
    found = None
    for d, total in sorted(sizes.items()):
        part = _found(firsts.where(F.col("d") == d), d, total, cosine, trees, leaf, overlap, sample, 8 * max_leaf, seed, block, kind)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), (F.col("id") == F.col("id")).alias("kept"))
    found = cut(found)
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    by_rep = copies.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    out = marked.select("id", "h", "g", F.col("v").isNotNull().alias("valid")).join(by_rep.select("h", "g", "n", "links", F.coalesce("root", "rep").alias("root")), ["h", "g"], "left")
    component = F.when(F.col("valid"), F.col("root")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.when(F.col("valid"), F.coalesce("links", F.lit(0)) + F.col("n") - 1).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _found(firsts: DataFrame, d: int, total: int, cosine: float, trees: int, leaf: int, overlap: float, sample: int, most: int, seed: int, block: int, kind: str) -> DataFrame:
    """(id, links, root): link counts of distinct vectors of one length, and their links as a forest."""
    spark = firsts.sparkSession
    some = firsts.where(F.pmod(F.xxhash64("id", F.lit("forest")), F.lit(1_000_000)) < F.lit(1e6 * min(1.0, sample / total))).select("v").toPandas()
    x = np.stack(some.v.to_list()) if len(some) else np.zeros((1, d))
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    forest = share(spark, [grow(x, total, leaf, seed * 1000 + t) for t in range(trees)])

    depth = max(0, math.ceil(math.log2(max(1, total / block))))

    def leaves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, leaf and block of all leaves, by row, block and leaf."""
        unit = x / np.abs(x).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        name = lambda c, t: mix(c * np.uint64(64) + np.uint64(t)).view(np.int64)
        got = [(r, name(c, t), name(b, t)) for t, tree in enumerate(forest()) for r, c, b in [tree.route(unit, overlap, depth)]]
        rows, keys, blocks = (np.concatenate([g[k] for g in got]) for k in range(3))
        order = np.lexsort((keys, blocks, rows))
        return rows[order], keys[order], blocks[order]

    def starts_of(rows: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Where a row's next block starts."""
        return np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (blocks[1:] != blocks[:-1])]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, _, blocks = leaves(_matrix(batch.column(0), d))
                keys, n = np.unique(blocks[starts_of(rows, blocks)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], names=["key", "n"])

    counts = firsts.select("v").mapInArrow(tidy(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    hot = cut(counts.where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("chunks")))
    n_hot = hot.count()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = _matrix(part.column(1), d)
                rows, keys, blocks = leaves(x)
                begins = np.searchsorted(rows, np.arange(part.num_rows + 1))
                starts = starts_of(rows, blocks)
                ends, own = np.append(starts[1:], len(rows)), rows[starts]
                take = pa.array(own)
                lists = _binary(keys.astype("<i8"), begins).take(take)
                packed = _binary(x.astype(kind).ravel(), np.arange(0, x.size + 1, d)).take(take)
                places = [pa.array((k - begins[own]).astype(np.int32)) for k in (starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(blocks[starts], pa.int64()), part.column(0).take(take), part.column(2).take(take), packed, lists, *places], names=["key", "id", "n", "v", "keys", "since", "till"])

    rows = firsts.select("id", "v", "n").mapInArrow(tidy(deal), "key long, id long, n long, v binary, keys binary, since int, till int")
    if n_hot:
        # a block of k chunks becomes the pairs of its chunks, each compared by a task of its own
        rows = rows.join(F.broadcast(hot) if n_hot <= 50_000 else hot, "key", "left").withColumn("chunk", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).otherwise(0))
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda o: F.struct(F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j"))))
        rows = rows.select("key", pair.alias("p"), "chunk", "id", "n", "v", "keys", "since", "till").select("key", "p.i", "p.j", "chunk", "id", "n", "v", "keys", "since", "till")
    else:
        rows = rows.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("chunk"), "id", "n", "v", "keys", "since", "till")
    compare = _comparer(d, cosine, kind)
    return rows.groupBy("key", "i", "j").applyInArrow(compare, T.StructType([T.StructField(c, T.LongType()) for c in ("id", "links", "root")]))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _comparer(d: int, cosine: float, kind: str):
    def compare(group: pa.Table) -> pa.Table:
        split = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        ids, n, chunk, since, till = (group.column(c).to_numpy() for c in ("id", "n", "chunk", "since", "till"))
        x = _values(group.column("v"), kind)[0].reshape(-1, d).astype(float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        keys, sizes = _values(group.column("keys"), "<i8")
        own = np.full((len(ids), int(sizes.max())), np.iinfo(np.int64).max)
        place = np.arange(own.shape[1])
        own[place < sizes[:, None]] = keys
        inside = (place >= since[:, None]) & (place < till[:, None])
        member, keys = np.nonzero(inside)[0], own[inside]
        order = np.argsort(keys, kind="stable")
        keys, member = keys[order], member[order]
        before = np.where(place < since[:, None], own, np.iinfo(np.int64).max)[:, : max(1, int(since.max()))]  # leaves of earlier blocks
        del own, inside
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        pairs, dense = [np.zeros(0, np.int64)], []
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            found = _pairs(x, chunk if split else None, member[a:b], cosine)
            if found is None:
                dense.append(member[a:b])
            else:
                pairs.append(found)
        pairs = np.unique(np.concatenate(pairs))
        for s in range(0, len(pairs), 20_000):
            p, q = np.divmod(pairs[s : s + 20_000], len(ids))
            first = _first_shared(before[p], before[q]) == np.iinfo(np.int64).max
            np.add.at(links, p[first], n[q[first]])
            np.add.at(links, q[first], n[p[first]])
            merge_sets(root, p, q)
        if dense:
            _dense(x, n, before, chunk if split else None, dense, pairs, cosine, links, root)
        some = (links > 0) | (root != np.arange(len(ids)))
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, root, ids)
        out = pa.table({"id": ids[some], "links": links[some], "root": low[root][some]})
        release()
        return out

    return compare


def _near(x: np.ndarray, chunk: np.ndarray | None, rows: np.ndarray, cols: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows are near which columns; `cols` start with the rows, and each pair counts once."""
    near = x[rows] @ x[cols].T >= cosine
    near[:, : len(rows)] = np.triu(near[:, : len(rows)], 1)
    if chunk is not None:
        near &= chunk[rows][:, None] != chunk[cols][None, :]
    return near


def _pairs(x: np.ndarray, chunk: np.ndarray | None, member: np.ndarray, cosine: float) -> np.ndarray | None:
    """The near pairs of a leaf as numbers; None if they are many."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(member), 512):
        rows, cols = member[at : at + 512], member[at:]
        near = _near(x, chunk, rows, cols, cosine)
        hits = np.count_nonzero(near)
        if hits > 4 * len(cols) + 1000:
            return None
        if hits:
            a, b = np.nonzero(near)
            found.append(rows[a] * len(x) + cols[b])
    return np.concatenate(found)


def _dense(x: np.ndarray, n: np.ndarray, before: np.ndarray, chunk: np.ndarray | None, dense: list[np.ndarray], pairs: np.ndarray, cosine: float, links: np.ndarray, root: np.ndarray) -> None:
    """Adds the links of leaves where most are linked, but for `pairs`, each once: what two vectors share comes from products of matrices."""
    member = np.unique(np.concatenate(dense))
    here = np.zeros((len(member), len(dense)), np.float32)
    for k, some in enumerate(dense):
        here[np.searchsorted(member, some), k] = 1
    step = max(16, min(512, 4_000_000 // len(member)))
    linked = np.zeros(len(member), bool)
    for at in range(0, len(member), step):
        near = _near(x, chunk, member[at : at + step], member[at:], cosine)
        linked[at : at + step] |= near.any(axis=1)
        linked[at:] |= near.any(axis=0)
    member, here = member[linked], here[linked]
    earlier = _Shared(before[member])
    for at in range(0, len(member), step):
        rows, cols = member[at : at + step], member[at:]
        near = _near(x, chunk, rows, cols, cosine)
        near &= here[at : at + step] @ here[at:].T > 0
        some, other = near.any(axis=1), near.any(axis=0)
        if not some.any():
            continue
        counted = near & ~earlier.shared(slice(at, at + step), slice(at, None))
        p, q = np.divmod(pairs[np.searchsorted(pairs, rows[0] * len(x)) : np.searchsorted(pairs, (rows[-1] + 1) * len(x))], len(x))
        a, b = np.searchsorted(rows, p), np.searchsorted(cols, q)
        known = (rows[np.minimum(a, len(rows) - 1)] == p) & (cols[np.minimum(b, len(cols) - 1)] == q)
        counted[a[known], b[known]] = False
        counted = counted.astype(float)
        links[rows] += (counted @ n[cols]).astype(np.int64)
        links[cols] += (n[rows] @ counted).astype(np.int64)
        for k in np.flatnonzero((near & (root[rows][:, None] != root[cols][None, :])).any(axis=1)):
            apart = cols[near[k] & (root[cols] != root[rows[k]])]
            merge_sets(root, np.full(len(apart), rows[k]), apart)


class _Shared:
    """Which rows share a value, by products of matrices of 0 and 1; kept while they are not too large."""

    def __init__(self, own: np.ndarray, most: int = 32_000_000) -> None:
        self.own = own
        values, times = np.unique(own[own != np.iinfo(np.int64).max], return_counts=True)
        values = values[times > 1]
        self.parts = [values[s : s + 256] for s in range(0, len(values), 256)]
        self.kept = [self._marks(v, slice(None)) for v in self.parts] if len(own) * len(values) <= most else None

    def _marks(self, values: np.ndarray, rows: slice) -> np.ndarray:
        own = self.own[rows]
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        r, k = np.nonzero(values[at] == own)
        found = np.zeros((len(own), len(values)), np.float32)
        found[r, at[r, k]] = 1
        return found

    def shared(self, rows: slice, cols: slice) -> np.ndarray:
        out = np.zeros((len(self.own[rows]), len(self.own[cols])), bool)
        for k, values in enumerate(self.parts):
            p, q = (self.kept[k][rows], self.kept[k][cols]) if self.kept else (self._marks(values, rows), self._marks(values, cols))
            out |= p @ q.T > 0
        return out


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The parts of an array between bounds as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype("<i4")), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, and how many each row has."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), kind), np.fromiter(map(len, held), np.int64, len(held)) // np.dtype(kind).itemsize


def _first_shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest value that each pair of sorted rows shares."""
    none = np.iinfo(np.int64).max
    out = np.full(len(p), none)
    for k in range(p.shape[1]):
        hit = (p[:, k, None] == q).any(axis=1) & (p[:, k] != none)
        out = np.where(hit, np.minimum(out, p[:, k]), out)
    return out
