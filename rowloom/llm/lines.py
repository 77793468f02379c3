"""Fuzzy line deduplication: candidate lines, edit similarity, connected groups.

Lines of `min_words` words or more are normalised to their words in lower case. Equal normalised lines
are one node; candidate pairs are verified by the edit similarity of their word sequences, and of every connected
group of lines the first occurrence (by id, then line) stays.

The registered query and the pipeline use `candidates="grams"`, which misses no pair of the edit similarity (`_gram_links`): the
rarest word pairs of each line are its keys, as many of them as the allowed edits can destroy and one more.

`candidates="simhash"` (the default of `repeated`) is the cheaper way for exact and nearly exact lines; README has its recall. Each distinct line has a
64-bit SimHash of its words; two hashes that differ in at most `DISTANCE` bits agree in at least `agree` of `blocks` blocks, so lines are joined on combinations of
blocks and compared by Hamming distance. What agrees in a block value goes on as clusters of lines, never as pairs, and a
cluster gives a spanning forest of its verified links; so copies of one line in many variants stay
linear. Block values with very many lines are dealt out as pairs of chunks.

Only word numbers, hashes and line positions move between tasks, but for one join of the texts with
the lines they lose.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TMP, attach, connected_components, cut, discard, may_be_in, merge_sets, merged_pieces, mix, pieces_of, ragged, reclaim, run_hashes, share, slices, stored, text_words, tidy

DISTANCE = 3
#: Block values and groups of keys with more lines become pairs of chunks of about that size.
CHUNK = 20_000
#: Letters, digits and all beyond ASCII are words; newlines part lines; the rest is space.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Cells for the counts of the words of long lines; long are those of more words than `LONG`.
CELLS, LONG = 2_048, 64
#: For each byte, its bits as eight bytes.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def words(line: str) -> list[bytes]:
    """A line's normalised words: runs of letters, digits and characters beyond ASCII, in lower case."""
    return line.lower().encode("utf-8", "replace").replace(b"\n", b" ").translate(_TABLE).split()


def simhash(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each run of word hashes: a bit is set where more than half of them have it."""
    sizes = ends - starts
    out = np.zeros(len(starts), np.uint64)
    small = np.flatnonzero((sizes < 256) & (sizes > 0))
    if len(small):
        pick = np.repeat(starts[small] - (np.cumsum(sizes[small]) - sizes[small]), sizes[small]) + np.arange(sizes[small].sum())
        lanes = _LANES[hashes[pick].view(np.uint8).reshape(-1, 8)]  # eight counters of a byte each in a 64-bit sum
        ones = np.add.reduceat(lanes, np.cumsum(sizes[small]) - sizes[small], axis=0).view(np.uint8).reshape(len(small), 64)
        out[small] = np.packbits(2 * ones.astype(np.int32) > sizes[small, None], axis=1).view(np.uint64).ravel()
    for k in np.flatnonzero(sizes >= 256):
        bits = np.unpackbits(hashes[starts[k] : ends[k]].view(np.uint8).reshape(-1, 8), axis=1)
        out[k] = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > sizes[k]).view(np.uint64)[0]
    return out


def edit_similar(a: list[np.ndarray], b: list[np.ndarray], least: float) -> np.ndarray:
    """For each pair of word sequences: is 1 - edit distance / longer length at least `least`? All pairs step together."""
    x, y = (np.concatenate([np.zeros(0, np.uint32), *z]).astype(np.uint32) for z in (a, b))
    p, q = (np.concatenate([[0], np.cumsum([len(w) for w in z])]).astype(np.int64) for z in (a, b))
    return _similar(x, p, y, q, least)


def _similar(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray, least: float, alike: bool = False) -> np.ndarray:
    """`edit_similar` of the runs x[p[k]:p[k+1]] and y[q[k]:q[k+1]]: by bounds where they decide, by the distance where not. `alike`: lengths and parities were compared before."""
    n, m = np.diff(p), np.diff(q)
    longer, shorter = np.maximum(n, m), np.minimum(n, m)
    limit = _limits(longer, least)
    out = np.zeros(len(n), bool)
    todo = np.flatnonzero(longer - shorter <= limit)
    out[todo] = alike
    # parities of the words of both: as many words differ at least, and of lines of different length one more each
    for k in range(0, 0 if alike else len(todo), 1_000):
        part = todo[k : k + 1_000]
        cells = [np.repeat(np.arange(len(part)), size[part]) * 1024 + (z[ragged(at[part], size[part])] & np.uint32(1023)) for z, at, size in ((x, p, n), (y, q, m))]
        odd = (np.bincount(np.concatenate(cells), minlength=1024 * len(part)).reshape(-1, 1024) & 1).sum(axis=1)
        out[part] = odd <= 2 * limit[part] - (longer - shorter)[part]
    todo = np.flatnonzero(out)
    if not len(todo):
        return out
    # what both begin and end with costs nothing; words that differ at one place cost one each
    size, first = shorter[todo], p[todo]
    at, of = ragged(np.zeros(len(todo), np.int64), size), np.repeat(np.arange(len(todo)), size)
    starts = np.cumsum(size) - size
    some = np.flatnonzero(size > 0)
    begin, finish, unlike = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
    if len(some):
        other = x[first[of] + at] != y[q[todo][of] + at]
        begin[some] = np.minimum.reduceat(np.where(other, at, size[of]), starts[some])
        unlike[some] = np.add.reduceat(other, starts[some], dtype=np.int64)
        other = x[p[todo + 1][of] - 1 - at] != y[q[todo + 1][of] - 1 - at]
        finish[some] = np.minimum.reduceat(np.where(other, at, size[of]), starts[some])
    finish = np.minimum(finish, size - begin)
    sure = (longer[todo] - begin - finish <= limit[todo]) | (unlike + longer[todo] - size <= limit[todo])
    left = np.flatnonzero(~sure)
    k = todo[left]
    xa, xb, ya, yb = p[k] + begin[left], p[k + 1] - finish[left], q[k] + begin[left], q[k + 1] - finish[left]
    swap = (xb - xa) > (yb - ya)  # the shorter core is the pattern
    small = np.where(swap, yb - ya, xb - xa) <= 64
    both = np.concatenate([x, y])
    pa_, pb = np.where(swap, ya + len(x), xa), np.where(swap, yb + len(x), xb)
    ta, tb = np.where(swap, xa, ya + len(x)), np.where(swap, xb, yb + len(x))
    good = np.zeros(len(k), bool)
    at = np.flatnonzero(small)
    for j in range(0, len(at), 4_000):
        part = at[j : j + 4_000]
        good[part] = _bit_distances(both, pa_[part], pb[part], ta[part], tb[part]) <= limit[k[part]]
    rest = np.flatnonzero(~small)
    if not alike:
        whole = k[rest]
        rest = rest[_may_share(both, np.concatenate([p, len(x) + q[1:]]), whole, len(n) + whole, longer[whole] - limit[whole])]
    if len(rest):
        good[rest] = _long_similar([both[a:b] for a, b in zip(pa_[rest], pb[rest], strict=True)], [both[a:b] for a, b in zip(ta[rest], tb[rest], strict=True)], limit[k[rest]])
    out[k] = good
    return out


def _bit_distances(words: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Edit distances between patterns words[a:b] of at most 64 words and texts words[c:d]: a column of differences in two 64-bit sets."""
    order = np.argsort(c - d, kind="stable")  # the longest text first
    a, b, c, d = a[order], b[order], c[order], d[order]
    m, n = b - a, d - c
    one, all_ = np.uint64(1), ~np.uint64(0)
    pattern = np.zeros((len(a), 64), np.uint32)
    real = np.arange(64) < m[:, None]
    pattern[real] = words[ragged(a, m)]
    up, down, score, last = np.full(len(a), all_), np.zeros(len(a), np.uint64), m.copy(), np.maximum(m - 1, 0).astype(np.uint64)
    for j in range(int(n.max(initial=0))):
        s = slice(0, int(np.searchsorted(-n, -j)))  # texts that go on
        same = np.packbits((pattern[s] == words[c[s] + j][:, None]) & real[s], axis=1, bitorder="little").view(np.uint64).ravel()
        xv = same | down[s]
        xh = (((same & up[s]) + up[s]) ^ up[s]) | same
        more, less = down[s] | ~(xh | up[s]), up[s] & xh
        score[s] += ((more >> last[s]) & one).astype(np.int64) - ((less >> last[s]) & one).astype(np.int64)
        more, less = (more << one) | one, less << one
        up[s], down[s] = less | ~(xv | more), more & xv
    score = np.where(m == 0, n, score)
    out = np.empty(len(a), np.int64)
    out[order] = score
    return out


def _long_similar(a: list[np.ndarray], b: list[np.ndarray], limit: np.ndarray) -> np.ndarray:
    """Is the edit distance of each pair within its limit? Bands grow until they decide, so near pairs cost little."""
    out = np.zeros(len(a), bool)
    todo = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        words, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        apart = np.bincount(at[: len(x)], minlength=len(words)) - np.bincount(at[len(x) :], minlength=len(words))
        if max(apart[apart > 0].sum(), -apart[apart < 0].sum()) <= limit[k]:  # an edit takes away one word at most
            todo.append(k)
    todo, band = np.array(todo, np.int64), 16
    sizes = np.array([len(x) for x in a], np.int64)
    while len(todo):
        bands = np.minimum(limit[todo], band)
        found = np.zeros(len(todo), np.int64)
        order = np.lexsort((sizes[todo], bands))
        at = 0
        while at < len(order):
            # pairs of like length and band go together; very long ones in smaller groups
            room = max(1, 2_000_000 // int(max(sizes[todo[order[at]]], 1) * (2 * bands[order[at]] + 3)))
            part = order[at : at + min(room, 4_000)]
            part = part[bands[part] == bands[part[0]]]
            found[part] = _distances([a[k] for k in todo[part]], [b[k] for k in todo[part]], int(bands[part[0]]))
            at += len(part)
        out[todo[found <= bands]] = True
        todo = todo[(found > bands) & (bands < limit[todo])]
        band *= 4
    return out


def _may_share(flat: np.ndarray, at: np.ndarray, p: np.ndarray, q: np.ndarray, least: np.ndarray) -> np.ndarray:
    """May the lines p and q (flat[at[k]:at[k+1]]) have `least` words in common, counted as often as both have them? By counts of words in `CELLS` cells,
    which are never less in common than the words; lines of 65,536 words or more may always."""
    out = np.ones(len(p), bool)
    size = np.diff(at)
    known = np.flatnonzero(np.maximum(size[p], size[q]) < 65_536)
    for k in range(0, len(known), 1_000):
        part = known[k : k + 1_000]
        some, of = np.unique(np.concatenate([p[part], q[part]]), return_inverse=True)
        counts = np.empty((len(some), CELLS), np.uint16)
        for j in range(0, len(some), 200):
            lines = some[j : j + 200]
            cells = np.repeat(np.arange(len(lines)) * CELLS, size[lines]) + (flat[ragged(at[lines], size[lines])] & np.uint32(CELLS - 1))
            counts[j : j + 200] = np.bincount(cells, minlength=CELLS * len(lines)).reshape(-1, CELLS)
        for j in range(0, len(part), 100):
            x, y = of[: len(part)][j : j + 100], of[len(part) :][j : j + 100]
            out[part[j : j + 100]] = np.minimum(counts[x], counts[y]).sum(axis=1, dtype=np.uint32) >= least[part[j : j + 100]]
    return out


def _distances(a: list[np.ndarray], b: list[np.ndarray], band: int) -> np.ndarray:
    """Edit distances, exact up to `band`, above it only known to be above."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    n, m, width = int(la.max(initial=0)), int(lb.max(initial=0)), 2 * band + 1
    x, y = np.full((len(a), n), -1, np.int64), np.full((len(b), max(m, n) + width + band), -2, np.int64)
    for k, (p, q) in enumerate(zip(a, b, strict=True)):
        x[k, : len(p)] = p
        y[k, band : band + len(q)] = q
    far = band + 1
    # row[d] is the distance at column i + d - band
    row = np.broadcast_to(np.where((np.arange(width) - band >= 0), np.arange(width) - band, far), (len(a), width)).astype(np.int32)
    done = np.where(la == 0, lb, -1)
    ramp = np.arange(width, dtype=np.int32)
    edge = np.full((len(a), 1), far, np.int32)
    for i in range(1, n + 1):
        same = x[:, i - 1, None] == y[:, i - 1 : i - 1 + width]
        diagonal, above = row + ~same, np.concatenate([row[:, 1:], edge], axis=1) + 1
        best = np.minimum(diagonal, above)
        col = i + np.arange(width) - band
        best[:, col < 0] = far
        best[:, col == 0] = i
        # insertions: a running minimum of best - column, plus column
        step = np.minimum.accumulate(best - ramp, axis=1) + ramp
        row = np.minimum(step, far)
        ended = la == i
        if ended.any():
            d = np.clip(lb[ended] - i + band, 0, width - 1)
            value = row[ended, d]
            done[ended] = np.where(np.abs(lb[ended] - i) <= band, value, far)
    return np.where(done < 0, far, done)


def edit_similarity(a: list, b: list) -> float:
    """The plain definition, for tests."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return 1 - row[-1] / max(len(a), len(b), 1)


def schemes(lines: int) -> tuple[int, int]:
    """(blocks, agree): more bits to a key for more lines; each scheme finds every pair within the distance."""
    return (4, 1) if lines < 1 << 28 else (5, 2) if lines < 1 << 36 else (6, 3)


def _masks(blocks: int, agree: int) -> list[int]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(parts, agree)]


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, similarity: float = 0.8, candidates: str = "simhash") -> DataFrame:
    """(id, t, gone): for each document that loses lines, xxhash64 of its text and the numbers (from 0) of those lines.

    Rows that repeat both id and text count as one document. Null ids come first. Candidates: "simhash" are
    lines within `DISTANCE` bits, "grams" are all lines that can have the similarity.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").select("id", F.xxhash64("text").alias("t"), "text")
    kind = docs.schema["id"].dataType
    sims = candidates == "simhash"
    schema = [T.StructField("id", kind), T.StructField("t", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("h", T.LongType())]
    schema += [*([T.StructField("sim", T.LongType())] if sims else []), T.StructField("seq", T.BinaryType())]
    lines = stored(docs.mapInArrow(tidy(_splitter(min_words, sims)), T.StructType(schema)))
    whole = lines.where("seq is not null")
    if sims:
        distinct = cut(whole.groupBy("h").agg(F.first("sim").alias("sim"), F.first("seq").alias("seq")))
        links = _links(distinct.select("h", "sim"), distinct.select("h", "seq"), similarity)
    else:
        links = _gram_links(whole.select("h", "seq"), similarity, min_words)
    roots = connected_components(links)
    at = F.struct("id", "t", "line")
    reclaim(df.sparkSession)
    groups = lines.groupBy("h").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    groups = cut(groups.join(roots.withColumnRenamed("node", "h").hint("merge"), "h", "left").where("root is not null or n > 1").select("h", "first", F.coalesce("root", "h").alias("root")))
    decided = cut(attach(groups, "root", {"keep": F.min("first")}).select("h", "keep"))
    gone = lines.select("id", "t", "line", "h").join(decided.hint("merge"), "h").where(~F.struct("id", "t", "line").eqNullSafe(F.col("keep")))
    out = cut(gone.groupBy("id", "t").agg(F.sort_array(F.collect_set("line")).alias("gone")))
    discard(lines)
    del groups, decided, gone
    reclaim(df.sparkSession)
    return out


def _splitter(min_words: int, sims: bool):
    """Documents (id, t, text) to their lines with enough words: position, hash, SimHash (`sims`), and word numbers,
    these null where the task has given them for an equal line before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 2 << 20):
            texts = [t.lower() for t in batch.column(2).to_pylist()]
            for first, _, data, starts, hashes in text_words(texts, _TABLE):
                breaks = np.flatnonzero(np.frombuffer(b"\n".join(data), np.uint8) == 10)
                begins = np.concatenate([[0], breaks + 1])  # of lines
                a = np.searchsorted(starts, begins)
                b = np.append(a[1:], len(starts))
                good = np.flatnonzero(b - a >= max(1, min_words))
                if not len(good):
                    continue
                doc_begins = np.cumsum([0, *(len(d) + 1 for d in data)])[:-1]
                doc = np.searchsorted(doc_begins, begins[good], side="right") - 1
                number = good - np.searchsorted(begins, doc_begins)[doc]
                a, b = a[good], b[good]
                h = run_hashes(hashes, a, b).view(np.int64)
                new = np.zeros(len(h), bool)
                values, where = np.unique(h, return_index=True)
                new[[k for v, k in zip(values.tolist(), where.tolist(), strict=True) if v not in seen]] = True
                if len(seen) < 1_000_000:
                    seen.update(values.tolist())
                take = pa.array(first + doc)
                cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array(number.astype(np.int32)), pa.array(h)]
                sizes = np.where(new, b - a, 0)
                offsets = np.concatenate([[0], 4 * np.cumsum(sizes)]).astype(np.int32)
                words = (hashes[ragged(a, sizes)] >> np.uint64(32)).astype("<u4")
                seq = pa.Array.from_buffers(pa.binary(), len(a), [pa.py_buffer(np.packbits(new, bitorder="little").tobytes()), pa.py_buffer(offsets), pa.py_buffer(words)])
                cols += [pa.array(simhash(hashes, a, b).view(np.int64)), seq] if sims else [seq]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "t", "line", "h", *(["sim"] if sims else []), "seq"])

    return run


def _links(sims: DataFrame, seqs: DataFrame, similarity: float) -> DataFrame:
    """(a, b): a forest of the links: distinct lines within the Hamming distance whose word sequences are similar enough."""
    total = sims.count()
    masks = _masks(*schemes(total))
    key = F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("c"), F.col("sim").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("v")) for k, m in enumerate(masks)]))
    rows = sims.select("h", "sim", key.alias("k")).select("k.c", "k.v", "h", "sim")
    limit = CHUNK
    hot = cut(rows.groupBy("c", "v").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("c", "v", F.ceil(F.col("n") / limit).cast("int").alias("chunks")))
    n_hot = hot.count()
    if not n_hot:
        rows = rows.select("c", "v", F.lit(0).alias("i"), F.lit(0).alias("j"), "h", "sim", F.lit(0).alias("chunk"))
    else:
        rows = rows.join(F.broadcast(hot) if n_hot <= 50_000 else hot, ["c", "v"], "left").withColumn("chunk", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("h"), F.col("chunks")).cast("int")).otherwise(0))
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda o: F.struct(F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j"))))
        rows = rows.select("c", "v", "h", "sim", "chunk", pair.alias("p")).select("c", "v", "p.i", "p.j", "h", "sim", "chunk")
    dealt = rows.repartition("c", "v").sortWithinPartitions("c", "v", "i", "j") if not n_hot else rows.repartition("c", "v", "i", "j").sortWithinPartitions("c", "v", "i", "j")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            last = int(new[-1]) if len(new) else 0
            if last:
                yield from _clusters([c[:last] for c in cols], np.concatenate([[0], new[:-1]]), masks)
            held = [c[last:] for c in cols]
        if held is not None and len(held[0]):
            yield from _clusters(held, np.array([0]), masks)

    clusters = dealt.mapInArrow(tidy(groups), "cluster long, c int, h long, sim long, side int")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= 20_000:
                name = held.column("cluster").to_numpy()
                ends = np.flatnonzero(name[1:] != name[:-1]) + 1
                if len(ends):  # all but the last cluster, which may go on
                    yield _forest(held.slice(0, int(ends[-1])), masks, similarity)
                    held = held.slice(int(ends[-1]))
        if held is not None and held.num_rows:
            yield _forest(held, masks, similarity)

    return clusters.join(seqs, "h").select("cluster", "c", "h", "sim", "side", "seq").repartition("cluster").sortWithinPartitions("cluster").mapInArrow(tidy(verify), "a long, b long")


def _forest(rows: pa.Table, masks: list[int], similarity: float) -> pa.RecordBatch:
    """The verified links of whole clusters (rows in order of cluster) as a forest."""
    name, c, h, sim, side = (rows.column(k).to_numpy() for k in ("cluster", "c", "h", "sim", "side"))
    sim = sim.view(np.uint64)
    offsets, values = [0], []
    for chunk in rows.column("seq").chunks:
        at = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64) // 4
        values.append(np.frombuffer(chunk.buffers()[2] or b"", "<u4")[at[0] : at[-1]])
        offsets += (at[1:] - at[0] + offsets[-1]).tolist()
    flat = np.concatenate(values)
    root = np.arange(len(h))

    def link(a: np.ndarray, b: np.ndarray) -> None:
        x = sim[a] ^ sim[b]
        near = (np.bitwise_count(x) <= DISTANCE) & ((side[a] < 0) | (side[a] != side[b])) & (root[a] != root[b])
        a, b, x = a[near], b[near], x[near]
        first = _first(x, masks) == c[a]
        a, b = a[first], b[first]
        for k in range(0, len(a), 50_000):
            p, q = a[k : k + 50_000], b[k : k + 50_000]
            apart = root[p] != root[q]
            p, q = p[apart], q[apart]
            good = edit_similar([flat[offsets[i] : offsets[i + 1]] for i in p], [flat[offsets[i] : offsets[i + 1]] for i in q], similarity)
            merge_sets(root, p[good], q[good])

    starts = np.concatenate([[0], np.flatnonzero(name[1:] != name[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(h)))
    # the first row of each cluster is its hub: what that connects needs no more pairs
    hub = np.repeat(starts, sizes)
    link(hub[hub != np.arange(len(h))], np.flatnonzero(hub != np.arange(len(h))))
    for n in np.unique(sizes[(sizes > 2) & (sizes <= 256)]):
        a, b = np.triu_indices(n - 1, 1)
        of = starts[sizes == n] + 1
        for k in range(0, len(of), max(1, 500_000 // len(a))):
            some = of[k : k + max(1, 500_000 // len(a)), None]
            link((some + a).ravel(), (some + b).ravel())
    for s, n in zip(starts[sizes > 256].tolist(), sizes[sizes > 256].tolist(), strict=True):
        for at in range(s + 1, s + n, 256):
            a, b = np.meshgrid(np.arange(at, min(at + 256, s + n)), np.arange(at, s + n), indexing="ij")
            link(a[a < b], b[a < b])
    moved = np.flatnonzero(root != np.arange(len(h)))
    return pa.RecordBatch.from_arrays([pa.array(h[moved]), pa.array(h[root[moved]])], names=["a", "b"])


def _first(x: np.ndarray, masks: list[int]) -> np.ndarray:
    """The first combination of blocks in which pairs agree, from the xor of their hashes."""
    out = np.full(len(x), len(masks))
    for k in range(len(masks) - 1, -1, -1):
        out[(x & np.uint64(masks[k])) == 0] = k
    return out


def _clusters(cols: list[np.ndarray], starts: np.ndarray, masks: list[int]) -> Iterator[pa.RecordBatch]:
    """The lines of each group (one block value, or a pair of its chunks) that have a near one there, by connected cluster."""
    c, _, i, j, h, sim, chunk = cols
    bits = sim.view(np.uint64)
    root = np.arange(len(h))
    sizes = np.diff(np.append(starts, len(h)))
    left, right, held = [], [], 0

    def flush() -> None:
        nonlocal left, right, held
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            near = (np.bitwise_count(bits[a] ^ bits[b]) <= DISTANCE) & ((i[a] == j[a]) | (chunk[a] != chunk[b]))
            merge_sets(root, a[near], b[near])
        left, right, held = [], [], 0

    for n in np.unique(sizes[(sizes > 1) & (sizes <= 512)]):
        a, b = np.triu_indices(n, 1)
        of = starts[sizes == n]
        for k in range(0, len(of), max(1, 500_000 // len(a))):
            some = of[k : k + max(1, 500_000 // len(a)), None]
            left.append((some + a).ravel())
            right.append((some + b).ravel())
            held += len(left[-1])
            if held > 500_000:
                flush()
    flush()
    for s, n in zip(starts[sizes > 512], sizes[sizes > 512], strict=True):
        for at in range(s, s + n, 512):
            rows = np.arange(at, min(at + 512, s + n))
            a, b = np.nonzero(np.bitwise_count(bits[rows][:, None] ^ bits[None, at : s + n]) <= DISTANCE)
            left, right = [rows[a[a < b]]], [b[a < b] + at]
            flush()
    count = np.bincount(root, minlength=len(root))
    some = np.flatnonzero(count[root] > 1)
    for k in range(0, len(some), 100_000):
        x = some[k : k + 100_000]
        r = root[x]
        name = mix(h[r].view(np.uint64) ^ mix(c[r].astype(np.uint64) * np.uint64(1 << 40) + i[r].astype(np.uint64) * np.uint64(1 << 20) + j[r].astype(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(c[x]), pa.array(h[x]), pa.array(sim[x]), pa.array(np.where(i[x] == j[x], -1, chunk[x]).astype(np.int32))], names=["cluster", "c", "h", "sim", "side"])


#: Counters of words for the order of grams; keys shared by more lines than GROUP are paired in a second step.
WORDS_LOG2, GROUP = 18, 8
#: Lines of more words have no parities in their entries: 64 of them would tell little.
PARITIES = 64
#: The place of a key that a line has more than once; those of others are below it.
ANYWHERE = 255
#: Bits of a line's hash in its entries.
_LOW = (1 << 40) - 1


def _limits(n: np.ndarray, similarity: float) -> np.ndarray:
    """The most edits between two lines of which the longer has n words."""
    return np.floor(n * (1 - similarity) + 1e-9).astype(np.int64)


def gram_size(similarity: float, min_words: int) -> int:
    """2 if lines within the similarity always share a pair of neighbouring words, else 1."""
    n = np.arange(max(2, min_words), max(2, min_words) + 1000)
    return 2 if similarity > 0.5 and (n - 1 - 2 * _limits(n, similarity) >= 1).all() else 1


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All word numbers of a binary column without nulls, and where each row starts (and the last one ends)."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    return np.frombuffer(column.buffers()[2] or b"", "<u4")[at[0] : at[-1]], at - at[0]


def _gram_keys(flat: np.ndarray, at: np.ndarray, counts: np.ndarray, similarity: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, place): the first keys of each line, at most 65,536 lines, in an order of all grams that puts rare words first.

    An edit destroys at most `size` grams of a line, an insertion one less. A line of n words and a longer one of m with
    at most d edits thus lack at most size * d - (m - n) of the grams of the shorter one and size * d of the longer one;
    so they share one among the first (that number + 1) of each. Of word pairs fewer do where they lie apart (`_fewest`). One of the
    grams shared is kept by the edits, so its places in the two lines are as near as `_near` has it.
    """
    n = np.diff(at)
    m = n[:, None] + np.arange(int(1 / max(1 - similarity, 1e-9)) + 2 if similarity < 1 else 1)
    prefix = (size * _limits(m, similarity) - (m - n[:, None])).max(axis=1) + 1
    of = np.repeat(np.arange(len(n)), n)
    cost = counts[flat >> np.uint32(32 - WORDS_LOG2)].astype(np.uint64)
    grams = flat.astype(np.uint64)
    where = np.arange(len(flat))
    if size == 2:
        where = np.flatnonzero(of[1:] == of[:-1])
        grams, cost = (grams[where] << np.uint64(32)) | grams[where + 1], cost[where] + cost[where + 1]
    order = (of[where].astype(np.uint64) << np.uint64(48)) | (cost << np.uint64(39)) | (mix(grams) >> np.uint64(25))
    by = np.argsort(order)
    order, where = order[by], where[by]
    new = np.concatenate([[True], order[1:] != order[:-1]])[: len(order)]
    single = new & np.concatenate([new[1:], [True]])[: len(order)]
    order, where, single = order[new], where[new], single[new]
    line = (order >> np.uint64(48)).astype(np.int64)
    rank = np.arange(len(line)) - np.searchsorted(line, np.arange(len(n)))[line]
    if size == 2 and 0.5 < similarity < 1:
        ranks = np.full(len(flat), 1 << 30, np.int32)
        ranks[where] = rank
        prefix = _fewest(ranks, at, prefix, similarity)
    first = rank < prefix[line]
    line, where, single = line[first], where[first], single[first]
    place = np.where(single, (where - at[line]) * ANYWHERE // n[line], ANYWHERE).astype(np.uint8)
    return line, order[first] & np.uint64((1 << 39) - 1), place


def _fewest(ranks: np.ndarray, at: np.ndarray, prefix: np.ndarray, similarity: float) -> np.ndarray:
    """For each line how many of its first word pairs are enough; ranks: of the pair that starts at each word, large where none does.

    An edit destroys two pairs only if they are neighbours, so runs of pairs take half their length (rounded up) each: s edits for the first t pairs.
    With at most d edits, of which m - n are insertions that destroy one pair, all t go only if s <= d and t <= 2 d - (m - n). A longer line of
    m words with d edits has d / (1 - similarity) words at least, so d <= (n - t) / (1 / (1 - similarity) - 2) wherever t is small enough.
    """
    n = np.diff(at)
    some = np.flatnonzero(n)
    low, high, of = np.zeros(len(n), np.int64), prefix.copy(), np.repeat(np.arange(len(n)), n)
    index = np.arange(len(ranks), dtype=np.int32)
    for _ in range(5):
        t = (low + high) // 2
        taken = ranks < t.astype(np.int32)[of]
        odd = taken & ((index - np.maximum.accumulate(np.where(taken, np.int32(-1), index))) & 1).astype(bool)
        edits = np.zeros(len(n), np.int64)
        edits[some] = np.add.reduceat(odd, at[:-1][some], dtype=np.int64)
        enough = edits > np.maximum(_limits(n, similarity), np.floor((n - t) / (1 / (1 - similarity) - 2) + 1e-6).astype(np.int64))
        low, high = np.where(enough, low, t), np.where(enough, t, high)
    return high


def _near(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """May a gram at places x and y of lines of n and m words be one that at most `most` edits keep? What is before it and behind it differs by as many words at most."""
    a, b = x.astype(np.int64), y.astype(np.int64)
    i, j = -(-a * n // ANYWHERE), -(-b * m // ANYWHERE)  # the first words with these places; the last ones are `more` behind at most
    more = np.maximum(n, m) // ANYWHERE
    before, behind = np.maximum(np.abs(i - j) - more, 0), np.maximum(np.abs((n - i) - (m - j)) - more, 0)
    return (a == ANYWHERE) | (b == ANYWHERE) | (before + behind <= most)


def _parities(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each line 64 parities of its words. With d edits, at most d words of each line are not in the other; as the lengths say
    how many more that are of the one than of the other, at most 2 d - (difference of lengths) parities differ."""
    bits = np.uint64(1) << (mix(flat.astype(np.uint64)) >> np.uint64(58))
    return np.bitwise_xor.reduceat(bits, at[:-1]) if len(bits) else np.zeros(len(at) - 1, np.uint64)


def _gram_links(lines: DataFrame, similarity: float, min_words: int) -> DataFrame:
    """(a, b): links that connect all lines (h, seq; repeats allowed) whose word sequences are similar enough.

    Lines that share a key and may be similar by length and parities are pairs; their edit similarity decides. A key of
    many lines first gives links to one of them; lines that are not connected by then are compared where they are (`_group_links`).
    Entries of keys name a line by 40 bits of its hash; what these bits have in common is told apart when lines are fetched.
    """
    spark, size, total = lines.sparkSession, gram_size(similarity, min_words), max(1, lines.count())
    width = 1 << WORDS_LOG2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(width, np.uint64)
        for batch in batches:
            found += np.bincount(_flat(batch.column(0))[0] >> np.uint32(32 - WORDS_LOG2), minlength=width).astype(np.uint64)
        yield from pieces_of(found, 1 << 14)

    order = share(spark, merged_pieces(lines.select("seq").mapInArrow(tidy(count), "piece int, data binary"), width, np.uint64, np.add, lambda x: np.round(8 * np.log2(np.maximum(x, 1))).clip(0, 255).astype(np.uint8)))
    buckets = max(64, total // 8_000)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order()
        for batch in batches:
            for k in range(0, batch.num_rows, 8_000):
                part = batch.slice(k, 8_000)
                h, (flat, at) = part.column(0).to_numpy(), _flat(part.column(1))
                if not len(flat):
                    continue
                line, key, place = _gram_keys(flat, at, counts, similarity, size)
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                key //= np.uint64(buckets)
                by = np.lexsort((key, bucket))
                line, key, bucket, place = line[by], key[by], bucket[by], place[by]
                n, sig, h = np.diff(at)[line], _parities(flat, at)[line], (h & _LOW)[line]
                starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
                ends = np.append(starts[1:], len(line))
                data = [_pack(key[a:b], h[a:b], n[a:b], sig[a:b], place[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(data, pa.binary())], names=["bucket", "data"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now:
                    yield from _key_pairs(held, now, buckets, similarity)
                    now, held = bucket, []
                held.append(_unpack(data))
        yield from _key_pairs(held, now, buckets, similarity)

    dealt = lines.mapInArrow(tidy(keys), "bucket long, data binary").repartition("bucket").sortWithinPartitions("bucket")
    found = stored(dealt.mapInArrow(tidy(pairs), "key long, a long, b long"))
    del dealt
    reclaim(spark)
    first = _verified(found.where("key is null").select("a", "b").distinct(), lines, similarity)
    many = found.where("key is not null").select("key", F.col("a").alias("low"))
    if many.isEmpty():
        return first
    nodes = connected_components(first).select((F.col("node").bitwiseAND(F.lit(_LOW))).alias("low"), F.col("root").alias("label"))
    labels = nodes.groupBy("low").agg(F.min("label").alias("label"), F.count_distinct("label").alias("several")).where("several = 1").drop("several")
    labelled = cut(many.join(labels.hint("merge"), "low", "left").withColumn("label", F.coalesce("label", "low")))
    discard(found)

    # keys of many lines that are not all connected; those with the same smallest line are one group, so a pair of lines mostly meets in one place
    mixed = labelled.groupBy(F.shiftright("key", 8).alias("name")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("low").alias("g")).where("lo < hi").select("name", "g")
    rest = cut(labelled.withColumn("name", F.shiftright("key", 8)).join(mixed.hint("merge"), "name").groupBy("g", "low").agg(F.collect_list("key").alias("keys"), F.first("label").alias("label")))
    if rest.isEmpty():
        return first
    hot = cut(rest.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("g", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    if hot.isEmpty():
        rest = rest.select("g", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("chunk"), "low", "label", "keys")
    else:
        rest = rest.join(hot.hint("merge"), "g", "left").withColumn("chunk", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("low"), F.col("chunks")).cast("int")).otherwise(0))
        sides = F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda o: F.struct(F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j")))
        rest = rest.select("g", F.explode(sides).alias("p"), "chunk", "low", "label", "keys").select("g", "p.i", "p.j", "chunk", "low", "label", "keys")
    reclaim(spark)
    texts = _wanted(lines, rest.select("low").distinct())
    whole = rest.join(texts.hint("merge"), "low").select("g", "i", "j", "chunk", "low", "label", "keys", "h", "seq")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK or sum(b.nbytes for b in held) >= 32 << 20:
                rows = pa.Table.from_batches(held).combine_chunks()
                name = np.stack([rows.column(c).to_numpy() for c in ("g", "i", "j")])
                ends = np.flatnonzero((name[:, 1:] != name[:, :-1]).any(axis=0)) + 1
                if len(ends):  # all but the last group, which may go on
                    yield _group_links(rows.slice(0, int(ends[-1])), similarity)
                    held = rows.slice(int(ends[-1])).to_batches()
        if held:
            yield _group_links(pa.Table.from_batches(held), similarity)

    return first.union(cut(whole.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(tidy(connect), "a long, b long")))


def _group_links(rows: pa.Table, similarity: float) -> pa.RecordBatch:
    """(a, b): links that connect what is similar among the lines of each key, for whole groups (g, i, j) of keys, in order.

    Each pair of lines of a key is connected by then, or compared if lengths and places of the key allow it; lines connected with most lines of
    a key are not paired among themselves. So copies of a line in many variants take few comparisons.
    """
    rows = rows.combine_chunks()
    g, i, j, chunk, low, label, h = (rows.column(c).to_numpy() for c in ("g", "i", "j", "chunk", "low", "label", "h"))
    count = len(h)
    block = np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    flat, at = _flat(pa.concat_arrays(rows.column("seq").chunks))
    n, sums = np.diff(at), _sums(flat, at)
    # lines of one label are connected; where 40 bits name several lines, a label may be that of another one
    by = np.lexsort((low, block))
    twice = np.zeros(count, bool)
    same = (block[by][1:] == block[by][:-1]) & (low[by][1:] == low[by][:-1])
    twice[by[1:][same]] = twice[by[:-1][same]] = True
    of = _numbered(block, twice, np.where(twice, np.arange(count), label))
    smallest = np.full(count, count)
    np.minimum.at(smallest, of, np.arange(count))
    root = smallest[of]
    lists = pa.concat_arrays(rows.column("keys").chunks)
    line = np.repeat(np.arange(count), lists.value_lengths().to_numpy())
    names = lists.flatten().to_numpy()
    key, place = _numbered(block[line], names >> 8), (names & 255).astype(np.uint8)
    # entries in order of key, class of length (similar lines are in the same or in neighbouring ones), and words before the key
    kind = np.minimum(np.log(np.maximum(n, 1)) / math.log(max(1.001 / similarity, 1.25)), 63).astype(np.int64)
    before = np.minimum(-(-place.astype(np.int64) * n[line] // ANYWHERE), (1 << 20) - 1)
    name = (((key * 64 + kind[line]) * 2 + (place == ANYWHERE)) << 20) + np.where(place == ANYWHERE, 0, before)
    by = np.argsort(name, kind="stable")
    name, key, line, place, before = name[by], key[by], line[by], place[by], before[by]
    a, b, tried = [], [], np.zeros(0, np.int64)

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal tried
        p, q = line[x], line[y]
        some = np.flatnonzero((root[p] != root[q]) & ((i[p] == j[p]) | (chunk[p] != chunk[q])))
        x, y, p, q = x[some], y[some], p[some], q[some]
        most = _limits(np.maximum(n[p], n[q]), similarity)
        some = np.flatnonzero((np.abs(n[p] - n[q]) <= most) & _near(place[x], place[y], n[p], n[q], most))
        pairs = np.setdiff1d(np.minimum(p[some], q[some]) * count + np.maximum(p[some], q[some]), tried)
        near = np.zeros(len(pairs), bool)
        for k in range(0, len(pairs), 20_000):
            p, q = pairs[k : k + 20_000] // count, pairs[k : k + 20_000] % count
            most, apart = _limits(np.maximum(n[p], n[q]), similarity), np.abs(n[p] - n[q])
            near[k : k + 20_000] = np.bitwise_count(sums[p] ^ sums[q]).sum(axis=1, dtype=np.int64) <= 2 * most - apart
            some = k + np.flatnonzero(near[k : k + 20_000] & (np.maximum(n[p], n[q]) > LONG))
            p, q = pairs[some] // count, pairs[some] % count
            longest = np.maximum(n[p], n[q])
            near[some] = _may_share(flat, at, p, q, longest - _limits(longest, similarity))
        pairs, unlike = pairs[near], []
        for k in range(0, len(pairs), 2_000):
            p, q = pairs[k : k + 2_000] // count, pairs[k : k + 2_000] % count
            some = root[p] != root[q]
            p, q = p[some], q[some]
            good = _similar(flat[ragged(at[p], n[p])], np.concatenate([[0], np.cumsum(n[p])]), flat[ragged(at[q], n[q])], np.concatenate([[0], np.cumsum(n[q])]), similarity, alike=True)
            a.append(h[p[good]])
            b.append(h[q[good]])
            merge_sets(root, p[good], q[good])
            unlike.append(p[~good] * count + q[~good])
        if unlike and len(tried) < 1_000_000:
            tried = np.concatenate([tried, *unlike])

    def by_parts(x: np.ndarray, low: np.ndarray, high: np.ndarray, one: np.ndarray) -> None:
        """Compares entries x with the entries [low, high) of each, some 200,000 pairs at once; those that are both not `one` only once."""
        size = np.maximum(high - low, 0)
        many, begin = np.concatenate([[0], np.cumsum(size)]), 0
        while begin < len(x):
            end = max(begin + 1, int(np.searchsorted(many, many[begin] + 200_000, "right")) - 1)
            p, q = np.repeat(x[begin:end], size[begin:end]), ragged(low[begin:end], size[begin:end])
            some = one[q] | (p < q)
            compare(p[some], q[some])
            begin = end

    # the first line of each class is compared with all of it, which connects copies
    starts = np.flatnonzero(np.concatenate([[True], name[1:] >> 21 != name[:-1] >> 21]))
    by_parts(starts, starts, np.append(starts[1:], len(key)), np.zeros(len(key), bool))
    # lines connected with most lines of a key have to meet the others only; all others meet those of like length and place
    parts, of, sizes = np.unique(key * count + root[line], return_inverse=True, return_counts=True)
    order = np.lexsort((sizes, parts // count))
    largest = np.zeros(len(parts), bool)
    largest[order[np.append(np.flatnonzero(np.diff(parts[order] // count)), len(order) - 1)]] = True
    one = largest[of]
    x = np.flatnonzero(~one)
    wide = _limits(np.ceil(n[line[x]] / similarity), similarity) + np.ceil(n[line[x]] / similarity).astype(np.int64) // ANYWHERE + 1
    anywhere = place[x] == ANYWHERE
    for step in (-1, 0, 1):
        there = (kind[line[x]] + step >= 0) & (kind[line[x]] + step <= 63)
        base = (key[x] * 64 + kind[line[x]] + step) << 21
        low, high = base + np.where(anywhere, 0, np.maximum(before[x] - wide, 0)), base + np.where(anywhere, 1 << 21, np.minimum(before[x] + wide + 1, 1 << 20))
        by_parts(x[there], np.searchsorted(name, low[there]), np.searchsorted(name, high[there]), one)
        there &= ~anywhere
        by_parts(x[there], np.searchsorted(name, base[there] + (1 << 20)), np.searchsorted(name, base[there] + (1 << 21)), one)
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none)) for x in (a, b)], names=["a", "b"])


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """For each row a number that equal rows share."""
    order = np.lexsort(columns)
    new = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    out = np.zeros(len(order), np.int64)
    out[order[1:]] = np.cumsum(new)
    return out


def _sums(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each line 1,024 parities of its words, as sixteen numbers (see `_parities`)."""
    out = np.zeros((len(at) - 1, 16), np.uint64)
    for k in range(0, len(out), 1_000):
        ends = at[k : k + 1_001]
        cells = np.repeat(np.arange(len(ends) - 1), np.diff(ends)) * 1024 + (flat[ends[0] : ends[-1]] & np.uint32(1023))
        out[k : k + 1_000] = np.packbits((np.bincount(cells, minlength=1024 * (len(ends) - 1)) & 1).astype(bool)).view(np.uint64).reshape(-1, 16)
    return out


def _pack(key: np.ndarray, h: np.ndarray, n: np.ndarray, sig: np.ndarray, place: np.ndarray) -> bytes:
    """Entries in order of key, column by column: steps of the keys and lengths by their bytes and compressed, the rest as it is."""
    count = len(key).to_bytes(4, "little")
    steps = np.diff(key, prepend=np.uint64(0)).astype("<u8")
    planes = np.concatenate([steps.view(np.uint8).reshape(-1, 8).T.ravel(), np.minimum(n, 65_535).astype("<u2").view(np.uint8).reshape(-1, 2).T.ravel()])
    squeezed = zstandard.compress(planes.tobytes(), 1)
    low = np.ascontiguousarray(h.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5])
    return b"".join([count, len(squeezed).to_bytes(4, "little"), squeezed, low.tobytes(), place.tobytes(), sig[n <= PARITIES].astype("<u8").tobytes()])


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    """Entries as arrays (key, h, n, sig, place); sig is 0 for lines without parities."""
    count, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    planes = np.frombuffer(zstandard.decompress(data[8 : 8 + size]), np.uint8)
    key = np.cumsum(np.ascontiguousarray(planes[: 8 * count].reshape(8, count).T).view("<u8").ravel(), dtype=np.uint64)
    n = np.ascontiguousarray(planes[8 * count :].reshape(2, count).T).view("<u2").ravel().astype(np.int64)
    low = np.zeros((count, 8), np.uint8)
    low[:, :5] = np.frombuffer(data, np.uint8, 5 * count, 8 + size).reshape(count, 5)
    sig = np.zeros(count, np.uint64)
    sig[n <= PARITIES] = np.frombuffer(data, "<u8", offset=8 + size + 6 * count)
    return key, low.view("<i8").ravel(), n, sig, np.frombuffer(data, np.uint8, count, 8 + size + 5 * count)


def _key_pairs(held: list[tuple], bucket: int | None, buckets: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(null, a, b) for pairs of a bucket that share a key and may be similar; (key and place in 8 bits, line, null) for lines of keys of many lines."""
    if not held:
        return
    key, h, n, sig, place = (np.concatenate(c) for c in zip(*held, strict=True))
    by = np.lexsort((h, n, key))  # the shortest line of a key comes first: it has least of its own
    key, h = key[by], h[by]
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])])  # a line that several tasks have given counts once
    by, key, h = by[first], key[first], h[first]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    several = np.repeat(sizes > 1, sizes)
    by, key, h, sizes = by[several], key[several], h[several], sizes[sizes > 1]
    if not len(key):
        return
    n, sig, place = n[by], sig[by], place[by]
    starts = np.cumsum(sizes) - sizes
    hot = np.repeat(sizes > GROUP, sizes)
    left, right = [np.repeat(starts, sizes)[hot]], [np.flatnonzero(hot)]
    active = np.flatnonzero(~hot)
    for step in range(1, GROUP):
        active = active[active + step < len(key)]
        active = active[key[active] == key[active + step]]
        if not len(active):
            break
        left.append(active)
        right.append(active + step)
    a, b = np.concatenate(left), np.concatenate(right)
    most = _limits(np.maximum(n[a], n[b]), similarity)
    good = (h[a] != h[b]) & (np.abs(n[a] - n[b]) <= most) & ((np.bitwise_count(sig[a] ^ sig[b]) <= 2 * most - np.abs(n[a] - n[b])) | (np.maximum(n[a], n[b]) > PARITIES))
    good &= (np.maximum(n[a], n[b]) >= 65_535) | _near(place[a], place[b], n[a], n[b], most)
    ends = np.unique(np.stack([np.minimum(h[a[good]], h[b[good]]), np.maximum(h[a[good]], h[b[good]])], axis=1), axis=0)
    names, none = ["key", "a", "b"], pa.nulls
    for k in range(0, len(ends), 100_000):
        p = ends[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([none(len(p), pa.int64()), pa.array(p[:, 0]), pa.array(p[:, 1])], names=names)
    some = np.flatnonzero(hot)
    for k in range(0, len(some), 100_000):
        x = some[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array((((key[x] * np.uint64(buckets) + np.uint64(bucket)) << np.uint64(8)) | place[x]).view(np.int64)), pa.array(h[x]), none(len(x), pa.int64())], names=names)


def _wanted(lines: DataFrame, low: DataFrame) -> DataFrame:
    """(h, low, seq): the distinct lines with these 40 bits of their hash. A filter spares most others the exchange."""
    some = may_be_in(lines.select(F.col("h").bitwiseAND(F.lit(_LOW)).alias("low"), "h", "seq"), "low", low)
    return some.join(low.hint("merge"), "low", "left_semi").groupBy("low", "h").agg(F.first("seq").alias("seq"))


def _verified(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """(a, b): hashes of the lines of the pairs (40 bits of each hash) whose word sequences are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                part = batch.slice(k, 2_000)
                (x, p), (y, q) = _flat(part.column(2)), _flat(part.column(3))
                good = pa.array(_similar(x, p, y, q, similarity))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], names=["a", "b"])

    pairs = stored(pairs)
    some = stored(_wanted(lines, pairs.select(F.explode(F.array("a", "b")).alias("low")).distinct()))
    reclaim(lines.sparkSession)
    ends = [some.select(F.col("low").alias(c), F.col("h").alias(f"{c}_h"), F.col("seq").alias(f"{c}_seq")).hint("merge") for c in "ab"]
    both = pairs.join(ends[0], "a").join(ends[1], "b")
    out = cut(both.select("a_h", "b_h", "a_seq", "b_seq").mapInArrow(tidy(verify), "a long, b long"))
    discard(pairs, some)
    del pairs, some, ends, both
    reclaim(lines.sparkSession)
    return out


def dedupe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False, **options) -> DataFrame:
    """`df` without repeated lines: of each group of similar lines of the whole corpus, one occurrence stays.

    Lines of fewer than `min_words` (5) words always stay; null and empty texts stay as they are. With
    `report`, n_lines, n_removed and removed (line numbers from 0) are added (clashing columns are
    replaced); otherwise columns are those of `df`.
    """
    gone = repeated(df, id_col, text_col, **options)
    docs = df.withColumnsRenamed({c: f"{TMP}x_{c}" for c in df.columns}).withColumn(f"{TMP}t", F.xxhash64(F.col(f"{TMP}x_{text_col}").cast("string")))
    both = docs.join(gone.withColumnsRenamed({"id": f"{TMP}id", "t": f"{TMP}u", "gone": f"{TMP}gone"}), F.col(f"{TMP}x_{id_col}").eqNullSafe(F.col(f"{TMP}id")) & (F.col(f"{TMP}t") == F.col(f"{TMP}u")), "left")
    text = F.col(f"{TMP}x_{text_col}")
    split, lost = F.split(text, "\n"), F.coalesce(F.col(f"{TMP}gone"), F.array().cast("array<int>"))
    kept: Column = F.array_join(F.filter(split, lambda _, k: ~F.array_contains(F.col(f"{TMP}gone"), k.cast("int"))), "\n")
    cleaned = F.when(F.col(f"{TMP}gone").isNull() | text.isNull(), text).otherwise(kept)
    extra = [F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.size(lost).cast("long").alias("n_removed"), lost.alias("removed")] if report else []
    new = {"n_lines", "n_removed", "removed"} if report else set()
    return both.select(*[(cleaned if c == text_col else F.col(f"{TMP}x_{c}")).alias(c) for c in df.columns if c.lower() not in new], *extra)
