"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles. Shingles are put in one global order, rare ones first. Two
documents whose sets overlap by `need` or more share at least l shingles among the first (size - need + l) of
each: the l-prefixes. The shortest of them are indexed and find the pairs. Each document chooses its
own l: a longer prefix costs more reading, but asks for more shared shingles before a pair is verified;
it takes the l with the least estimated cost. Verification compares whole sets, so the result is exact.

The order comes from counts of all documents in a sketch (a table of hashed counters of fixed size);
an imprecise count changes the cost, never the result.

Equal sets are one node, whatever the number of copies. Within the documents that share a prefix
shingle, each is first verified against one hub. Documents that these links connect need no pair
between themselves, so large groups of near copies stay linear; a document with too much of its own has none of the group's
shingles in its shortest prefix. All other pairs are joined and verified, and connected components close the links. No side of these joins has a bound, so none is
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, connected_components, cut, may_be_in, merged_pieces, pieces_of, reclaim, run_hashes, share, slices, stored, text_words, tidy

LEVELS = 4
#: Counters of the sketch: 2^21 bytes on their way to the tasks, whatever the input.
WIDTH_LOG2, PIECE = 21, 1 << 16


#: A-Z as a-z; ASCII white space as spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its word shingles; of its whole sequence if it is shorter."""
    out: list[np.ndarray] = []
    for _, _, data, starts, words in text_words(texts, _TABLE):
        ends = np.cumsum([len(d) + 1 for d in data])
        at = np.searchsorted(starts, np.concatenate([[0], ends]))
        span = np.arange(max(0, len(words) - size + 1))
        grams = run_hashes(words, span, span + size)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(grams[a : b - size + 1]))
            else:
                out.append(run_hashes(words[a:b], np.array([0]), np.array([b - a])) if b > a else np.zeros(0, np.uint64))
    return out


def digest(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def need(n, percent: int):
    """The least overlap that a set of n elements needs with any other."""
    return (percent * n + 99) // 100


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id): the smallest id (an integer) reachable by links, itself included, for each row.

    Words are runs of characters other than ASCII white space, A-Z in lower case. Two rows link when
    100 * shared >= percent * united distinct shingles. Rows without words or text link with nothing.
    Repeated rows stay; a null id reaches and is reached like any other and is never the smallest, and
    is its own component only among nulls. An empty table gives no rows. Other columns are dropped.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).select("id", F.xxhash64("text").alias("t"), "text")
    known = index(docs, size, percent)
    roots = connected_components(near(known, docs, size, percent))
    nodes = known.where("sig is not null").groupBy("sig").agg(F.min("id").alias("least"))
    grouped = cut(nodes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), "least"))
    by_sig = attach(grouped, "root", {"component_id": F.min("least")}).select("sig", "component_id")
    out = known.select("id", "sig", "n").join(by_sig, "sig", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def index(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, t, sig, n, level, common, tokens), stored: for each row of (id, t, text) the digest (null without words) and size
    of its set, and its prefix. Of rows with one set in a partition only the first has the tokens."""
    order = share(docs.sparkSession, sketch(docs.select("text"), size))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order()
        noise = float(np.median(2.0 ** (counts.astype(float) / 8)))
        seen: set[int] = set()
        for batch in slices(batches, 2 << 20):
            cols: list[list] = [[] for _ in range(4)]
            tokens: list[np.ndarray | None] = []
            for found in shingle_sets(batch.column(2).to_pylist(), size):
                sig = digest(found) if len(found) else None
                new = sig is not None and sig not in seen
                if new and len(seen) < 1_000_000:
                    seen.add(sig)
                prefix, level, common = _prefix(found, counts, percent, noise) if new else (None, None, None)
                for col, value in zip(cols, (sig, len(found), level, common), strict=True):
                    col.append(value)
                tokens.append(prefix)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in tokens if x is not None)]))
            offsets = pa.array(np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in tokens])]).astype(np.int32))
            kinds = (pa.int64(), pa.int32(), pa.int8(), pa.int16())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.ListArray.from_arrays(offsets, flat)], names=["id", "t", "sig", "n", "level", "common", "tokens"])

    return stored(docs.mapInArrow(tidy(prefixes), "id long, t long, sig long, n int, level tinyint, common smallint, tokens array<long>"))


def near(known: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links between the digests of different shingle sets of `index`, enough of them to connect all that link."""
    sets = known.where("level is not null")
    first = F.least(F.size("tokens"), F.col("n") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1)
    rows = sets.select("sig", "n", "common", F.posexplode(F.slice("tokens", F.lit(1), first)).alias("pos", "token"))
    # only tokens of two sets or more matter; one exchange tells (a window's rows may spill, they are not collected)
    token = Window.partitionBy("token")
    rows = rows.withColumn("lo", F.min("sig").over(token)).withColumn("hi", F.max("sig").over(token)).where("lo < hi").drop("lo", "hi")
    rows = cut(rows.dropDuplicates(["token", "sig"]))
    reclaim(docs.sparkSession)

    def least(x: str, y: str) -> Column:
        """The overlap that two sets of these sizes need."""
        return F.ceil((F.col(f"{x}n") + F.col(f"{y}n")) * percent / (100.0 + percent))

    def meet(x: str, y: str) -> Column:
        """Sets of like sizes that share a token of both shortest prefixes."""
        like = (F.col(f"{x}n") * 100 >= F.col(f"{y}n") * percent) & (F.col(f"{y}n") * 100 >= F.col(f"{x}n") * percent)
        return like & (F.col(f"{x}pos") <= F.col(f"{x}n") - least(x, y)) & (F.col(f"{y}pos") <= F.col(f"{y}n") - least(x, y))

    def enough(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that share as many tokens as the level of the larger set asks for (of equals that with the larger digest)
        in prefixes that are as much longer."""
        pairs = cut(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        some = may_be_in(sets.select("sig", "n", "level", "tokens"), "sig", wanted).join(wanted.hint("merge"), "sig", "left_semi").dropDuplicates(["sig"])
        x, y = (some.select(F.col("sig").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("n", "level", "tokens")]).hint("merge") for c in "ab")
        level = F.when((F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") > F.col("b"))), F.col("a_level")).otherwise(F.col("b_level")).cast("int")
        of = lambda c: F.slice(f"{c}_tokens", F.lit(1), (F.col(f"{c}_n") - least("a_", "b_")).cast("int") + level)
        return pairs.join(x, "a").join(y, "b").where(F.size(F.array_intersect(of("a"), of("b"))) >= level).select("a", "b")

    # the commonest set of each token (the most typical of a group of near copies) is its hub
    hub = rows.groupBy("token").agg(F.max(F.struct("common", "sig", "n", "pos")).alias("h")).select("token", *[F.col(f"h.{k}").alias(f"h_{k}") for k in ("sig", "n", "pos")])
    stars = rows.join(hub.hint("merge"), "token").where("sig != h_sig").where(meet("", "h_")).select(F.least("sig", "h_sig").alias("a"), F.greatest("sig", "h_sig").alias("b")).distinct()
    linked = cut(verified(enough(stars), known, docs, size, percent))
    # sets that are connected already need no pairs between themselves
    labels = cut(connected_components(linked)).select(F.col("node").alias("sig"), F.col("root").alias("label"))
    labelled = rows.join(labels.hint("merge"), "sig", "left").withColumn("label", F.coalesce("label", "sig")).drop("common")
    mixed = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    rest = cut(labelled.join(mixed.hint("merge"), "token", "left_semi"))
    x, y = (rest.select(*[F.col(c).alias(f"{p}_{c}") for c in rest.columns]) for p in "xy")
    joined = x.join(y, (F.col("x_token") == F.col("y_token")) & (F.col("x_label") != F.col("y_label")) & (F.col("x_sig") < F.col("y_sig")) & meet("x_", "y_"))
    pairs = joined.select(F.col("x_sig").alias("a"), F.col("y_sig").alias("b")).distinct()
    tied = labels.select(F.col("sig").alias("a"), F.col("label").alias("b")).where("a != b")
    return tied.union(verified(enough(pairs), known, docs, size, percent))


def _prefix(found: np.ndarray, counts: np.ndarray, percent: int, noise: float) -> tuple[np.ndarray, int, int]:
    """The longest prefix of a set, its level, and how common its shingles are.

    The estimate for level l: reading the lists of the l-prefix, and verifying the candidates; each
    candidate uses up l list entries at least. `noise` is what a counter holds of other shingles.
    """
    n = len(found)
    c = counts[found & np.uint64(len(counts) - 1)]
    by = np.lexsort((found, c))
    found, c = found[by], 2.0 ** (c[by].astype(float) / 8)
    least = need(n, percent)
    base = n - least
    lists = np.maximum(c - 1.5 * noise, 1.0)
    cost = [lists[: base + k].sum() * (1 + 50 / k) for k in range(1, min(LEVELS, least) + 1)]
    level = int(np.argmin(cost)) + 1
    return found[: min(n, base + LEVELS)], level, round(100 * float(np.log2(c).mean()))


def sketch(texts: DataFrame, size: int) -> np.ndarray:
    """How many texts have each shingle: hashed counters, as 8 * log2 of the count in one byte."""
    width = 1 << WIDTH_LOG2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint32)
        for batch in slices(batches, 2 << 20):
            sets = shingle_sets(batch.column(0).to_pylist(), size)
            if sets:
                total += np.bincount((np.concatenate(sets) & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint32)
        yield from pieces_of(total, PIECE)

    parts = texts.mapInArrow(tidy(count), "piece int, data binary")
    return merged_pieces(parts, width, np.uint32, lambda a, b: a.astype(np.uint64) + b, lambda x: np.round(8 * np.log2(np.maximum(x, 1))).clip(0, 255).astype(np.uint8))


def verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set digests whose sets are similar enough, compared whole."""
    pairs = cut(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    # one text of each set; most texts are in no pair, the filter spares them the shingles, the join below is exact
    texts = cut(known.select("sig", "t").join(wanted.hint("merge"), "sig", "left_semi").groupBy("sig").agg(F.min("t").alias("t")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 2 << 20):
            rows = []
            for found in shingle_sets(batch.column(1).to_pylist(), size):
                if len(found) and (sig := digest(found)) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(sig)
                    rows.append((sig, found.view(np.int64)))
            if rows:
                flat = pa.array(np.concatenate([s for _, s in rows]))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(s) for _, s in rows)]), pa.int32()), flat)], names=["sig", "found"])

    some = may_be_in(docs.select("t", "text"), "t", texts.select("t"), sets, "sig long, found array<long>")
    whole = stored(some.join(wanted.hint("merge"), "sig", "left_semi").groupBy("sig").agg(F.first("found").alias("found")))
    both = pairs.join(whole.select(F.col("sig").alias("a"), F.col("found").alias("x")).hint("merge"), "a").join(whole.select(F.col("sig").alias("b"), F.col("found").alias("y")).hint("merge"), "b")
    overlap = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("o"), (F.size("x") + F.size("y")).alias("s"))
    return overlap.where(F.col("o") * 100 >= (F.col("s") - F.col("o")) * percent).select("a", "b")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """Of each component the row with the least (id, digest of its set, hash of its text), null ids last; columns stay as they are.

    Exact repeats of a row's id and text stay once, and so do rows without words or text, which link with nothing.
    An empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).select("id", F.xxhash64("text").alias("t"), "text")
    known = index(docs, size, percent)
    roots = connected_components(near(known, docs, size, percent))
    nodes = known.where("sig is not null").groupBy("sig").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "sig", "t")).alias("least"))
    grouped = nodes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min("least").alias("least"))
    keep = grouped.select("least.id", "least.t").union(known.where("sig is null").select("id", "t")).select(F.col("id").alias("_rl_id"), F.col("t").alias("_rl_u")).distinct()
    marked = df.withColumn("_rl_t", F.xxhash64(F.col(text_col).cast("string")))
    kept = marked.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col("_rl_id")) & (F.col("_rl_t") == F.col("_rl_u")), "left_semi")
    return kept.dropDuplicates([id_col, "_rl_t"]).select(*df.columns)
