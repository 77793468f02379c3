"""Skip rules: leave out objects that were seen before, in this run or in earlier ones.

A key is a list of cells; missing and empty cells are equal. The earliest occurrence is the one kept.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import TMP, blank, cut, first_by, hub_join, key, micros, neighbour
from .base import seconds as seconds_of


def skip_never(rows: DataFrame) -> DataFrame:
    """K1."""
    return rows


def history(committed: DataFrame, runs: DataFrame, program_id: int) -> DataFrame:
    """K8: the committed keys of a program, from its complete runs that had a skip block. A renamed copy has its own id, so it starts empty."""
    good = runs.where((F.col("program_id") == program_id) & F.col("has_skip") & F.col("complete")).select("run_id")
    return committed.where(F.col("program_id") == program_id).join(good, "run_id", "left_semi")


def compact(committed: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """One row for each key, with its first and last commit: what a growing history has to keep."""
    return committed.groupBy(*[blank(k).alias(k) for k in keys]).agg(F.min(ts).alias("first_commit"), F.max(ts).alias("last_commit"))


def skip_ever(rows: DataFrame, seen: DataFrame | None, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """K2: the first occurrence of each key that is not in `seen`. Running it again on its own result changes nothing."""
    new = rows
    if seen is not None:
        old = seen.select(key(keys).alias(f"{TMP}seen")).distinct()
        new = rows.withColumn(f"{TMP}key", key(keys)).join(old, F.col(f"{TMP}key") == F.col(f"{TMP}seen"), "left_anti").drop(f"{TMP}key")
    return first_by(new, [blank(k) for k in keys], order)


def skip_this_run(rows: DataFrame, keys: Sequence[str], order: Sequence[str], run: str = "run_id") -> DataFrame:
    """K3: the first occurrence of each key in each run."""
    return first_by(rows, [F.col(run), *[blank(k) for k in keys]], order)


def greedy(rows: DataFrame, keys: Sequence[str], at: Column, limit: float, order: Sequence[str], last_kept: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """The rows that have no kept row of their key within `limit` before them (at equal distance: skipped).

    Kept rows reset the clock, skipped ones do not, so this is no window function. Rows are dealt out by ranges of key and position and
    streamed past one number, the last kept position, within each part; equal positions of a key are thinned out
    before the exchange. A key that several parts share needs to know where the part before left off: see `_entries`, which finds that for
    all parts at once, so a key with most of the rows spreads over all tasks. `last_kept` (keys and `kept_at`, a number) is where
    earlier runs left off; `parts` sets the number of ranges. Rows without a position are skipped.
    """
    k, t, last, part = f"{TMP}k", f"{TMP}at", f"{TMP}last", f"{TMP}part"
    marked = rows.withColumns({k: F.to_json(key(keys)), t: at.cast("double")}).where(F.col(t).isNotNull())
    # of a key's rows at one position only the first can be kept: a partial aggregate instead of a sort of them all
    marked = first_by(marked, [k, t], order)
    dealt = marked.repartitionByRange(parts, k, t) if parts else marked.repartitionByRange(k, t)
    # a checkpoint keeps the parts and their order
    dealt = cut(dealt.withColumn(part, F.spark_partition_id()).sortWithinPartitions(k, t))
    before = None
    if last_kept is not None:
        before = last_kept.select(F.to_json(key(keys)).alias(k), F.col("kept_at").cast("double").alias(last)).groupBy(k).agg(F.max(last).alias(last))
    entries = _entries(dealt.select(k, t, part), limit, before)
    if before is not None:
        dealt = dealt.join(before, k, "left")
    else:
        dealt = dealt.withColumn(last, F.lit(None).cast("double"))
    if entries:
        # of the keys that parts share, as many as there are parts at most
        found = F.broadcast(rows.sparkSession.createDataFrame(entries, f"{TMP}ek string, {TMP}ep int, {TMP}el double"))
        dealt = dealt.join(found, (F.col(k) == F.col(f"{TMP}ek")) & (F.col(part) == F.col(f"{TMP}ep")), "left").withColumn(last, F.coalesce(f"{TMP}el", last))
    if before is not None:
        dealt = dealt.repartition(part).sortWithinPartitions(part, k, t)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, None
        for batch in batches:
            keep = []
            for n, (*at_key, t, last) in enumerate(zip(*(batch.column(f"{TMP}{c}").to_pylist() for c in ("part", "k", "at", "last")), strict=True)):
                if at_key != now:
                    now, kept = at_key, last
                if kept is None or t - kept > limit:
                    keep.append(n)
                    kept = t
            yield batch.select(names).take(pa.array(keep, pa.int64()))

    return dealt.mapInArrow(run, T.StructType([rows.schema[c] for c in names]))


#: Groups of shared keys, in all, that are followed on the driver instead of by joins.
FEW = 50_000


def _entries(dealt: DataFrame, limit: float, before: DataFrame | None) -> list[tuple[str, int, float]]:
    """(key, part, last kept position before the part) of the keys that several parts share; infinity where nothing of the part is kept.

    Within a part every row leads to a next kept row, and so to the last one kept there (pointer doubling). Neighbouring rows with the same last one form a group: a
    part's map from entry to exit. An exit leads to one group of the part that holds the first position beyond the limit, so all groups
    form a forest, and doubling of its pointers marks the groups that each key's first row leads to in log2(parts) rounds of joins (`FEW` groups or fewer are
    followed on the driver, with the same result). Shared keys are fewer than parts, and beyond that only their parts' bounds and entries come to the driver: both are bounded by
    the number of partitions.
    """
    k, t, part = (f"{TMP}{c}" for c in ("k", "at", "part"))
    spans = dealt.groupBy(k, part).agg(F.min(t).alias("low"), F.max(t).alias("high"))
    shared = spans.groupBy(k).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(part, "low", "high"))).alias("of")).where("n > 1")
    starts = shared if before is None else shared.join(before, k, "left")
    found = starts.select(k, "of", (F.lit(None) if before is None else F.col(f"{TMP}last")).cast("double").alias("last")).collect()
    if not found:
        return []
    spark = dealt.sparkSession
    bounds = {r[0]: ([x[0] for x in r["of"]], [x["high"] for x in r["of"]]) for r in found}

    def target(name: str, last: float) -> int | None:
        """The part that holds the key's first position beyond the limit."""
        parts, highs = bounds[name]
        n = bisect.bisect_left(highs, True, key=lambda h: h - last > limit)
        return parts[n] if n < len(parts) else None

    first = {name: (parts[0] if last is None else target(name, last), float("-inf") if last is None else last) for name, last, parts in ((r[0], r["last"], bounds[r[0]][0]) for r in found)}
    # which parts' exits may lead to a part: ranges in order, so fewer than twice the parts
    leads: dict[tuple[str, int], list[int]] = {}
    for r in found:
        parts, highs = bounds[r[0]]
        for x in r["of"]:
            a, b = (bisect.bisect_left(highs, True, key=lambda h, v=v: h - v > limit) for v in (x["low"], x["high"]))
            for to in parts[a : b + 1]:
                if to > x[0]:
                    leads.setdefault((r[0], to), []).append(x[0])

    groups_schema = "k string, part int, g int, high double, leaves double"

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (name, p), pieces in held.items():
                at = np.concatenate(pieces)
                follow = _next(at, limit)
                while True:
                    further = follow[follow]
                    if (further == follow).all():
                        break
                    follow = further
                ends = np.flatnonzero(np.append(follow[1:] != follow[:-1], True))
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.full(n, p, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(at[ends]), pa.array(at[follow[ends]])], names=["k", "part", "g", "high", "leaves"])
            held.clear()

        for batch in batches:
            names, at, p = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            change = [0, *(n for n in range(1, len(names)) if names[n] != names[n - 1] or p[n] != p[n - 1]), len(names)]
            for a, b in zip(change, change[1:], strict=False):
                if a < b and names[a] in bounds:
                    if (names[a], p[a]) not in held:
                        yield from flush()
                    held.setdefault((names[a], p[a]), []).append(at[a:b])
        yield from flush()

    groups = dealt.where(F.col(k).isin(list(bounds))).mapInArrow(maps, groups_schema)
    few = groups.limit(FEW + 1).toArrow()
    if few.num_rows <= FEW:  # so few that they are followed here, a step for each part
        of: dict[tuple[str, int], list[tuple[float, float]]] = {}
        for name, p, high, leaves in zip(*(few.column(c).to_pylist() for c in ("k", "part", "high", "leaves")), strict=True):
            of.setdefault((name, p), []).append((high, leaves))
        last = {}
        for name, (p, leaves) in first.items():
            while p is not None:
                last[name, p] = leaves
                own = sorted(of[name, p])
                leaves = own[bisect.bisect_left(own, True, key=lambda g, v=leaves: g[0] - v > limit)][1]
                p = target(name, leaves)
        return [(name, p, last.get((name, p), float("inf"))) for name, (parts, _) in bounds.items() for p in parts]
    groups = cut(groups)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups to the pairs (part they are left from, part they are entered in): as exits where they lead, as entries from wherever exits may come."""
        for batch in batches:
            out = []
            for name, p, g, high, leaves in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to = target(name, leaves)
                if to is not None:
                    out.append((name, p, to, False, g, leaves))
                out += [(name, i, p, True, g, high) for i in leads.get((name, p), [])]
                if first[name][0] == p:
                    out.append((name, -1, p, True, g, high))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.float64()], strict=True)], names=["k", "a", "b", "entry", "g", "v"])

    def meet(table: pa.Table) -> pa.Table:
        """Each exit of part a with the group of part b that it leads to: the first whose last position is beyond the limit."""
        name, a, b = table.column("k")[0].as_py(), table.column("a")[0].as_py(), table.column("b")[0].as_py()
        entry = table.column("entry").to_numpy()
        g, v = table.column("g").to_numpy(), table.column("v").to_numpy()
        by = np.argsort(v[entry])
        high, into = v[entry][by], g[entry][by]
        leaves, own = (np.array([first[name][1]]), np.array([-1], np.int32)) if a == -1 else (v[~entry], g[~entry])
        at = _first_beyond(high, leaves, limit)
        ok = at < len(high)
        n = int(ok.sum())
        return pa.table({"k": pa.array([name] * n, pa.string()), "a": pa.array(np.full(n, a, np.int32)), "g": pa.array(own[ok].astype(np.int32)), "leaves": pa.array(leaves[ok]), "b": pa.array(np.full(n, b, np.int32)), "into": pa.array(into[at[ok]].astype(np.int32))})

    dealt_groups = groups.mapInArrow(deal, "k string, a int, b int, entry boolean, g int, v double")
    edges = cut(dealt_groups.groupBy("k", "a", "b").applyInArrow(meet, "k string, a int, g int, leaves double, b int, into int"))
    reached = cut(edges.where("a = -1").select("k", F.col("b").alias("part"), F.col("into").alias("g")))
    jumps = edges.where("a >= 0").select("k", F.col("a").alias("part"), "g", F.col("b").alias("to_part"), F.col("into").alias("to_g"))
    span = 1
    while span < max(len(parts) for parts, _ in bounds.values()):
        there = reached.join(jumps, ["k", "part", "g"]).select("k", F.col("to_part").alias("part"), F.col("to_g").alias("g"))
        reached = cut(reached.union(there).distinct())
        span *= 2
        if span < max(len(parts) for parts, _ in bounds.values()):
            on = jumps.select("k", F.col("part").alias("to_part"), F.col("g").alias("to_g"), F.col("to_part").alias("far_part"), F.col("to_g").alias("far_g"))
            jumps = cut(jumps.join(on, ["k", "to_part", "to_g"]).select("k", "part", "g", F.col("far_part").alias("to_part"), F.col("far_g").alias("to_g")))
    # the exits on each key's way, each the entry of the part that it leads to
    way = edges.where("a >= 0").join(reached.select("k", F.col("part").alias("a"), "g"), ["k", "a", "g"]).select("k", "b", "leaves").union(edges.where("a = -1").select("k", "b", "leaves"))
    last = {(r.k, r.b): r.leaves for r in way.collect()}  # one for each part of a shared key at most
    none = float("inf")
    return [(name, p, last.get((name, p), none)) for name, (parts, _) in bounds.items() for p in parts]


def _first_beyond(at: np.ndarray, v: np.ndarray, limit: float) -> np.ndarray:
    """For each v the number of the first of the sorted positions that is more than `limit` after it."""
    n = np.searchsorted(at, v + limit, side="right")
    # where v + limit is rounded: the rule is a difference beyond the limit
    while (less := (n > 0) & (at[np.maximum(n, 1) - 1] - v > limit)).any():
        n = n - less
    while (more := (n < len(at)) & ~(at[np.minimum(n, len(at) - 1)] - v > limit)).any():
        n = n + more
    return n


def _next(at: np.ndarray, limit: float) -> np.ndarray:
    """The row kept after each row, itself where there is none."""
    n = _first_beyond(at, at, limit)
    return np.where(n < len(at), n, np.arange(len(at)))


def skip_last_runs(rows: DataFrame, keys: Sequence[str], n: int, order: Sequence[str], run_no: str = "run_no", since: str = "commit", parts: int | None = None) -> DataFrame:
    """K4: skipped if the key was committed in this run or the n runs before; `since="sighting"` counts mere sightings."""
    if since == "sighting":
        return _since_sighting(rows, keys, F.col(run_no).cast("double"), n, order, parts)
    return greedy(rows, keys, F.col(run_no), n, order, parts=parts)


def skip_within(rows: DataFrame, keys: Sequence[str], seconds: float, order: Sequence[str], ts: str = "ts", since: str = "commit", last_kept: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """K5: skipped if the key was committed within the period before; `since="sighting"` counts mere sightings. `kept_at` of `last_kept` is in seconds."""
    if since == "sighting":
        return _since_sighting(rows, keys, seconds_of(ts), seconds, order, parts)
    before = None if last_kept is None else last_kept.withColumn("kept_at", F.round(F.col("kept_at") * 1e6))
    return greedy(rows, keys, micros(ts), round(seconds * 1e6), order, before, parts)  # whole microseconds are exact


def _since_sighting(rows: DataFrame, keys: Sequence[str], at: Column, limit: float, order: Sequence[str], parts: int | None) -> DataFrame:
    k, t, before = f"{TMP}k", f"{TMP}at", f"{TMP}before"
    found = neighbour(rows.withColumns({k: F.to_json(key(keys)), t: at}), [k], order, F.col(t), before, parts=parts)
    gap = F.col(t) - F.col(before)
    return found.where(gap.isNull() | (gap > limit)).drop(k, t, before)


def skip_hierarchical(parents: DataFrame, children: DataFrame, parent_id: str, child_parent: str, decide_parents, decide_children) -> tuple[DataFrame, DataFrame]:
    """K6: parents first; children of skipped parents go and don't enter history; the child rule sees only the others.

    The rules are functions from rows to the rows kept. K7: a child rule may use the parent's cells once
    they are joined on.
    """
    kept = decide_parents(parents)
    inside = children.join(kept.select(F.col(parent_id).alias(f"{TMP}p")).distinct(), F.col(child_parent) == F.col(f"{TMP}p"), "left_semi")
    return kept, decide_children(inside)


def commit(kept: DataFrame, keys: Sequence[str], path: str, program_id: int, run_id: int, ts: str = "ts") -> None:
    """K9: the kept keys of a run; writing the same run again replaces them. Readers go by the runs marked complete (`history`)."""
    found = kept.select(*[blank(k).alias(k) for k in keys], ts).withColumns({"program_id": F.lit(program_id).cast("long"), "run_id": F.lit(run_id).cast("long")})
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("program_id", "run_id").parquet(path)


def changed_rows(rows: DataFrame, ids: Sequence[str], values: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Rows whose values differ from the same object's row before; an object's first row counts as changed. `parts` splits objects with very many rows."""
    names = [f"{TMP}id{i}" for i in range(len(ids))]
    before = f"{TMP}before"
    found = neighbour(rows.withColumns({n: blank(c) for n, c in zip(names, ids, strict=True)}), names, order, key(values), before, parts=parts)
    return found.where(F.col(before).isNull() | (F.col(before) != key(values))).drop(before, *names)


def _digest(cells: Sequence[Column]) -> Column:
    """128 bits of a key's cells."""
    return F.struct(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit("rowloom"), *cells).alias("b"))


def key_report(rows: DataFrame, key_sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each candidate key: rows, distinct keys, rows dropped, keys with only empty cells, largest group. One scan for all keys.

    Keys are told apart by 128-bit digests, so what is exchanged is a few numbers a row, however long the cells are.
    """
    names = list(key_sets)
    each = []
    for k, n in enumerate(names):
        cells = [blank(c) for c in key_sets[n]]
        each.append(F.struct(F.lit(k).alias("k"), _digest(cells).alias("key"), reduce(and_, [c == "" for c in cells]).alias("empty")))
    groups = rows.select(F.explode(F.array(*each)).alias("e")).groupBy("e.k", "e.key").agg(F.count("*").alias("n"), F.first("e.empty").alias("empty"))
    total = groups.groupBy("k").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.coalesce(F.sum(F.when(F.col("empty"), F.col("n"))), F.lit(0)).alias("n_empty"), F.max("n").alias("largest"))
    every = rows.sparkSession.createDataFrame(list(enumerate(names)), "k int, key_name string").join(F.broadcast(total), "k", "left")
    n = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_rows", "n_keys", "n_empty", "largest")}
    return every.select("key_name", n["n_rows"].alias("n_rows"), n["n_keys"].alias("n_keys"), (n["n_rows"] - n["n_keys"]).alias("n_dropped"), n["n_empty"].alias("n_empty"), n["largest"].alias("largest"))


#: Rows of a table for each range of digests that `_repeated` compares in one piece.
PIECE = 100_000


def _repeated(rows: DataFrame, sets: Sequence[Sequence[str]], n: int) -> set[int]:
    """The numbers of the sets of columns whose cells two of the n rows share.

    Each row has a digest of 38 to 48 bits for each set, more for more rows. Tasks sort them and hand them on by range, four bytes each, and each range looks for
    equal ones. Only rows with such a digest are then grouped by 128 bits. Pieces are bounded by `PIECE` rows or so for each range.
    """
    bits = min(16, max(6, math.ceil(math.log2(max(1, n / PIECE)))))
    low = np.uint64(2**32 - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            ks, ranges, data = [], [], []
            for k in range(len(sets)):
                every = np.sort(np.concatenate([b.column(k).to_numpy().view(np.uint64) for b in held]) >> np.uint64(32 - bits))
                at, of = (every >> np.uint64(32)).astype(np.int64), (every & low).astype("<u4")
                cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                    ks.append(k)
                    ranges.append(int(at[a]))
                    data.append(of[a:b].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(ranges, pa.int64()), pa.array(data, pa.binary())], names=["k", "range", "data"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1_000_000:
                yield flush()
                held.clear()
                size = 0
        if size:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        every = np.sort(np.concatenate([np.frombuffer(x, "<u4") for x in table.column("data").to_pylist()]))
        same = np.unique(every[1:][every[1:] == every[:-1]]).astype(np.int64)
        k, at = table.column("k")[0].as_py(), table.column("range")[0].as_py()
        return pa.table({"k": pa.array(np.full(len(same), k, np.int32)), "short": pa.array(same + (at << 32))})

    digests = [F.xxhash64(*[blank(x) for x in c]) for c in sets]
    dealt = rows.select(*[d.alias(f"h{i}") for i, d in enumerate(digests)]).mapInArrow(deal, "k int, range long, data binary")
    shared = cut(dealt.groupBy("k", "range").applyInArrow(meet, "k int, short long"))
    many = shared.count()
    if not many:
        return set()
    if many <= 1_000_000:  # chance ones, and those that a slice did not show
        shared = F.broadcast(shared)
    each = F.array(*[F.struct(F.lit(i).alias("k"), F.shiftrightunsigned(d, 32 - bits).alias("short"), _digest([blank(x) for x in c]).alias("key")) for i, (c, d) in enumerate(zip(sets, digests, strict=True))])
    twice = rows.select(F.inline(each)).join(shared, ["k", "short"], "left_semi").groupBy("k", "key").count().where("count > 1")
    return {r.k for r in twice.select("k").distinct().collect()}


def minimal_keys(rows: DataFrame, columns: Sequence[str], most: int = 4, at_once: int = 100, slices: int = 64) -> DataFrame:
    """All minimal keys among `columns` with up to `most` of them: key (its columns, in the given order), n_rows. Without rows, the empty key.

    A key tells all rows apart, missing and empty cells being equal. Sets of columns are taken by size. A pass over the rows sketches the number of
    distinct cells of all sets of one size (HyperLogLog, 4,096 registers: a standard error of 1.6 %); those that come within four standard errors of the number
    of rows go on. Of these, one slice of the digests (`slices` make up all) is grouped: two equal ones prove a set no key. All rows are compared for the few sets that are left, by
    `_repeated`, which exchanges four bytes a row and set. Sets that hold a key are passed over, and sets that cannot be keys as their columns' numbers multiply to too few. So
    the passes are a few for each size, whatever the number of sets (`at_once` share a pass); every reported key is compared on all rows, and a key is missed only if
    its sketch is off by more than four standard errors (about once in 15,000).
    """
    spark, n = rows.sparkSession, rows.count()
    found: list[tuple[str, ...]] = [] if n > 1 else [()]
    near = 1 - 4 * 1.04 / 64
    estimates: dict[tuple[str, ...], float] = {}
    for size in range(1, min(most, len(columns)) + 1):
        sets = [c for c in itertools.combinations(columns, size) if not any(set(k) <= set(c) for k in found)]
        if size > 1:
            sets = [c for c in sets if math.prod(estimates[(x,)] / near for x in c) >= n]
        likely = []
        for k in range(0, len(sets), at_once):
            part = sets[k : k + at_once]
            sketched = rows.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*[blank(x) for x in c]), 12)).alias(f"s{i}") for i, c in enumerate(part)]).first()
            estimates |= {c: max(1.0, float(x)) for c, x in zip(part, sketched, strict=True)}
            likely += [c for c in part if estimates[c] >= near * n]
        for k in range(0, len(likely), at_once):
            part = likely[k : k + at_once]
            each = F.array(*[F.struct(F.lit(i).alias("k"), _digest([blank(x) for x in c]).alias("key")) for i, c in enumerate(part)])
            slice_of = F.filter(each, lambda e: F.pmod(e["key"]["a"], F.lit(slices)) == 0)
            twice = rows.select(F.inline(slice_of)).groupBy("k", "key").count().where("count > 1")
            out = {r.k for r in twice.select("k").distinct().collect()}
            part = [c for i, c in enumerate(part) if i not in out]
            again = _repeated(rows, part, n) if part else set()
            found += [c for i, c in enumerate(part) if i not in again]
    return spark.createDataFrame([(list(c), n) for c in found], "key array<string>, n_rows long")


def key_quality(rows: DataFrame, keys: Sequence[str], truth: str) -> DataFrame:
    """false_merges (keys that stand for several objects) and missed_merges (objects with several keys)."""
    pairs = rows.select(key(keys).alias("k"), F.col(truth).alias("t")).distinct()
    false = pairs.groupBy("k").agg(F.count("t").alias("n")).where("n > 1").agg(F.count("*").alias("false_merges"))
    missed = pairs.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("missed_merges"))
    return false.withColumn("_rl_one", F.lit(1)).join(missed.withColumn("_rl_one", F.lit(1)), "_rl_one").drop("_rl_one")


def recording_dedupe(events: DataFrame, seq: str = "seq", hub_share: float | None = None) -> DataFrame:
    """The items scraped in a recording, in order and with repeats; each shows the last value of its id.

    The id is xpath, page and value (link or text, whichever was scraped). With `hub_share`, repeats of an item that makes up this share of all or more are spread over tasks.
    """
    value = F.when(F.col("link_scraping"), F.col("link")).otherwise(F.col("text"))
    named = events.withColumn("item_id", F.concat(blank("xpath"), F.lit("_"), blank("source_url"), blank(value))).withColumn("value", value)
    last = named.groupBy("item_id").agg(F.max_by("value", seq).alias("shown"))
    if hub_share:
        return hub_join(named, last.withColumnRenamed("item_id", f"{TMP}id"), "item_id", f"{TMP}id", hub_share).select(seq, "item_id", "shown")
    return named.join(last, "item_id").select(seq, "item_id", "shown")
