"""Schedules as data: what to start and cancel, and runs that would coincide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import TMP, micros, neighbour


def schedule_diff(current: DataFrame, active: DataFrame) -> DataFrame:
    """H1: (schedule, prog_id, action): start what is scheduled but not active, cancel what is active but no longer scheduled."""
    a, b = (x.select("schedule", "prog_id").distinct() for x in (current, active))
    on = a.schedule.eqNullSafe(b.schedule) & a.prog_id.eqNullSafe(b.prog_id)
    return a.join(b, on, "left_anti").withColumn("action", F.lit("start")).unionByName(b.join(a, on, "left_anti").withColumn("action", F.lit("cancel")))


def overlapping_runs(runs: DataFrame, machine: Sequence[str] = ("machine",), run: str = "run_id", start: str = "start_ts", end: str = "end_ts", cell_seconds: float | None = None) -> DataFrame:
    """H2: pairs of runs (a < b) of one machine whose times overlap; ends are exclusive, empty runs overlap nothing.

    Of two overlapping runs the later one starts within the other, so pairs are points in intervals. Time is cut into cells and cells are
    paired up level by level; a run takes the fewest such pieces that cover it, two a level at most, and a start has one piece above it on each level.
    The point is in the run iff they meet on exactly one piece: an equi-join on machine, level and piece, n log n rows whatever the
    lengths of runs, and no pair twice. `cell_seconds` is the length of a cell, by default about that of the middle run: only runs within one cell of each
    other are compared in vain.
    """
    a, b, cell = f"{TMP}a", f"{TMP}b", f"{TMP}cell"
    timed = runs.where(F.col(start) < F.col(end)).select(*machine, run, start, end, micros(start).alias(a), micros(end).alias(b))
    middle, longest = timed.agg(F.percentile_approx(F.col(b) - F.col(a), 0.5, 100), F.max(F.col(b) - F.col(a))).first()
    size = max(1, round(cell_seconds * 1e6) if cell_seconds else middle or 1)
    top = max(1, (longest or 1) // size + 2).bit_length() - 1
    pieces = timed.withColumns({f"{TMP}l": F.floor(F.col(a) / size), f"{TMP}r": F.floor((F.col(b) - 1) / size) + 1})

    def level(k: int) -> list[Column]:
        """The pieces of level k: an odd one at the left, an odd one at the right."""
        left, right = -F.shiftright(-F.col(f"{TMP}l"), k), F.shiftright(F.col(f"{TMP}r"), k)
        piece = lambda ok, n: F.when((left < right) & ok, F.struct(F.lit(k).alias("level"), n.alias("piece")))
        return [piece(left.bitwiseAND(1) == 1, left), piece(right.bitwiseAND(1) == 1, right - 1)]

    over = pieces.select("*", F.inline(F.array(*[x for k in range(top + 1) for x in level(k)]))).where("piece is not null").alias("o")
    path = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col(cell), k).alias("piece")) for k in range(top + 1)])
    points = timed.withColumn(cell, F.floor(F.col(a) / size)).select("*", F.inline(path)).alias("p")
    o, p = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"p.{c}"))
    on = (o("level") == p("level")) & (o("piece") == p("piece")) & (o(a) <= p(a)) & (p(a) < o(b)) & ((o(a) < p(a)) | (o(run) < p(run))) & (o(run) != p(run))
    for m in machine:
        on = on & (o(m) == p(m))
    return over.join(points, on).select(*[o(m).alias(m) for m in machine], F.least(o(run), p(run)).alias("run_a"), F.greatest(o(run), p(run)).alias("run_b"), p(start).alias("from_ts"), F.least(o(end), p(end)).alias("to_ts"))


def preempt(runs: DataFrame, machine: Sequence[str] = ("machine",), order: Sequence[str] = ("start_ts", "run_id"), start: str = "start_ts", end: str = "end_ts", parts: int | None = None) -> DataFrame:
    """H3: a later start halts the running one: stopped_at is the run's end or the next start, whichever is first. `parts` splits machines with very many runs."""
    following = F.col(f"{TMP}next")
    found = neighbour(runs, list(machine), list(order), F.col(start), f"{TMP}next", following=True, parts=parts)
    return found.withColumns({"stopped_at": F.least(F.col(end), following), "preempted": F.coalesce(following < F.col(end), F.lit(False))}).drop(f"{TMP}next")


def add_scheduled_run(schedules: DataFrame, new: DataFrame) -> DataFrame:
    """H4."""
    return schedules.unionByName(new)


def remove_scheduled_run(schedules: DataFrame, gone: DataFrame) -> DataFrame:
    """H4: without the schedules of `gone`."""
    g = gone.select(F.col("schedule").alias("_rl_s"), F.col("prog_id").alias("_rl_p")).distinct()
    return schedules.join(g, schedules.schedule.eqNullSafe(g["_rl_s"]) & schedules.prog_id.eqNullSafe(g["_rl_p"]), "left_anti")
