"""Interval grids and joins of events to intervals, windows and state paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_grid(horizons: DataFrame, dt: float, horizon: str = "T", closed: bool = True) -> DataFrame:
    """Rows ``(…, b, t_start, t_end)`` from each row's horizon.

    ``closed`` ends exactly at the horizon; otherwise the grid keeps whole steps only, as a
    plain range does, and may stop short of the horizon.
    """
    T_ = F.col(horizon)
    if closed:
        last = F.ceil(T_ / dt) - 1
    else:
        last = F.floor(T_ / dt + F.lit(1e-9)) - 1
    rows = horizons.filter(T_ > 0).withColumn(
        "b", F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    )
    start = F.col("b") * F.lit(dt)
    end = (F.col("b") + 1) * F.lit(dt)
    return rows.select(
        *[c for c in horizons.columns],
        F.col("b").cast("int").alias("b"),
        start.alias("t_start"),
        (F.least(end, T_) if closed else end).alias("t_end"),
    )


def interval_index(t: Column, dt: float, horizon: Column, mode: str = "clip") -> Column:
    """Interval number on a uniform grid that ends at ``horizon``.

    ``clip`` sends outsiders to the edge intervals, ``drop`` gives null, ``hist`` closes the
    last interval on the right and gives null outside.
    """
    top = (F.ceil(horizon / dt) - 1).cast("long")
    raw = F.floor(t / dt).cast("long")
    raw = F.when(t >= (raw + 1) * F.lit(dt), raw + 1).when(t < raw * F.lit(dt), raw - 1).otherwise(raw)
    if mode == "clip":
        return F.greatest(F.least(raw, top), F.lit(0).cast("long")).cast("int")
    inside = (t >= 0) & ((t < horizon) if mode == "drop" else (t <= horizon))
    return F.when(inside, F.least(raw, top)).cast("int")


def range_join(points: DataFrame, windows: DataFrame, keys: Sequence[str], t: str, lo: str, hi: str,
               width: float, how: str = "inner", closed: str = "left") -> DataFrame:
    """Join points to windows that contain them, as an equi join on time cells.

    Each window is listed once per cell of ``width`` it touches, so the join hashes on
    ``(keys, cell)`` and neither side has to fit in one task. ``closed`` is ``left`` for
    ``[lo, hi)`` or ``right`` for ``(lo, hi]``.
    """
    w = F.lit(float(width))
    cells = windows.withColumn(
        "__cell", F.explode(F.sequence(F.floor(F.col(lo) / w).cast("long"), F.floor(F.col(hi) / w).cast("long")))
    )
    probe = points.withColumn("__cell", F.floor(F.col(t) / w).cast("long"))
    p, c = probe.alias("p"), cells.alias("c")
    x = F.col(f"p.{t}")
    inside = (x >= F.col(f"c.{lo}")) & (x < F.col(f"c.{hi}")) if closed == "left" else (x > F.col(f"c.{lo}")) & (x <= F.col(f"c.{hi}"))
    cond = (F.col("p.__cell") == F.col("c.__cell")) & inside
    for k in keys:
        cond = cond & (F.col(f"p.{k}") == F.col(f"c.{k}"))
    joined = p.join(c, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__cell")
    left = [F.col(f"p.{n}") for n in points.columns]
    right = [F.col(f"c.{n}") for n in windows.columns if n not in points.columns]
    return joined.select(*left, *right)


def disjoint(windows: DataFrame, keys: Sequence[str], lo: str = "s", hi: str = "e") -> DataFrame:
    """What each window ``[lo, hi)`` covers that no window with an earlier start does: per key disjoint pieces, so a point is in one at most."""
    order = Window.partitionBy(*keys).orderBy(lo, F.desc(hi)) if keys else Window.partitionBy(F.lit(0)).orderBy(lo, F.desc(hi))
    reached = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = windows.filter(F.col(lo) < F.col(hi)).withColumn(lo, F.greatest(F.col(lo), F.coalesce(reached, F.col(lo))))
    return pieces.filter(F.col(lo) < F.col(hi))


def in_window(events: DataFrame, windows: DataFrame, keys: Sequence[str], ids: Sequence[str], t: str = "t",
              width: float = 24.0, name: str = "inside") -> DataFrame:
    """Flag events inside any window ``[s, e)``; overlapping windows still count once.

    Windows become disjoint pieces first, so a left join by time cell meets one at most: events move once and keep their rows,
    whether ``ids`` tell them apart or not.
    """
    pieces = disjoint(windows.select(*keys, "s", "e"), keys).withColumn("__hit", F.lit(1))
    marked = range_join(events, pieces.select(*keys, F.col("s").alias("__s"), F.col("e").alias("__e"), "__hit"), keys, t, "__s", "__e", width, "left")
    return marked.withColumn(name, F.coalesce("__hit", F.lit(0))).drop("__hit", "__s", "__e")


def interval_overlap(grid: DataFrame, windows: DataFrame, keys: Sequence[str], width: float, name: str = "active") -> DataFrame:
    """1 for intervals that overlap an active window: ``t_end > s and t_start < e``.

    Of disjoint windows only the last that starts before an interval's end can decide. So the time after each start, up to the next one or as far as an
    interval can reach back, is a piece that carries the window's end, and ``t_end`` is in one at most.
    """
    longest = grid.agg(F.max(F.col("t_end") - F.col("t_start")).alias("__longest"))  # one row
    active = disjoint(windows.filter("z = 1").select(*keys, "s", "e"), keys)
    following = F.lead("s").over(Window.partitionBy(*keys).orderBy("s") if keys else Window.partitionBy(F.lit(0)).orderBy("s"))
    pieces = active.withColumn("__next", following).crossJoin(F.broadcast(longest))
    until = F.least(F.coalesce("__next", F.col("e") + F.col("__longest")), F.col("e") + F.col("__longest"))
    pieces = pieces.select(*keys, F.col("s").alias("__s"), until.alias("__until"), F.col("e").alias("__e"))
    met = range_join(grid, pieces, keys, "t_end", "__s", "__until", width, "left", closed="right")
    return met.withColumn(name, F.coalesce((F.col("__e") > F.col("t_start")).cast("int"), F.lit(0))).drop("__s", "__until", "__e")


def state_at_time(points: DataFrame, path: DataFrame, keys: Sequence[str], ids: Sequence[str], t: str, width: float,
                  default: str = "zero", name: str = "state") -> DataFrame:
    """State of the first path segment ``[s, e)`` that contains each point.

    Outside every segment the state is 0, or with ``default='last'`` the path's last state. Segments become disjoint pieces, so points move once.
    """
    pieces = disjoint(path.select(*keys, "s", "e", "z"), keys).select(*keys, F.col("s").alias("__s"), F.col("e").alias("__e"), F.col("z").alias("__z"))
    out = range_join(points, pieces, keys, t, "__s", "__e", width, "left")
    fallback = F.lit(0)
    if default == "last":
        last = path.groupBy(*keys).agg(F.max_by("z", "s").alias("__last")) if keys else path.agg(F.max_by("z", "s").alias("__last"))
        out = out.join(last, list(keys), "left") if keys else out.join(F.broadcast(last), how="left", on=F.lit(True))
        fallback = F.col("__last")
    return out.withColumn(name, F.coalesce("__z", fallback).cast("int")).drop("__s", "__e", "__z", "__last")


def switch_intervals(path: DataFrame, grid_horizon: float, dt: float, keys: Sequence[str]) -> DataFrame:
    """Intervals that contain a state change at ``0 < e < T``."""
    w = Window.partitionBy(*keys).orderBy("s")
    steps = path.withColumn("__next", F.lead("z").over(w))
    changes = steps.filter((F.col("e") > 0) & (F.col("e") < grid_horizon))
    b = interval_index(F.col("e"), dt, F.lit(float(grid_horizon)), "clip")
    return changes.select(*keys, b.alias("b")).distinct().withColumn("switch", F.lit(1))


def active_event_truth(events: DataFrame, grid: DataFrame, keys: Sequence[str], z: str = "z") -> DataFrame:
    """Per interval: was any event born active; share of active births; event count."""
    per = events.groupBy(*keys, "b").agg(
        F.max(z).alias("__any"), F.avg(z).alias("birth_fraction"), F.count(F.lit(1)).alias("__n")
    )
    return (
        grid.join(per, [*keys, "b"], "left")
        .withColumn("truth", F.coalesce("__any", F.lit(0)).cast("int"))
        .withColumn("n_events", F.coalesce("__n", F.lit(0)).cast("long"))
        .drop("__any", "__n")
    )


def interval_counts(events: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    per = events.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("__n"))
    return grid.join(per, [*keys, "b"], "left").withColumn("n", F.coalesce("__n", F.lit(0))).drop("__n")


def active_runs(scored: DataFrame, keys: Sequence[str], score: str, threshold: float = 0.5, min_active: int = 1) -> DataFrame:
    """Merge adjacent intervals at or above the threshold into windows ``(s, e)``.

    A key with fewer than ``min_active`` passing intervals also gets its best one.
    """
    best = scored.groupBy(*keys).agg(
        F.min_by("b", F.struct(-F.col(score), F.col("b"))).alias("__best"),
        F.sum((F.col(score) >= threshold).cast("int")).alias("__passing"),
    )
    on = scored.join(best, list(keys)).filter(
        (F.col(score) >= threshold) | ((F.col("__passing") < min_active) & (F.col("b") == F.col("__best")))
    )
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("b"))
    return (
        on.withColumn("__island", F.col("b") - rn)
        .groupBy(*keys, "__island")
        .agg(F.min("t_start").alias("s"), F.max("t_end").alias("e"))
        .drop("__island")
    )
