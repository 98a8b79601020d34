"""A study from sessions to summary: methods are fitted and scored for all sessions that have no finished row yet."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.operators.events import in_domain, split_by_time
from flockwise.operators.statistics import replicate_summary
from flockwise.plans import em as EM
from flockwise.plans import heldout as HO
from flockwise.session import cut_lineage
from flockwise.sources.writers import append_results, resume_filter, table_exists

#: Names of the methods (two-regime model, static gates, count HMM, full matrix) and the least events of a side.
PROPOSED, STATIC, COUNTS, MATRIX = METHODS = ("proposed", "b1", "b2", "b3")
LEAST_SIDE = 10
SCORE = ["heldout_loglik", "test_events", "nll_per_event"]


@dataclass(frozen=True)
class Shape:
    """Size and time of the sessions' model."""

    k: int
    m: int
    dt: float
    horizon: float
    fraction: float = 0.2
    chunk_rows: int | None = None


def _count_hmm(events: DataFrame, shape: Shape) -> DataFrame:
    cut = shape.horizon * (1.0 - shape.fraction)
    sides = split_by_time(events.filter(in_domain(0.0, shape.horizon, shape.k, shape.m)), ["fit_id"], shape.horizon, shape.fraction, LEAST_SIDE)
    n = sides.filter("split = 'test'").groupBy("fit_id").agg(F.count(F.lit(1)).alias("test_events"))
    ll = HO.heldout_count_hmm(sides, cut, shape.horizon - cut, shape.dt)
    return ll.join(n, "fit_id").withColumn("nll_per_event", -F.col("heldout_loglik") / F.col("test_events"))


def scorers(settings: EM.Settings, matrix_iters: int = 200) -> dict[str, Callable[[DataFrame, Shape], DataFrame]]:
    """Held-out score of each method: ``fit_id`` and ``SCORE``."""
    args = lambda s: (s.k, s.m, s.dt, s.horizon, s.fraction)
    return {
        PROPOSED: lambda e, s: HO.heldout_regime(e, *args(s), settings, chunk_rows=s.chunk_rows),
        STATIC: lambda e, s: HO.heldout_static_gates(e, *args(s), settings, chunk_rows=s.chunk_rows),
        COUNTS: _count_hmm,
        MATRIX: lambda e, s: HO.heldout_full_matrix(e, *args(s), iters=matrix_iters, chunk_rows=s.chunk_rows),
    }


def _status(events: DataFrame, shape: Shape) -> DataFrame:
    """Why a session can't be scored, from its own events: one aggregate."""
    inside = in_domain(0.0, shape.horizon, shape.k, shape.m)
    late = F.col("t") >= shape.horizon * (1.0 - shape.fraction)
    n = events.groupBy("fit_id").agg(F.count_if(inside & ~late).alias("__early"), F.count_if(inside & late).alias("__late"))
    short = F.when(F.least("__early", "__late") < LEAST_SIDE, F.format_string(f"fewer than {LEAST_SIDE} events on a side: %d and %d", "__early", "__late"))
    return n.select("fit_id", short.alias("__short"))


def run_study(sessions: DataFrame, events: DataFrame, path: str, shape: Shape, settings: EM.Settings, methods: Sequence[str] = METHODS,
              matrix_iters: int = 200) -> DataFrame:
    """Score ``methods`` for every row of ``sessions`` and append a row per (session, method) to the table at ``path``.

    ``sessions`` has ``fit_id`` and any manifest columns, ``events`` has ``fit_id, event_id, t, actor, mark``. A task whose row is there with
    status ``ok`` is not run again, so a study that was stopped goes on where it was; all sessions of a method are one job, and its rows
    are written when it ends. A session without a score is a row too: status ``error`` and a message. Returns each task's last row.
    """
    spark, keys = sessions.sparkSession, ["fit_id", "method"]
    score = scorers(settings, matrix_iters)
    unknown = sorted(set(methods) - set(score))
    if unknown:
        raise ValueError(f"unknown methods: {unknown}")
    tasks = sessions.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods]))).withColumn("attempt", F.lit(1))
    if table_exists(spark, path):
        done = spark.read.parquet(path)
        before = done.groupBy(*keys).agg((F.max("attempt") + 1).alias("__next"))
        tasks = resume_filter(tasks, done, keys).join(before, keys, "left").withColumn("attempt", F.coalesce("__next", "attempt")).drop("__next")
    tasks = cut_lineage(tasks)  # the table grows below
    for method in methods:
        mine = tasks.filter(F.col("method") == method)
        if mine.isEmpty():
            continue
        rows = events.join(mine.select("fit_id"), "fit_id", "left_semi")
        found = score[method](rows, shape).select("fit_id", *[F.col(c).cast("double" if c != "test_events" else "long").alias(c) for c in SCORE])
        out = mine.join(found, "fit_id", "left").join(_status(rows, shape), "fit_id", "left")
        fine = F.col("nll_per_event").isNotNull() & ~F.isnan("nll_per_event") & (F.abs("nll_per_event") < float("inf"))
        why = F.coalesce("__short", F.when(F.col("test_events").isNull(), "no events inside the model").otherwise("the score is not finite"))
        out = out.withColumn("status", F.when(fine, "ok").otherwise("error")).withColumn("message", F.when(~fine, why)).drop("__short")
        append_results(out, path)
    return latest(spark.read.parquet(path), keys) if table_exists(spark, path) else tasks


def latest(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of each task's last attempt."""
    rest = [c for c in results.columns if c not in keys]
    last = results.groupBy(*keys).agg(F.max_by(F.struct(*rest), "attempt").alias("__r"))
    return last.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def summary(results: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """Mean, deviation and count of the held-out score over finished sessions, and how many failed, per group."""
    ok = replicate_summary(results.filter("status = 'ok'"), list(keys), ["nll_per_event"])
    count = results.groupBy(*keys).agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") != "ok").alias("n_error"))
    return count.join(ok, list(keys), "left")
