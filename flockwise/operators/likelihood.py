"""Rates, compensators, emissions and the sums an M-step needs, from the chunked history."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockwise.operators.batched import Chunk
from flockwise.operators.history import EPS, Layout, carry_states, chunk_pass, context, parted, sum_vectors


def rates(seg, p, present: bool = False):
    """Rates under state 0 and 1 at every event, and their parts.

    State 0 keeps active mass of earlier intervals only; state 1 adds the same interval.
    Present-time gating has no active term in state 0 and all past mass in state 1.
    """
    nu, a0, a1, rho0, rho1, _, _ = p
    i, m = seg.ev["actor"], seg.ev["mark"]
    fr = seg.mix(seg.R, rho0)
    base = nu[i, m]
    routine = np.einsum("nj,jn->n", fr, a0[:, i])
    if present:
        f0 = np.zeros_like(fr)
        f1 = seg.mix(seg.P, rho1)
    else:
        f0 = seg.mix(seg.pre, rho1)
        f1 = f0 + seg.mix(seg.same, rho1)
    act0 = np.einsum("nj,jn->n", f0, a1[:, i])
    act1 = np.einsum("nj,jn->n", f1, a1[:, i])
    lam0 = np.maximum(base + routine + act0, EPS)
    lam1 = np.maximum(base + routine + act1, EPS)
    return lam0, lam1, base, routine, act0, act1, fr, f0, f1


def decayed_traces(lay: Layout, params: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Before each event: routine and active trace per source ``actor * M + mark``."""
    def fn(fit, cand, seg, w, g1, p):
        return list(zip([fit] * len(w), seg.ev["event_id"].tolist(), seg.R.tolist(), seg.P.tolist()))

    return chunk_pass(lay, params, weights, fn, "fit_id long, event_id long, routine array<double>, active array<double>",
                      ["fit_id", "event_id", "routine", "active"])


def event_intensity(lay: Layout, params: DataFrame, weights: DataFrame | None, present: bool = False) -> DataFrame:
    def fn(fit, cand, seg, w, g1, p):
        lam0, lam1, base, routine, act0, act1, *_ = rates(seg, p, present)
        return list(zip([fit] * len(w), seg.ev["event_id"].tolist(), seg.ev["b"].tolist(), lam0, lam1, base, routine, act0, act1))

    cols = ["fit_id", "event_id", "b", "lam0", "lam1", "base", "routine", "active_pre", "active_full"]
    return chunk_pass(lay, params, weights, fn, "fit_id long, event_id long, b int, " + ", ".join(f"{c} double" for c in cols[3:]), cols)


def gate_features(lay: Layout, params: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Per event: base rate, active features of both states, and the compensator weight."""
    def fn(fit, cand, seg, w, g1, p):
        _, _, base, routine, _, _, _, f0, f1 = rates(seg, p)
        rem = seg.ev["t_end"] - seg.ev["t"]
        cw = p[4].sum(axis=1)[seg.ev["mark"]] * -np.expm1(-p[6] * rem) / p[6]
        return list(zip([fit] * len(w), seg.ev["event_id"].tolist(), seg.ev["b"].tolist(), seg.ev["actor"].tolist(), base + routine, f0.tolist(), f1.tolist(), cw))

    cols = ["fit_id", "event_id", "b", "actor", "routine_base", "feat0", "feat1", "comp_within"]
    return chunk_pass(lay, params, weights, fn,
                      "fit_id long, event_id long, b int, actor int, routine_base double, feat0 array<double>, feat1 array<double>, comp_within double", cols)


PARTIAL = ["n", "l0", "l1", "w0", "w1", "d0", "d1"]


def interval_sums(lay: Layout, params: DataFrame, weights: DataFrame | None, present: bool = False) -> DataFrame:
    """Per fit, candidate and non-empty interval: log-rate sums, within-interval expected
    counts, and the decayed mass each interval passes on. Hot intervals arrive in parts."""
    def fn(fit, cand, seg, w, g1, p):
        lam0, lam1, *_ = rates(seg, p, present)
        nu, a0, a1, rho0, rho1, b0, b1 = p
        i, m, b = seg.ev["actor"], seg.ev["mark"], seg.ev["b"]
        out0 = a0.sum(axis=1)[i] * rho0.sum(axis=1)[m]
        out1 = a1.sum(axis=1)[i] * rho1.sum(axis=1)[m]
        rem = np.maximum(seg.ev["t_end"] - seg.ev["t"], 0.0)
        e0, e1 = np.exp(-b0 * rem), np.exp(-b1 * rem)
        cols = [np.ones(len(b)), np.log(lam0), np.log(lam1), out0 * (1 - e0), out1 * (1 - e1), out0 * b0 * e0, w * out1 * b1 * e1]
        heads = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        sums = [np.add.reduceat(c, heads).tolist() for c in cols]
        return list(zip([fit] * len(heads), [cand] * len(heads), b[heads].tolist(), *sums))

    parts = chunk_pass(lay, params, weights, fn, "fit_id long, cand int, b int, " + ", ".join(f"{c} double" for c in PARTIAL), ["fit_id", "cand", "b", *PARTIAL])
    return parts.groupBy("fit_id", "cand", "b").agg(*[F.sum(c).alias(c) for c in PARTIAL])


# --- M-step sums ------------------------------------------------------------------------


def score_and_gradient(lay: Layout, params: DataFrame, weights: DataFrame, gradient: bool = True) -> DataFrame:
    """Per fit and candidate one vector: event part of Q minus the event compensators, then,
    if asked, the gradients in A1, A0, rho0 and rho1.

    Later intervals telescope in the compensator (posterior rows sum to one), so every term
    is a sum over events and no interval pass is needed. All fits and candidates of a chunk are summed together.
    """
    horizon, K, M = lay.horizon, lay.K, lay.M
    ctx = context(lay, params, weights, carry_states(lay, params, weights))
    names = ["fit_id", "cand", "vec"]

    def run(pdf: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows = Chunk(pdf, c, K, M).score_and_gradient(horizon, gradient) if len(pdf) and len(c) else []
        return pd.DataFrame(rows, columns=names)

    rows = lay.events.groupBy("chunk").cogroup(ctx.groupBy("chunk")).applyInPandas(run, "fit_id long, cand int, vec array<double>")
    return sum_vectors(rows, ["fit_id", "cand"])


def baseline_sums(lay: Layout, params: DataFrame, weights: DataFrame) -> DataFrame:
    """Expected background events per actor and mark.

    This update's state-0 rate has no active term, and its active trace is not split by
    interval.
    """
    K, M = lay.K, lay.M

    def fn(fit, cand, seg, w, g1, p):
        nu, a0, a1, rho0, rho1, _, _ = p
        i, m = seg.ev["actor"], seg.ev["mark"]
        routine = np.einsum("nj,jn->n", seg.mix(seg.R, rho0), a0[:, i])
        active = np.einsum("nj,jn->n", seg.mix(seg.P, rho1), a1[:, i])
        base = nu[i, m]
        lam0 = np.maximum(base + routine, EPS)
        lam1 = np.maximum(base + routine + active, EPS)
        resp = (1.0 - g1) * base / lam0 + g1 * base / lam1
        return [(fit, cand, np.bincount(i * M + m, weights=resp, minlength=K * M).tolist())]

    rows = chunk_pass(lay, params, weights, fn, "fit_id long, cand int, vec array<double>", ["fit_id", "cand", "vec"])
    return sum_vectors(rows, ["fit_id", "cand"])


def static_loglik(lay: Layout, params: DataFrame) -> DataFrame:
    """Single-regime log-likelihood: log rates minus the compensator with its tail."""
    horizon = lay.horizon

    def fn(fit, cand, seg, w, g1, p):
        nu, a0, _, rho0, _, b0, _ = p
        i, m = seg.ev["actor"], seg.ev["mark"]
        lam = np.maximum(nu[i, m] + np.einsum("nj,jn->n", seg.mix(seg.R, rho0), a0[:, i]), 1e-12)
        comp = a0.sum(axis=1)[i] * rho0.sum(axis=1)[m] * -np.expm1(-b0 * (horizon - seg.ev["t"]))
        return [(fit, cand, float(np.log(lam).sum() - comp.sum()), len(i))]

    rows = chunk_pass(lay, params, None, fn, "fit_id long, cand int, part double, n long", ["fit_id", "cand", "part", "n"])
    total = rows.groupBy("fit_id", "cand").agg(F.sum("part").alias("part"), F.sum("n").alias("n"))
    nu_sum = F.aggregate("nu", F.lit(0.0), lambda a, x: a + x)
    return total.join(params.select("fit_id", "cand", nu_sum.alias("__nu")), ["fit_id", "cand"]).select(
        "fit_id", "cand", (F.col("part") - F.col("__nu") * F.lit(horizon)).alias("loglik"), "n"
    )


def rescaled_residuals(lay: Layout, params: DataFrame, weights: DataFrame | None, present: bool = False) -> DataFrame:
    """Compensator between consecutive events of a fit.

    Just after each event there is routine and active mass, which fades until the next event; what a chunk's first event needs
    of the event before it is in the carried state. Present-time gating scales the active part by the posterior of the later
    event's interval (pass weights of one for its traces).
    """
    def fn(fit, cand, seg, w, g1, p):
        nu, a0, a1, rho0, rho1, b0, b1 = p
        o0 = np.outer(a0.sum(axis=1), rho0.sum(axis=1)).ravel()
        o1 = np.outer(a1.sum(axis=1), rho1.sum(axis=1)).ravel()
        ev, n = seg.ev, len(w)
        src = ev["actor"] * seg.M + ev["mark"]
        last, past0, past1 = (0.0, 0.0, 0.0) if seg.carry is None else (seg.carry[0], seg.carry[3] @ o0, seg.carry[4] @ o1)
        mass0 = np.r_[past0, (seg.R @ o0 + b0 * o0[src])[:-1]]
        mass1 = np.r_[past1, (seg.P @ o1 + w * b1 * o1[src])[:-1]]
        dt = ev["t"] - np.r_[last, ev["t"][:-1]]
        residual = nu.sum() * dt + mass0 * -np.expm1(-b0 * dt) / b0 + (g1 if present else 1.0) * mass1 * -np.expm1(-b1 * dt) / b1
        return list(zip([fit] * n, ev["event_id"].tolist(), ev["b"].tolist(), residual.tolist()))

    return chunk_pass(lay, params, weights, fn, "fit_id long, event_id long, b int, residual double", ["fit_id", "event_id", "b", "residual"])


def interval_routes(seg, p):
    """Active mass inside each interval of a fit, per route that has any: places of intervals, source actors and marks,
    actors and marks, sums; and the intervals at these places."""
    K, M, a1, rho1 = seg.K, seg.M, p[2], p[4]
    i, m, b = seg.ev["actor"], seg.ev["mark"], seg.ev["b"]
    heads = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    group = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(b)]))
    # only sources that an event has seen in its interval; then sums over runs of equal (interval, route)
    at, source = np.nonzero(seg.same)
    j, k = source // M, source % M
    mass = seg.same[at, source] * a1[j, i[at]] * rho1[k, m[at]]
    route = np.ravel_multi_index((group[at], j, k, i[at], m[at]), (len(heads), K, M, K, M))
    kept, place = np.unique(route[mass > 0], return_inverse=True)
    total = np.bincount(place, weights=mass[mass > 0], minlength=len(kept))
    return (*np.unravel_index(kept, (len(heads), K, M, K, M)), total), b[heads]


def excitation_attribution(lay: Layout, params: DataFrame) -> DataFrame:
    """Active mass inside each interval by source actor, source mark, actor and mark.

    The chunk pass already holds the same-interval mass of every source at every event; it is
    reduced to one row per interval and route before it leaves the chunk.
    """
    def fn(fit, cand, seg, w, g1, p):
        (g, *rest), b = interval_routes(seg, p)
        return list(zip([fit] * len(g), b[g].tolist(), *(x.tolist() for x in rest)))

    cols = ["fit_id", "b", "src", "src_mark", "dst", "dst_mark", "mass"]
    rows = chunk_pass(lay, params, None, fn, "fit_id long, b int, src int, src_mark int, dst int, dst_mark int, mass double", cols)
    return rows.groupBy(*cols[:-1]).agg(F.sum("mass").alias("mass"))


ROUTES = {"sender": ["src"], "receiver": ["dst"], "edge": ["src", "dst"], "mark": ["src_mark", "dst_mark"], "full": ["src", "src_mark", "dst", "dst_mark"]}


def top_routes(mass: DataFrame, top: int = 3) -> DataFrame:
    """The largest entries per interval for each kind of route."""
    parts = None
    for kind, cols in ROUTES.items():
        one = mass.groupBy("fit_id", "b", *cols).agg(F.sum("mass").alias("mass"))
        one = one.select("fit_id", "b", F.lit(kind).alias("kind"), F.concat_ws(",", *cols).alias("route"), "mass")
        parts = one if parts is None else parts.unionByName(one)
    order = Window.partitionBy("fit_id", "b", "kind").orderBy(F.desc(F.round("mass", 9)), F.asc("route"))
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def top_excitation(lay: Layout, params: DataFrame, top: int = 3) -> DataFrame:
    """``top_routes`` of the attribution. A fit that lies whole in a chunk is ranked there, so that only its largest entries leave it."""
    whole, spanning = parted(lay)
    sizes = {"src": lay.K, "src_mark": lay.M, "dst": lay.K, "dst_mark": lay.M}

    def fn(fit, cand, seg, w, g1, p):
        (g, *places, mass), b = interval_routes(seg, p)
        places, out = dict(zip(sizes, places)), []
        for kind, cols in ROUTES.items():
            shape = (len(b), *(sizes[c] for c in cols))
            kept, at = np.unique(np.ravel_multi_index((g, *(places[c] for c in cols)), shape), return_inverse=True)
            total = np.bincount(at, weights=mass, minlength=len(kept))
            at, *names = np.unravel_index(kept, shape)
            route = np.array([",".join(map(str, r)) for r in zip(*names)], dtype=str)
            order = np.lexsort((route, -np.round(total, 9), at))
            rank = np.arange(len(order)) - np.searchsorted(at, at, "left") + 1
            order, rank = order[rank <= top], rank[rank <= top]
            out += zip([fit] * len(order), b[at[order]].tolist(), [kind] * len(order), route[order].tolist(), total[order].tolist(), rank.tolist())
        return out

    cols = ["fit_id", "b", "kind", "route", "mass", "rank"]
    out = chunk_pass(whole, params, None, fn, "fit_id long, b int, kind string, route string, mass double, rank int", cols)
    return out if spanning is None else out.unionByName(top_routes(excitation_attribution(spanning, params), top))
