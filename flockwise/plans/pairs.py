"""Pairwise couplings: events of each actor pair inside active windows, and their fits.

A pair whose events make few pairs of events among themselves is fitted inside a task, by projected
quasi-Newton steps on its own sums until the projected gradient vanishes. Busy pairs are fitted by
expectation-maximisation: an iteration is one pass over the chunked pair events, a pair spans many
chunks and carries its history from chunk to chunk, and pairs that meet the same test leave the loop.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.operators.graph import ordered_pairs
from flockwise.operators.history import ELEMENT, MAX_EXPONENT, Layout, element_schema, layout, scan, sum_vectors
from flockwise.operators.intervals import range_join
from flockwise.session import cut_lineage

# Bounds of the pair model's rates, jumps and decays.
MU_BOUNDS = (1e-8, 10.0)
ALPHA_BOUNDS = (1e-8, 10.0)
BETA_BOUNDS = (1e-4, 20.0)


def pair_segments(events: DataFrame, windows: DataFrame, keys: Sequence[str], m: int, width: float) -> DataFrame:
    """Events of each unordered pair in windows ``(s, e]``, clock reset per window.

    Dimensions 0..m-1 are the marks of the first actor, m..2m-1 those of the second.
    """
    inside = range_join(events.select(*keys, "event_id", "t", "actor", "mark"), windows.select(*keys, "s", "e"), keys, "t", "s", "e", width, closed="right")
    pairs = ordered_pairs(events.select(*keys, "actor").distinct(), keys, "actor", directed=False)
    sided = pairs.select("*", F.explode(F.array("src", "dst")).alias("actor"))
    dim = F.when(F.col("actor") == F.col("src"), F.col("mark")).otherwise(F.lit(m) + F.col("mark"))
    return inside.join(sided, [*keys, "actor"]).select(
        *keys, "src", "dst", "s", "e", "event_id", (F.col("t") - F.col("s")).alias("t_rel"), dim.cast("int").alias("dim"))


def decayed_pairs(t, src, beta, state, lagged, t_state):
    """Before each event and per (target, source): decayed counts and their lag-weighted form."""
    n, D = len(t), beta.shape[0]
    S, V = np.empty((n, D, D)), np.empty((n, D, D))
    block = np.floor(beta.max() * (t - t[0]) / MAX_EXPONENT)
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        gap = t[lo] - t_state
        fade = np.exp(-beta * gap)
        state, lagged = state * fade, (lagged + gap * state) * fade
        rel = (t[lo:hi] - t[lo])[:, None, None]
        up = np.exp(beta[None] * rel)
        inc = np.zeros((hi - lo, D, D))
        at = np.arange(hi - lo)
        inc[at, :, src[lo:hi]] = up[at, :, src[lo:hi]]
        c, ct = np.cumsum(inc, axis=0), np.cumsum(inc * rel, axis=0)
        before, before_t = c - inc, ct - inc * rel
        S[lo:hi] = (state + before) / up
        V[lo:hi] = (lagged + rel * state + rel * before - before_t) / up
        span = rel[-1]
        state, lagged = (state + c[-1]) / up[-1], (lagged + span * state + span * c[-1] - ct[-1]) / up[-1]
        t_state = t[hi - 1]
    return S, V, state, lagged


#: Event pairs up to which a pair of actors is fitted inside a task, and how many go to a task about.
MEETINGS, TASK_MEETINGS = 2_000_000, 200_000
#: Pairs that are moved together, and the least pairs of a task.
TOGETHER, TASK_PAIRS = 2_048, 1_800
#: Greatest component of the projected gradient at a solution, steps that the curvature remembers, least slope that a step keeps, halvings of a step.
GRADIENT_TOL, MEMORY, ARMIJO, HALVINGS = 1e-4, 30, 1e-4, 40
#: Size of a step in a jump, as a share of that in a decay.
RATIO = 0.3
#: Where a fit starts: least rate, jumps from the same and from another dimension, decay.
START_RATE, START_OWN, START_OTHER, START_DECAY = 1e-3, 0.02, 0.05, 1.0


class TargetSums:
    """Log-likelihoods and gradients of the targets of many pairs, from each pair's own pairs of events.

    A pair's log-likelihood is a sum over its ``D`` targets, and each target has its own rate, jumps and decays (mu, alpha, beta by
    source), so targets are fitted on their own: row ``pair * D + target``. ``pair`` numbers the pairs from 0, ``total`` holds their
    observed time.
    """

    def __init__(self, pair, segment, t, dim, length, total: np.ndarray, D: int):
        order = np.lexsort((t, segment, pair))
        pair, segment, t, dim, length = (x[order] for x in (pair, segment, t, dim, length))
        n = len(t)
        head = np.r_[True, (segment[1:] != segment[:-1]) | (pair[1:] != pair[:-1])][:n]
        place = np.arange(n)
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        # every event with all earlier ones of its segment, and every event with all targets that it excites
        late = np.repeat(place, place - first)
        early = np.arange(len(late)) - np.repeat(np.cumsum(place - first) - (place - first), place - first) + first[late]
        own = pair * D + dim
        into = (pair * D * D)[:, None] + np.arange(D)[None, :] * D + dim[:, None]
        self._hold(D, np.repeat(total, D), own, late, own[late] * D + dim[early], t[late] - t[early], into.ravel(), np.repeat(length - t, D))

    def _hold(self, D, total, own, late, cell, gap, into, left) -> None:
        self.D, self.total, self.own, self.late, self.cell, self.gap, self.into, self.left = D, total, own, late, cell, gap, into, left

    def taken(self, keep: np.ndarray) -> TargetSums:
        """Some of the targets."""
        out, D, to = TargetSums.__new__(TargetSums), self.D, np.cumsum(keep) - 1
        events, met, excited = keep[self.own], keep[self.cell // D], keep[self.into // D]
        moved = lambda cell: to[cell // D] * D + cell % D
        out._hold(D, self.total[keep], to[self.own[events]], (np.cumsum(events) - 1)[self.late[met]], moved(self.cell[met]), self.gap[met], moved(self.into[excited]), self.left[excited])
        return out

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The negative log-likelihoods and their gradients, a row per target."""
        D, P = self.D, len(x)
        mu, alpha, beta = x[:, 0], x[:, 1 : 1 + D], x[:, 1 + D :]
        jump, decay = alpha.ravel(), beta.ravel()
        fade = np.exp(-decay[self.cell] * self.gap)
        lam = np.maximum(mu[self.own] + np.bincount(self.late, weights=jump[self.cell] * fade, minlength=len(self.own)), 1e-300)
        stay = np.exp(-decay[self.into] * self.left)
        by_cell = lambda w, at: np.bincount(at, weights=w, minlength=P * D).reshape(P, D)
        room, tail = by_cell(1.0 - stay, self.into), by_cell(self.left * stay, self.into)
        by_target = lambda w: np.bincount(self.own, weights=w, minlength=P)
        value = by_target(np.log(lam)) - mu * self.total - (alpha / beta * room).sum(axis=1)
        pull = fade / lam[self.late]
        slope = np.empty_like(x)
        slope[:, 0] = by_target(1.0 / lam) - self.total
        slope[:, 1 : 1 + D] = by_cell(pull, self.cell) - room / beta
        slope[:, 1 + D :] = alpha * (room / beta**2 - tail / beta - by_cell(self.gap * pull, self.cell))
        return -value, -slope


class PairSums:
    """The same for one pair, whole: (mu, alpha, beta) of all targets in a row."""

    def __init__(self, segment, t, dim, length, total: float, D: int):
        self.D, self.targets = D, TargetSums(np.zeros(len(t), int), segment, t, dim, length, np.array([total], float), D)

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        D = self.D
        value, slope = self.targets(by_target(x[None], D))
        return float(value.sum()), np.concatenate([slope[:, 0], slope[:, 1 : 1 + D].ravel(), slope[:, 1 + D :].ravel()])


def by_target(x: np.ndarray, D: int) -> np.ndarray:
    """Rows (mu, alpha, beta) of pairs as rows of their targets."""
    mu, alpha, beta = x[:, :D], x[:, D : D + D * D], x[:, D + D * D :]
    return np.concatenate([mu.reshape(-1, 1), alpha.reshape(-1, D), beta.reshape(-1, D)], axis=1)


def pair_bounds(D: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = (np.concatenate([np.full(D, m[k]), np.full(D * D, a[k]), np.full(D * D, b[k])]) for k, (m, a, b) in enumerate([(MU_BOUNDS, ALPHA_BOUNDS, BETA_BOUNDS)] * 2))
    return low, high


def scales(rates: np.ndarray, D: int) -> np.ndarray:
    """Sizes of a step in each component: rates are small and stiff, decays are not."""
    more = np.full((*rates.shape[:-1], D * D), START_DECAY)
    return np.concatenate([rates, RATIO * more, more], axis=-1)


def projected_gradient(x, slope, low, high):
    """How far a unit step down the slope moves inside the bounds."""
    return np.abs(np.clip(x - slope, low, high) - x).max(axis=-1, initial=0.0)


def minimised(f, x: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int, scale=1.0) -> tuple[np.ndarray, float, float, int]:
    """``minimised_together`` for one point."""

    class One:
        def __call__(self, y):
            value, slope = f(y[0])
            return np.array([value]), slope[None]

    x, value, slope, it = minimised_together(One(), x[None], low, high, steps, np.broadcast_to(scale, x.shape)[None])
    return x[0], float(value[0]), float(slope[0]), int(it[0])


#: Share of the points that still move below which the others leave the arrays.
CROWD = 0.75


def minimised_together(f, x: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Projected quasi-Newton steps with limited memory from many points at once; the points, values, projected gradients, and the steps taken.

    Components at a bound that the slope pushes outwards are held; the others move along the remembered curvature, and the
    step is halved until the value falls enough. Steps are taken in units of ``scale``; the gradient test is not.
    Every point has its own steps and halvings: a call of ``f`` tries one of each, and points that are done leave (``f.taken``).
    """
    dot = lambda a, b: np.einsum("pn,pn->p", a, b)
    P, n = x.shape
    low, high, x = low / scale, high / scale, x / scale
    x = np.clip(x, low, high)
    value, slope = f(x * scale)
    slope = slope * scale
    ends = np.empty((P, n)), np.empty(P), np.empty(P), np.zeros(P, int)
    place, it, halved, steep = np.arange(P), np.zeros(P, int), np.zeros(P, int), np.zeros(P, bool)
    s, y = np.zeros((P, MEMORY, n)), np.zeros((P, MEMORY, n))
    kept, head = np.zeros(P, int), np.zeros(P, int)  # how many steps are remembered, and where the next goes
    d, live = np.zeros((P, n)), np.ones(P, bool)

    def test(at):
        return projected_gradient(x[at] * scale[at], slope[at] / scale[at], low[at] * scale[at], high[at] * scale[at])

    def held(at):
        return np.where(((x[at] <= low[at]) & (slope[at] > 0)) | ((x[at] >= high[at]) & (slope[at] < 0)), 0.0, 1.0)

    def plain(at):
        return held(at) * slope[at] / np.maximum(1.0, np.abs(slope[at]).max(axis=1))[:, None]

    def curved(at):
        """The slope times the remembered inverse curvature."""
        free, used = held(at), []
        out, gain = free * slope[at], np.zeros(len(at))
        for k in range(int(kept[at].max(initial=0))):
            slot = (head[at] - 1 - k) % MEMORY
            a, b = s[at, slot] * free, y[at, slot] * free
            ab = dot(a, b)
            fit = (ab > 1e-12) & (k < kept[at])
            ab = np.where(fit, ab, 1.0)
            share = np.where(fit, dot(a, out) / ab, 0.0)
            out -= share[:, None] * b
            fresh = fit & (gain == 0)
            if fresh.any():
                gain[fresh] = ab[fresh] / dot(b[fresh], b[fresh])
            used.append((share, a, b, ab, fit))
        out *= np.where(gain > 0, gain, 1.0 / np.maximum(1.0, np.abs(out).max(axis=1)))[:, None]
        for share, a, b, ab, fit in reversed(used):
            out += np.where(fit, share - dot(b, out) / ab, 0.0)[:, None] * a
        return out

    def aimed(at):
        """Begin a step; points that are done or have no way down stop."""
        over = ~((it[at] < steps) & np.isfinite(value[at]) & (test(at) > GRADIENT_TOL))
        live[at[over]] = False
        at = at[~over]
        it[at] += 1
        d[at], halved[at], steep[at] = curved(at), 0, False
        turned(at[~(dot(d[at], slope[at]) > 0)])

    def turned(at):
        """Go down the slope itself instead; where that does not fall either, rounding hides any further fall."""
        live[at[steep[at]]] = False
        at = at[~steep[at]]
        d[at], halved[at], steep[at] = plain(at), 0, True
        live[at[~(dot(d[at], slope[at]) > 0)]] = False

    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        aimed(np.arange(P))
        while True:
            if not live.all() and (live.mean() < CROWD or not live.any()):
                out = ~live
                for end, now in zip(ends, (x[out] * scale[out], value[out], test(np.flatnonzero(out)), it[out]), strict=True):
                    end[place[out]] = now
                if out.all():
                    return ends
                x, value, slope, scale, low, high, place, it, halved, steep, s, y, kept, head, d = (
                    v[live] for v in (x, value, slope, scale, low, high, place, it, halved, steep, s, y, kept, head, d))
                f, live = f.taken(live), np.ones(len(x), bool)
            new = np.clip(x - 0.5 ** halved[:, None] * d, low, high)
            there, rise = f(new * scale)
            rise = rise * scale
            good = live & np.isfinite(there) & (there <= value + ARMIJO * dot(slope, new - x))
            at = np.flatnonzero(good)
            a, b = new[at] - x[at], rise[at] - slope[at]
            keep = dot(a, b) > 1e-10
            into = at[keep]
            s[into, head[into]], y[into, head[into]] = a[keep], b[keep]
            head[into], kept[into] = (head[into] + 1) % MEMORY, np.minimum(kept[into] + 1, MEMORY)
            x[at], value[at], slope[at] = new[at], there[at], rise[at]
            failed = np.flatnonzero(live & ~good)
            halved[failed] += 1
            if len(at):
                aimed(at)
            spent = failed[halved[failed] == HALVINGS]
            kept[spent] = 0
            turned(spent)


def _units(pdf: pd.DataFrame, ctx: pd.DataFrame, D: int):
    if not len(pdf) or not len(ctx):
        return
    pdf = pdf.sort_values("pos", kind="stable")
    ids = pdf["fit_id"].to_numpy()
    t, dim = pdf["t"].to_numpy(), pdf["actor"].to_numpy()
    heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])
    head = ctx[ctx["kind"] == "p"].set_index("fit_id")
    carry = {r.fit_id: np.asarray(r.arr) for r in ctx[ctx["kind"] == "c"].itertuples()}
    for lo, hi in zip(heads[:-1], heads[1:]):
        if ids[lo] not in head.index:
            continue
        row = head.loc[ids[lo]]
        v = np.asarray(row["arr"], dtype=float)
        mu, alpha, beta = v[:D], v[D : D + D * D].reshape(D, D), v[D + D * D :].reshape(D, D)
        yield ids[lo], row["pair"], row["len"], t[lo:hi], dim[lo:hi], mu, alpha, beta, carry.get(ids[lo]), lo == 0, hi == len(ids)


CTX = ["chunk", "fit_id", "kind", "pair", "len", "arr"]


def _context(lay: Layout, units: DataFrame, params: DataFrame) -> DataFrame:
    p = lay.fits.join(units, "fit_id").join(params.select("pair", F.concat("mu", "alpha", "beta").alias("arr")), "pair")
    return p.select("chunk", "fit_id", F.lit("p").alias("kind"), "pair", "len", "arr")


def em_sums(lay: Layout, units: DataFrame, params: DataFrame, D: int) -> DataFrame:
    """Per pair one vector: log-rate sum and the expected counts an update needs."""
    ctx = _context(lay, units, params)
    ctx = ctx.select(*[F.col(c).alias(c) for c in CTX])
    if lay.spans:
        def summarise(key, pdf: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for unit, _, _, t, dim, _, _, beta, _, first, last in _units(pdf, c, D):
                if last:
                    zero = np.zeros((D, D))
                    *_, s, v = decayed_pairs(t, dim, beta, zero, zero, t[0])
                    rows.append((int(key[0]), unit, 0, bool(first), [t[-1], *s.ravel(), *v.ravel()], beta.ravel().tolist()))
            return pd.DataFrame(rows, columns=ELEMENT)

        def join(x, y, aux):
            x, y, beta, n = np.asarray(x), np.asarray(y), np.asarray(aux), D * D
            gap = y[0] - x[0]
            fade = np.exp(-beta * gap)
            return [y[0], *(x[1 : 1 + n] * fade + y[1 : 1 + n]), *((x[1 + n :] + gap * x[1 : 1 + n]) * fade + y[1 + n :])]

        schema = element_schema(lay)
        made = lay.events.groupBy("chunk").cogroup(ctx.groupBy("chunk")).applyInPandas(summarise, schema)
        carried = scan(cut_lineage(made), lay.n_chunks, join, schema)
        ctx = ctx.unionByName(carried.select("chunk", "fit_id", F.lit("c").alias("kind"), F.lit("").alias("pair"), F.lit(0.0).alias("len"), "arr"))
        ctx = ctx.select(*[F.col(c).alias(c) for c in CTX])

    def run(pdf: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, pair, length, t, dim, mu, alpha, beta, carry, _, _ in _units(pdf, c, D):
            zero, n = np.zeros((D, D)), D * D
            s0, v0, t0 = (zero, zero, t[0]) if carry is None else (carry[1 : 1 + n].reshape(D, D), carry[1 + n :].reshape(D, D), carry[0])
            S, V, _, _ = decayed_pairs(t, dim, beta, s0, v0, t0)
            at = np.arange(len(t))
            own_s, own_v, a = S[at, dim], V[at, dim], alpha[dim]
            lam = np.maximum(mu[dim] + np.sum(a * own_s, axis=1), 1e-300)
            base = np.bincount(dim, weights=mu[dim] / lam, minlength=D)
            born, lag = np.zeros((D, D)), np.zeros((D, D))
            np.add.at(born, dim, a * own_s / lam[:, None])
            np.add.at(lag, dim, a * own_v / lam[:, None])
            left = length - t
            e = np.exp(-beta[:, dim] * left)
            room, tail = np.zeros((D, D)), np.zeros((D, D))
            np.add.at(room.T, dim, (1.0 - e).T)
            np.add.at(tail.T, dim, (left * e).T)
            rows.append((pair, [float(np.log(lam).sum()), *base, *born.ravel(), *lag.ravel(), *room.ravel(), *tail.ravel()]))
        return pd.DataFrame(rows, columns=["pair", "vec"])

    parts = lay.events.groupBy("chunk").cogroup(ctx.groupBy("chunk")).applyInPandas(run, "pair string, vec array<double>")
    return sum_vectors(parts, ["pair"])


FITTED = "alpha array<double>, beta array<double>, loglik double, gradient double, iterations int"


def _small_pairs(named: DataFrame, good: DataFrame, D: int, steps: int) -> DataFrame:
    """Pairs of few event pairs, several to a task: ``pair`` and ``FITTED``."""
    spark = named.sparkSession
    total, pairs = good.agg(F.coalesce(F.sum("meetings"), F.lit(0.0)), F.count(F.lit(1))).first()
    tasks = int(max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), total // TASK_MEETINGS + 1, pairs // TASK_PAIRS + 1))
    pack = F.pmod(F.xxhash64("pair"), F.lit(tasks)).cast("int").alias("pack")
    rows = named.select("pair", "s", (F.col("e") - F.col("s")).alias("len"), "t_rel", "dim", pack).repartition(tasks, "pack")
    heads = good.select(F.col("pair").alias("pair"), F.col("total").alias("total"), F.col("meetings").cast("double").alias("meetings"), pack).repartition(tasks, "pack")  # fresh identities
    bounds = pair_bounds(D)
    names = ["pair", "alpha", "beta", "loglik", "gradient", "iterations"]

    def run(pdf: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        if not len(heads) or not len(pdf):
            return pd.DataFrame(columns=names)
        heads = heads.sort_values("meetings", kind="stable")
        at = pd.Index(heads["pair"]).get_indexer(pdf["pair"])
        s, t, dim, length = (pdf[c].to_numpy() for c in ("s", "t_rel", "dim", "len"))
        order = np.argsort(at, kind="stable")
        edge = np.searchsorted(at[order], np.arange(len(heads) + 1))
        total, heavy = heads["total"].to_numpy(float), np.cumsum(heads["meetings"].to_numpy(float))
        # groups of a bounded number of pairs and of pairs of events
        group = np.maximum.accumulate(np.arange(len(heads)) // TOGETHER + (heavy // TASK_MEETINGS).astype(int))
        out = []
        for rows in np.split(np.arange(len(heads)), np.flatnonzero(np.diff(group)) + 1):
            here = order[edge[rows[0]] : edge[rows[-1] + 1]]
            q, P = at[here] - rows[0], len(rows)
            f = TargetSums(q, s[here], t[here], dim[here], length[here], total[rows], D)
            rates = np.maximum(np.bincount(q * D + dim[here], minlength=P * D).reshape(P, D) / total[rows][:, None], START_RATE)
            start = np.concatenate([rates, np.tile(np.where(np.eye(D, dtype=bool), START_OWN, START_OTHER).ravel(), (P, 1)), np.full((P, D * D), START_DECAY)], axis=1)
            low, high = (np.tile(by_target(x[None], D), (P, 1)) for x in bounds)
            x, value, slope, it = minimised_together(f, by_target(start, D), low, high, steps, by_target(scales(rates, D), D))
            out.append(pd.DataFrame({
                "pair": heads["pair"].to_numpy()[rows], "alpha": list(x[:, 1 : 1 + D].reshape(P, D * D)), "beta": list(x[:, 1 + D :].reshape(P, D * D)),
                "loglik": -value.reshape(P, D).sum(axis=1), "gradient": slope.reshape(P, D).max(axis=1), "iterations": it.reshape(P, D).max(axis=1)}))
        return pd.concat(out)[names]

    return cut_lineage(rows.groupBy("pack").cogroup(heads.groupBy("pack")).applyInPandas(run, "pair string, " + FITTED))


def pairwise_coupling(segments: DataFrame, windows: DataFrame, keys: Sequence[str], m: int, iters: int = 500, min_events: int = 4,
                      chunk_rows: int | None = None, meetings: int = MEETINGS, passes: int = 200) -> DataFrame:
    """Integrated coupling ``Σ alpha/beta`` in both directions of every pair with enough events.

    Pairs whose fit has no finite log-likelihood, or whose projected gradient is above the tolerance after ``iters`` steps, are dropped.
    Pairs of actors with more than ``meetings`` pairs of events are fitted by at most ``passes`` passes over their events.
    """
    D = 2 * m
    named = segments.withColumn("pair", F.concat_ws("/", *[F.col(k).cast("string") for k in keys], "src", "dst"))
    per_window = named.groupBy("pair", *keys, "src", "dst", "s").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("dim") < m).alias("__a"), *[F.count_if(F.col("dim") == d).alias(f"__n{d}") for d in range(D)])
    counts = per_window.groupBy("pair", *keys, "src", "dst").agg(
        F.sum("n").alias("n"), F.sum("__a").alias("__a"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("meetings"), *[F.sum(f"__n{d}").alias(f"__n{d}") for d in range(D)])
    total = windows.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("total"))
    good = cut_lineage(counts.filter((F.col("n") >= min_events) & (F.col("__a") > 0) & (F.col("__a") < F.col("n"))).join(total, list(keys)))
    few, many = good.filter(F.col("meetings") <= meetings), good.filter(F.col("meetings") > meetings)
    out = few.select("pair", *keys, "src", "dst").join(_small_pairs(named, few, D, iters), "pair")
    if not many.isEmpty():
        out = out.unionByName(_busy_pairs(named, many, windows, keys, D, passes, chunk_rows).select(*out.columns))
    fine = F.col("loglik").isNotNull() & ~F.isnan("loglik") & (F.abs("loglik") < float("inf")) & (F.col("gradient") <= GRADIENT_TOL)
    out = out.filter(fine).withColumn("ratio", F.zip_with("alpha", "beta", lambda a, b: F.greatest(a / F.greatest(b, F.lit(1e-12)), F.lit(0.0))))
    pick = lambda test: F.aggregate(F.filter(F.transform("ratio", lambda x, i: F.when(test((i / D).cast("int"), i % D), x)), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    ahead = out.select(*keys, "src", "dst", pick(lambda row, col: (row >= m) & (col < m)).alias("w"), "loglik")
    back = out.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), pick(lambda row, col: (row < m) & (col >= m)).alias("w"), "loglik")
    return ahead.unionByName(back)


def _busy_pairs(named: DataFrame, good: DataFrame, windows: DataFrame, keys: Sequence[str], D: int, iters: int, chunk_rows: int | None) -> DataFrame:
    """Expectation-maximisation by passes over the chunked events; pairs that meet the gradient test leave the loop."""
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    params = cut_lineage(good.select(
        "pair", *keys, "src", "dst", "n", "total",
        F.array(*[F.greatest(F.col(f"__n{d}") / F.col("total"), F.lit(START_RATE)) for d in range(D)]).alias("mu"),
        arr(START_OWN if i // D == i % D else START_OTHER for i in range(D * D)).alias("alpha"), arr(START_DECAY for _ in range(D * D)).alias("beta")))
    unit = named.withColumn("fit_id", F.concat_ws("@", "pair", F.col("s").cast("string")))
    longest = windows.agg(F.max(F.col("e") - F.col("s"))).first()[0] or 0.0
    events = unit.join(params.select("pair"), "pair", "left_semi").select("fit_id", "event_id", F.col("t_rel").alias("t"), F.col("dim").alias("actor"), F.lit(0).alias("mark"))
    lay = layout(events, D, 1, max(longest, 1.0), max(longest, 1.0), chunk_rows)
    units = cut_lineage(unit.select("fit_id", "pair", (F.col("e") - F.col("s")).alias("len")).distinct().join(params.select("pair"), "pair", "left_semi"))
    names = params.columns
    fit = ["loglik", "gradient", "iterations"]
    schema = ", ".join(f"{n} {t}" for n, t in params.dtypes) + ", loglik double, gradient double, iterations int"
    low, high = pair_bounds(D)

    def update(it: int):
        def run(batches):
            for pdf in batches:
                rows = []
                for r in pdf.to_dict("records"):
                    v, n = np.asarray(r["vec"], dtype=float), D * D
                    born, lag, room, tail = v[1 + D :].reshape(4, D, D)
                    mu, alpha, beta = np.asarray(r["mu"]), np.asarray(r["alpha"]).reshape(D, D), np.asarray(r["beta"]).reshape(D, D)
                    r["loglik"] = float(v[0] - mu.sum() * r["total"] - np.sum(alpha / beta * room))
                    slope = np.concatenate([r["total"] - v[1 : 1 + D] / mu, (room / beta - born / alpha).ravel(), (lag - alpha * (room / beta**2 - tail / beta)).ravel()])
                    r["gradient"], r["iterations"] = projected_gradient(np.concatenate([mu, alpha.ravel(), beta.ravel()]), slope, low, high), it
                    if r["gradient"] > GRADIENT_TOL:
                        size = born / np.maximum(room, 1e-12)
                        new = np.clip(np.where(born > 1e-12, born / np.maximum(lag + size * tail, 1e-12), beta), *BETA_BOUNDS)
                        r["mu"] = np.clip(v[1 : 1 + D] / r["total"], *MU_BOUNDS).tolist()
                        r["alpha"] = np.clip(np.where(room > 0, size * new, alpha), *ALPHA_BOUNDS).ravel().tolist()
                        r["beta"] = new.ravel().tolist()
                    rows.append([r[c] for c in (*names, *fit)])
                yield pd.DataFrame(rows, columns=[*names, *fit])

        return run

    done, running = None, params
    for it in range(1, iters + 1):
        sums = em_sums(lay, units, running, D)
        moved = cut_lineage(running.select(*names).join(sums, "pair").mapInPandas(update(it), schema))
        over = F.coalesce(F.col("gradient") <= GRADIENT_TOL, F.lit(False)) | F.isnan("gradient") | F.lit(it == iters)
        part, running = moved.filter(over), moved.filter(~over)
        done = part if done is None else done.unionByName(part)
        if it == iters or running.isEmpty():
            break
    return done
