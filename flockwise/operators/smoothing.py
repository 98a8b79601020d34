"""Interval emissions and two-state smoothing, for many fits and for long grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockwise.operators.history import Layout
from flockwise.operators.likelihood import PARTIAL, interval_sums
from flockwise.session import cut_lineage

PACK_ROWS = 50_000


def _packs(rows: float) -> int:
    return max(1, int(rows // PACK_ROWS) + 1)


# --- emissions --------------------------------------------------------------------------


EMISSION = ["n", "log0", "log1", "comp_base", "comp_carried", "comp_routine", "comp_active", "ell0", "ell1"]


#: Intervals of a grid that a task fills at a time.
GRID_BLOCK = 65_536


def _block_carries(sums: DataFrame, keys: list[str], lay: Layout, block: int) -> DataFrame:
    """Mass alive at the start of each grid block, per key and kind: ``keys, block, c0, c1``.

    ``sums`` has ``b, block, d0, d1, beta0, beta1``: mass as of each interval's end. Blocks are summed in parallel; what is folded
    along a grid is one row per block.
    """
    dt, horizon, blocks = lay.dt, lay.horizon, -(-lay.B // block)
    ends = lambda n: F.least(n * F.lit(float(dt)), F.lit(float(horizon)))
    left = ends((F.col("block") + 1) * block) - ends(F.col("b") + 1)
    parts = sums.groupBy(*keys, "block").agg(*[F.sum(F.col(f"d{k}") * F.exp(-F.col(f"beta{k}") * left)).alias(f"m{k}") for k in (0, 1)], F.first("beta0").alias("beta0"), F.first("beta1").alias("beta1"))
    kinds = dict(sums.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block long, c0 double, c1 double"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        at, first = pdf["block"].to_numpy(), int(pdf["block"].iloc[0])
        mass = np.zeros((2, blocks))
        mass[:, at] = pdf[["m0", "m1"]].to_numpy().T
        beta = pdf[["beta0", "beta1"]].iloc[0].to_numpy(float)
        held, rows = np.zeros(2), []
        for k in range(first, blocks - 1):
            held = held * np.exp(-beta * (min((k + 1) * block * dt, horizon) - k * block * dt)) + mass[:, k]
            rows.append((k + 1, *held))
        out = pd.DataFrame(rows, columns=["block", "c0", "c1"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return parts.groupBy(*keys).applyInPandas(fold, schema)


def _block_starts(lay: Layout, k: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and bounds of a block's intervals."""
    b = np.arange(k * block, min((k + 1) * block, lay.B))
    return b, np.minimum(np.append(b, b[-1] + 1) * lay.dt, lay.horizon)


def _alive(d, delta, beta, carry) -> np.ndarray:
    """Mass alive at each interval start of a block, for many series: what earlier ends of the block left, and what came into it."""
    alive, held = np.empty(d.shape), carry
    fade = np.exp(-beta[:, None] * delta)
    for b in range(d.shape[1]):
        alive[:, b] = held
        held = held * fade[:, b] + d[:, b]
    return alive


def _places(index: pd.DataFrame, rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the keys of ``rows`` stand in ``index``, -1 if they do not."""
    return pd.MultiIndex.from_frame(index[keys]).get_indexer(pd.MultiIndex.from_frame(rows[keys]))


def _shape_of(lay: Layout) -> Layout:
    """The numbers of a layout, without its tables."""
    return Layout(None, None, None, lay.n_chunks, lay.n_fits, lay.spans, lay.K, lay.M, lay.dt, lay.horizon)


def interval_emissions(lay: Layout, params: DataFrame, weights: DataFrame | None, present: bool = False, n_cands: int = 1, block: int = GRID_BLOCK) -> DataFrame:
    """``ell[b, z]`` and its parts on the zero-filled grid of every fit.

    The compensator is separable: per interval only a scalar of routine and one of active
    mass is carried forward, so the pass is over intervals, not over sources. Grids are cut into blocks; one task holds
    blocks of about ``PACK_ROWS`` rows, and what earlier blocks left comes in as two numbers.
    """
    blocks, shape = -(-lay.B // block), _shape_of(lay)
    sums = interval_sums(lay, params, weights, present).withColumn("block", F.floor(F.col("b") / block).cast("long"))
    nu_sum = F.aggregate("nu", F.lit(0.0), lambda a, x: a + x)
    head = params.select("fit_id", "cand", nu_sum.alias("nu"), "beta0", "beta1")
    if blocks > 1:
        sums = cut_lineage(sums)
        carries = _block_carries(sums.join(head.select("fit_id", "cand", "beta0", "beta1"), ["fit_id", "cand"]), ["fit_id", "cand"], lay, block)
        head = head.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        head = head.join(carries, ["fit_id", "cand", "block"], "left").fillna(0.0, ["c0", "c1"])
    else:
        head = head.withColumn("block", F.lit(0).cast("long")).withColumn("c0", F.lit(0.0)).withColumn("c1", F.lit(0.0))
    pack = F.pmod(F.xxhash64("fit_id", "cand", "block"), F.lit(_packs(lay.n_fits * lay.B * n_cands)))

    def run(rows: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, own in fits.groupby("block"):
            b, bounds = _block_starts(shape, int(k), block)
            mine = rows[rows["block"] == k]
            at = _places(own, mine, ["fit_id", "cand"])
            mine, at = mine[at >= 0], at[at >= 0]
            v = np.zeros((len(PARTIAL), len(own), len(b)))
            v[:, at, mine["b"].to_numpy() - b[0]] = mine[PARTIAL].to_numpy(float).T
            n, l0, l1, w0, w1, d0, d1 = v
            nu, b0, b1, c0, c1 = own[["nu", "beta0", "beta1", "c0", "c1"]].to_numpy(float).T
            delta = np.diff(bounds)
            # mass d is as of the interval's end, which is the next interval's start
            carried0 = _alive(d0, delta, b0, c0) * -np.expm1(-b0[:, None] * delta) / b0[:, None]
            carried1 = _alive(d1, delta, b1, c1) * -np.expm1(-b1[:, None] * delta) / b1[:, None]
            base = nu[:, None] * delta
            shared = base + carried0 + (0.0 if present else carried1)
            active = w1 + (carried1 if present else 0.0)
            found = {"n": n.astype(np.int64), "log0": l0, "log1": l1, "comp_base": base, "comp_carried": shared - base, "comp_routine": w0, "comp_active": active,
                     "ell0": l0 - shared - w0, "ell1": l1 - shared - w0 - active}
            out.append(pd.DataFrame({"fit_id": np.repeat(own["fit_id"].to_numpy(), len(b)), "cand": np.repeat(own["cand"].to_numpy(), len(b)),
                                     "b": np.tile(b.astype(np.int32), len(own)), **{c: x.ravel() for c, x in found.items()}}))
        return pd.concat(out) if out else pd.DataFrame(columns=["fit_id", "cand", "b", *EMISSION])

    schema = "fit_id long, cand int, b int, n long, " + ", ".join(f"{c} double" for c in EMISSION[1:])
    left = sums.withColumn("pack", pack).groupBy("pack")
    right = head.select(*[F.col(c).alias(c) for c in head.columns])  # fresh identities
    return left.cogroup(right.withColumn("pack", pack).groupBy("pack")).applyInPandas(run, schema)


def interval_start_traces(lay: Layout, events: DataFrame, betas: DataFrame, weights: DataFrame | None, block: int = GRID_BLOCK) -> DataFrame:
    """Traces per source at each interval start (events strictly before), non-zero rows only.

    Events reduce to one decayed sum per interval and source; those few rows are scanned, block of the grid by block.
    """
    e = events.join(betas, "fit_id")
    if weights is not None:
        e = e.join(weights.select("fit_id", "b", "w"), ["fit_id", "b"], "left").fillna(1.0, ["w"])
    else:
        e = e.withColumn("w", F.lit(1.0))
    rem = F.col("t_end") - F.col("t")
    keys, blocks, shape = ["fit_id", "actor", "mark"], -(-lay.B // block), _shape_of(lay)
    sums = e.groupBy(*keys, "b").agg(
        F.sum(F.col("beta0") * F.exp(-F.col("beta0") * rem)).alias("d0"),
        F.sum(F.col("w") * F.col("beta1") * F.exp(-F.col("beta1") * rem)).alias("d1"),
        F.first("beta0").alias("beta0"), F.first("beta1").alias("beta1"),
    ).withColumn("block", F.floor(F.col("b") / block).cast("long"))
    none = F.lit(0.0)
    rows = sums.select(*keys, "block", "b", "d0", "d1", "beta0", "beta1", none.alias("c0"), none.alias("c1"))
    if blocks > 1:
        sums = cut_lineage(sums)
        carries = _block_carries(sums, keys, lay, block).join(betas.select("fit_id", "beta0", "beta1"), "fit_id")
        rows = sums.select(*keys, "block", "b", "d0", "d1", "beta0", "beta1", none.alias("c0"), none.alias("c1")).unionByName(
            carries.select(*keys, "block", F.lit(-1).alias("b"), none.alias("d0"), none.alias("d1"), "beta0", "beta1", "c0", "c1"))
    pack = F.pmod(F.xxhash64(*keys, "block"), F.lit(_packs(lay.n_fits * lay.B * lay.K * lay.M)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, g in pdf.groupby("block"):
            b, bounds = _block_starts(shape, int(k), block)
            own = g.groupby(keys, as_index=False).agg({"beta0": "first", "beta1": "first", "c0": "sum", "c1": "sum"})
            g = g[g["b"] >= 0]
            d = np.zeros((2, len(own), len(b)))
            d[:, _places(own, g, keys), g["b"].to_numpy() - b[0]] = g[["d0", "d1"]].to_numpy().T
            r, s = (_alive(d[z], np.diff(bounds), own[f"beta{z}"].to_numpy(), own[f"c{z}"].to_numpy()).ravel() for z in (0, 1))
            some = (r > 0) | (s > 0)
            out.append(pd.DataFrame({"fit_id": np.repeat(own["fit_id"].to_numpy(), len(b))[some], "b": np.tile(b.astype(np.int32), len(own))[some],
                                     "actor": np.repeat(own["actor"].to_numpy(), len(b))[some], "mark": np.repeat(own["mark"].to_numpy(), len(b))[some],
                                     "routine": r[some], "active": s[some]}))
        return pd.concat(out)

    found = rows.withColumn("pack", pack).groupBy("pack").applyInPandas(run, "fit_id long, b int, actor int, mark int, routine double, active double")
    return found.filter("routine > 0 OR active > 0")


# --- forward-backward -------------------------------------------------------------------


def _lse(a, axis):
    m = np.max(a, axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.sum(np.exp(a - m), axis=axis))


def block_products(log_e, log_p, first):
    """Log-matrix of a block per segment: entering state to last state. ``first`` marks
    blocks that start the grid, whose first step has no transition."""
    F_, L, _ = log_e.shape
    eye = np.where(np.eye(2) > 0, 0.0, -np.inf)
    start = np.where(first[:, None, None], eye[None], log_p)
    acc = start + log_e[:, 0][:, None, :]
    for b in range(1, L):
        acc = _lse(acc[:, :, :, None] + log_p[:, None, :, :], 2) + log_e[:, b][:, None, :]
    return acc


def block_smooth(log_e, log_p, enter, leave, first, log_z):
    """Posterior and transition posteriors of a block from its entering and leaving messages."""
    F_, L, _ = log_e.shape
    alpha = np.empty((F_, L, 2))
    prev = np.empty((F_, L, 2))
    a = enter
    for b in range(L):
        step = _lse(a[:, :, None] + log_p, 1)
        if b == 0:
            step = np.where(first[:, None], enter, step)
        prev[:, b] = a
        a = step + log_e[:, b]
        alpha[:, b] = a
    beta = np.empty((F_, L, 2))
    beta[:, L - 1] = leave
    for b in range(L - 2, -1, -1):
        beta[:, b] = _lse(log_p + (log_e[:, b + 1] + beta[:, b + 1])[:, None, :], 2)
    lg = np.clip(np.nan_to_num(alpha + beta - log_z[:, None, None], nan=-745.0, posinf=0.0, neginf=-745.0), -745.0, 0.0)
    g = np.exp(lg)
    g /= np.maximum(g.sum(axis=2, keepdims=True), 1e-300)
    lx = prev[:, :, :, None] + log_p[:, None] + (log_e + beta)[:, :, None, :] - log_z[:, None, None, None]
    x = np.exp(np.clip(np.nan_to_num(lx, nan=-745.0, posinf=0.0, neginf=-745.0), -745.0, 0.0))
    x /= np.maximum(x.sum(axis=(2, 3), keepdims=True), 1e-300)
    return g, x


CHAIN = ["p00", "p01", "p10", "p11", "pi0", "pi1"]


def _stack(pdf: pd.DataFrame, chains: pd.DataFrame):
    """Segments of equal length stacked: yields keys, first intervals, emissions, transitions and starts, and the rows of ``chains``."""
    pdf = pdf.sort_values(["fit_id", "cand", "block", "b"], kind="stable")
    key = pdf[["fit_id", "cand", "block"]].to_numpy()
    heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    size = np.diff(np.r_[heads, len(pdf)])
    e = pdf[["ell0", "ell1"]].to_numpy()
    places = _places(chains, pdf.iloc[heads], ["fit_id", "cand", "block"])
    if (places < 0).any():
        raise KeyError("series without a chain")
    p = chains[CHAIN].to_numpy(float)[places]
    with np.errstate(divide="ignore"):
        log_p, log_pi = np.log(p[:, :4].reshape(-1, 2, 2) + 1e-18), np.log(p[:, 4:] + 1e-18)
    for L in np.unique(size):
        some = size == L
        at = heads[some]
        yield key[at], pdf["b"].to_numpy()[at], e[at[:, None] + np.arange(L)[None, :]], log_p[some], log_pi[some], chains.iloc[places[some]]


SMOOTH = "fit_id long, cand int, b int, g0 double, g1 double, xi array<double>, loglik double"
SMOOTH_COLS = ["fit_id", "cand", "b", "g0", "g1", "xi", "loglik"]


def _rows(keys, b0, g, x, log_z, first) -> pd.DataFrame:
    n, L = g.shape[:2]
    xi = np.empty(n * L, dtype=object)
    xi[:] = list(x.reshape(n * L, 4))
    xi[np.flatnonzero(first) * L] = None
    return pd.DataFrame({"fit_id": np.repeat(keys[:, 0], L), "cand": np.repeat(keys[:, 1], L), "b": (b0[:, None] + np.arange(L)).ravel().astype(np.int32),
                         "g0": g[:, :, 0].ravel(), "g1": g[:, :, 1].ravel(), "xi": xi, "loglik": np.repeat(log_z, L)})


def forward_backward(emissions: DataFrame, chains: DataFrame, n_intervals: int, n_series: int, block: int = 65536) -> DataFrame:
    """Posterior ``g0, g1``, the posterior of the transition into each interval, and loglik.

    A series whose emissions are not finite has a loglik that is not finite, which says that its posterior is void;
    the other series are not touched. ``emissions`` has ``fit_id, cand, b, ell0, ell1`` on a dense grid; ``chains`` has one row
    of transition and start probabilities per series. Series are smoothed side by side. A grid
    longer than ``block`` is cut: 2x2 log-matrix products per block run in parallel, a fold of
    one small matrix per block gives the messages at block borders, and blocks are then
    smoothed in parallel.
    """
    blocks = -(-n_intervals // block)
    e = emissions.select("fit_id", "cand", "b", "ell0", "ell1", F.floor(F.col("b") / block).cast("long").alias("block"))
    packs = F.lit(_packs(n_series * n_intervals))
    spread = chains.select("fit_id", "cand", *CHAIN, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def paired(right: DataFrame):
        key = F.pmod(F.xxhash64("fit_id", "cand", "block"), packs)
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # fresh identities
        return e.withColumn("pack", key).groupBy("pack").cogroup(right.withColumn("pack", key).groupBy("pack"))

    if blocks == 1:
        def whole(pdf: pd.DataFrame, ch: pd.DataFrame) -> pd.DataFrame:
            parts = []
            for keys, b0, log_e, log_p, log_pi, _ in _stack(pdf, ch) if len(pdf) else ():
                first = np.ones(len(keys), dtype=bool)
                prod = block_products(log_e, log_p, first)
                log_z = _lse((log_pi[:, :, None] + prod).reshape(len(keys), 4), 1)
                g, x = block_smooth(log_e, log_p, log_pi, np.zeros((len(keys), 2)), first, log_z)
                parts.append(_rows(keys, b0, g, x, log_z, first))
            return pd.concat(parts) if parts else pd.DataFrame(columns=SMOOTH_COLS)

        return paired(spread).applyInPandas(whole, SMOOTH)

    e = cut_lineage(e)  # read twice

    def products(pdf: pd.DataFrame, ch: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for keys, _, log_e, log_p, _, own in _stack(pdf, ch) if len(pdf) else ():
            prod = block_products(log_e, log_p, keys[:, 2] == 0)
            parts.append(own[["fit_id", "cand", "block", *CHAIN]].assign(prod=list(prod.reshape(-1, 4))))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["fit_id", "cand", "block", *CHAIN, "prod"])

    numbers = "fit_id long, cand int, block long, " + ", ".join(f"{c} double" for c in CHAIN)
    made = paired(spread).applyInPandas(products, numbers + ", prod array<double>")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """Messages at the block borders of many series at once, which have the same blocks."""
        pdf = pdf.sort_values(["fit_id", "cand", "block"], ignore_index=True)
        mats = np.stack(pdf["prod"].to_list()).reshape(-1, blocks, 2, 2)
        with np.errstate(divide="ignore"):
            enter = [np.log(pdf[["pi0", "pi1"]].to_numpy().reshape(-1, blocks, 2)[:, 0] + 1e-18)]
        for k in range(blocks):
            enter.append(_lse(enter[-1][:, :, None] + mats[:, k], 1))
        leave = [np.zeros((len(mats), 2))]
        for k in range(blocks - 1, 0, -1):
            leave.append(_lse(mats[:, k] + leave[-1][:, None, :], 2))
        log_z = np.repeat(_lse(enter[-1], 1), blocks)
        flat = lambda x: list(np.stack(x, axis=1).reshape(-1, 2))
        return pdf.drop(columns=["prod", "pack"]).assign(enter=flat(enter[:-1]), leave=flat(leave[::-1]), log_z=log_z)

    # a task folds whole series, a row per block of each
    folds = F.lit(_packs(n_series * blocks))
    borders = made.withColumn("pack", F.pmod(F.xxhash64("fit_id", "cand"), folds)).groupBy("pack").applyInPandas(
        fold, numbers + ", enter array<double>, leave array<double>, log_z double")

    def smooth(pdf: pd.DataFrame, ch: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for keys, b0, log_e, log_p, _, own in _stack(pdf, ch) if len(pdf) else ():
            enter, leave = (np.stack(own[c].to_list()) for c in ("enter", "leave"))
            log_z, first = own["log_z"].to_numpy(), keys[:, 2] == 0
            g, x = block_smooth(log_e, log_p, enter, leave, first, log_z)
            parts.append(_rows(keys, b0, g, x, log_z, first))
        return pd.concat(parts) if parts else pd.DataFrame(columns=SMOOTH_COLS)

    return paired(borders).applyInPandas(smooth, SMOOTH)


def ctmc_chains(params: DataFrame, delta: float) -> DataFrame:
    """Transition over the mean interval width and the stationary start, per series."""
    from flockwise.functions.scalar import ctmc_transition

    p00, p01, p10, p11 = ctmc_transition("eta_on", "eta_off", F.lit(float(delta)))
    s = F.col("eta_on") + F.col("eta_off")
    return params.select("fit_id", "cand", p00.alias("p00"), p01.alias("p01"), p10.alias("p10"), p11.alias("p11"),
                         (F.col("eta_off") / s).alias("pi0"), (F.col("eta_on") / s).alias("pi1"))


def estep(lay: Layout, params: DataFrame, weights: DataFrame | None, present: bool = False, block: int = 65536) -> DataFrame:
    """Emissions, chain and smoothing; one row per fit and interval."""
    em = interval_emissions(lay, params, weights, present)
    return forward_backward(em, ctmc_chains(params, lay.horizon / lay.B), lay.B, lay.n_fits, block)


def xi_sums(post: DataFrame) -> DataFrame:
    """Expected transitions and loglik per series."""
    return post.groupBy("fit_id", "cand").agg(
        *[F.sum(F.col("xi")[i]).alias(f"x{i // 2}{i % 2}") for i in range(4)], F.sum("g0").alias("occ0"), F.sum("g1").alias("occ1"),
        F.first("loglik").alias("loglik"), F.count(F.lit(1)).alias("intervals"),
    )


# --- diagnostics on emissions -----------------------------------------------------------


def emission_diagnostics(em: DataFrame) -> DataFrame:
    """Per fit: counts of intervals and events, spread of log-odds, compensator totals."""
    d = F.col("ell1") - F.col("ell0")
    return em.groupBy("fit_id").agg(
        F.count(F.lit(1)).alias("intervals"), F.count_if(F.col("n") > 0).alias("nonempty"), F.sum("n").alias("events"), F.max("n").alias("max_events"),
        F.min(d).alias("min_delta"), F.avg(d).alias("mean_delta"), F.max(d).alias("max_delta"),
        F.count_if(d > 0).alias("active_favor"), F.count_if(d < 0).alias("dormant_favor"),
        F.sum("log0").alias("log0"), F.sum("log1").alias("log1"), F.sum(F.col("comp_base") + F.col("comp_carried")).alias("comp_shared"),
        F.sum("comp_routine").alias("comp_routine"), F.sum("comp_active").alias("comp_active"),
        F.max(F.when(F.col("n") > 0, F.col("comp_active") / F.greatest(F.abs("log1"), F.lit(1e-9)))).alias("max_active_ratio"),
    )


def top_intervals(em: DataFrame, top: int = 8) -> DataFrame:
    """The busiest and the most state-separating non-empty intervals of each fit."""
    d = F.round(F.col("ell1") - F.col("ell0"), 9)
    busy = em.filter("n > 0").withColumn("delta", d)
    out = None
    for name, order in (("events", F.desc("n")), ("separation", F.desc(F.abs("delta"))), ("active", F.desc("delta"))):
        w = Window.partitionBy("fit_id").orderBy(order, F.asc("b"))
        part = busy.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("fit_id", F.lit(name).alias("measure"), "rank", "b", "n", "delta")
        out = part if out is None else out.unionByName(part)
    return out


# Thresholds and size of the forensic selection.
FORENSIC_LOG_ODDS = 2.5
FORENSIC_COMPENSATOR_RATIO = 1.0
FORENSIC_MAX = 10


def forensic_intervals(em: DataFrame) -> DataFrame:
    """Up to ten intervals per fit: strong log-odds or a large active compensator, each once
    with its best reason; fits without any get the most state-separating ones."""
    d = F.round(F.col("ell1") - F.col("ell0"), 9)
    ratio = F.round(F.col("comp_active") / F.greatest(F.abs("log1"), F.lit(1e-9)), 9)
    rows = em.filter("n > 0").select("fit_id", "b", d.alias("delta"), ratio.alias("ratio"))
    options = F.array(
        F.struct(F.when(F.col("delta") >= FORENSIC_LOG_ODDS, F.col("delta")).alias("score"), F.lit("strong_active").alias("reason")),
        F.struct(F.when(F.col("ratio") >= FORENSIC_COMPENSATOR_RATIO, F.col("ratio")).alias("score"), F.lit("active_compensator_large").alias("reason")),
    )
    found = rows.withColumn("o", F.explode(options)).filter("o.score IS NOT NULL").select("fit_id", "b", F.col("o.score").alias("score"), F.col("o.reason").alias("reason"))
    once = Window.partitionBy("fit_id", "b").orderBy(F.desc("score"), F.desc("reason"))
    found = found.withColumn("__r", F.row_number().over(once)).filter("__r = 1").drop("__r").withColumn("key", F.col("score"))
    spare = rows.join(found.select("fit_id").distinct(), "fit_id", "left_anti").select(
        "fit_id", "b", F.col("delta").alias("score"), F.lit("top_state_sep").alias("reason"), F.abs("delta").alias("key"))
    best = Window.partitionBy("fit_id").orderBy(F.desc("key"), F.asc("b"))
    return found.unionByName(spare).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= FORENSIC_MAX).drop("key")
