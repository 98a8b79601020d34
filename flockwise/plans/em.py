"""Distributed EM for the two-regime self-exciting model, many fits per job.

Fits that lie whole in a chunk are fitted inside its task, see ``local``: one pass over the
events, whatever the number of iterations. A fit that spans chunks is fitted by passes over them.
There, every step is either a pass over the chunked events (sums per fit and candidate) or a map
over parameter rows. Step sizes are not tried one after the other: all halvings of a step are
candidates of one pass, which also returns the gradient at each candidate, so a block step
costs one pass over the events. Progress is kept in reliable storage after each step.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockwise.functions import scalar as S
from flockwise.operators import likelihood as L
from flockwise.operators import profile as P
from flockwise.operators import smoothing as SM
from flockwise.operators.history import Layout, layout, parted, place_weights
from flockwise.plans import local
from flockwise.plans import rows as R
from flockwise.plans import steps as T
from flockwise.plans.steps import decay_projection, switch_rates  # noqa: F401
from flockwise.session import cut_lineage

VARIANTS = ("full_model", "single_gate", "dense_active_block", "shared_beta", "shared_beta_rho", "present_time_gating")


@dataclass(frozen=True)
class Settings:
    """Fit settings; the defaults are the library's, see the presets below."""

    max_iters: int = 50
    tol: float = 1e-4
    lambda_g: float = 0.1
    lambda_h: float = 0.1
    lambda_e: float = 0.01
    lambda_0: float = 0.01
    lr: float = 0.01
    n_inner_steps: int = 5
    n_decay_steps: int = T.DECAY_STEPS
    stability_threshold: float = 0.95
    stability_target: float = 0.80
    preserve_a0: bool = False
    freeze_nuisance: bool = False
    diagonal_a0: bool = False
    beta_min: float = 1e-3
    beta_max: float = 20.0
    beta_ratio: float = 2.0
    pi1_init: float = 0.15
    eta_off_floor: float = 0.0
    eta_prior_s: float = 0.0
    eta_prior_pi: float = 0.0
    eta_pi1_target: float | None = None
    eta_beta_kappa: float = 0.0
    eta_beta_target: float = 0.5
    eta_gamma_shape: float = 2.0
    eta_gamma_rate: float = 1.0
    eta_gamma_weight: float = 0.0
    variant: str = "full_model"


REPLICATION = Settings(lambda_g=0.02, lambda_h=0.02, lambda_e=0.01, lambda_0=0.05, n_inner_steps=10)
REAL_DATA = Settings(lambda_g=0.05, lambda_h=0.05, lambda_e=0.05, lambda_0=0.10, lr=0.0025, n_inner_steps=3, stability_target=0.50)


# --- schedules and small algebra --------------------------------------------------------


#: The iteration from which the floors are constant, and both floors at the first iteration and from then on.
SETTLED = 12
SHARE_FLOOR, POSTERIOR_FLOOR = (0.05, 0.005), (0.05, 0.001)


def floors(it: int, settled: int = SETTLED) -> tuple[float, float]:
    """Floors of the stationary share and of the posterior, falling linearly until ``settled``."""
    share, posterior = (float(np.interp(it, (1, settled), ends)) for ends in (SHARE_FLOOR, POSTERIOR_FLOOR))
    return share, posterior


def floored_rates(eta_on, eta_off, share: float):
    share = min(max(share, 1e-6), 1 - 1e-6)
    return F.greatest(eta_on, F.lit(share / (1 - share)) * F.greatest(eta_off, F.lit(1e-12))), eta_off


def switch_rate_table(xi: DataFrame, on: float, off: float, delta: float, s: Settings) -> DataFrame:
    """Switch rates per fit from its expected transitions and occupancies."""
    def run(batches):
        for pdf in batches:
            x = np.nan_to_num(pdf[["x00", "x01", "x10", "x11"]].to_numpy(dtype=float))
            new = switch_rates(x, pdf["occ0"].to_numpy() * delta, pdf["occ1"].to_numpy() * delta, on, off, delta, s)
            yield pdf[["fit_id", "loglik"]].assign(eta_on=new[0], eta_off=new[1])

    return xi.mapInPandas(run, "fit_id long, loglik double, eta_on double, eta_off double")


def gradients(vec, K: int, M: int) -> tuple:
    """Slopes in A1, A0, rho0 and rho1 from stacked sums."""
    v = np.stack([np.asarray(x, float) for x in vec])[:, 1:]
    a, b, c, d = np.split(v, np.cumsum([K * K, K * K, M * M]), axis=1)
    return a.reshape(-1, K, K), b.reshape(-1, K, K), c.reshape(-1, M, M), d.reshape(-1, M, M)


def _candidate(p: dict, number: int, pen=0.0) -> dict:
    n = len(p["fit_id"])
    return {**p, "cand": np.full(n, number), "pen": np.broadcast_to(np.asarray(pen, float), n), "vec": np.full(n, None) if number else p["vec"]}


def gate_candidates(p: dict, K: int, M: int, lg: float, lh: float, le: float, lr: float) -> list[dict]:
    """Current rows and the halvings of a proximal step in g, h, U, V."""
    to, can = T.gate_directions(p, gradients(p["vec"], K, M)[0])
    can &= ~p["stop"].astype(bool)
    some, to = R.taken(p, can), R.taken(to, can)
    return [_candidate(p, 0)] + [_candidate(T.moved_gates(some, to, lr * 0.5**c, lg, lh, le), c + 1) for c in range(T.HALVINGS) if can.any()]


def block_candidates(p: dict, K: int, M: int, block: str, step: float, ridge: float, diagonal: bool) -> list[dict]:
    """Current rows and the halvings of a projected step in A0, rho0 or rho1."""
    slope, can = T.block_direction(p, block, dict(zip(("a1", "a0", "rho0", "rho1"), gradients(p["vec"], K, M), strict=True))[block], ridge, diagonal)
    some, slope = R.taken(p, can), slope[can]
    moved = [T.moved_block(some, block, slope, step * 0.5**c) for c in range(T.HALVINGS) if can.any()]
    return [_candidate(p, 0, T.ridge_of(p, ridge))] + [_candidate(q, c, T.ridge_of(q, ridge)) for c, q in enumerate(moved, 1)]


def decay_offset_candidates(p: dict, s: Settings) -> list[dict]:
    """Current rows, and those that forward differences in both decays compare with them."""
    return [_candidate(p, 0)] + [_candidate({**p, "beta0": a, "beta1": b}, c) for c, (a, b) in enumerate(T.decay_offsets(p, s), 1)]


def decay_candidates(p: dict, s: Settings) -> list[dict]:
    """Where the decays stay (projected), and the halvings of a step along ``d0``, ``d1``; infeasible current rows never win."""
    here = _candidate(p, 0)
    slopes = [p["d0"].astype(float), p["d1"].astype(float)]
    can = np.isfinite(slopes[0]) & np.isfinite(slopes[1]) & (np.hypot(*slopes) > 0)
    some, slopes = R.taken(p, can), [x[can] for x in slopes]
    still = _candidate(T.moved_decays(p, [0.0, 0.0], 0.0, s), T.HALVINGS + 1)
    return [here, still] + [_candidate(T.moved_decays(some, slopes, T.DECAY_STEP * 0.5**c, s), c + 1) for c in range(T.HALVINGS) if can.any()]


# --- start values -----------------------------------------------------------------------


def init_params(events: DataFrame, k: int, m: int, horizon: float, d: int = 2, seed: int = 0, dt: float = 24.0, adaptive: bool = False,
                dense: bool = False, day_scale: bool = False) -> DataFrame:
    """Start row per fit from rates, mark transitions and gap quantiles, plus seeded noise."""
    keys = ["fit_id"]
    fits = events.groupBy("fit_id").agg(F.count(F.lit(1)).alias("__n"))
    rho = P.mark_transitions(events, keys, m, dt).groupBy("fit_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("src_mark", "dst_mark", "p"))), lambda s: s["p"]).alias("rho0"))
    beta = P.decay_rate_init(events, keys, dt, day_scale)
    if adaptive:
        nu = P.rate_matrix(events, keys, k, m, horizon).groupBy("fit_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("actor", "mark", "nu"))), lambda s: s["nu"]).alias("nu"))
        base = fits.join(nu, "fit_id")
    else:
        rate = F.greatest(F.col("__n") / F.lit(float(k * m * horizon)), F.lit(1e-3))
        base = fits.withColumn("nu", F.array_repeat(rate, k * m))

    def draws(label: str, n: int):
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: S.uniform_draw(seed, label, F.col("fit_id"), i))

    def normals(label: str, n: int):
        a, b = draws(label + "a", n), draws(label + "b", n)
        return F.zip_with(a, b, lambda x, y: F.lit(0.01) * F.sqrt(-2.0 * F.log(F.greatest(x, F.lit(1e-12)))) * F.cos(F.lit(2 * np.pi) * y))

    dim = k if dense else d
    eye = F.array(*[F.lit(1.0 if i // k == i % k else 0.0) for i in range(k * k)])
    a0 = F.transform(draws("a0", k * k), lambda x, i: F.when((i / k).cast("int") == i % k, F.lit(0.0)).otherwise(x * 0.02))
    full = base.join(rho, "fit_id").join(beta, "fit_id").select(
        "fit_id", F.lit(0).alias("cand"), "nu", a0.alias("a0"), F.array_repeat(F.lit(0.1), k).alias("g"), F.array_repeat(F.lit(0.1), k).alias("h"),
        (eye if dense else normals("u", k * dim)).alias("u"), normals("v", k * dim).alias("v"), "rho0", F.col("rho0").alias("rho1"),
        F.array_repeat(F.lit(0.0), k * k).alias("a1"), "beta0", "beta1", F.lit(0.03).alias("eta_on"), F.lit(0.3).alias("eta_off"))
    return R.update(full, k, m, lambda p: [R.with_coupling(p)])


# --- M-step -----------------------------------------------------------------------------

#: Fixed value: how far a gate step may lower the objective.
GATE_TOL = 1e-8
WORK = "vec array<double>, pen double, stop boolean"
AIMED = WORK + ", d0 double, d1 double"


def _score(lay: Layout, cands: DataFrame, weights: DataFrame, gradient: bool = True) -> DataFrame:
    cands = cut_lineage(cands)
    fresh = L.score_and_gradient(lay, cands.filter("vec IS NULL"), weights, gradient).withColumnRenamed("vec", "__vec")
    return cands.join(fresh, ["fit_id", "cand"], "left").withColumn("vec", F.coalesce("vec", "__vec")).drop("__vec")


def _choose(scored: DataFrame, tol: float, still: int = -1) -> DataFrame:
    """Keep one candidate per fit: the first acceptable halving, else the current row or its projection ``still``."""
    per = Window.partitionBy("fit_id")
    q = F.col("vec")[0] - F.col("pen")
    usable = ~F.isnan("__q") & F.col("__q").isNotNull()
    rows = scored.withColumn("__q", q).withColumn("__base", F.max(F.when(F.col("cand") == 0, F.col("__q"))).over(per))
    good = (F.col("cand") > 0) & usable & (F.col("__q") >= F.col("__base") - tol)
    # ``still`` is taken where no halving is good enough
    order = F.when(F.col("cand") == still, 999_999).when(good, F.col("cand")).when(F.col("cand") == 0, 1_000_000)
    rows = rows.filter(good | (F.col("cand") == 0) | (F.col("cand") == still))
    best = rows.withColumn("__r", F.row_number().over(per.orderBy(F.asc(order.cast("int"))))).filter("__r = 1")
    return best.withColumn("stop", F.col("stop") | (F.col("cand") == 0)).withColumn("cand", F.lit(0)).drop("__q", "__base", "__r")


def refresh_baseline(lay: Layout, cur: DataFrame, weights: DataFrame) -> DataFrame:
    """``nu`` = expected background events over the window length."""
    sums = L.baseline_sums(lay, cur, weights).select("fit_id", F.col("vec").alias("__nu"))
    rate = F.transform("__nu", lambda x: F.greatest(x / F.lit(lay.horizon), F.lit(1e-9)))
    return cur.join(sums, "fit_id", "left").withColumn("nu", F.coalesce(rate, F.transform("nu", lambda x: F.lit(1e-9)))).drop("__nu")


def decay_step(lay: Layout, cur: DataFrame, weights: DataFrame, s: Settings) -> DataFrame:
    """One step of projected ascent in both decays: a pass for the slopes, a pass for the halvings."""
    K, M = lay.K, lay.M
    near = cut_lineage(R.update(cur, K, M, lambda p: decay_offset_candidates(p, s), WORK))
    far = L.score_and_gradient(lay, near.filter("cand > 0"), weights, gradient=False).groupBy("fit_id").agg(
        F.max(F.when(F.col("cand") == 1, F.col("vec")[0])).alias("q0"), F.max(F.when(F.col("cand") == 2, F.col("vec")[0])).alias("q1"))

    def aimed(p):
        here = np.array([v[0] for v in p["vec"]], float)
        slopes, can = T.decay_slopes(p, here, [p["q0"].astype(float), p["q1"].astype(float)])
        return [{**p, "d0": np.where(can, slopes[0], np.nan), "d1": np.where(can, slopes[1], np.nan)}]

    ready = R.update(cur.join(far, "fit_id"), K, M, aimed, AIMED)
    cands = R.update(ready, K, M, lambda p: decay_candidates(p, s), WORK)
    return _choose(_score(lay, cands, weights, gradient=False), 0.0, still=T.HALVINGS + 1)


def mstep(lay: Layout, params: DataFrame, weights: DataFrame, xi: DataFrame | None, s: Settings, anneal: float = 1.0, static: bool = False) -> DataFrame:
    """Switch rates, baseline, gates, nuisance blocks, decays, baseline again, in that order."""
    whole, spanning = parted(lay)
    out = local.mstep_whole(whole, params, weights, xi, s, anneal, static)
    if spanning is None:
        return out
    return out.unionByName(mstep_spanning(spanning, params.join(spanning.fits.select("fit_id").distinct(), "fit_id", "left_semi"), weights, xi, s, anneal, static))


def mstep_spanning(lay: Layout, params: DataFrame, weights: DataFrame, xi: DataFrame | None, s: Settings, anneal: float = 1.0, static: bool = False) -> DataFrame:
    """The same by passes over the chunked events."""
    K, M = lay.K, lay.M
    delta = lay.horizon / lay.B
    weights = cut_lineage(place_weights(lay, weights))
    cur = params.select(*_columns(R.PARAM_SCHEMA))
    if xi is not None:
        sums = xi.select("fit_id", "x00", "x01", "x10", "x11", "occ0", "occ1")

        def rates(p):
            x = np.nan_to_num(np.stack([p[c].astype(float) for c in ("x00", "x01", "x10", "x11")], axis=1))
            on, off = switch_rates(x, p["occ0"] * delta, p["occ1"] * delta, p["eta_on"], p["eta_off"], delta, s)
            return [{**p, "eta_on": on, "eta_off": off}]

        cur = R.update(cur.join(sums, "fit_id"), K, M, rates)
    cur = cut_lineage(refresh_baseline(lay, cur, weights))
    vec = L.score_and_gradient(lay, cur, weights).select("fit_id", "vec")
    cur = cur.join(vec, "fit_id").withColumn("pen", F.lit(0.0)).withColumn("stop", F.lit(False))
    lg, lh = s.lambda_g * anneal, s.lambda_h * anneal
    le = 0.0 if s.variant == "dense_active_block" else s.lambda_e
    for _ in range(s.n_inner_steps):
        cands = R.update(cur, K, M, lambda p: gate_candidates(p, K, M, lg, lh, le, s.lr), WORK)
        cur = _choose(_score(lay, cands, weights), GATE_TOL)
    cur = cur.withColumn("stop", F.lit(False))
    blocks = [] if s.freeze_nuisance else (["a0"] if static else ["a0", "rho0", "rho1"])
    for block in blocks:
        cands = R.update(cur, K, M, lambda p, block=block: block_candidates(p, K, M, block, 0.25 * s.lr, s.lambda_0, s.diagonal_a0), WORK)
        cur = _choose(_score(lay, cands, weights), 0.0)
    for _ in range(0 if static else s.n_decay_steps):
        cur = decay_step(lay, cur, weights, s)
    return refresh_baseline(lay, cur, weights).select(*_columns(R.PARAM_SCHEMA))


_columns = R.names_of


def blend(old: DataFrame, new: DataFrame, it: int, K: int, M: int, s: Settings, static: bool = False) -> DataFrame:
    """Momentum, constraints of the variant and the stability projection; ``sound`` is false where a fit did not stay finite."""
    joined = new.join(old.select("fit_id", *[F.col(c).alias(f"old_{c}") for c in R.PARAMS]), "fit_id")

    def mix(p):
        p, radius, good = T.blended({k: p[f"old_{k}"] for k in R.PARAMS}, p, it, s, static)
        return [{**p, "radius": radius, "sound": good}]

    return R.update(joined, K, M, mix, "radius double, sound boolean")


# --- EM loop ----------------------------------------------------------------------------


@dataclass
class Fit:
    """Results of all fits: parameters, posterior per interval, iteration trace."""

    params: DataFrame
    posterior: DataFrame | None
    trace: DataFrame
    layout: Layout
    settings: Settings = field(default_factory=Settings)


def _weights(post: DataFrame, floor: float, present: bool = False) -> DataFrame:
    w = F.lit(1.0) if present else F.greatest(F.least(F.col("g1"), F.lit(1.0 - floor)), F.lit(floor))
    return post.select("fit_id", "b", w.alias("w"), "g1")


def start_weights(lay: Layout, params: DataFrame, value) -> DataFrame:
    g = value if not isinstance(value, float) else F.lit(value)
    return params.select("fit_id", g.alias("__g"), F.explode(F.sequence(F.lit(0), F.lit(lay.B - 1))).alias("b")).select(
        "fit_id", "b", F.col("__g").alias("w"), F.col("__g").alias("g1"))


def _diagonal_mean(c: str):
    m = F.sqrt(F.size(c)).cast("int")
    on = F.filter(F.transform(c, lambda x, i: F.when(i % (m + 1) == 0, x)), lambda x: x.isNotNull())
    return F.aggregate(on, F.lit(0.0), lambda a, x: a + x) / m


def _trace(params: DataFrame, stats: DataFrame, it: int) -> DataFrame:
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    return params.join(stats, "fit_id").select(
        "fit_id", F.lit(it).alias("iteration"), "loglik", "active_frac", F.size(F.filter("g", lambda x: x > 0.01)).alias("nonzero_gates"), "radius",
        "beta0", "beta1", "eta_on", "eta_off", mean("a0").alias("a0_mean"), F.array_max("a0").alias("a0_max"),
        *[_diagonal_mean(c).alias(f"{c}_diag_mean") for c in ("rho0", "rho1")])


def _finish(running: DataFrame, prev: DataFrame | None, stats: DataFrame, tol: float) -> DataFrame:
    """Flag fits whose log-likelihood moved by less than the tolerance, and those that did not stay finite."""
    now = stats.select("fit_id", F.col("loglik").alias("__ll"))
    out = running.join(now, "fit_id")
    moved = F.lit(False)
    if prev is not None:
        out = out.join(prev, "fit_id")
        moved = F.abs(F.col("__ll") - F.col("__prev")) / (F.abs(F.col("__prev")) + 1e-8) < tol
    lost = F.isnan("__ll") | (F.abs("__ll") == float("inf")) | F.col("__ll").isNull()
    failed = F.when(lost, local.LOST).when(~F.col("sound"), local.WILD)
    out = out.withColumn("failed", failed).withColumn("__done", moved | F.col("failed").isNotNull())
    return out.drop("__prev") if prev is not None else out


def fit_all(lay: Layout, several: list[local.Run]) -> list[Fit]:
    """EM over all fits of a layout, for several settings or clamps at once; small fits inside their chunks' tasks, all runs side by side, those
    that span chunks by passes over the events.

    A fit that does not stay finite keeps its last finite parameters, ``Fit.params.failed`` says why, and the others go on.
    """
    for r in several:
        if r.settings.variant not in VARIANTS:
            raise ValueError(f"unknown variant: {r.settings.variant}")
    started = [replace(r, init=R.update(r.init, lay.K, lay.M, lambda p, v=r.settings.variant: [T.enforce(p, v)])) if not r.static else r for r in several]
    whole, spanning = parted(lay)
    fitted = local.fit_whole(whole, started, floors)
    out = [_held(fitted.where(F.col("run") == i).drop("run"), lay, r) for i, r in enumerate(started)]
    if spanning is None:
        return out
    ids = spanning.fits.select("fit_id").distinct()
    large = []
    for r in started:
        init = r.init.join(ids, "fit_id", "left_semi")
        held = None if r.clamp is None else r.clamp.join(ids, "fit_id", "left_semi")
        large.append(_static_spanning(spanning, init, r.settings) if r.static else _fit_spanning(spanning, init, r.settings, held, r.xi))
    return [_joined(a, b, r.clamp) for a, b, r in zip(out, large, started, strict=True)]


def fit_regime_model(lay: Layout, init: DataFrame, s: Settings = Settings(), clamp: DataFrame | None = None, xi: DataFrame | None = None) -> Fit:
    """EM over all fits, see ``fit_all``. ``clamp`` holds a fixed posterior (``fit_id, b, g1``) and ``xi`` expected transitions: then only M-steps run."""
    return fit_all(lay, [local.Run(init, s, clamp, xi)])[0]


def fit_static_gates(lay: Layout, init: DataFrame, s: Settings) -> Fit:
    """The same model with the state fixed at one; routes and decays keep their start values."""
    return fit_all(lay, [local.Run(init, s, static=True)])[0]


def _held(fitted: DataFrame, lay: Layout, r: local.Run) -> Fit:
    post = None if r.static else local.posterior_of(fitted) if r.clamp is None else r.clamp
    return Fit(fitted.select(*_columns(R.PARAM_SCHEMA), "iterations", "failed"), post, local.traces_of(fitted), lay, r.settings)


def _joined(a: Fit, b: Fit, clamp: DataFrame | None = None) -> Fit:
    post = a.posterior if clamp is not None or a.posterior is None else a.posterior.unionByName(b.posterior)
    return Fit(a.params.unionByName(b.params), post, a.trace.unionByName(b.trace), a.layout, a.settings)


def _fit_spanning(lay: Layout, init: DataFrame, s: Settings, clamp: DataFrame | None, xi: DataFrame | None) -> Fit:
    """The same by passes over the chunked events. Fits that converge or fail leave the loop, so late iterations touch only what is still moving."""
    K, M, present = lay.K, lay.M, s.variant == "present_time_gating"
    running = cut_lineage(init)
    weights = start_weights(lay, running, float(np.clip(s.pi1_init, 1e-4, 1 - 1e-4)))
    done: list[DataFrame] = []
    traces: list[DataFrame] = []
    posts: list[DataFrame] = []
    prev = None
    for it in range(1, s.max_iters + 1):
        share, floor = floors(it)
        if clamp is None:
            on, off = floored_rates(F.col("eta_on"), F.col("eta_off"), share)
            eff = running.withColumn("eta_on", on).withColumn("eta_off", off)
            post = cut_lineage(SM.estep(lay, eff, weights.withColumn("w", F.lit(1.0)) if present else weights, present))
            stats = SM.xi_sums(post).withColumn("active_frac", F.col("occ1") / F.col("intervals"))
        else:
            post = clamp
            occ = clamp.groupBy("fit_id").agg(F.sum(1 - F.col("g1")).alias("occ0"), F.sum("g1").alias("occ1"), F.avg("g1").alias("active_frac"))
            stats = xi.select("fit_id", "x00", "x01", "x10", "x11").join(occ, "fit_id").withColumn("loglik", F.lit(float(it)))
        new = mstep_spanning(lay, running, _weights(post, 0.0, present), stats, s, min(1.0, it / 10.0))
        mixed = cut_lineage(_finish(blend(running, new, it, K, M, s), prev, stats, s.tol if clamp is None else -1.0))
        traces.append(_trace(mixed, stats.select("fit_id", "loglik", "active_frac"), it))
        last = it == s.max_iters
        out = mixed if last else mixed.filter("__done")
        done.append(out.select(*_columns(R.PARAM_SCHEMA), F.lit(it).alias("iterations"), "failed"))
        posts.append(post.join(out.select("fit_id"), "fit_id", "left_semi").select("fit_id", "b", "g1").withColumn("floor", F.lit(floor)).withColumn("share", F.lit(share)))
        if last or mixed.filter("NOT __done").isEmpty():
            break
        running = mixed.filter("NOT __done").select(*_columns(R.PARAM_SCHEMA))
        prev = mixed.select("fit_id", F.col("__ll").alias("__prev"))
        weights = _weights(post, floor)
    params = cut_lineage(_union(done))
    trace = cut_lineage(_union(traces))
    if clamp is not None:
        return Fit(params, clamp, trace, lay, s)
    # one more E-step, so the posterior belongs to the returned parameters
    last_post = _union(posts)
    share = last_post.groupBy("fit_id").agg(F.first("share").alias("share"))
    on = F.greatest(F.col("eta_on"), F.col("share") / (1 - F.col("share")) * F.greatest("eta_off", F.lit(1e-12)))
    eff = params.join(share, "fit_id").withColumn("eta_on", on)
    w = F.greatest(F.least(F.col("g1"), 1 - F.col("floor")), F.col("floor"))
    final = last_post.select("fit_id", "b", (F.lit(1.0) if present else w).alias("w"), "g1")
    smooth = cut_lineage(SM.estep(lay, eff, final, present))
    return Fit(params, smooth.where(~F.isnan("loglik") & (F.abs("loglik") < float("inf"))), trace, lay, s)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _static_spanning(lay: Layout, init: DataFrame, s: Settings) -> Fit:
    K, M = lay.K, lay.M
    running = cut_lineage(init)
    ones = start_weights(lay, running, 1.0)
    traces, done, prev = [], [], None
    for it in range(1, s.max_iters + 1):
        em = SM.interval_emissions(lay, running, ones)
        stats = cut_lineage(em.groupBy("fit_id").agg(F.sum("ell1").alias("loglik")).withColumn("active_frac", F.lit(1.0)))
        new = mstep_spanning(lay, running, ones, None, s, min(1.0, it / 10.0), static=True)
        mixed = cut_lineage(_finish(blend(running, new, it, K, M, s, static=True), prev, stats, s.tol))
        traces.append(_trace(mixed, stats, it))
        last = it == s.max_iters
        out = mixed if last else mixed.filter("__done")
        done.append(out.select(*_columns(R.PARAM_SCHEMA), F.lit(it).alias("iterations"), "failed"))
        if last or mixed.filter("NOT __done").isEmpty():
            break
        running = mixed.filter("NOT __done").select(*_columns(R.PARAM_SCHEMA))
        prev = mixed.select("fit_id", F.col("__ll").alias("__prev"))
    return Fit(cut_lineage(_union(done)), None, cut_lineage(_union(traces)), lay, s)


# --- estimator --------------------------------------------------------------------------


class TwoRegimeEstimator(Estimator):
    """Fits every ``fit_id`` of an event table ``(fit_id, event_id, t, actor, mark)``."""

    @keyword_only
    def __init__(self, *, k: int, m: int, horizon: float, dt: float = 2.0, d: int = 2, seed: int = 0, settings: Settings = REPLICATION, chunk_rows: int | None = None):
        super().__init__()
        self.k, self.m, self.horizon, self.dt, self.d, self.seed = k, m, horizon, dt, d, seed
        self.settings, self.chunk_rows = settings, chunk_rows

    def _fit(self, dataset: DataFrame) -> TwoRegimeModel:
        lay = layout(dataset, self.k, self.m, self.dt, self.horizon, self.chunk_rows)
        dense = self.settings.variant == "dense_active_block"
        init = init_params(lay.events, self.k, self.m, self.horizon, self.d, self.seed, max(self.dt, self.horizon / 64), dense=dense)
        fit = fit_regime_model(lay, init, self.settings)
        return TwoRegimeModel(fit, self)


class TwoRegimeModel(Model):
    def __init__(self, fit: Fit, parent: TwoRegimeEstimator):
        super().__init__()
        self.params_table, self.posterior, self.trace, self.parent_ = fit.params, fit.posterior, fit.trace, parent
        self._layout = fit.layout

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Smoothed posterior of new events under the fitted parameters, history reset."""
        e = self.parent_
        lay = layout(dataset, e.k, e.m, e.dt, e.horizon, e.chunk_rows)
        share = F.col("eta_on") / (F.col("eta_on") + F.col("eta_off"))
        return SM.estep(lay, self.params_table, start_weights(lay, self.params_table, F.greatest(F.least(share, F.lit(1 - 1e-4)), F.lit(1e-4))))

    def edges(self) -> DataFrame:
        return R.edges(self.params_table, self.parent_.k)


def with_settings(s: Settings, **changes) -> Settings:
    return replace(s, **changes)
