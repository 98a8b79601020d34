"""Held-out scoring: fit on the early part, score the late part with history reset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.functions import scalar as S
from flockwise.operators import likelihood as L
from flockwise.operators import ordered
from flockwise.operators import smoothing as SM
from flockwise.operators.events import split_by_time
from flockwise.operators.history import layout
from flockwise.operators.intervals import interval_counts, interval_grid, interval_index
from flockwise.plans import em as EM


def _sides(events: DataFrame, k: int, m: int, dt: float, horizon: float, fraction: float, chunk_rows: int | None):
    cut = horizon * (1.0 - fraction)
    both = split_by_time(events, ["fit_id"], horizon, fraction)
    train = layout(both.filter("split = 'train'"), k, m, dt, cut, chunk_rows)
    test = layout(both.filter("split = 'test'"), k, m, dt, horizon - cut, chunk_rows)
    return train, test


def heldout_regime(events: DataFrame, k: int, m: int, dt: float, horizon: float, fraction: float, settings: EM.Settings, d: int = 2, seed: int = 0,
                   chunk_rows: int | None = None) -> DataFrame:
    """Negative log-likelihood per late event under the regime model fitted early."""
    train, test = _sides(events, k, m, dt, horizon, fraction, chunk_rows)
    init = EM.init_params(train.events, k, m, train.horizon, d, seed, train.horizon / 32, adaptive=True)
    fit = EM.fit_regime_model(train, init, settings)
    share = F.col("eta_on") / (F.col("eta_on") + F.col("eta_off"))
    prior = EM.start_weights(test, fit.params, F.greatest(F.least(share, F.lit(1 - 1e-4)), F.lit(1e-4)))
    post = SM.estep(test, fit.params, prior)
    ll = post.groupBy("fit_id").agg(F.first("loglik").alias("heldout_loglik"), F.avg("g1").alias("active_mean"))
    n = test.events.groupBy("fit_id").agg(F.count(F.lit(1)).alias("test_events"))
    return ll.join(n, "fit_id").withColumn("nll_per_event", -F.col("heldout_loglik") / F.col("test_events"))


def _static_score(test, params: DataFrame) -> DataFrame:
    ll = L.static_loglik(test, params)
    return ll.select("fit_id", F.col("loglik").alias("heldout_loglik"), F.col("n").alias("test_events"), (-F.col("loglik") / F.col("n")).alias("nll_per_event"))


def heldout_static_gates(events: DataFrame, k: int, m: int, dt: float, horizon: float, fraction: float, settings: EM.Settings, d: int = 2, seed: int = 0,
                         chunk_rows: int | None = None) -> DataFrame:
    """Late log-likelihood of the one-state model: joint coupling, averaged routes and decays."""
    train, test = _sides(events, k, m, dt, horizon, fraction, chunk_rows)
    init = EM.init_params(train.events, k, m, train.horizon, d, seed, train.horizon / 32, adaptive=True)
    p = EM.fit_static_gates(train, init, settings).params
    half = lambda a, b: F.zip_with(a, b, lambda x, y: 0.5 * (x + y))
    merged = p.withColumn("a0", F.zip_with("a0", "a1", lambda x, y: x + y)).withColumn("rho0", half("rho0", "rho1")).withColumn(
        "beta0", 0.5 * (F.col("beta0") + F.col("beta1")))
    return _static_score(test, merged)


def heldout_full_matrix(events: DataFrame, k: int, m: int, dt: float, horizon: float, fraction: float, iters: int, chunk_rows: int | None = None) -> DataFrame:
    from flockwise.plans.baselines import fit_full_matrix

    train, test = _sides(events, k, m, dt, horizon, fraction, chunk_rows)
    return _static_score(test, fit_full_matrix(train, iters=iters))


def heldout_count_hmm(sides: DataFrame, train_horizon: float, test_horizon: float, dt: float) -> DataFrame:
    """Two-rate count model from thresholded early counts, scored on late counts.

    ``sides`` has ``fit_id, t, split`` with the late side re-zeroed. ``rate_share`` is the
    upper rate over the sum of rates, not a share of active time. Grids shorter than four
    intervals use one Poisson rate.
    """
    keys = ["fit_id"]

    def counts(side: str, horizon: float) -> DataFrame:
        ev = sides.filter(F.col("split") == side).withColumn("b", interval_index(F.col("t"), dt, F.lit(float(horizon)), "hist"))
        grid = interval_grid(sides.select(*keys).distinct().withColumn("T", F.lit(float(horizon))), dt).select(*keys, "b")
        return interval_counts(ev.filter("b IS NOT NULL"), grid, keys)

    train, test = counts("train", train_horizon), counts("test", test_horizon)
    cut = ordered.percentiles(train, keys, "n", {"__q": 0.75})
    z = train.join(cut, keys).withColumn("z", (F.col("n") >= F.col("__q")).cast("int"))
    z = ordered.lag(z, keys, [F.asc("b")], F.floor(F.col("b") / 4096).cast("long"), ["z"])
    avg = lambda v: F.avg(F.when(F.col("z") == v, F.col("n")))
    step = lambda a, b: F.count_if((F.col("prev_z") == a) & (F.col("z") == b)) + 1.0
    fit = z.groupBy(*keys).agg(
        F.avg("n").alias("mean"), avg(0).alias("lo"), avg(1).alias("hi"), F.count(F.lit(1)).alias("bins"), step(0, 0).alias("n00"), step(0, 1).alias("n01"),
        step(1, 0).alias("n10"), step(1, 1).alias("n11"), F.greatest(F.avg(1 - F.col("z")), F.lit(1e-6)).alias("a"), F.greatest(F.avg("z"), F.lit(1e-6)).alias("c"))
    one = F.col("bins") < 4
    lam0 = F.when(one, F.col("mean")).otherwise(F.greatest(F.coalesce("lo", "mean"), F.lit(1e-6)))
    fit = fit.withColumn("lambda0", lam0).withColumn("lambda1", F.when(one, F.col("mean")).otherwise(F.greatest(F.coalesce("hi", "mean"), F.col("lambda0") + 1e-6)))
    fit = fit.select(
        *keys, F.lit(0).alias("cand"), "lambda0", "lambda1", F.when(one, 0.95).otherwise(F.col("n00") / (F.col("n00") + F.col("n01"))).alias("p00"),
        F.when(one, 0.95).otherwise(F.col("n11") / (F.col("n10") + F.col("n11"))).alias("p11"), (F.col("a") / (F.col("a") + F.col("c"))).alias("pi0"), (F.col("c") / (F.col("a") + F.col("c"))).alias("pi1"))
    facts = S.log_factorials(test.withColumnRenamed("n", "k"))
    em = test.withColumnRenamed("n", "k").join(facts, "k").join(fit.select(*keys, "lambda0", "lambda1"), keys).select(
        *keys, F.lit(0).alias("cand"), "b", S.poisson_logpmf("k", "lambda0", "log_factorial", 1e-9).alias("ell0"), S.poisson_logpmf("k", "lambda1", "log_factorial", 1e-9).alias("ell1"))
    chain = fit.withColumn("p01", 1.0 - F.col("p00")).withColumn("p10", 1.0 - F.col("p11"))
    n = int(-(-test_horizon // dt))
    series = sides.select(*keys).distinct().count()
    post = SM.forward_backward(em, chain.select(*keys, "cand", "p00", "p01", "p10", "p11", "pi0", "pi1"), n, series)
    ll = post.groupBy(*keys).agg(F.first("loglik").alias("heldout_loglik"))
    return ll.join(fit, keys).select(*keys, "heldout_loglik", "lambda0", "lambda1", "p00", "p11", (F.col("lambda1") / (F.col("lambda0") + F.col("lambda1"))).alias("rate_share"))
