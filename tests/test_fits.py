"""EM on a small supplied table: likelihood climbs, invariants hold, chunking does not matter."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flockwise.operators.batched import Events
from flockwise.operators.history import layout
from flockwise.plans import em as EM
from flockwise.plans.local import Whole
from flockwise.plans.rows import coupling


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for f in (1, 2):
        t = np.sort(rng.uniform(0, 60, 90))
        rows.append(pd.DataFrame({"fit_id": f, "event_id": np.arange(90) + 100 * f, "t": t, "actor": rng.integers(0, 3, 90), "mark": rng.integers(0, 2, 90)}))
    return spark.createDataFrame(pd.concat(rows))


def run(table, rows):
    lay = layout(table, 3, 2, 6.0, 60.0, chunk_rows=rows)
    init = EM.init_params(lay.events, 3, 2, 60.0, dt=6.0)
    return EM.fit_regime_model(lay, init, EM.with_settings(EM.REPLICATION, max_iters=2, n_inner_steps=1, n_decay_steps=1))


def test_em_climbs_and_ignores_chunking(table):
    a, b = run(table, 1000), run(table, 16)
    x, y = (f.trace.orderBy("fit_id", "iteration").toPandas() for f in (a, b))
    np.testing.assert_allclose(x.loglik, y.loglik, rtol=1e-9)
    for _, g in x.groupby("fit_id"):
        assert np.all(np.diff(g.loglik) > -1e-6)
    post = a.posterior.toPandas()
    np.testing.assert_allclose(post.g0 + post.g1, 1.0, atol=1e-12)
    p = a.params.toPandas().iloc[0]
    assert p.beta1 >= 2 * p.beta0 * 0.9 and min(p.g) >= 0
    np.testing.assert_allclose(np.sum(np.reshape(p.rho0, (2, 2)), axis=1), 1.0)


def test_switch_rates_beat_their_neighbours():
    x = np.array([40.0, 3.0, 2.0, 15.0])
    on, off = (v[0] for v in EM.switch_rates(x, 43.0, 17.0, 0.05, 0.2, 1.0, EM.Settings()))

    def q(a, b):
        s, e = a + b, np.exp(-(a + b))
        p00, p11 = (b + a * e) / s, (a + b * e) / s
        return float(np.sum(x * np.log([p00, 1 - p00, 1 - p11, p11])))

    assert all(q(on, off) >= q(on * u, off * v) - 1e-6 for u in (0.9, 1.0, 1.1) for v in (0.9, 1.0, 1.1))


def test_coupling_has_zero_diagonal():
    a, _, _ = coupling(np.ones(3), np.ones(3), np.zeros((3, 2)), np.zeros((3, 2)))
    assert np.all(np.diag(a) == 0) and a[0, 1] == pytest.approx(np.log(2))


def test_decays_keep_their_ratio():
    b0, b1 = EM.decay_projection(2.0, 2.5, EM.Settings())
    assert b1 == pytest.approx(2 * b0) and b0 * b1 == pytest.approx(5.0)


def test_registry_is_complete():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_estimator_fits_and_scores(table):
    est = EM.TwoRegimeEstimator(k=3, m=2, horizon=60.0, dt=6.0, settings=EM.with_settings(EM.REPLICATION, max_iters=1, n_inner_steps=1))
    model = est.fit(table)
    assert model.params_table.count() == 2
    assert model.transform(table).filter(F.abs(F.col("g0") + F.col("g1") - 1) > 1e-9).count() == 0


@pytest.fixture(scope="module")
def uneven(spark):
    """Two small fits and one of more rows than a chunk holds."""
    rng = np.random.default_rng(8)
    rows = []
    for f, n in ((1, 20), (2, 60), (3, 25)):
        t = np.sort(rng.uniform(0, 60, n))
        rows.append(pd.DataFrame({"fit_id": f, "event_id": np.arange(n) + 100 * f, "t": t, "actor": rng.integers(0, 3, n), "mark": rng.integers(0, 2, n)}))
    return spark.createDataFrame(pd.concat(rows))


def test_small_and_spanning_fits_of_one_layout_equal_those_of_whole_chunks(uneven):
    from flockwise.plans import baselines as B

    fits, dense = [], []
    for rows in (1000, 40):
        lay = layout(uneven, 3, 2, 6.0, 60.0, chunk_rows=rows)
        assert lay.spans == (rows == 40)
        init = EM.init_params(lay.events, 3, 2, 60.0, dt=6.0)
        fits.append(EM.fit_regime_model(lay, init, EM.with_settings(EM.REPLICATION, max_iters=1, n_inner_steps=2, n_decay_steps=2)))
        dense.append(B.fit_full_matrix(lay, iters=2, every=2, grid=3).orderBy("fit_id").toPandas())
    a, b = (f.params.orderBy("fit_id").toPandas() for f in fits)
    assert list(a.fit_id) == [1, 2, 3] and a.failed.isna().all() and b.failed.isna().all()
    for name in ("nu", "a0", "a1", "g", "h", "rho0", "rho1", "beta0", "beta1", "eta_on", "eta_off"):
        for x, y in ((a[name], b[name]), (dense[0][name], dense[1][name])):
            np.testing.assert_allclose(np.stack(x.map(np.atleast_1d)), np.stack(y.map(np.atleast_1d)), rtol=1e-9, atol=1e-12)
    x, y = (f.posterior.orderBy("fit_id", "b").toPandas() for f in fits)
    np.testing.assert_allclose(x.g1, y.g1, atol=1e-9)
    x, y = (f.trace.orderBy("fit_id", "iteration").toPandas() for f in fits)
    np.testing.assert_allclose(x.drop(columns="fit_id"), y[x.columns].drop(columns="fit_id"), rtol=1e-8, atol=1e-12)


@pytest.mark.parametrize("rows", [1000, 40])
def test_a_broken_fit_is_a_row_and_the_others_go_on(uneven, rows):
    lay = layout(uneven, 3, 2, 6.0, 60.0, chunk_rows=rows)
    init = EM.init_params(lay.events, 3, 2, 60.0, dt=6.0)
    broken = 1 if rows == 1000 else 2
    init = init.withColumn("beta0", F.when(F.col("fit_id") == broken, float("nan")).otherwise(F.col("beta0")))
    fit = EM.fit_regime_model(lay, init, EM.with_settings(EM.REPLICATION, max_iters=1, n_inner_steps=1, n_decay_steps=1))
    got = {r.fit_id: r for r in fit.params.collect()}
    assert set(got) == {1, 2, 3} and got[broken].failed and not any(got[f].failed for f in got if f != broken)
    assert {r.fit_id for r in fit.posterior.select("fit_id").distinct().collect()} == {1, 2, 3} - {broken}


def test_runs_side_by_side_equal_runs_alone(uneven):
    lay = layout(uneven, 3, 2, 6.0, 60.0)
    init = EM.init_params(lay.events, 3, 2, 60.0, dt=6.0)
    settings = [EM.with_settings(EM.REPLICATION, max_iters=2, n_inner_steps=1, variant=v) for v in ("full_model", "present_time_gating")]
    together = EM.fit_all(lay, [EM.local.Run(init, s) for s in settings])
    for fit, s in zip(together, settings, strict=True):
        x, y = (f.trace.orderBy("fit_id", "iteration").toPandas() for f in (fit, EM.fit_regime_model(lay, init, s)))
        pd.testing.assert_frame_equal(x, y)


def test_switch_rates_without_priors_are_the_shares_of_moves():
    x = np.array([[40.0, 3.0, 2.0, 15.0], [0, 0, 0, 0], [1.0, 9.0, 9.0, 1.0], [5.0, 0.0, 0.0, 0.0]])
    on, off = EM.switch_rates(x, 1.0, 1.0, 0.05, 0.2, 2.0, EM.Settings())
    rate, share = -np.log(1 - 3 / 43 - 2 / 17) / 2.0, (3 / 43) / (3 / 43 + 2 / 17)
    assert on[0] == pytest.approx(rate * share) and off[0] == pytest.approx(rate * (1 - share))
    assert (on[1], off[1]) == (0.05, 0.2) and on[2] == off[2] == 5.0 and on[3] == off[3] == 1e-4


def test_priors_pull_switch_rates():
    x, occ = np.array([40.0, 3.0, 2.0, 15.0]), (43.0, 17.0)
    rates = lambda **kw: [v[0] for v in EM.switch_rates(x, *occ, 0.05, 0.2, 1.0, EM.Settings(**kw))]
    free, held = rates(), rates(eta_prior_s=1e6, eta_prior_pi=1e6, eta_pi1_target=0.4)
    assert sum(held) == pytest.approx(0.25, rel=1e-3) and held[0] / sum(held) == pytest.approx(0.4, rel=1e-3)
    weak = rates(eta_prior_s=1e-9)
    np.testing.assert_allclose(weak, free, rtol=1e-5)
    tilted = rates(eta_beta_kappa=50.0, eta_beta_target=0.9, eta_gamma_weight=2.0)
    assert tilted[0] / sum(tilted) > free[0] / sum(free)


def test_packed_rounds_equal_distributed_ones(spark):
    from flockwise.plans import baselines as B

    rng = np.random.default_rng(3)
    rows = [(f, b, int(rng.poisson(1 if (b // 5) % 2 else 6))) for f in (1, 2, 3) for b in range(20)]
    counts = spark.createDataFrame(rows, "fit_id long, b int, n long")
    (fit, post), (far, far_post) = B.fit_count_hmm(counts, 20, 3, 2, 6), B._long_count_hmm(counts, 20, 3, 2, 6, 1e-6, 0)
    x, y = (d.orderBy("fit_id").toPandas() for d in (fit, far))
    np.testing.assert_allclose(x[["loglik", "rate0", "rate1", "p00", "p11"]], y[["loglik", "rate0", "rate1", "p00", "p11"]], rtol=1e-9)
    x, y = (d.orderBy("fit_id", "b").toPandas() for d in (post, far_post))
    np.testing.assert_allclose(x.g1, y.g1, atol=1e-9)


def paired(e, beta0, beta1, w):
    """Routine, earlier and same-interval mass before each event, pair by pair."""
    out = np.zeros((3, len(e.t), e.S))
    for f, (lo, size) in enumerate(zip(e.heads, e.sizes)):
        for n in range(lo, lo + size):
            for k in range(lo, n):
                out[0, n, e.src[k]] += beta0[f] * np.exp(-beta0[f] * (e.t[n] - e.t[k]))
                x = beta1[f] * np.exp(-beta1[f] * (e.t[n] - e.t[k]))
                out[1 + (e.b[k] == e.b[n]), n, e.src[k]] += x * (1.0 if e.b[k] == e.b[n] else w[k])
    return out


def grouped(sizes, seed=0):
    rng = np.random.default_rng(seed)
    ids = np.repeat(np.arange(len(sizes)), sizes)
    t = np.concatenate([np.sort(np.round(rng.uniform(0, 100, n), 1)) for n in sizes])
    return Events(pd.DataFrame({"pos": np.arange(len(ids)), "fit_id": ids, "t": t, "b": (t // 5).astype(int), "actor": rng.integers(0, 5, len(ids)), "mark": rng.integers(0, 3, len(ids)),
                                "t_end": (t // 5 + 1) * 5.0}), 5, 3), rng


def test_scanned_traces_are_sums_over_pairs():
    e, rng = grouped([1, 40, 2, 90, 1, 13, 250])
    n = len(e.sizes)
    beta0, beta1, fits = rng.uniform(1e-3, 1, n), np.array([0.01, 0.5, 20.0, 3.0, 1.0, 2.0, 20.0]), np.arange(n) % 2 == 1
    whole = Whole(e, 100.0, 5.0)
    w = rng.uniform(0.01, 1, (n, 20))[whole.q, e.b]
    want = paired(e, beta0, beta1, w)
    found = whole.traces({"beta0": beta0, "beta1": beta1}, w)
    for x, y in zip(found, want):
        np.testing.assert_allclose(x.reshape(len(y), -1), y, rtol=1e-11, atol=1e-300)
    # of some fits only, the others from before
    part = whole.traces({"beta0": beta0 * 2, "beta1": beta1}, w, fits, found, active=False)
    again = paired(e, beta0 * 2, beta1, w)[0]
    np.testing.assert_allclose(part[0].reshape(len(again), -1), np.where(fits[whole.q][:, None], again, want[0]), rtol=1e-11, atol=1e-300)


def test_traces_hold_no_pairs():
    import tracemalloc

    e, _ = grouped([190] * 100)
    beta = np.full(100, 0.5)
    tracemalloc.start()
    Whole(e, 100.0, 5.0).traces({"beta0": beta, "beta1": beta}, np.ones(len(e.t)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(e.t) * e.S * 8
