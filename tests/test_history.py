"""Distributed history, likelihood and smoothing against direct sums, for several chunkings."""

import numpy as np
import pandas as pd
import pytest

from flockwise.operators import history as H
from flockwise.operators import likelihood as L
from flockwise.operators import smoothing as S

K, M, T, DT, B = 3, 2, 20.0, 4.0, 5
RNG = np.random.default_rng(0)
NU, A0, A1 = RNG.uniform(0.1, 0.3, (K, M)), RNG.uniform(0, 0.2, (K, K)), RNG.uniform(0, 0.4, (K, K))
np.fill_diagonal(A1, 0.0)
R0, R1, B0, B1 = RNG.dirichlet(np.ones(M), M), RNG.dirichlet(np.ones(M), M), 0.7, 1.9


def _events(n, fit):
    t = np.sort(RNG.uniform(0, T, n))
    t[3], t[10:13] = t[2], t[10]  # ties
    return pd.DataFrame({"fit_id": fit, "event_id": np.arange(n) + 1000 * fit, "t": t, "actor": RNG.integers(0, K, n), "mark": RNG.integers(0, M, n)})


EVENTS = pd.concat([_events(40, 1), _events(25, 2), _events(60, 3)])
W = {(f, b): float(RNG.uniform()) for f in (1, 2, 3) for b in range(B)}
G = {k: float(RNG.uniform()) for k in W}


def brute(fit, a0=A0, a1=A1):
    e = EVENTS[EVENTS.fit_id == fit].sort_values(["t", "actor", "mark", "event_id"])
    t, a, m = e.t.values, e.actor.values, e.mark.values
    b = np.minimum((t // DT).astype(int), B - 1)
    ell, lam = np.zeros((B, 2)), []
    for n in range(len(t)):
        k = np.arange(n)
        d0, d1 = B0 * np.exp(-B0 * (t[n] - t[k])), B1 * np.exp(-B1 * (t[n] - t[k]))
        w = np.array([W[fit, x] for x in b[:n]])
        act = a1[a[k], a[n]] * R1[m[k], m[n]] * d1
        l0 = NU[a[n], m[n]] + np.sum(a0[a[k], a[n]] * R0[m[k], m[n]] * d0) + np.sum((w * act)[b[:n] < b[n]])
        l1 = l0 + np.sum(act[b[:n] == b[n]])
        lam.append((l0, l1))
        ell[b[n]] += np.log([l0, l1])
    for q in range(B):
        s, en = q * DT, (q + 1) * DT
        shared, active = NU.sum() * DT, 0.0
        for k in range(len(t)):
            o0, o1 = a0[a[k]].sum(), a1[a[k]].sum()
            if b[k] < q:
                shared += o0 * (np.exp(-B0 * (s - t[k])) - np.exp(-B0 * (en - t[k]))) + W[fit, b[k]] * o1 * (np.exp(-B1 * (s - t[k])) - np.exp(-B1 * (en - t[k])))
            elif b[k] == q:
                shared += o0 * (1 - np.exp(-B0 * (en - t[k])))
                active += o1 * (1 - np.exp(-B1 * (en - t[k])))
        ell[q] -= [shared, shared + active]
    return e.event_id.values, np.array(lam), ell


def q_value(fit, **kw):
    ell = brute(fit, **kw)[2]
    g = np.array([G[fit, b] for b in range(B)])
    return float(np.sum((1 - g) * ell[:, 0] + g * ell[:, 1]))


@pytest.fixture(scope="module")
def inputs(spark):
    flat = [x.ravel().tolist() for x in (NU, A0, A1, R0, R1)]
    params = spark.createDataFrame(
        [(f, 0, *flat, B0, B1, 0.1, 0.2) for f in (1, 2, 3)],
        "fit_id long, cand int, nu array<double>, a0 array<double>, a1 array<double>, rho0 array<double>, rho1 array<double>, beta0 double, beta1 double, eta_on double, eta_off double")
    weights = spark.createDataFrame([(f, b, W[f, b], G[f, b]) for f, b in W], "fit_id long, b int, w double, g1 double")
    return spark.createDataFrame(EVENTS), params, weights


@pytest.mark.parametrize("rows, fan", [(1000, 1024), (7, 1024), (3, 4)])
def test_rates_emissions_and_q(inputs, monkeypatch, rows, fan):
    events, params, weights = inputs
    monkeypatch.setattr(H, "FAN", fan)
    lay = H.layout(events, K, M, DT, T, chunk_rows=rows)
    assert lay.spans == (rows < 60)
    rate = L.event_intensity(lay, params, weights).toPandas().set_index("event_id")
    em = S.interval_emissions(lay, params, weights).toPandas()
    vec = L.score_and_gradient(lay, params, weights).toPandas().set_index("fit_id")["vec"]
    for f in (1, 2, 3):
        ids, lam, ell = brute(f)
        np.testing.assert_allclose(rate.loc[ids][["lam0", "lam1"]].values, lam, atol=1e-12)
        np.testing.assert_allclose(em[em.fit_id == f].sort_values("b")[["ell0", "ell1"]].values, ell, atol=1e-11)
        assert vec[f][0] - NU.sum() * T == pytest.approx(q_value(f), abs=1e-10)
    lay.release()


def test_gradient_matches_differences(inputs):
    events, params, weights = inputs
    lay = H.layout(events, K, M, DT, T, chunk_rows=9)
    v = L.score_and_gradient(lay, params, weights).toPandas().set_index("fit_id")["vec"][3]
    h = 1e-5
    for name, base, off in (("a1", A1, 1), ("a0", A0, 1 + K * K)):
        for j, i in ((0, 1), (2, 0), (1, 2)):
            d = np.zeros((K, K))
            d[j, i] = h
            num = (q_value(3, **{name: base + d}) - q_value(3, **{name: base - d})) / (2 * h)
            assert v[off + j * K + i] == pytest.approx(num, abs=1e-6)


def test_smoothing_blocks_agree(inputs):
    events, params, weights = inputs
    lay = H.layout(events, K, M, DT, T)
    one = S.estep(lay, params, weights).toPandas().sort_values(["fit_id", "b"])
    cut = S.estep(lay, params, weights, block=2).toPandas().sort_values(["fit_id", "b"])
    np.testing.assert_allclose(one.g1.values, cut.g1.values, atol=1e-12)
    np.testing.assert_allclose(one.loglik.values, cut.loglik.values, atol=1e-10)
    np.testing.assert_allclose(one.g0 + one.g1, 1.0, atol=1e-12)
    for f, g in one.groupby("fit_id"):
        xi, g1 = list(g.xi), g.g1.values
        for b in range(1, B):
            x = np.array(xi[b]).reshape(2, 2)
            assert x.sum(axis=1)[1] == pytest.approx(g1[b - 1], abs=1e-10)
            assert x.sum(axis=0)[1] == pytest.approx(g1[b], abs=1e-10)


def test_decayed_prefix_survives_large_exponents():
    t = np.array([0.0, 1.0, 400.0, 400.5, 5000.0])
    got, _ = H.decayed_prefix(t, np.zeros(5, dtype=int), np.ones(5), 1, 20.0, np.zeros(1), 0.0)
    want = [sum(20.0 * np.exp(-20.0 * (t[n] - t[k])) for k in range(n)) for n in range(5)]
    np.testing.assert_allclose(got[:, 0], want, rtol=1e-12)


def test_long_grids_in_blocks_equal_whole_ones(inputs):
    """Emissions, traces at interval starts and present-time gating with the grid cut into blocks of three intervals."""
    events, params, weights = inputs
    lay = H.layout(events, K, M, DT, T)
    for present in (False, True):
        a, b = (S.interval_emissions(lay, params, None if present else weights, present, block=n).orderBy("fit_id", "cand", "b").toPandas() for n in (S.GRID_BLOCK, 3))
        assert len(a) == len(b)
        np.testing.assert_allclose(a.drop(columns=["fit_id"]).to_numpy(float), b[a.columns].drop(columns=["fit_id"]).to_numpy(float), rtol=1e-10, atol=1e-12)
    betas = params.select("fit_id", "beta0", "beta1").distinct()
    x, y = (S.interval_start_traces(lay, lay.events, betas, weights, block=n).orderBy("fit_id", "actor", "mark", "b").toPandas() for n in (S.GRID_BLOCK, 3))
    np.testing.assert_allclose(x.to_numpy(float), y.to_numpy(float), rtol=1e-10, atol=1e-13)
