"""Steps of whole fits side by side: rates without rows per source, and decays at their own pace."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flockwise.operators.batched import Events
from flockwise.operators.history import layout
from flockwise.plans import em as EM
from flockwise.plans import local
from flockwise.plans import steps as T
from flockwise.plans.local import Whole


def grouped(sizes, K=3, M=2, span=100.0, dt=5.0, seed=0):
    rng = np.random.default_rng(seed)
    ids = np.repeat(np.arange(len(sizes)), sizes)
    t = np.concatenate([np.sort(np.round(rng.uniform(0, span - 1, n), 1)) for n in sizes])
    pdf = pd.DataFrame({"pos": np.arange(len(ids)), "fit_id": ids, "t": t, "b": (t // dt).astype(int), "actor": rng.integers(0, K, len(ids)),
                        "mark": rng.integers(0, M, len(ids)), "t_end": (t // dt + 1) * dt})
    return Whole(Events(pdf, K, M), span, dt), rng


def params(whole, rng):
    n, K, M = whole.F, whole.K, whole.M
    off = 1.0 - np.eye(K)
    p = {"fit_id": whole.e.ids, "nu": rng.uniform(0.01, 0.1, (n, K, M)), "a0": rng.uniform(0, 0.2, (n, K, K)) * off, "g": rng.uniform(0.1, 1, (n, K)), "h": rng.uniform(0.1, 1, (n, K)),
         "u": rng.normal(0, 0.3, (n, K, 2)), "v": rng.normal(0, 0.3, (n, K, 2)), "rho0": rng.dirichlet(np.ones(M), (n, M)), "rho1": rng.dirichlet(np.ones(M), (n, M)),
         "beta0": rng.uniform(0.05, 0.5, n), "beta1": rng.uniform(1.0, 3.0, n), "eta_on": np.full(n, 0.03), "eta_off": np.full(n, 0.3)}
    return T.enforce(p, "full_model")


def rates_by_pairs(whole, p, w):
    """Routine, earlier and same-interval rate of each event, pair by pair."""
    e, out = whole.e, np.zeros((3, len(whole.q)))
    for f, (lo, size) in enumerate(zip(e.heads, e.sizes)):
        for n in range(lo, lo + size):
            for k in range(lo, n):
                lag, at, via = e.t[n] - e.t[k], (f, e.i[k], e.i[n]), (f, e.m[k], e.m[n])
                out[0, n] += p["a0"][at] * p["rho0"][via] * p["beta0"][f] * np.exp(-p["beta0"][f] * lag)
                x = p["a1"][at] * p["rho1"][via] * p["beta1"][f] * np.exp(-p["beta1"][f] * lag)
                same = e.b[k] == e.b[n]
                out[1 + same, n] += x * (1.0 if same else w[k])
    return out


# fits of one event, of one interval, of many; the bounds send the last two to the scan by doubling
@pytest.mark.parametrize("sizes, steps, pairs", [([1, 40, 2, 90, 1, 13], 512, 8), ([30, 1, 60], 4, 8), ([80, 5], 512, 0)])
def test_rates_are_sums_over_pairs(monkeypatch, sizes, steps, pairs):
    monkeypatch.setattr(local, "STEPS", steps)
    monkeypatch.setattr(local, "PAIRS", pairs)
    whole, rng = grouped(sizes)
    p, w = params(whole, rng), rng.uniform(0.01, 1, (whole.F, whole.B))[whole.q, whole.e.b]
    coupled = whole.coupled(p, w)
    found = sum(whole.excited(0, p["beta0"], coupled)), *whole.excited(1, p["beta1"], coupled)
    assert whole.scans == (steps == 4 or pairs == 0)
    np.testing.assert_allclose(found, rates_by_pairs(whole, p, w), rtol=1e-11, atol=1e-15)


def test_a_lost_fit_leaves_the_rates_of_others_alone():
    whole, rng = grouped([20, 30, 25])
    p, w = params(whole, rng), np.ones(75)
    good = whole.excited(1, p["beta1"], whole.coupled(p, w))
    bad = whole.excited(1, np.where(np.arange(3) == 1, np.nan, p["beta1"]), whole.coupled(p, w))
    for x, y in zip(good, bad):
        np.testing.assert_array_equal(x[whole.q != 1], y[whole.q != 1])


def test_trials_make_no_rows_per_source(monkeypatch):
    """Before, each trial of a decay made all traces anew."""
    whole, rng = grouped([40] * 12)
    made = []
    masses = Whole.traces
    monkeypatch.setattr(Whole, "traces", lambda self, *a, **k: made.append(1) or masses(self, *a, **k))
    g = rng.uniform(0.1, 0.9, (whole.F, whole.B))
    whole.mstep(params(whole, rng), g, g, None, None, EM.REPLICATION, 1.0, False)
    assert len(made) == 1


def test_a_group_moves_like_its_fits_alone():
    """Some fits take their first trial and others none; each ends where it ends without company."""
    whole, rng = grouped([40, 15, 60, 33, 8, 27, 50], seed=3)
    p, g = params(whole, rng), rng.uniform(0.05, 0.95, (whole.F, whole.B))
    together = whole.mstep(p, g, g, None, None, EM.REPLICATION, 1.0, False)
    for f in range(whole.F):
        one = np.arange(whole.F) == f
        alone = whole.taken(one).mstep({k: x[one] for k, x in p.items()}, g[one], g[one], None, None, EM.REPLICATION, 1.0, False)
        for k in ("nu", "a0", "g", "h", "rho0", "rho1", "beta0", "beta1"):
            np.testing.assert_allclose(alone[k][0], together[k][f], rtol=1e-7, atol=1e-10, err_msg=f"{k} {f}")


def test_decays_that_begin_out_of_bounds_move_alike_inside_a_chunk_and_across(spark):
    rng = np.random.default_rng(8)
    rows = []
    for f, n in ((1, 20), (2, 60), (3, 25)):
        t = np.sort(rng.uniform(0, 60, n))
        rows.append(pd.DataFrame({"fit_id": f, "event_id": np.arange(n) + 100 * f, "t": t, "actor": rng.integers(0, 3, n), "mark": rng.integers(0, 2, n)}))
    events, found = spark.createDataFrame(pd.concat(rows)), []
    for size in (1000, 40):
        lay = layout(events, 3, 2, 6.0, 60.0, chunk_rows=size)
        init = EM.init_params(lay.events, 3, 2, 60.0, dt=6.0).withColumn("beta1", F.when(F.col("fit_id") == 2, 45.0).otherwise(F.col("beta1")))
        fit = EM.fit_regime_model(lay, init, EM.with_settings(EM.REPLICATION, max_iters=1, n_inner_steps=1, n_decay_steps=2))
        found.append(fit.params.orderBy("fit_id").toPandas())
    for k in ("beta0", "beta1", "nu"):
        np.testing.assert_allclose(np.stack(found[0][k].map(np.atleast_1d)), np.stack(found[1][k].map(np.atleast_1d)), rtol=1e-9)
