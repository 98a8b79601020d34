"""Registered fit queries pass the limits of the presets and operators on."""

import inspect
from unittest.mock import MagicMock

import numpy as np
import pandas as pd
import pytest

from flockwise.plans import baselines as B
from flockwise.plans import diagnostics as D
from flockwise.plans import em as EM
from flockwise.plans import heldout as HO
from flockwise.plans import pairs as PR
from workload import fits as W

CASES = [
    ("fit_regime_model", EM, "fit_regime_model", {"s": EM.REPLICATION}),
    ("fit_static_gates", EM, "fit_static_gates", {"s": EM.REPLICATION}),
    ("mstep", EM, "mstep", {"s": EM.REPLICATION}),
    ("decay_step", EM, "decay_step", {"s": EM.REPLICATION}),
    ("switch_rate_step", EM, "switch_rate_table", {"s": EM.REPLICATION}),
    ("fit_clamped", D, "fit_clamped", {"settings": EM.REPLICATION}),
    ("dose_response", D, "dose_response", {"settings": EM.REPLICATION}),
    ("heldout_regime", HO, "heldout_regime", {"settings": EM.REAL_DATA}),
    ("heldout_static", HO, "heldout_static_gates", {"settings": EM.REAL_DATA}),
    ("heldout_static", HO, "heldout_full_matrix", {"iters": 200}),
    ("fit_count_hmm", B, "fit_count_hmm", {"restarts": 10, "max_iters": 200, "tol": 1e-6}),
    ("modular_pipeline", B, "modular_pipeline", {"restarts": 10, "hmm_iters": 200, "pair_iters": 500}),
    ("fit_full_matrix", B, "fit_full_matrix", {"iters": 200, "every": 10}),
    ("pairwise_coupling", PR, "pairwise_coupling", {"iters": 500}),
    ("oracle_posterior", D, "oracle_posterior", {"n_iters": 25, "tol": 1e-5}),
]


@pytest.fixture
def mocked(monkeypatch):
    """No table is read: only the calls of the operators are looked at."""
    for name in ("C.events", "C.sessions", "C.windows", "EM.init_params", "EM.start_weights", "PR.pair_segments", "D.corrupt_posterior"):
        where, what = name.split(".")
        monkeypatch.setattr(getattr(W, where), what, MagicMock())
    for name in ("S", "I", "laid_out", "fits", "fixed_params", "count_grid", "binned", "named", "summary", "cut_lineage"):
        monkeypatch.setattr(W, name, MagicMock())
    monkeypatch.setattr(W, "setup", lambda *a, **k: (MagicMock(), MagicMock(), MagicMock()))
    monkeypatch.setattr(W, "clamped", lambda *a, **k: (MagicMock(), MagicMock(), MagicMock()))
    monkeypatch.setattr(W.EM, "_score", MagicMock())
    monkeypatch.setattr(W.EM, "_choose", MagicMock())
    monkeypatch.setattr(W.R, "update", lambda cur, k, m, propose, *a: propose(cur))
    return monkeypatch


def calls_of(mocked, module, name):
    seen, signature = [], inspect.signature(getattr(module, name))

    def record(*a, **k):
        bound = signature.bind(*a, **k)
        bound.apply_defaults()
        seen.append(bound.arguments)
        return MagicMock()

    mocked.setattr(module, name, record)
    return seen


@pytest.mark.parametrize("query, module, operator, limits", CASES, ids=[f"{c[0]}-{c[2]}" for c in CASES])
def test_limits_are_the_operators_own(spark, mocked, query, module, operator, limits):
    seen = calls_of(mocked, module, operator)
    if operator == "heldout_full_matrix":
        mocked.setattr(HO, "heldout_static_gates", MagicMock())
    elif operator == "heldout_static_gates":
        mocked.setattr(HO, "heldout_full_matrix", MagicMock())
    getattr(W, query)(spark, "")
    assert len(seen) == (5 if query == "decay_step" else 1) and {k: seen[0][k] for k in limits} == limits


def test_every_variant_is_fitted(spark, mocked):
    fits, starts = [], calls_of(mocked, EM, "init_params")
    mocked.setattr(EM, "fit_all", lambda lay, runs: fits.extend(runs) or [MagicMock() for _ in runs])
    W.fit_variant(spark, "")
    assert [f.settings for f in fits] == [EM.with_settings(EM.REPLICATION, variant=v) for v in EM.VARIANTS]
    assert [i["kwargs"]["dense"] for i in starts] == [v == "dense_active_block" for v in EM.VARIANTS]


def test_all_doses_are_given(spark, mocked):
    seen = calls_of(mocked, D, "dose_response")
    W.dose_response(spark, "")
    assert seen[0]["doses"] == (0.0, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0)


def test_slope_is_resampled_as_often_as_in_the_reference():
    import __spark_entry__ as entry

    assert "FROM range(1000) r" in entry.oracle_sql()["seed_bootstrap_slope_full"]


def test_every_nuisance_block_moves(spark):
    rows = {(r.block, r.session_id): r for r in W.nuisance_step(spark, "/root/testdata/sf0.001").collect()}
    names, sessions = {b for b, _ in rows}, {s for _, s in rows}
    assert names == {"a0", "rho0", "rho1"} and len(rows) == 3 * len(sessions)
    differ = lambda column, a, b: any(getattr(rows[a, s], column) != getattr(rows[b, s], column) for s in sessions)
    assert differ("rho0", "rho0", "a0") and differ("rho1", "rho1", "a0") and differ("sum_a0", "a0", "rho0")
    assert not differ("rho1", "rho0", "a0") and not differ("rho0", "rho1", "a0")


def test_traces_are_kept_while_decays_and_weights_stand():
    from flockwise.operators.batched import Events
    from flockwise.plans.local import Whole

    rng = np.random.default_rng(5)
    n, K, M = 60, 3, 2
    fit = np.repeat([4, 9, 11], 20)
    t = np.sort(rng.uniform(0, 48, (3, 20)), axis=1).ravel()
    pdf = pd.DataFrame({"pos": np.arange(n), "fit_id": fit, "t": t, "b": (t // 12).astype(int), "actor": rng.integers(0, K, n), "mark": rng.integers(0, M, n), "t_end": (t // 12 + 1) * 12})
    whole, p, w = Whole(Events(pdf, K, M), 48.0, 12.0), {"beta0": np.full(3, 0.4), "beta1": np.full(3, 0.7)}, np.ones(n)
    first = whole.same_traces(p, w)
    assert whole.same_traces({k: v.copy() for k, v in p.items()}, w.copy()) is first
    keep = np.array([True, False, True])
    part, q = whole.taken(keep), {k: v[keep] for k, v in p.items()}
    for a, b in zip(part.same_traces(q, w[keep[whole.q]]), part.traces(q, w[keep[whole.q]]), strict=True):
        assert np.array_equal(a, b)
    other = {**p, "beta1": np.full(3, 0.8)}
    for a, b in zip(whole.same_traces(other, w), whole.traces(other, w), strict=True):
        assert np.array_equal(a, b)
