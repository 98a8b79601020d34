"""Rounds of the packed count HMM against sums over all state paths; radii of dense matrices."""

import itertools
import math

import numpy as np
import pytest

from flockwise.plans import baselines as B


@pytest.mark.parametrize("big", [3, 900])
def test_round_equals_sums_over_paths(big):
    n = np.array([[0.0, 1, 4, big], [2, 0, big, 1]]).T
    fact = np.vectorize(lambda k: math.lgamma(k + 1.0))(n)
    state = {"rate0": [0.5, 1.0], "rate1": [3.0, 2.5], "p00": [0.9, 0.7], "p01": [0.1, 0.3], "p10": [0.2, 1e-12], "p11": [0.8, 1.0], "pi0": [0.6, 0.9], "pi1": [0.4, 0.1]}
    state = {k: np.array(v) for k, v in state.items()}
    new, loglik, g = B.hmm_round(n, fact, state)
    for s in range(2):
        paths, logs = list(itertools.product((0, 1), repeat=4)), []
        for path in paths:
            x = math.log(state[f"pi{path[0]}"][s])
            for b, z in enumerate(path):
                rate = state[f"rate{z}"][s]
                x += n[b, s] * math.log(rate) - rate - fact[b, s] + (math.log(state[f"p{path[b - 1]}{z}"][s]) if b else 0.0)
            logs.append(x)
        logs = np.array(logs)
        total = logs.max() + math.log(np.exp(logs - logs.max()).sum())
        weight = np.exp(logs - total)
        on = np.array([sum(w for w, path in zip(weight, paths, strict=True) if path[b]) for b in range(4)])
        assert loglik[s] == pytest.approx(total, rel=1e-10) and g[s, :, 1] == pytest.approx(on, abs=1e-9)
        up = sum(w * sum(a == 0 and z == 1 for a, z in zip(path, path[1:])) for w, path in zip(weight, paths, strict=True))
        stay = sum(w * sum(a == 0 and z == 0 for a, z in zip(path, path[1:])) for w, path in zip(weight, paths, strict=True))
        if up + stay > 1e-6:
            assert new["p01"][s] == pytest.approx(up / (up + stay), abs=1e-9)
        assert new["rate1"][s] == pytest.approx(max((on * n[:, s]).sum() / max(on.sum(), 1e-12), 1e-3), rel=1e-9)


def test_radius_is_found_wherever_it_may_exceed_the_bound():
    from flockwise.plans import rows as R

    rng = np.random.default_rng(4)
    a = rng.uniform(0, 1, (40, 5, 5)) * rng.uniform(0, 0.6, 40)[:, None, None]
    a[0] = np.nan
    near, whole = R.radius_beyond(a, 0.95), R.spectral_radius(a)
    assert ((near > 0.95) == (whole > 0.95)).all() and (near[whole > 0.95] == whole[whole > 0.95]).all() and (near == 0).any()
