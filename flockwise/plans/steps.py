"""The moves of an M-step on stacked parameters: every array has the fits along its first axis."""

from __future__ import annotations

import numpy as np

from flockwise.plans import rows as R

#: Trials of a step, each half the one before; bound of the gates' joint slope.
HALVINGS, SLOPE_BOUND = 6, 50.0
#: Greatest value of a routine coupling.
A0_BOUND = 2.0
#: Fixed values of the decays' ascent: its steps, the first trial of a step, and the relative offset of its differences.
DECAY_STEPS, DECAY_STEP, DECAY_OFFSET = 5, 0.5, 0.01
#: Fixed values of the switch rates: bounds of the total rate, of the share's logit, and of what is returned.
RATE_BOUNDS, LOGIT_BOUND, ETA_BOUNDS = (1e-6, 50.0), 20.0, (1e-4, 5.0)


def per_fit(x, like):
    """One value per fit, shaped to meet ``like``."""
    return np.reshape(x, (-1,) + (1,) * (np.ndim(like) - 1))


# --- gates ------------------------------------------------------------------------------


def gate_directions(p: dict, slope: np.ndarray) -> tuple[dict, np.ndarray]:
    """Slopes in g, h, U and V from that in A1, bounded together; and which fits can move."""
    K = slope.shape[-1]
    d = slope * (1.0 - np.eye(K))
    _, sp, bend = R.coupling(p["g"], p["h"], p["u"], p["v"])
    weighed, inner = d * sp, p["g"][:, :, None] * p["h"][:, None, :] * d * bend
    found = {"g": weighed @ p["h"][..., None], "h": R.turned(weighed) @ p["g"][..., None], "u": inner @ p["v"], "v": R.turned(inner) @ p["u"]}
    found = {k: np.nan_to_num(x).reshape(p[k].shape) for k, x in found.items()}
    norm = np.sqrt(sum((x * x).reshape(len(x), -1).sum(axis=1) for x in found.values()))
    scale = np.minimum(1.0, SLOPE_BOUND / np.where(norm > 0, norm, 1.0))
    return {k: x * per_fit(scale, x) for k, x in found.items()}, norm > 0


def moved_gates(p: dict, to: dict, step: float, lg: float, lh: float, le: float) -> dict:
    """A proximal step: soft thresholds on the gates, row shrinkage on the embeddings."""
    def shrunk(name):
        x = p[name] + step * to[name]
        return x * np.maximum(0.0, 1.0 - step * le / (np.linalg.norm(x, axis=-1, keepdims=True) + 1e-12))

    gates = {k: np.maximum(0.0, p[k] + step * (to[k] - penalty)) for k, penalty in (("g", lg), ("h", lh))}
    return R.with_coupling({**p, **gates, "u": shrunk("u"), "v": shrunk("v")})


# --- routine coupling and routes --------------------------------------------------------


def block_direction(p: dict, block: str, slope: np.ndarray, ridge: float, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the penalised objective in one block, along its simplex for routes; and which fits can move."""
    if block == "a0":
        slope = slope - 2.0 * ridge * p["a0"]
        if not diagonal:
            slope = slope * (1.0 - np.eye(slope.shape[-1]))
    else:
        slope = slope - (slope * p[block]).sum(axis=-1, keepdims=True)
    return slope, R.finite(slope) & slope.reshape(len(slope), -1).any(axis=1)


def moved_block(p: dict, block: str, slope: np.ndarray, step: float) -> dict:
    x = p[block] + step * slope
    return {**p, block: np.clip(x, 0.0, A0_BOUND) if block == "a0" else R.project_rows(x)}


def ridge_of(p: dict, ridge: float) -> np.ndarray:
    return ridge * (p["a0"] ** 2).sum(axis=(1, 2))


# --- decays -----------------------------------------------------------------------------


def decay_projection(b0, b1, s) -> tuple[np.ndarray, np.ndarray]:
    """The decays as a mean and a half-gap of logarithms: the gap is widened to the least one, then both ends are bounded."""
    low, high, gap = np.log([s.beta_min, s.beta_max, s.beta_ratio])
    x, y = (np.clip(np.log(np.maximum(b, 1e-300)), low, high) for b in (b0, b1))
    half = np.maximum(y - x, gap) / 2
    first = np.clip((x + y) / 2 - half, low, high)
    second = np.clip((x + y) / 2 + half, np.minimum(first + gap, high), high)
    return np.exp(first), np.exp(second)


def decay_offsets(p: dict, s) -> list[tuple[np.ndarray, np.ndarray]]:
    """The points that forward differences compare with the current one: either decay a little higher, within its bounds."""
    out = []
    for name in ("beta0", "beta1"):
        q = {k: np.array(p[k], float) for k in ("beta0", "beta1")}
        q[name] = q[name] + DECAY_OFFSET * np.maximum(1.0, np.abs(q[name]))
        out.append(tuple(np.clip(q[k], s.beta_min, s.beta_max) for k in ("beta0", "beta1")))
    return out


def decay_slopes(p: dict, here: np.ndarray, there: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Slopes in both decays from the objective here and at the offsets; and which fits can move."""
    slopes = []
    for name, q in zip(("beta0", "beta1"), there, strict=True):
        with np.errstate(invalid="ignore"):
            d = (q - here) / (DECAY_OFFSET * np.maximum(1.0, np.abs(p[name])))
        slopes.append(np.where(np.isfinite(q), d, 0.0))
    norm = np.hypot(*slopes)
    return slopes, np.isfinite(here) & np.isfinite(norm) & (norm > 0)


def moved_decays(p: dict, slopes: list[np.ndarray], step: float, s) -> dict:
    # the bounded logarithm takes what is below zero to the least decay
    b0, b1 = decay_projection(p["beta0"] + step * slopes[0], p["beta1"] + step * slopes[1], s)
    return {**p, "beta0": b0, "beta1": b1}


# --- switch rates -----------------------------------------------------------------------


def switch_rates(x, occ0, occ1, on, off, delta: float, s) -> tuple[np.ndarray, np.ndarray]:
    """The rates that maximise the expected transition log-likelihood, plus priors where they are set.

    ``x``: expected transitions 00, 01, 10, 11 per fit. Over a step of ``delta`` the chain leaves its states with
    probabilities ``share * m`` and ``(1 - share) * m``, where ``m = 1 - exp(-rate * delta)``. Without
    priors both follow from the shares of transitions. Fits without any transition keep their rates.
    """
    x = np.atleast_2d(np.asarray(x, float))
    on, off, occ0, occ1 = (np.broadcast_to(np.asarray(v, float), len(x)) for v in (on, off, occ0, occ1))
    seen = (x > 0).any(axis=1)
    tiny = 1e-300
    up, down = x[:, 1] / np.maximum(x[:, 0] + x[:, 1], tiny), x[:, 2] / np.maximum(x[:, 2] + x[:, 3], tiny)
    mixed = up + down
    inside = (mixed > 0) & (mixed < 1)
    # beyond, the next state does not depend on the last; below, no state is ever left
    share = np.where(inside, up / np.maximum(mixed, tiny), (x[:, 1] + x[:, 3]) / np.maximum(x.sum(axis=1), tiny))
    rate = np.where(inside, -np.log1p(-np.where(inside, mixed, 0.5)) / delta, np.where(mixed > 0, RATE_BOUNDS[1], RATE_BOUNDS[0]))
    edge = 1.0 / (1.0 + np.exp(LOGIT_BOUND))
    z = np.stack([np.log(np.clip(rate, *RATE_BOUNDS)), _logit(np.clip(share, edge, 1.0 - edge))], axis=1)
    if s.eta_prior_s or s.eta_prior_pi or s.eta_beta_kappa > 0 or s.eta_gamma_weight > 0:
        z = _with_priors(z, x, on, off, occ0, occ1, delta, s)
    total, share = np.exp(z[:, 0]), 1.0 / (1.0 + np.exp(-z[:, 1]))
    new_on, new_off = np.where(seen, share * total, on), np.maximum(np.where(seen, (1.0 - share) * total, off), s.eta_off_floor)
    return np.clip(new_on, *ETA_BOUNDS), np.clip(new_off, *ETA_BOUNDS)


def _logit(p):
    return np.log(p) - np.log1p(-p)


def _with_priors(z, x, on, off, occ0, occ1, delta, s, steps: int = 200):
    """Newton steps on (log rate, logit share), halved until the objective rises; Fisher information stands in for curvature."""
    center = np.log(np.maximum(on + off, 1e-4))
    target = occ1 / np.maximum(occ0 + occ1, 1e-9) if s.eta_pi1_target is None else np.full(len(x), s.eta_pi1_target)
    middle = _logit(np.clip(target, 1e-4, 1 - 1e-4))
    goal = float(np.clip(s.eta_beta_target, 1e-4, 1 - 1e-4))
    a, b = (s.eta_beta_kappa * goal - 1.0, s.eta_beta_kappa * (1.0 - goal) - 1.0) if s.eta_beta_kappa > 0 else (0.0, 0.0)

    def parts(z):
        r, share = np.exp(z[:, 0]), 1.0 / (1.0 + np.exp(-z[:, 1]))
        stay = np.exp(-r * delta)
        up, down = np.clip(share * (1 - stay), 1e-12, 1 - 1e-12), np.clip((1 - share) * (1 - stay), 1e-12, 1 - 1e-12)
        return r, share, stay, up, down

    def value(z):
        r, share, _, up, down = parts(z)
        q = x[:, 0] * np.log1p(-up) + x[:, 1] * np.log(up) + x[:, 2] * np.log(down) + x[:, 3] * np.log1p(-down)
        q = q - 0.5 * s.eta_prior_s * (z[:, 0] - center) ** 2 - 0.5 * s.eta_prior_pi * (z[:, 1] - middle) ** 2
        return q + a * np.log(share) + b * np.log1p(-share) + s.eta_gamma_weight * ((s.eta_gamma_shape - 1.0) * z[:, 0] - s.eta_gamma_rate * r)

    low, high = np.array([np.log(RATE_BOUNDS[0]), -LOGIT_BOUND]), np.array([np.log(RATE_BOUNDS[1]), LOGIT_BOUND])
    best = value(z)
    for _ in range(steps):
        r, share, stay, up, down = parts(z)
        odds_up, odds_down = x[:, 1] / up - x[:, 0] / (1 - up), x[:, 2] / down - x[:, 3] / (1 - down)
        turn, tilt = r * delta * stay, share * (1 - share) * (1 - stay)
        slope = np.stack([
            turn * (share * odds_up + (1 - share) * odds_down) - s.eta_prior_s * (z[:, 0] - center) + s.eta_gamma_weight * (s.eta_gamma_shape - 1.0 - s.eta_gamma_rate * r),
            tilt * (odds_up - odds_down) - s.eta_prior_pi * (z[:, 1] - middle) + a * (1 - share) - b * share,
        ], axis=1)
        n0, n1 = (x[:, 0] + x[:, 1]) / (up * (1 - up)), (x[:, 2] + x[:, 3]) / (down * (1 - down))
        both = np.array([[n0 * (turn * share) ** 2 + n1 * (turn * (1 - share)) ** 2 + s.eta_prior_s + s.eta_gamma_weight * s.eta_gamma_rate * r,
                          n0 * turn * share * tilt - n1 * turn * (1 - share) * tilt],
                         [n0 * turn * share * tilt - n1 * turn * (1 - share) * tilt, (n0 + n1) * tilt**2 + s.eta_prior_pi + max(a + b, 0.0) * share * (1 - share)]])
        info = np.moveaxis(both, 2, 0) + 1e-9 * np.eye(2)
        move, left = np.linalg.solve(info, slope[..., None])[..., 0], np.ones(len(z), bool)
        gain = 0.0
        for _ in range(30):
            trial = np.clip(z + move, low, high)
            q = value(trial)
            better = left & (q > best)
            gain = max(gain, float((q - best)[better].max(initial=0.0)))
            z, best = np.where(better[:, None], trial, z), np.where(better, q, best)
            left &= ~better
            move = move * 0.5
            if not left.any():
                break
        if gain < 1e-12:
            break
    return z


# --- after a step -----------------------------------------------------------------------


def enforce(p: dict, variant: str) -> dict:
    """The constraints of a variant: parameters that share a value take the mean."""
    if variant == "single_gate":
        g = 0.5 * (p["g"] + p["h"])
        p = {**p, "g": g, "h": g.copy()}
    elif variant == "dense_active_block":
        n, K = p["g"].shape
        p = {**p, "u": np.broadcast_to(np.eye(K), (n, K, K)).copy()}
    elif variant in ("shared_beta", "shared_beta_rho"):
        b = 0.5 * (p["beta0"] + p["beta1"])
        p = {**p, "beta0": b, "beta1": b.copy()}
        if variant == "shared_beta_rho":
            r = R.project_rows(0.5 * (p["rho0"] + p["rho1"]))
            p = {**p, "rho0": r, "rho1": r.copy()}
    return R.with_coupling(p)


def stabilise(p: dict, threshold: float, target: float, keep_a0: bool) -> tuple[dict, np.ndarray]:
    """Shrink the coupling by ``target / radius`` where the joint branching matrix's spectral radius is over the threshold.

    The active part is a product of two gates, so each takes the factor's square root; the other part takes all of it, or none.
    """
    radius = R.spectral_radius(p["a0"] + p["a1"])
    over = np.isfinite(radius) & (radius > threshold)
    if not over.any():
        return p, radius
    factor = np.where(over, np.clip(target / np.where(over, radius, 1.0), 0.0, 1.0), 1.0)
    powers = {"g": 0.5, "h": 0.5} if keep_a0 else {"g": 0.5, "h": 0.5, "a0": 1.0}
    q = R.with_coupling({**p, **{name: p[name] * per_fit(factor**power, p[name]) for name, power in powers.items()}})
    return q, np.where(over, R.spectral_radius(q["a0"] + q["a1"]), radius)


#: Iterations of strong momentum, and the weights of the old parameters and of the old decays, then and later.
STRONG, MOMENTUM = 10, ((0.5, 0.2), (0.3, 0.1))


def blended(old: dict, new: dict, it: int, s, static: bool = False) -> tuple[dict, np.ndarray, np.ndarray]:
    """Momentum, constraints of the variant and the stability projection; the radius, and which fits stayed finite.

    A fit that did not keeps its old parameters.
    """
    arrays, decays = MOMENTUM[it > STRONG]
    keep = {**dict.fromkeys(("nu", "a0", "g", "h", "u", "v", "rho0", "rho1"), arrays), "beta0": decays, "beta1": decays}
    p = {**new, **{k: w * old[k] + (1.0 - w) * new[k] for k, w in keep.items()}}
    if static:
        half = np.full(len(new["fit_id"]), 0.5)
        p |= {k: old[k] for k in ("rho0", "rho1", "beta0", "beta1")} | {"eta_on": half, "eta_off": half.copy()}
    p["rho0"], p["rho1"] = R.project_rows(p["rho0"]), R.project_rows(p["rho1"])
    p = enforce(p, s.variant)
    good = np.logical_and.reduce([R.finite(p[k]) for k in ("g", "h", "u", "v", "a0", "rho0", "rho1", "nu")])
    p = {**p, **{k: np.where(per_fit(good, p[k]), p[k], old[k]) for k in R.PARAMS}}
    p, radius = stabilise(p, s.stability_threshold, s.stability_target, s.preserve_a0 or static)
    return p, radius, good
