"""Parameters as table rows: one row per fit, arrays as columns.

Fits are independent, so every update below is a map over parameter rows. A batch of rows is
stacked: each array has the fits along its first axis, and one expression moves them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARRAYS = ["nu", "a0", "g", "h", "u", "v", "rho0", "rho1", "a1"]
SCALARS = ["beta0", "beta1", "eta_on", "eta_off"]
PARAMS = [*ARRAYS, *SCALARS]
#: Rows that are stacked and moved together, however many a batch holds.
TOGETHER = 512
PARAM_SCHEMA = "fit_id long, cand int, " + ", ".join(f"{a} array<double>" for a in ARRAYS) + ", " + ", ".join(f"{s} double" for s in SCALARS)


def names_of(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(", ")]


def softplus(x):
    return np.log1p(np.exp(-np.abs(x))) + np.maximum(x, 0.0)


def turned(x):
    """Each matrix transposed."""
    return np.swapaxes(x, -1, -2)


def coupling(g, h, u, v, clip: float = 40.0):
    """``A1 = g hᵀ softplus(U Vᵀ)`` with a zero diagonal, and the softplus part and its slope."""
    inner = u @ turned(v)
    bounded = np.clip(inner, -clip, clip)
    sp = softplus(bounded)
    a1 = g[..., :, None] * h[..., None, :] * sp * (1.0 - np.eye(g.shape[-1]))
    slope = np.where(np.abs(inner) < clip, 1.0 / (1.0 + np.exp(-bounded)), 0.0)
    return a1, sp, slope


def with_coupling(p: dict) -> dict:
    return {**p, "a1": coupling(p["g"], p["h"], p["u"], p["v"])[0]}


def stacked(pdf: pd.DataFrame, K: int, M: int, prefix: str = "") -> dict:
    """Columns as arrays over the rows; parameters take their shapes."""
    shapes = {"nu": (K, M), "a0": (K, K), "g": (K,), "h": (K,), "u": (K, -1), "v": (K, -1), "rho0": (M, M), "rho1": (M, M), "a1": (K, K)}
    out = {}
    for c in pdf.columns:
        shape = shapes.get(c.removeprefix("old_"))
        out[c] = pdf[c].to_numpy() if shape is None else np.stack([np.asarray(x, float) for x in pdf[c]]).reshape(len(pdf), *shape)
    return out


def taken(p: dict, at) -> dict:
    """The rows ``at`` (mask or places) of stacked parameters."""
    return {k: x[at] for k, x in p.items()}


def table(p: dict, names: Iterable[str]) -> pd.DataFrame:
    """Stacked parameters as rows; what is missing is null."""
    n = len(p["fit_id"])
    return pd.DataFrame({c: list(p[c].reshape(n, -1)) if c in ARRAYS else p.get(c, [None] * n) for c in names})


def update(df: DataFrame, K: int, M: int, fn: Callable[[dict], list[dict]], extra: str = "") -> DataFrame:
    """Map parameter rows: ``fn`` gets stacked rows and returns stacked rows, one set or more."""
    schema = PARAM_SCHEMA + (", " + extra if extra else "")
    names = names_of(schema)

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), TOGETHER):
                for q in fn(stacked(pdf.iloc[lo : lo + TOGETHER], K, M)):
                    yield table(q, names)

    return df.mapInPandas(run, schema)


def project_rows(rho, eps: float = 1e-9):
    rho = np.maximum(rho, eps)
    return rho / np.maximum(rho.sum(axis=-1, keepdims=True), eps)


def finite(x) -> np.ndarray:
    """Per row, whether all values are finite."""
    return np.isfinite(x).reshape(len(x), -1).all(axis=1)


def spectral_radius(a) -> np.ndarray:
    """Per matrix; infinite where it holds what is not finite."""
    out, good = np.full(len(a), np.inf), finite(a)
    out[good] = np.abs(np.linalg.eigvals(a[good])).max(axis=-1)
    return out


def radius_beyond(a, bound: float) -> np.ndarray:
    """The spectral radius where it may exceed ``bound``, else zero: no row or column sum of sizes is below it."""
    sizes = np.abs(a)
    near = ~(np.minimum(sizes.sum(axis=1).max(axis=1), sizes.sum(axis=2).max(axis=1)) <= bound)
    out = np.zeros(len(a))
    if near.any():
        out[near] = spectral_radius(a[near])
    return out


def edges(params: DataFrame, K: int, column: str = "a1") -> DataFrame:
    """Off-diagonal edges of a coupling matrix as ``(fit_id, src, dst, w)``."""
    return params.select("fit_id", F.posexplode(column).alias("pos", "w")).select(
        "fit_id", F.floor(F.col("pos") / K).cast("int").alias("src"), (F.col("pos") % K).cast("int").alias("dst"), "w").filter("src <> dst")
