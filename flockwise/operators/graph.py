"""Coupling graphs: pairs, active coupling, role scores, degree and spectral members."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockwise.functions import scalar as S


def ordered_pairs(items: DataFrame, keys: Sequence[str], item: str, directed: bool = True) -> DataFrame:
    """All non-self pairs inside each key, as an equi join on the key.

    Meant for actor sets of bounded size (a model's K actors), never for events.
    """
    tag = [] if keys else [F.lit(0).alias("__k")]
    on = list(keys) or ["__k"]
    a = items.select(*keys, *tag, F.col(item).alias("src")).distinct()
    b = items.select(*keys, *tag, F.col(item).alias("dst")).distinct()
    cond = F.col("src") != F.col("dst") if directed else F.col("src") < F.col("dst")
    return a.join(b, on).filter(cond).drop("__k")


def active_coupling(actors: DataFrame, keys: Sequence[str], inner_clip: float | None = 40.0, hardened: bool = False) -> DataFrame:
    """``A1[src,dst] = g_src h_dst softplus(U_src · V_dst)`` with a zero diagonal.

    ``actors`` has ``actor, g, h, u, v`` with array embeddings. The hardened form bounds all
    inputs first and caps the result at two.
    """
    a = actors
    if hardened:
        lim = lambda c, lo, hi: F.greatest(F.least(F.coalesce(F.col(c), F.lit(0.0)), F.lit(hi)), F.lit(lo))
        a = (
            a.withColumn("g", lim("g", 0.0, 5.0)).withColumn("h", lim("h", 0.0, 5.0))
            .withColumn("u", F.transform("u", lambda x: F.greatest(F.least(x, F.lit(10.0)), F.lit(-10.0))))
            .withColumn("v", F.transform("v", lambda x: F.greatest(F.least(x, F.lit(10.0)), F.lit(-10.0))))
        )
    pairs = ordered_pairs(a, keys, "actor")
    src = a.select(*keys, F.col("actor").alias("src"), "g", "u")
    dst = a.select(*keys, F.col("actor").alias("dst"), "h", "v")
    dot: Column = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    if inner_clip is not None:
        dot = F.greatest(F.least(dot, F.lit(inner_clip)), F.lit(-inner_clip))
    w = F.col("g") * F.col("h") * S.softplus(dot)
    if hardened:
        w = F.least(w, F.lit(2.0))
    return pairs.join(src, [*keys, "src"]).join(dst, [*keys, "dst"]).select(*keys, "src", "dst", w.alias("w"))


def role_scores(edges: DataFrame, keys: Sequence[str], mode: str = "max") -> DataFrame:
    """Sender (row sum), receiver (column sum) and member (combined normalised) scores."""
    sent = edges.groupBy(*keys, F.col("src").alias("actor")).agg(F.sum("w").alias("__s"))
    got = edges.groupBy(*keys, F.col("dst").alias("actor")).agg(F.sum("w").alias("__r"))
    both = sent.join(got, [*keys, "actor"], "full").select(
        *keys, "actor", F.coalesce("__s", F.lit(0.0)).alias("sender"), F.coalesce("__r", F.lit(0.0)).alias("receiver")
    )
    tops = both.groupBy(*keys).agg(F.max("sender").alias("__ms"), F.max("receiver").alias("__mr"))
    joined = both.join(tops, list(keys)) if keys else both.join(F.broadcast(tops), F.lit(True))
    norm = lambda c, m: F.col(c) / F.greatest(F.col(m), F.lit(1e-12))
    return joined.withColumn("member", S.combine_scores(norm("sender", "__ms"), norm("receiver", "__mr"), mode)).drop("__ms", "__mr")


def degree_members(edges: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """``sqrt(out * in)`` degree, the top-k members and the hub (largest out degree)."""
    from flockwise.operators.ranking import top_flag

    roles = role_scores(edges, keys).select(*keys, "actor", F.col("sender").alias("out_degree"), F.col("receiver").alias("in_degree"))
    scored = roles.withColumn("score", F.sqrt(F.col("out_degree") * F.col("in_degree")))
    return top_flag(top_flag(scored, keys, "score", k, "member"), keys, "out_degree", 1, "hub")


def _per_graph(edges: DataFrame, keys: Sequence[str], fn, fields: str, columns: list[str]) -> DataFrame:
    """Run ``fn(actors, matrix) -> rows`` on each key's coupling matrix.

    A group is one model's edge list, so it is bounded by the square of the model's actor
    count; models are spread over the cluster.
    """
    types = dict(edges.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        actors = np.unique(np.r_[pdf["src"].to_numpy(), pdf["dst"].to_numpy()])
        a = np.zeros((len(actors), len(actors)))
        np.add.at(a, (np.searchsorted(actors, pdf["src"]), np.searchsorted(actors, pdf["dst"])), pdf["w"].to_numpy())
        out = pd.DataFrame(fn(actors, a), columns=columns)
        for k in reversed(list(keys)):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return edges.select(*keys, "src", "dst", "w").groupBy(*keys).applyInPandas(run, schema)


def spectral_radius(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _per_graph(edges, keys, lambda actors, a: [(float(np.max(np.abs(np.linalg.eigvals(a)))),)], "radius double", ["radius"])


def spectral_members(edges: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Top-k of ``sqrt(|u| |v|)`` on the leading singular pair; the hub has the largest ``|u|``."""
    from flockwise.operators.ranking import top_flag

    def leading(actors, a):
        u, _, vt = np.linalg.svd(a)
        left, right = np.abs(u[:, 0]), np.abs(vt[0])
        return list(zip(actors.tolist(), left, right, np.sqrt(left * right)))

    scored = _per_graph(edges, keys, leading, "actor int, u double, v double, score double", ["actor", "u", "v", "score"])
    return top_flag(top_flag(scored, keys, "score", k, "member"), keys, "u", 1, "hub")


def stability_scale(edges0: DataFrame, edges1: DataFrame, keys: Sequence[str], threshold: float = 0.95, target: float = 0.80) -> DataFrame:
    """Scale factor per key that brings the radius of ``A0 + A1`` back to the target."""
    joint = edges0.select(*keys, "src", "dst", "w").unionByName(edges1.select(*keys, "src", "dst", "w"))
    joint = joint.groupBy(*keys, "src", "dst").agg(F.sum("w").alias("w"))
    rad = spectral_radius(joint, keys)
    scale = F.when(F.col("radius") > threshold, F.least(F.lit(target) / F.col("radius"), F.lit(1.0))).otherwise(F.lit(1.0))
    return rad.withColumn("scale", scale)


def mark_lift(rho: DataFrame, keys: Sequence[str], m: int) -> tuple[DataFrame, DataFrame]:
    """``rho1 - rho0`` per cell; and same-mark mass and escalation lift.

    ``rho`` is long: ``regime (0/1), src_mark, dst_mark, p``. Escalation is the mean lift from
    marks 0 and 1 into mark 2; it needs at least three marks.
    """
    pick = lambda r: F.max(F.when(F.col("regime") == r, F.col("p")))
    cells = rho.groupBy(*keys, "src_mark", "dst_mark").agg(pick(0).alias("rho0"), pick(1).alias("rho1")).withColumn(
        "lift", F.col("rho1") - F.col("rho0")
    )
    same = F.col("src_mark") == F.col("dst_mark")
    up = F.lit(m >= 3) & (F.col("src_mark") < 2) & (F.col("dst_mark") == 2)
    summary = cells.groupBy(*keys).agg(
        F.sum(F.when(same, F.col("rho0"))).alias("same_mark_mass0"),
        F.sum(F.when(same, F.col("rho1"))).alias("same_mark_mass1"),
        F.sum(F.when(same, F.col("lift"))).alias("same_mark_lift"),
        F.avg(F.when(up, F.col("lift"))).alias("escalation_lift"),
    )
    return cells, summary


def edge_scores(edges: DataFrame, members: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score and truth of every ordered pair inside the member set."""
    pairs = ordered_pairs(members, keys, "actor")
    scored = pairs.join(edges, [*keys, "src", "dst"], "left").withColumn("score", F.coalesce("w", F.lit(0.0))).drop("w")
    marked = truth.select(*keys, "src", "dst").distinct().withColumn("__y", F.lit(1))
    return scored.join(marked, [*keys, "src", "dst"], "left").withColumn("y_true", F.coalesce("__y", F.lit(0))).drop("__y")
