"""Replicate summaries, paired tests, recovery thresholds, lag correlations and task grids."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flockwise.functions import scalar as S
from flockwise.operators import ordered


def replicate_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], zero_std: bool = False) -> DataFrame:
    """Mean, sample deviation and count of every metric per group; null keys form groups."""
    aggs: list[Column] = []
    for m in metrics:
        std = F.stddev_samp(m)
        aggs += [F.avg(m).alias(f"{m}_mean"), (F.coalesce(std, F.lit(0.0)) if zero_std else std).alias(f"{m}_std"), F.count(m).alias(f"{m}_count")]
    return df.groupBy(*keys).agg(*aggs)


def report_tables(df: DataFrame, session_col: str, parts: Mapping[str, str], keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One summary per named table, each over the sessions whose name contains its part."""
    tables = F.array(*[F.struct(F.lit(n).alias("table"), F.lit(p).alias("part")) for n, p in parts.items()])
    tagged = df.withColumn("__t", F.explode(tables)).filter(F.col(session_col).contains(F.col("__t.part")))
    return replicate_summary(tagged.withColumn("table", F.col("__t.table")).drop("__t"), ["table", *keys], metrics)


def pivot_methods(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], metric: str, how: str = "min_by", order: str | None = None) -> DataFrame:
    """One column per method: its mean, or its first value in ``order``."""
    agg = F.avg(metric) if how == "avg" else F.min_by(metric, order)
    return df.groupBy(*keys).pivot(column, list(values)).agg(agg)


def paired_methods(df: DataFrame, keys: Sequence[str], metric: str, method: str, baseline: str, method_col: str = "method",
                   close: Mapping[str, float] | None = None) -> DataFrame:
    """Differences ``method - baseline`` on equal keys, at given parameter levels."""
    for c, v in (close or {}).items():
        df = df.filter(F.abs(F.col(c) - F.lit(v)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.lit(v)))
    a = df.filter(F.col(method_col) == method).select(*keys, F.col(metric).alias("value"))
    b = df.filter(F.col(method_col) == baseline).select(*keys, F.col(metric).alias("base"))
    return a.join(b, list(keys)).withColumn("d", F.col("value") - F.col("base")).filter(F.col("d").isNotNull() & ~F.isnan("d"))


def paired_bootstrap(pairs: DataFrame, ids: Sequence[str], d: str, n_boot: int, seed: int) -> DataFrame:
    """Mean difference with a percentile interval from ``n_boot`` resamples.

    Every resample draws ``n`` of the ``n`` pairs by ``floor(u n)``; draws meet pairs in an
    equi join on the position. ``n`` is the number of replicates of a study.
    """
    spark = pairs.sparkSession
    order = Window.orderBy(*[F.asc(i) for i in ids])
    placed = pairs.withColumn("__pos", F.row_number().over(order) - 1)
    size = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_delta"))
    boots = spark.range(n_boot).select(F.col("id").alias("boot"))
    draws = (
        boots.join(F.broadcast(size), F.lit(True)).filter("n > 0")
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("__pos", F.floor(S.uniform_draw(seed, "boot", F.col("boot"), F.col("j")) * F.col("n")).cast("int"))
    )
    means = draws.join(placed.select("__pos", d), "__pos").groupBy("boot").agg(F.avg(d).alias("m"))
    ci = means.agg(F.percentile("m", 0.025).alias("ci_lo"), F.percentile("m", 0.975).alias("ci_hi"))
    return size.join(F.broadcast(ci), F.lit(True)).withColumnRenamed("n", "n_pairs")


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t for whole degrees of freedom: a finite sum over powers of the cosine of atan(t / sqrt(df)).

    Null without a t or a degree of freedom. One group's sum has df / 2 terms.
    """
    angle = F.atan(F.abs(t) / F.sqrt(df))
    c2, odd = F.cos(angle) * F.cos(angle), df % 2 == 1
    # each term is the last one times c2 and (2k-1)/(2k), or 2k/(2k+1) where df is odd
    last = F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("int")
    ratio = lambda k: F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
    first = F.when(odd, F.cos(angle)).otherwise(F.lit(1.0))
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * c2 * ratio(k.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(steps, start, add)["total"] * F.sin(angle)
    inside = F.when(odd, (angle + F.when(df > 1, series).otherwise(0.0)) * (2.0 / math.pi)).otherwise(series)
    return F.when((df >= 1) & t.isNotNull() & ~F.isnan(t), F.greatest(F.lit(1.0) - inside, F.lit(0.0)))


def paired_t_test(pairs: DataFrame, keys: Sequence[str], d: str) -> DataFrame:
    """Per group: pairs, mean, deviation, standard error, t and two-sided p."""
    n = F.count(d)
    sd = F.stddev_samp(d)
    out = pairs.groupBy(*keys).agg(n.alias("n"), F.avg(d).alias("mean_d"), sd.alias("sd_d"), (sd / F.sqrt(n)).alias("se"))
    t = F.when(F.col("se") > 0, F.col("mean_d") / F.col("se"))
    return out.withColumn("t", t).withColumn("p", t_two_sided(F.col("t"), F.col("n") - 1))


def signed_ranks(pairs: DataFrame, keys: Sequence[str], d: str) -> DataFrame:
    """Signed-rank statistic: zeros dropped and counted, mid-ranks of absolute differences, cut by value so that no key is ranked in one task."""
    x = F.abs(d).alias("__a")
    levels = pairs.filter(F.col(d).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("__rows"), F.sum((F.col(d) > 0).cast("long")).alias("__pos"))
    levels = levels.withColumn("__n", F.when(F.col("__a") > 0, F.col("__rows")).otherwise(F.lit(0)))
    placed = ordered.running_sum(levels, keys, [F.asc("__a")], ordered.value_bucket(F.col("__a")), "__n", "__upto")
    mid = F.col("__upto") - (F.col("__n") - 1) / 2.0
    return placed.withColumn("__mid", mid).groupBy(*keys).agg(
        F.sum("__n").alias("n"),
        F.sum(F.when(F.col("__a") > 0, F.col("__mid") * F.col("__pos")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("__a") > 0, F.col("__mid") * (F.col("__n") - F.col("__pos"))).otherwise(0.0)).alias("w_minus"),
        F.sum(F.col("__n") * F.col("__n") * F.col("__n") - F.col("__n")).alias("tie_term"),
        F.sum(F.col("__rows") - F.col("__n")).alias("n_zero"),
    ).filter("n > 0")


def wilcoxon_p_greater(w: float | None, n: int, tie_term: int, n_zero: int = 0, method: str = "auto") -> float | None:
    """One-sided p of ``W+``: exact counts of rank sums, or the normal limit with a correction for ties.

    ``auto`` takes exact counts for at most 50 pairs without ties or dropped zeros.
    """
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"unknown method: {method}")
    if w is None or n < 1:
        return None
    if method == "exact" or method == "auto" and n <= 50 and tie_term == 0 and n_zero == 0:
        ways = np.ones(1)
        for r in range(1, n + 1):
            ways = np.pad(ways, (0, r)) + np.pad(ways, (r, 0))
        return float(ways[math.ceil(w) :].sum() / ways.sum())
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - tie_term / 48.0
    return 0.5 * math.erfc((w - mean) / math.sqrt(2.0 * var)) if var > 0 else None


def wilcoxon_signed(pairs: DataFrame, keys: Sequence[str], d: str, method: str = "auto") -> DataFrame:
    @F.pandas_udf("double")
    def p(w: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon_p_greater(*row, method) for row in zip(w, n, ties, zeros, strict=True)], dtype=float)

    out = signed_ranks(pairs, keys, d)
    return out.withColumn("p_greater", p("w_plus", F.col("n"), F.col("tie_term"), F.col("n_zero")))


def recovery_threshold(df: DataFrame, keys: Sequence[str], level: str, exposure: str, metric: str, alpha: str, n_eff: str, at: float = 0.9,
                       weight: str | None = None) -> DataFrame:
    """Per level: the smallest exposure whose mean recovery reaches ``at``, else censored.

    ``weight`` counts a row several times, which is how resampled seeds are represented.
    """
    w = F.col(weight) if weight else F.lit(1.0)

    def wavg(c: str) -> Column:
        return F.sum(F.when(F.col(c).isNotNull(), w * F.col(c))) / F.sum(F.when(F.col(c).isNotNull(), w))

    cells = df.groupBy(*keys, level, exposure).agg(
        wavg(metric).alias("rec"), wavg(n_eff).alias("__neff"),
        F.sum(F.when(F.col(alpha).isNotNull(), w * F.col(alpha))).alias("__sa"), F.sum(F.when(F.col(alpha).isNotNull(), w)).alias("__na"),
    )
    hit = F.col("rec") >= at
    out = cells.groupBy(*keys, level).agg(
        (F.sum("__sa") / F.sum("__na")).alias("alpha"),
        F.min(F.when(hit, F.col(exposure))).alias("threshold"),
        F.min_by("__neff", F.when(hit, F.col(exposure))).alias("threshold_n_eff"),
    )
    good = F.col("threshold").isNotNull() & (F.col("alpha") > 0)
    return (
        out.withColumn("threshold", F.when(good, F.col("threshold")))
        .withColumn("threshold_n_eff", F.when(good, F.col("threshold_n_eff")))
        .withColumn("censored", (~good).cast("int"))
    )


def loglog_slope(thresholds: DataFrame, keys: Sequence[str], min_levels: int = 3) -> DataFrame:
    """Slope and intercept of log threshold on log alpha over uncensored levels."""
    ok = F.col("censored") == 0
    x = F.when(ok, F.log("alpha"))
    y = F.when(ok, F.log("threshold"))
    n = F.count_if(ok)
    return thresholds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_levels"), n.alias("n_uncensored"),
        F.when(n >= min_levels, F.regr_slope(y, x)).alias("slope"),
        F.when(n >= min_levels, F.regr_intercept(y, x)).alias("intercept"),
    )


def seed_bootstrap_slope(df: DataFrame, seed_col: str, level: str, exposure: str, metric: str, alpha: str, n_eff: str, n_boot: int,
                         seed: int, at: float = 0.9, min_good: int = 20) -> DataFrame:
    """Interval of the slope from resampled seeds, and whether it covers -2.

    A resample is a weight per (bootstrap id, seed); rows join to their weights.
    """
    spark = df.sparkSession
    seeds = df.select(seed_col).distinct().withColumn("__pos", F.row_number().over(Window.orderBy(seed_col)) - 1)
    size = seeds.agg(F.count(F.lit(1)).alias("__n"))
    draws = (
        spark.range(n_boot).select(F.col("id").alias("boot"))
        .join(F.broadcast(size), F.lit(True))
        .withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
        .withColumn("__pos", F.floor(S.uniform_draw(seed, "seedboot", F.col("boot"), F.col("__j")) * F.col("__n")).cast("int"))
        .groupBy("boot", "__pos").agg(F.count(F.lit(1)).cast("double").alias("__w"))
    )
    # reduce to one row per seed and cell before resampling, so resamples multiply only those
    cells = df.groupBy(seed_col, level, exposure).agg(
        F.avg(metric).alias(metric), F.avg(alpha).alias(alpha), F.avg(n_eff).alias(n_eff), F.count(F.lit(1)).alias("__rows")
    )
    rows = cells.join(seeds, seed_col).join(draws, "__pos").withColumn("__w", F.col("__w") * F.col("__rows"))
    slopes = loglog_slope(recovery_threshold(rows, ["boot"], level, exposure, metric, alpha, n_eff, at, "__w"), ["boot"])
    good = slopes.filter("slope IS NOT NULL")
    out = good.agg(F.count(F.lit(1)).alias("n_boot_ok"), F.percentile("slope", 0.025).alias("ci_lo"), F.percentile("slope", 0.975).alias("ci_hi"))
    enough = F.col("n_boot_ok") >= min_good
    return (
        out.withColumn("ci_lo", F.when(enough, F.col("ci_lo"))).withColumn("ci_hi", F.when(enough, F.col("ci_hi")))
        .withColumn("covers_neg2", F.coalesce((F.col("ci_lo") <= -2.0 + 1e-6) & (F.col("ci_hi") >= -2.0 - 1e-6), F.lit(False)))
    )


def nearest_level(df: DataFrame, column: str, requested: float | None) -> DataFrame:
    if requested is None:
        return df.agg(F.max(column).alias("level"))
    x = F.col(column).cast("double")
    return df.agg(F.min_by(x, F.struct(F.abs(x - F.lit(requested)), x)).alias("level"))


def lag_correlation(counts: DataFrame, keys: Sequence[str], item: str, b: str, n: str, bins: int, lags: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Pearson r of binned counts for every ordered pair of items at each lag, and the best lag.

    ``counts`` holds the non-empty bins only. Sums over all ``bins - lag`` positions follow
    from the non-empty cells, so empty bins are never materialised: the join runs on bins
    where both items are active. Rows outside ``[0, bins)`` take no part.
    """
    lag_arr = F.array(*[F.lit(i) for i in lags])
    counts = counts.filter((F.col(b) >= 0) & (F.col(b) < bins))  # both sides and all sums cover the same bins
    left = counts.select(*keys, F.col(item).alias("source"), F.col(b).alias("__b"), F.col(n).alias("__x")).withColumn("lag", F.explode(lag_arr))
    left = left.filter(F.col("__b") + F.col("lag") < bins).withColumn("__at", F.col("__b") + F.col("lag"))
    right = counts.select(*keys, F.col(item).alias("target"), F.col(b).alias("__at"), F.col(n).alias("__y"))
    cross = (
        left.join(right, [*keys, "__at"]).filter("source <> target")
        .groupBy(*keys, "source", "target", "lag").agg(F.sum(F.col("__x") * F.col("__y")).cast("double").alias("sxy"))
    )
    sx = left.groupBy(*keys, "source", "lag").agg(
        F.sum("__x").cast("double").alias("sx"), F.sum(F.col("__x") * F.col("__x")).cast("double").alias("sxx")
    )
    tail = right.withColumn("lag", F.explode(lag_arr)).filter(F.col("__at") >= F.col("lag"))
    sy = tail.groupBy(*keys, "target", "lag").agg(
        F.sum("__y").cast("double").alias("sy"), F.sum(F.col("__y") * F.col("__y")).cast("double").alias("syy")
    )
    from flockwise.operators.graph import ordered_pairs

    pairs = ordered_pairs(counts, keys, item).withColumnsRenamed({"src": "source", "dst": "target"}).withColumn("lag", F.explode(lag_arr))
    full = (
        pairs.join(sx, [*keys, "source", "lag"], "left").join(sy, [*keys, "target", "lag"], "left")
        .join(cross, [*keys, "source", "target", "lag"], "left").fillna(0.0, ["sx", "sxx", "sy", "syy", "sxy"])
    )
    m = F.lit(float(bins)) - F.col("lag")
    vx = m * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = m * F.col("syy") - F.col("sy") * F.col("sy")
    r = F.when((m >= 3) & (vx > 0) & (vy > 0), (m * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))
    long = full.select(*keys, "source", "target", "lag", r.alias("r"))
    best = long.groupBy(*keys, "source", "target").agg(
        F.min(F.when(F.col("r").isNotNull(), F.struct((-F.round("r", 12)).alias("k"), F.col("lag"), F.col("r")))).alias("__b"),
        F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("zero_lag_r"),
    )
    best = best.select(*keys, "source", "target", F.col("__b.lag").alias("best_lag"), F.col("__b.r").alias("best_r"), "zero_lag_r",
                       (F.col("__b.r") - F.col("zero_lag_r")).alias("lift_vs_zero"))
    return long, best


def band(x: Column | str, edges: Sequence[float] = (0.5, 1.0, 1.5)) -> Column:
    """Right-closed band number 0..len(edges)."""
    x = F.col(x) if isinstance(x, str) else x
    out = F.when(x.isNull(), F.lit(None).cast("int"))
    for i, e in enumerate(edges):
        out = out.when(x <= e, i)
    return out.otherwise(len(edges))


def band_summary(df: DataFrame, keys: Sequence[str], ratio: str, metrics: Sequence[str], edges: Sequence[float] = (0.5, 1.0, 1.5)) -> DataFrame:
    return (
        df.withColumn("band", band(ratio, edges)).filter("band IS NOT NULL").groupBy(*keys, "band")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(ratio).alias("ratio_mean"), *[F.avg(m).alias(f"{m}_mean") for m in metrics])
    )


# --- task grids and display -------------------------------------------------------------

# Method names with their accepted aliases.
METHOD_ALIASES = {
    "proposed": ("proposed", "ours", "regime"),
    "b1": ("b1", "static"),
    "b2": ("b2", "modular"),
    "b3": ("b3", "spectral"),
    "b4": ("b4", "degree"),
}


def resolve_methods(names: Sequence[str] | str) -> list[str]:
    """Canonical method names for a list of aliases; ``all`` means every method."""
    wanted = names.split(",") if isinstance(names, str) else list(names)
    lookup = {a: m for m, aliases in METHOD_ALIASES.items() for a in aliases}
    out: list[str] = []
    for name in (w.strip().lower() for w in wanted if w.strip()):
        if name != "all" and name not in lookup:
            raise ValueError(f"unknown method: {name}")
        out += [m for m in (METHOD_ALIASES if name == "all" else [lookup[name]]) if m not in out]
    return out


def task_grid(spark: SparkSession, base: DataFrame, **axes: Sequence) -> DataFrame:
    """Every base row with every combination of the axes, by exploding literal arrays."""
    out = base
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def phase_grid(df: DataFrame, share: str, horizon: str, metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(share, horizon).agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics], F.count(F.lit(1)).alias("n"))


def weaklink_role(df: DataFrame) -> DataFrame:
    """A weak receiver counts only when it is included and members and hub are exact."""
    ok = (F.col("weak_recovered") == 1) & (F.col("member_exact") == 1) & (F.col("hub_exact") == 1)
    return df.withColumn("weak_role_recovered", ok.cast("int"))


def display_table(summary: DataFrame, labels: Mapping[str, str], key: str, order: Sequence[str], metrics: Sequence[str], digits: int = 3) -> DataFrame:
    """Formatted rows in label order: fixed decimals, ``---`` for null."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    pos = F.array_position(F.array(*[F.lit(k) for k in labels]), F.col(key))
    cell = lambda c: F.coalesce(F.replace(F.format_number(F.col(c), digits), F.lit(","), F.lit("")), F.lit("---"))
    return (
        summary.filter(pos > 0).orderBy(pos, *order)
        .select(F.coalesce(names[F.col(key)], F.col(key)).alias("label"), *order, *[cell(m).alias(m) for m in metrics])
    )
