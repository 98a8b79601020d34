"""Counts, rates and start values computed from event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockwise.operators import ordered


def dense_cells(keys: DataFrame, **sizes: int) -> DataFrame:
    """Every key with every index combination, by exploding short ranges."""
    out = keys
    for name, n in sizes.items():
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out


def actor_mark_counts(df: DataFrame, keys: Sequence[str], k: int, m: int) -> DataFrame:
    counts = df.groupBy(*keys, "actor", "mark").agg(F.count(F.lit(1)).alias("__n"))
    cells = dense_cells(counts.select(*keys).distinct(), actor=k, mark=m)
    return cells.join(counts, [*keys, "actor", "mark"], "left").withColumn("n", F.coalesce("__n", F.lit(0))).drop("__n")


def rate_matrix(df: DataFrame, keys: Sequence[str], k: int, m: int, horizon: float, eps: float = 1e-6) -> DataFrame:
    """Rates per actor and mark, floored at 5% of the 5th percentile of the positive ones.

    The percentile runs over at most ``k * m`` cells per key.
    """
    nu = actor_mark_counts(df, keys, k, m).withColumn("rate", F.col("n") / F.lit(max(horizon, eps)))
    low = nu.groupBy(*keys).agg(F.percentile(F.when(F.col("rate") > 0, F.col("rate")), 0.05).alias("__p"))
    floor = F.greatest(F.coalesce(F.col("__p") * 0.05, F.lit(eps)), F.lit(eps))
    return nu.join(low, list(keys)).select(*keys, "actor", "mark", F.greatest("rate", floor).alias("nu"))


def mark_transitions(df: DataFrame, keys: Sequence[str], m: int, width: float, order: Sequence[str] = ("t", "mark", "event_id"),
                     prior: float = 1.0) -> DataFrame:
    """Row-normalised counts of consecutive marks of one actor, plus a prior count per cell."""
    rows = ordered.lag(df.select(*keys, "actor", *order), [*keys, "actor"], [F.asc(c) for c in order],
                       ordered.time_bucket(F.col("t"), width), ["mark"])
    pairs = rows.filter("prev_mark IS NOT NULL").groupBy(*keys, F.col("prev_mark").alias("src_mark"), F.col("mark").alias("dst_mark")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    cells = dense_cells(df.select(*keys).distinct() if keys else df.limit(1).select(F.lit(0).alias("__one")), src_mark=m, dst_mark=m).drop("__one")
    filled = cells.join(pairs, [*keys, "src_mark", "dst_mark"], "left").withColumn("__w", F.coalesce("__n", F.lit(0)) + F.lit(prior))
    share = F.col("__w") / F.sum("__w").over(Window.partitionBy(*keys, "src_mark"))
    return filled.select(*keys, "src_mark", "dst_mark", share.alias("p"))


def inter_arrivals(df: DataFrame, keys: Sequence[str], width: float, order: Sequence[str] = ("t", "event_id")) -> DataFrame:
    rows = ordered.lag(df.select(*keys, *order), keys, [F.asc(c) for c in order], ordered.time_bucket(F.col("t"), width), ["t"])
    return rows.filter("prev_t IS NOT NULL").withColumn("gap", F.col("t") - F.col("prev_t")).drop("prev_t")


def _clip(x: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    return F.greatest(F.least(x, F.lit(hi)), lo)


def decay_rate_init(df: DataFrame, keys: Sequence[str], width: float, day_scale: bool = False) -> DataFrame:
    """Start values for the slow and the fast decay from quantiles of the gaps.

    Keys without a usable gap get the defaults of the scale.
    """
    slow, fast = (0.75, 0.25) if day_scale else (0.5, 0.1)
    gaps = inter_arrivals(df, keys, width).filter("gap > 1e-8")
    q = ordered.percentiles(gaps, keys, "gap", {"__slow": slow, "__fast": fast})
    base = df.select(*keys).distinct()
    out = base.join(q, list(keys), "left") if keys else q
    if day_scale:
        b0 = _clip(1.0 / F.col("__slow"), 0.03, 1.0)
        b1 = _clip(1.0 / F.col("__fast"), b0 + 0.05, 4.0)
        d0, d1 = 0.2, 0.8
    else:
        b0 = _clip(1.0 / F.col("__slow"), 0.1, 1.0)
        b1 = _clip(1.0 / F.col("__fast"), b0 + 0.1, 8.0)
        d0, d1 = 1.0, 2.0
    return out.select(*keys, F.coalesce(b0, F.lit(d0)).alias("beta0"), F.coalesce(b1, F.lit(d1)).alias("beta1"))


def quantile_filter(df: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """Rows at or above their group's exact quantile; ties at the quantile stay."""
    cut = ordered.percentiles(df, keys, value, {"__cut": q})
    return df.join(cut, list(keys)).filter(F.col(value) >= F.col("__cut")).drop("__cut")


def precision_report(df: DataFrame, precision: str, width_days: str, t: str) -> tuple[DataFrame, DataFrame]:
    """Rows and share per precision level; and exact share, median width and tied-time share."""
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    levels = df.groupBy(precision).agg(F.count(F.lit(1)).alias("n"))
    levels = levels.join(F.broadcast(total), F.lit(True)).withColumn("share", F.col("n") / F.col("__total")).drop("__total")
    times = df.groupBy(t).agg(F.count(F.lit(1)).alias("__n"))
    ties = times.agg((1.0 - F.count(F.lit(1)) / F.sum("__n")).alias("tied_share"))
    exact = df.agg(F.avg((F.col(precision) == 1).cast("double")).alias("exact_share"))
    median = ordered.percentiles(df, [], width_days, {"median_width": 0.5})
    summary = exact.join(F.broadcast(ties), F.lit(True)).join(F.broadcast(median), F.lit(True))
    return levels, summary


def group_windows(df: DataFrame, group: str, year: str, years: int, step: int) -> DataFrame:
    """Every sliding window of whole years that fits each group's span."""
    span = df.groupBy(group).agg(F.min(year).alias("__lo"), F.max(year).alias("__hi"))
    return span.filter(F.col("__hi") - years + 1 >= F.col("__lo")).select(
        group, F.explode(F.sequence(F.col("__lo"), F.col("__hi") - (years - 1), F.lit(step))).alias("y0")
    )


def screen_windows(df: DataFrame, group: str, stream: str, year: str, precision: str, label: str, years: int, step: int,
                   top_k: int, min_events: int, min_streams: int, min_topk: int) -> DataFrame:
    """Rank group-windows by the events of their ``top_k`` busiest streams.

    Rows are first reduced to counts per (group, year, stream); windows are built from those
    counts, so the wide overlap of sliding windows never multiplies raw rows.
    """
    spans = group_windows(df, group, year, years, step)
    yearly = df.groupBy(group, year, stream).agg(
        F.count(F.lit(1)).alias("__n"), F.sum((F.col(precision) == 1).cast("long")).alias("__exact")
    )
    in_span = (F.col(year) >= F.col("y0")) & (F.col(year) < F.col("y0") + years)
    per = (
        spans.join(yearly, group).filter(in_span)
        .groupBy(group, "y0", stream).agg(F.sum("__n").alias("n"), F.sum("__exact").alias("exact"))
    )
    order = Window.partitionBy(group, "y0").orderBy(F.desc("n"), F.asc(stream))
    ranked = per.withColumn("__rn", F.row_number().over(order))
    top = F.col("__rn") <= top_k
    stats = ranked.groupBy(group, "y0").agg(
        F.sum("n").alias("total_events"),
        F.count(F.lit(1)).alias("n_streams"),
        F.sum(F.when(top, F.col("n"))).alias("topk_events"),
        F.count_if(top).alias("topk_streams"),
        F.percentile(F.when(top, F.col("n")), 0.5).alias("median_topk_count"),
        F.min(F.when(top, F.col("n"))).alias("min_topk_count"),
        F.max(F.when(top, F.col("n"))).alias("max_topk_count"),
        (F.sum("exact") / F.sum("n")).alias("exact_pct"),
        F.to_json(
            F.map_from_entries(
                F.transform(
                    F.array_sort(F.collect_list(F.when(top, F.struct("__rn", F.col(stream).cast("string").alias("s"), "n")))),
                    lambda e: F.struct(e["s"], e["n"]),
                )
            )
        ).alias("top_streams_json"),
    )
    label_year = df.groupBy(group, year, label).agg(F.count(F.lit(1)).alias("__n"))
    labels = spans.join(label_year, group).filter(in_span).groupBy(group, "y0", label).agg(F.sum("__n").alias("n"))
    lw = Window.partitionBy(group, "y0").orderBy(F.desc("n"), F.asc(label))
    top_labels = (
        labels.withColumn("__rn", F.row_number().over(lw)).filter("__rn <= 3")
        .groupBy(group, "y0")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rn", F.col(label).alias("l")))), lambda e: e["l"]), "; ").alias("top_labels"))
    )
    kept = stats.filter((F.col("total_events") >= min_events) & (F.col("n_streams") >= min_streams) & (F.col("topk_events") >= min_topk))
    final = Window.orderBy(F.desc("topk_events"), F.desc("total_events"), F.asc(group), F.asc("y0"))
    return kept.join(top_labels, [group, "y0"]).withColumn("rank", (F.row_number().over(final) - 1).cast("long"))


def effective_count(df: DataFrame, keys: Sequence[str], ring: Sequence[int], k: int, c0: float = 1.0, delta: float = 0.05) -> DataFrame:
    """Active-born events of ring members and the rate ``c0 sqrt(ln(K²/delta)/n)``."""
    n = F.count_if((F.col("z") == 1) & F.col("actor").isin(list(ring)))
    lam = F.when(F.col("n_eff") > 0, F.lit(c0) * F.sqrt(F.log(F.lit(float(k) ** 2 / delta)) / F.col("n_eff"))).otherwise(F.lit(float("inf")))
    return df.groupBy(*keys).agg(n.alias("n_eff")).withColumn("lambda_t", lam)


def active_exposure(path: DataFrame, keys: Sequence[str], horizon: float) -> DataFrame:
    on = F.col("z") == 1
    total = F.coalesce(F.sum(F.when(on, F.col("e") - F.col("s"))), F.lit(0.0))
    return path.groupBy(*keys).agg(
        total.alias("active_time"), (total / F.lit(horizon)).alias("active_share"), F.count_if(on).alias("episodes")
    )


def overlay_diagnostics(events: DataFrame, keys: Sequence[str], members: Sequence[int], source: int, weak: int, k: int,
                        horizon: float, active_time: float, delta: float = 0.05) -> DataFrame:
    """One row per key that compares background, overlay and removed counts of the planted set.

    ``events`` has ``actor, is_injected, removed, inside``. Everything is one conditional
    aggregate per actor, then one small aggregate over actors.
    """
    bg = F.col("is_injected") == 0
    per = events.groupBy(*keys, "actor").agg(
        F.count_if(bg).alias("orig"),
        F.count_if(~bg).alias("signal"),
        F.count_if(bg & (F.col("removed") == 1)).alias("conv"),
        F.count_if(bg & (F.col("inside") == 1)).alias("orig_active"),
    )
    everyone = dense_cells(events.select(*keys).distinct(), actor=k)
    per = everyone.join(per, [*keys, "actor"], "left").fillna(0, ["orig", "signal", "conv", "orig_active"])
    member = F.col("actor").isin(list(members))
    receiver = member & (F.col("actor") != source)

    def over(cond: Column, col: str, fn):
        return fn(F.when(cond, F.col(col)))

    aggs = [F.sum("orig").alias("orig_background"), F.sum("signal").alias("signal_all"), F.sum("conv").alias("removed_background"),
            F.sum("orig_active").alias("orig_bg_active")]
    leftover = F.col("orig") - F.col("conv")
    per = per.withColumn("left", leftover)
    for col in ("orig", "signal", "conv", "left"):
        for who, cond in (("member", member), ("receiver", receiver)):
            aggs += [
                over(cond, col, F.sum).alias(f"{col}_{who}_total"),
                over(cond, col, F.min).alias(f"{col}_{who}_min"),
                over(cond, col, F.avg).alias(f"{col}_{who}_mean"),
            ]
        aggs.append(over(F.col("actor") == source, col, F.max).alias(f"{col}_source"))
    aggs.append(over(F.col("actor") == weak, "signal", F.max).alias("weak_count"))
    one = per.groupBy(*keys).agg(*aggs)
    log_factor = F.log(F.lit(float(max(k, 1)) ** 2 / delta))
    expected = F.col("orig_background") / F.lit(max(horizon, 1e-9)) * F.lit(active_time)
    return (
        one.withColumn("expected_bg_active", expected)
        .withColumn("signal_to_expected", F.col("signal_member_total") / F.greatest(F.col("expected_bg_active"), F.lit(1e-9)))
        .withColumn("signal_to_observed", F.col("signal_member_total") / F.greatest(F.col("orig_bg_active").cast("double"), F.lit(1e-9)))
        .withColumn("weak_share", F.col("weak_count") / F.greatest(F.col("signal_receiver_total").cast("double"), F.lit(1.0)))
        .withColumn("nominal_lambda", F.sqrt(log_factor / F.greatest(F.col("signal_member_total").cast("double"), F.lit(1.0))))
        .withColumn("nominal_lambda_min_member", F.sqrt(log_factor / F.greatest(F.col("signal_member_min").cast("double"), F.lit(1.0))))
        .withColumn("volume_neutral_ratio", F.col("removed_background") / F.greatest(F.col("signal_all"), F.lit(1)))
        .withColumn("conversion_cap_hit", (F.col("removed_background") < F.col("signal_all")).cast("int"))
    )
