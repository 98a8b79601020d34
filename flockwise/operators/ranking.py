"""Rank statistics, selections and set metrics, for many groups at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockwise.operators import ordered


def top_flag(df: DataFrame, keys: Sequence[str], score: str, k: int, name: str, tie: str = "actor") -> DataFrame:
    """Flag the ``k`` best rows per key; equal scores favour the larger ``tie`` value."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(tie))
    return df.withColumn("__rn", F.row_number().over(w)).withColumn(name, (F.col("__rn") <= k).cast("int")).drop("__rn")


def ks_exp1(df: DataFrame, keys: Sequence[str], x: str, ids: Sequence[str] = ()) -> DataFrame:
    """Largest distance, on both sides, between the empirical and the Exp(1) distribution."""
    order = [F.asc(x), *[F.asc(i) for i in ids]]
    bucket = ordered.value_bucket(F.col(x))
    placed = ordered.rank(df.select(*keys, x, *ids), keys, order, bucket, "__i")
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = placed.join(size, list(keys)) if keys else placed.join(F.broadcast(size), F.lit(True))
    cdf = F.lit(1.0) - F.exp(-F.col(x))
    i, n = F.col("__i"), F.col("n")
    return joined.groupBy(*keys).agg(F.max(F.greatest(i / n - cdf, cdf - (i - 1) / n)).alias("ks"), F.first("n").alias("n"))


def qq_points(df: DataFrame, keys: Sequence[str], x: str, ids: Sequence[str] = ()) -> DataFrame:
    """Each sorted value with its rank, Exp(1) quantile and empirical distribution value."""
    order = [F.asc(x), *[F.asc(i) for i in ids]]
    placed = ordered.rank(df.select(*keys, x, *ids), keys, order, ordered.value_bucket(F.col(x)), "i")
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    joined = placed.join(size, list(keys)) if keys else placed.join(F.broadcast(size), F.lit(True))
    return joined.select(
        *keys, "i", x,
        (-F.log(1.0 - (F.col("i") - 0.5) / F.col("__n"))).alias("theory"),
        (F.col("i") / F.col("__n")).alias("ecdf"),
    )


def roc_auc(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """Pairwise AUC with half weight on ties; null if a class is empty.

    Rows collapse to per-score class counts, and a bucketed running sum of negatives gives
    every positive the number of negatives it beats: no pairs and no hot-key sort.
    """
    counts = df.groupBy(*keys, F.col(score).cast("double").alias("__s")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("__p"), F.sum((F.col(y) != 1).cast("long")).alias("__q")
    )
    run = ordered.running_sum(counts, keys, [F.asc("__s")], ordered.value_bucket(F.col("__s")), "__q", "__below", inclusive=False)
    wins = F.sum(F.col("__p") * (F.col("__below") + 0.5 * F.col("__q")))
    p, q = F.sum("__p"), F.sum("__q")
    return run.groupBy(*keys).agg(
        F.when((p > 0) & (q > 0), wins / (p.cast("double") * q)).alias("auc"), p.alias("positives"), q.alias("negatives")
    )


def largest_gap_select(df: DataFrame, keys: Sequence[str], score: str, min_k: int = 1, use_log: bool = False, tie: str = "actor") -> DataFrame:
    """Flag the items above the biggest drop of the sorted scores (first drop on ties)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(tie))
    level = F.log(F.greatest(F.col(score), F.lit(1e-12))) if use_log else F.col(score)
    placed = df.withColumn("__rn", F.row_number().over(w)).withColumn("__gap", level - F.lead(level).over(w))
    cut = placed.groupBy(*keys).agg(
        F.min(F.when(F.col("__gap").isNotNull(), F.struct((-F.col("__gap")).alias("g"), F.col("__rn").alias("r"))))["r"].alias("__cut")
    )
    split = F.greatest(F.coalesce("__cut", F.lit(1)), F.lit(min_k))
    out = placed.join(cut, list(keys)) if keys else placed.join(F.broadcast(cut), F.lit(True))
    return out.withColumn("selected", (F.col("__rn") <= split).cast("int")).drop("__rn", "__gap", "__cut")


def actor_rank(df: DataFrame, keys: Sequence[str], score: str, name: str = "rank", tie: str = "actor") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(tie))
    return df.withColumn(name, F.row_number().over(w))


def receiver_diagnostics(df: DataFrame, keys: Sequence[str], h: str, hub: int, receivers: Sequence[int], weak: int) -> DataFrame:
    """Receivers ranked without the hub: recovered set, its F1, rank and score of the weak one."""
    placed = actor_rank(df.filter(F.col("actor") != hub), keys, h, "__rank")
    n = len(receivers)
    chosen = F.col("__rank") <= n
    hit = chosen & F.col("actor").isin(list(receivers))
    is_weak = F.col("actor") == weak
    size = F.lit(float(n))
    tp = F.sum(hit.cast("int"))
    prec = tp / F.greatest(F.sum(chosen.cast("int")).cast("double"), F.lit(1.0))
    rec = tp / F.greatest(size, F.lit(1.0))
    return placed.groupBy(*keys).agg(
        (2 * prec * rec / F.greatest(prec + rec, F.lit(1e-12))).alias("receiver_f1"),
        F.coalesce(F.max(F.when(is_weak, chosen.cast("int"))), F.lit(0)).alias("weak_recovered"),
        F.coalesce(F.max(F.when(is_weak, F.col("__rank"))), F.lit(-1)).alias("weak_rank"),
        F.max(F.when(is_weak, F.col(h))).alias("weak_score"),
        F.array_sort(F.collect_list(F.when(chosen, F.col("actor")))).alias("predicted"),
    )


def metrics_at_edge_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 of the ``m`` best-scored pairs, ``m`` the number of true edges.

    Truth that is all positive or all negative raises when the row is read.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("src"), F.asc("dst"))
    sizes = df.groupBy(*keys).agg(F.sum("y_true").cast("long").alias("__m"), F.count(F.lit(1)).alias("__n"))
    placed = df.withColumn("__rn", F.row_number().over(order)).join(sizes, list(keys))
    picked = F.col("__rn") <= F.col("__m")
    tp = F.sum((picked & (F.col("y_true") == 1)).cast("long")).alias("tp")
    base = placed.groupBy(*keys).agg(tp, F.first("__m").alias("m"), F.first("__n").alias("n"))
    base = base.withColumn("m", F.when((F.col("m") > 0) & (F.col("m") < F.col("n")), F.col("m")).otherwise(
        F.raise_error(F.lit("edge truth needs both positives and negatives")).cast("long")))
    auc = roc_auc(df, keys, "y_true", "score").select(*keys, "auc")
    m, n = F.col("m"), F.col("n")
    f1 = F.col("tp") / m
    return base.join(auc, list(keys)).select(
        *keys, n.alias("n_pairs"), m.alias("n_edges"), (n - m).alias("n_non_edges"), (m / n).alias("edge_density"),
        f1.alias("precision_at_m"), f1.alias("recall_at_m"), f1.alias("f1_at_m"), "auc",
        (m / n).alias("chance_f1_at_m"), F.lit(0.5).alias("chance_auc"),
        (f1 - m / n).alias("f1_lift_over_chance"), (F.col("auc") - 0.5).alias("auc_lift_over_chance"),
        (F.lit(1.0) / (m * (n - m))).alias("auc_granularity"),
    )


def one_to_one_join(scores: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails on duplicate keys on either side, and if it has no row.

    The check rides along: each side is grouped by the join keys anyway, and a group larger
    than one raises inside the job.
    """
    def unique(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in rest])
        guard = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"duplicate keys in {side}")).cast("long")).otherwise(F.col("__n"))
        return g.withColumn("__n", guard).filter("__n = 1").drop("__n")

    return require_rows(unique(scores, "scores").join(unique(truth, "truth"), list(keys)), "join of scores and truth")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, with a count beside it that raises inside the job if there is no row."""
    empty = F.when(F.col("__n") == 0, F.raise_error(F.lit(f"{what} is empty")).cast("boolean")).otherwise(F.lit(False))
    guard = df.agg(F.count(F.lit(1)).alias("__n")).filter(empty)
    return df.unionByName(guard.select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes]))


# --- sets -------------------------------------------------------------------------------


def set_prf(pred: Column, truth: Column, empty_is_one: bool = False) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two id arrays."""
    p, t = F.array_distinct(pred), F.array_distinct(truth)
    tp = F.size(F.array_intersect(p, t)).cast("double")
    prec = tp / F.greatest(F.size(p), F.lit(1))
    rec = tp / F.greatest(F.size(t), F.lit(1))
    f1 = 2.0 * prec * rec / F.greatest(prec + rec, F.lit(1e-12))
    if empty_is_one:
        both = (F.size(p) == 0) & (F.size(t) == 0)
        return prec, rec, F.when(both, F.lit(1.0)).otherwise(f1)
    return prec, rec, f1


def set_equal(a: Column, b: Column) -> Column:
    return ((F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)).cast("int")


def exact_support(df: DataFrame) -> DataFrame:
    """Exact matches of ``pred_ring/true_ring``, ``pred_receivers/true_receivers``, ``hub_pred/true_hub``."""
    out = (
        df.withColumn("member_exact", set_equal(F.col("pred_ring"), F.col("true_ring")))
        .withColumn("receiver_exact", set_equal(F.col("pred_receivers"), F.col("true_receivers")))
        .withColumn("hub_exact", (F.col("hub_pred") == F.col("true_hub")).cast("int"))
    )
    both = F.col("member_exact") * F.col("receiver_exact")
    return out.withColumn("member_receiver_exact", both).withColumn("all_role_exact", both * F.col("hub_exact"))


def membership_metrics(df: DataFrame, keys: Sequence[str], pred: str, truth: str) -> DataFrame:
    """Long-form precision, recall, F1 from 0/1 flags per item."""
    tp = F.sum((F.col(pred) * F.col(truth)).cast("double"))
    prec = tp / F.greatest(F.sum(pred), F.lit(1))
    rec = tp / F.greatest(F.sum(truth), F.lit(1))
    return df.groupBy(*keys).agg(
        prec.alias("precision"), rec.alias("recall"), (2.0 * prec * rec / F.greatest(prec + rec, F.lit(1e-12))).alias("f1")
    )


# --- concentration and posterior gaps ---------------------------------------------------


def gini_support(df: DataFrame, keys: Sequence[str], x: str, ids: Sequence[str]) -> DataFrame:
    """Gini index of the non-negative part and effective support ``(Σx)²/Σx²``."""
    clean = df.filter(F.col(x).isNotNull() & ~F.isnan(x)).withColumn("__x", F.greatest(F.col(x), F.lit(0.0)))
    placed = ordered.rank(clean, keys, [F.asc("__x"), *[F.asc(i) for i in ids]], ordered.value_bucket(F.col("__x")), "__i")
    s, n = F.sum("__x"), F.count(F.lit(1))
    gini = F.when(s == 0, F.lit(0.0)).otherwise(2.0 * F.sum(F.col("__i") * F.col("__x")) / (n * s) - (n + 1.0) / n)
    return placed.groupBy(*keys).agg(
        gini.alias("gini"), (s * s / F.greatest(F.sum(F.col("__x") * F.col("__x")), F.lit(1e-300))).alias("effective_support")
    )


def posterior_gap(df: DataFrame, keys: Sequence[str], hat: str, star: str, truth: str, n: str, lam: Column) -> DataFrame:
    """Gap of a fitted posterior to a reference one on intervals with events.

    A label flip is undone first when ``1 - hat`` is closer in squared error.
    """
    on = df.filter(F.col(n) > 0)
    a, b = F.col(hat), F.col(star)
    flip = on.groupBy(*keys).agg(
        (F.sum((a - b) * (a - b)) > F.sum((1.0 - a - b) * (1.0 - a - b))).alias("__flip")
    )
    joined = on.join(flip, list(keys)).withColumn("__h", F.when(F.col("__flip"), 1.0 - a).otherwise(a))
    gap = joined.withColumn("__gap", F.abs(F.col("__h") - b))
    w = F.col(n).cast("double")
    wmean = lambda e: F.sum(w * e) / F.sum(w)
    tr = F.col(truth).cast("double")
    p95 = ordered.percentiles(gap, keys, "__gap", {"gap_p95": 0.95})
    out = gap.groupBy(*keys).agg(
        F.max("__gap").alias("gap_max"), F.avg("__gap").alias("gap_mean"), wmean(F.col("__gap")).alias("gap_wmean"),
        wmean(F.abs(b - tr)).alias("bayes_gap_wmean"),
        wmean((F.col("__h") - tr) * (F.col("__h") - tr)).alias("brier_hat"), wmean((b - tr) * (b - tr)).alias("brier_star"),
        # not corr(): an aggregate divides before the condition is looked at
        F.when((F.stddev_pop("__h") > 1e-12) & (F.stddev_pop(tr) > 1e-12), F.covar_pop("__h", tr) / (F.stddev_pop("__h") * F.stddev_pop(tr))).alias("truth_corr"),
    )
    return out.join(p95, list(keys)).withColumn("gap_over_lambda", F.col("gap_wmean") / lam)
