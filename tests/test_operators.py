"""Edge rules on tiny fixtures, and skew-safe primitives against plain windows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flockwise.operators import events as E
from flockwise.operators import intervals as I
from flockwise.operators import ordered as O
from flockwise.operators import ranking as K
from flockwise.operators import statistics as T
from flockwise.plans import pairs as P


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, with many ties."""
    rng = np.random.default_rng(1)
    key = np.where(rng.uniform(size=600) < 0.7, 0, rng.integers(1, 6, 600))
    return spark.createDataFrame(pd.DataFrame({"k": key, "id": np.arange(600), "x": np.round(rng.normal(size=600), 1)}))


def test_rank_lag_and_running_sum_equal_windows(skewed):
    w = Window.partitionBy("k").orderBy("x", "id")
    order, bucket = [F.asc("x"), F.asc("id")], O.value_bucket(F.col("x"))
    got = O.rank(skewed, ["k"], order, bucket, "rn").join(
        O.lag(skewed, ["k"], order, bucket, ["x"]).select("id", "prev_x"), "id").join(
        O.running_sum(skewed, ["k"], order, bucket, "id", "s").select("id", "s"), "id")
    want = skewed.withColumn("rn2", F.row_number().over(w)).withColumn("p2", F.lag("x").over(w)).withColumn("s2", F.sum("id").over(w))
    bad = got.join(want.select("id", "rn2", "p2", "s2"), "id").filter("rn <> rn2 OR s <> s2 OR NOT (prev_x <=> p2)")
    assert bad.count() == 0


def test_percentiles_equal_numpy(skewed):
    got = O.percentiles(skewed, ["k"], "x", {"a": 0.05, "b": 0.5, "c": 0.99}).toPandas().set_index("k")
    for k, g in skewed.toPandas().groupby("k"):
        np.testing.assert_allclose(got.loc[k][["a", "b", "c"]].values, np.percentile(g.x, [5, 50, 99]), atol=1e-12)


def test_interval_modes(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1.999,), (2.0,), (5.0,), (6.0,)], "t double")
    got = df.select(*[I.interval_index(F.col("t"), 2.0, F.lit(5.0), m).alias(m) for m in ("clip", "drop", "hist")]).toPandas()
    assert got["clip"].tolist() == [0, 0, 0, 1, 2, 2]
    assert got["drop"].fillna(-9).tolist() == [-9, 0, 0, 1, -9, -9]
    assert got["hist"].fillna(-9).tolist() == [-9, 0, 0, 1, 2, -9]


def test_grid_ends_at_horizon(spark):
    rows = I.interval_grid(spark.createDataFrame([(5.0,)], "T double"), 2.0).orderBy("b").collect()
    assert [(r.t_start, r.t_end) for r in rows] == [(0.0, 2.0), (2.0, 4.0), (4.0, 5.0)]


def test_auc_ties_and_one_class(spark):
    df = spark.createDataFrame([(0, 1, 0.5), (0, 0, 0.5), (0, 1, 0.9), (0, 0, 0.1), (1, 1, 0.3)], "k int, y int, s double")
    got = {r.k: r.auc for r in K.roc_auc(df, ["k"], "y", "s").collect()}
    assert got[0] == pytest.approx(3.5 / 4) and got[1] is None


def test_empty_sets_score_one_only_on_request(spark):
    df = spark.createDataFrame([([], [])], "p array<int>, t array<int>")
    a = df.select(K.set_prf(F.col("p"), F.col("t"))[2].alias("f"), K.set_prf(F.col("p"), F.col("t"), True)[2].alias("g")).first()
    assert a.f == 0.0 and a.g == 1.0


def test_one_to_one_join_rejects_duplicates(spark):
    a = spark.createDataFrame([(1, 0.5), (1, 0.6)], "k int, s double")
    b = spark.createDataFrame([(1, 1)], "k int, y int")
    with pytest.raises(Exception, match="duplicate keys in scores"):
        K.one_to_one_join(a, b, ["k"]).collect()


def test_removals_are_nested_prefixes(spark):
    bg = spark.createDataFrame([(0, i, float(i), 0) for i in range(40)], "session_id long, event_id long, t double, actor int")
    win = spark.createDataFrame([(0, 10.0, 20.0, 1)], "session_id long, s double, e double, z int")
    taken = []
    for n in (3, 12, 60):
        over = bg.limit(1).select("session_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("event_id"), F.lit(0).alias("actor"))
        out, report = E.volume_neutral_removal(bg, over, win, ["session_id"], 7)
        taken.append({r.event_id for r in out.filter("removed = 1").collect()})
        assert report.first().cap_hit == int(n > 40)
    assert taken[0] < taken[1] < taken[2] and len(taken[2]) == 40
    assert not any(10 <= i < 20 for i in taken[1])


def test_t_and_wilcoxon_p_values(spark):
    rows = [(2.0, 10), (1.0, 1), (1.0, 2), (2.5, 3), (-2.5, 3), (0.0, 7), (3.3, 29), (None, 4), (1.0, 0)]
    want = [0.07338803, 0.5, 0.42264973, 0.08770665, 0.08770665, 1.0, 0.00256, None, None]
    got = spark.createDataFrame(rows, "t double, df int").select(T.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    for r, w in zip(got, want, strict=True):
        assert r.p is None if w is None else r.p == pytest.approx(w, abs=3e-5)
    assert T.wilcoxon_p_greater(15.0, 5, 0) == pytest.approx(1 / 32)
    assert T.wilcoxon_p_greater(15.0, 5, 0, n_zero=1) == T.wilcoxon_p_greater(15.0, 5, 0, method="normal")
    pairs = spark.createDataFrame([(1, v) for v in (0.0, 0.0, 1.0, -1.0, 2.0, 3.0, None)] + [(2, 0.0)], "k int, d double")
    r = T.signed_ranks(pairs, ["k"], "d").collect()
    assert [(x.k, x.n, x.w_plus, x.w_minus, x.tie_term, x.n_zero) for x in r] == [(1, 4, 8.5, 1.5, 6, 2)]


def test_method_aliases():
    assert T.resolve_methods("ours,static") == ["proposed", "b1"]
    with pytest.raises(ValueError):
        T.resolve_methods("nope")


def test_pair_fit_climbs_and_ignores_chunking(spark):
    rng = np.random.default_rng(3)
    ev = pd.DataFrame({"session_id": 0, "event_id": np.arange(120), "t": np.sort(rng.uniform(0, 50, 120)), "actor": rng.integers(0, 2, 120), "mark": 0})
    events = spark.createDataFrame(ev)
    win = spark.createDataFrame([(0, 0.0, 20.0), (0, 25.0, 50.0)], "session_id long, s double, e double")
    seg = P.pair_segments(events, win, ["session_id"], 1, 5.0)
    fits = {(n, c): P.pairwise_coupling(seg, win, ["session_id"], 1, iters=n, chunk_rows=c).orderBy("src").collect() for n, c in ((2, None), (4, None), (4, 11))}
    assert fits[4, None][0].loglik >= fits[2, None][0].loglik - 1e-9
    for a, b in zip(fits[4, None], fits[4, 11]):
        assert a.w == pytest.approx(b.w, abs=1e-9) and a.loglik == pytest.approx(b.loglik, abs=1e-8)
    # first iteration's log-likelihood against the direct sum at the start values
    first = P.pairwise_coupling(seg, win, ["session_id"], 1, iters=1).first().loglik
    direct = 0.0
    inside = [ev[(ev.t > s) & (ev.t <= e)].assign(t=lambda d, s=s: d.t - s) for s, e in ((0, 20), (25, 50))]
    mu = np.maximum(np.bincount(pd.concat(inside).actor, minlength=2) / 45.0, 1e-3)
    alpha = np.array([[0.02, 0.05], [0.05, 0.02]])
    for g, length in zip(inside, (20.0, 25.0)):
        t, d = g.t.values, g.actor.values
        for n in range(len(t)):
            direct += np.log(mu[d[n]] + np.sum(alpha[d[n], d[:n]] * np.exp(-(t[n] - t[:n]))))
            direct -= np.sum(alpha[:, d[n]]) * (1 - np.exp(-(length - t[n])))
        direct -= mu.sum() * length
    assert first == pytest.approx(direct, abs=1e-8)
