"""Nulls, bounds, empty joins and hot keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flockwise.operators import batched, events as E
from flockwise.operators import history as H
from flockwise.operators import ordered, ranking, statistics
from flockwise.plans import em as EM
from flockwise.plans import selection as SE


def test_null_labels_take_no_code(spark):
    rows = [(None,)] * 5 + [("a",)] * 3 + [("b",)] * 2 + [("c",)]
    got = E.top_k_labels(spark.createDataFrame(rows, "label string"), "label", 2).collect()
    assert sorted((r.label, r.actor) for r in got) == [("a", 0), ("b", 1)]


def test_bins_outside_the_grid_change_no_correlation(spark):
    rng = np.random.default_rng(1)
    rows = [(item, b, int(rng.integers(1, 5))) for item in (0, 1) for b in range(20) if rng.random() < 0.7]
    table = lambda r: spark.createDataFrame(r, "item int, b int, n int")
    args = ([], "item", "b", "n", 20, [0, 1, 2])
    clean = statistics.lag_correlation(table(rows), *args)[0].orderBy("source", "target", "lag").collect()
    stray = statistics.lag_correlation(table([*rows, (1, 25, 50), (0, -3, 50), (1, 20, 9)]), *args)[0].orderBy("source", "target", "lag").collect()
    assert [r.r for r in clean] == pytest.approx([r.r for r in stray])


def test_an_empty_join_is_an_error(spark):
    left = spark.createDataFrame([(1, 0.5)], "k long, score double")
    right = spark.createDataFrame([(2, 1)], "k long, truth int")
    assert ranking.one_to_one_join(left, right.withColumn("k", F.lit(1).cast("long")), ["k"]).count() == 1
    with pytest.raises(Exception, match="is empty"):
        ranking.one_to_one_join(left, right, ["k"]).collect()


def test_layout_counts_what_it_leaves_out(spark):
    rows = [(1, i, float(i), 0, 0) for i in range(5)] + [(1, 9, 99.0, 0, 0), (2, 10, 1.0, 7, 0), (2, 11, 1.0, 0, 0), (2, 12, float("nan"), 0, 0)]
    lay = H.layout(spark.createDataFrame(rows, "fit_id long, event_id long, t double, actor int, mark int"), 2, 2, 1.0, 10.0)
    assert {r.fit_id: r.n_dropped for r in lay.dropped().collect()} == {1: 1, 2: 2}
    lay.release()


@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1.7e12, 1e3), (0.0, 1e-9)])
def test_a_hot_key_is_cut_at_any_magnitude(spark, shift, scale):
    """No bucket of a key that holds nearly all rows gets more than a few hundredths of them, and ranks stay exact."""
    df = spark.range(20_000).select((F.col("id") % 500 == 0).cast("int").alias("k"), (F.lit(shift) + F.rand(3) * scale).alias("x"), "id")
    df = df.cache()
    sizes = ordered.with_bucket(df, ordered.value_bucket(F.col("x"))).groupBy("k", ordered.BUCKET).count()
    assert sizes.agg(F.max("count")).first()[0] <= 600
    got = ordered.rank(df, ["k"], [F.asc("x"), F.asc("id")], ordered.value_bucket(F.col("x"))).toPandas()
    want = got.sort_values(["k", "x", "id"]).groupby("k").cumcount() + 1
    assert (got.rn == want.reindex(got.index)).all()
    df.unpersist()


def test_ranks_with_nulls_infinities_and_nan(spark):
    rows = [(i, v) for i, v in enumerate([None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.0, None])]
    df = spark.createDataFrame(rows, "id long, x double")
    got = {r.id: r.rn for r in ordered.rank(df, [], [F.asc("x"), F.asc("id")], ordered.value_bucket(F.col("x"))).collect()}
    assert got == {0: 1, 7: 2, 3: 3, 4: 4, 5: 5, 6: 6, 2: 7, 1: 8}


def test_first_events_prune_later_cells(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("k"), "id", (F.col("id") * 0.5).alias("t"))
    got = E.head_n_events(df, ["k"], 7, 10.0, order=["t", "id"]).collect()
    assert sorted(r.id for r in got) == list(range(14))


def test_runs_and_schedules():
    assert batched.runs(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert EM.floors(1) == (0.05, 0.05) and EM.floors(12) == EM.floors(99) == (0.005, 0.001)
    for b0, b1 in [(1.0, 9.0), (4.0, 1.0), (1e-9, 1e9)]:
        a, b = EM.decay_projection(b0, b1, EM.Settings())
        s = EM.Settings()
        assert s.beta_min * (1 - 1e-9) <= a and b <= s.beta_max * (1 + 1e-9) and b >= s.beta_ratio * a * (1 - 1e-9)
    assert EM.decay_projection(1.0, 9.0, EM.Settings()) == pytest.approx((1.0, 9.0))


def test_mixture_separates_two_groups():
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(-5, 0.3, 40), rng.normal(0, 0.3, 10)]
    weights = SE.mixture_weights(x)
    assert (weights[:40] < 0.01).all() and (weights[40:] > 0.99).all()


def test_smoothing_in_blocks_joins_nothing_and_equals_one_block(spark):
    """Messages go with the rows, so nothing is sent through the driver to be broadcast."""
    from flockwise.operators import smoothing as SM

    rng = np.random.default_rng(2)
    em = pd.DataFrame({"fit_id": np.repeat(np.arange(7), 21), "cand": 0, "b": np.tile(np.arange(21), 7), "ell0": rng.normal(0, 3, 147), "ell1": rng.normal(0, 3, 147)})
    em.loc[em.fit_id == 3, "ell1"] = np.nan  # a void series does not touch the others
    chains = pd.DataFrame({"fit_id": np.arange(7), "cand": 0, "eta_on": rng.uniform(0.01, 0.2, 7), "eta_off": rng.uniform(0.01, 0.2, 7)})
    e = spark.createDataFrame(em).withColumn("cand", F.col("cand").cast("int")).withColumn("b", F.col("b").cast("int"))
    c = SM.ctmc_chains(spark.createDataFrame(chains).withColumn("cand", F.col("cand").cast("int")), 2.0)
    cut, one = SM.forward_backward(e, c, 21, 7, block=4), SM.forward_backward(e, c, 21, 7)
    assert "Join" not in cut._jdf.queryExecution().optimizedPlan().toString()
    a, b = (x.filter("fit_id <> 3").orderBy("fit_id", "b").toPandas() for x in (cut, one))
    assert len(a) == 126
    np.testing.assert_allclose(a[["g0", "g1", "loglik"]].to_numpy(float), b[["g0", "g1", "loglik"]].to_numpy(float), rtol=1e-9)
    assert [x is None for x in a["xi"]] == [x is None for x in b["xi"]] == [k % 21 == 0 for k in range(126)]
    np.testing.assert_allclose(np.stack(a["xi"].dropna()), np.stack(b["xi"].dropna()), rtol=1e-8, atol=1e-12)


def test_sizes_meet_a_large_fit_in_many_tasks(spark):
    old = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(old, ("-1", "false", "8")):
            spark.conf.set(c, v)
        rows = spark.range(4000).select(F.col("id").alias("pos"), F.when(F.col("id") < 3900, 1).otherwise(F.col("id")).alias("fit_id"))
        sizes = rows.groupBy("fit_id").agg(F.min("pos").alias("__first"), F.count(F.lit(1)).alias("__size"))
        got = H.with_sizes(rows, sizes, 100).withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        for c, v in old.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert len(got) == 4000 and set(got[got.fit_id == 1][["__first", "__size"]].itertuples(index=False, name=None)) == {(0, 3900)}
    assert (got[got.fit_id > 1]["__first"] == got[got.fit_id > 1]["pos"]).all() and (got[got.fit_id > 1]["__size"] == 1).all()
    assert got.groupby("task").size().max() < 2000  # on the fit alone, one task holds all 3,900


def test_routes_are_ranked_alike_inside_and_across_chunks(spark):
    from flockwise.operators import likelihood as L

    rng, K, M, n = np.random.default_rng(5), 12, 2, 160
    ev = pd.DataFrame({"fit_id": np.where(np.arange(n) < 70, 1, np.arange(n) // 15), "event_id": np.arange(n), "t": rng.uniform(0, 96, n),
                       "actor": rng.integers(0, K, n), "mark": rng.integers(0, M, n)})
    events = spark.createDataFrame(ev)
    one = {"cand": 0, "nu": [0.01] * (K * M), "a0": [0.01] * (K * K), "a1": rng.uniform(0, 0.1, K * K).tolist(), "rho0": [0.5] * (M * M),
           "rho1": [0.25, 0.75, 0.6, 0.4], "beta0": 0.05, "beta1": 0.3}
    params = spark.createDataFrame(pd.DataFrame([{"fit_id": f, **one} for f in ev.fit_id.unique()])).withColumn("cand", F.lit(0))
    laid = {c: H.layout(events, K, M, 24.0, 96.0, chunk_rows=c) for c in (20, 1000)}
    assert laid[20].spans and laid[20].events.filter("NOT cut").count() and not laid[1000].spans
    row = lambda r: (r.fit_id, r.b, r.kind, r["rank"], r.route, round(r.mass, 9))
    want = sorted(map(row, L.top_routes(L.excitation_attribution(laid[1000], params)).collect()))
    for lay in laid.values():
        top = L.top_excitation(lay, params)
        assert sorted(map(row, top.collect())) == want
    # nothing is shuffled behind a pass over whole fits; before, all routes were
    assert "Window" not in top._jdf.queryExecution().optimizedPlan().toString()


def test_residuals_need_nothing_from_other_tasks(spark):
    from flockwise.operators import likelihood as L

    rng, n = np.random.default_rng(8), 90
    ev = pd.DataFrame({"fit_id": np.where(np.arange(n) < 70, 1, 2), "event_id": np.arange(n), "t": rng.integers(0, 90, n) / 1.0, "actor": rng.integers(0, 2, n), "mark": 0})
    one = {"nu": [0.1, 0.2], "a0": [0.0, 0.3, 0.2, 0.0], "a1": [0.0, 0.5, 0.4, 0.0], "rho0": [1.0], "rho1": [1.0], "beta0": 0.05, "beta1": 0.3}
    params = spark.createDataFrame(pd.DataFrame([{"fit_id": f, **one} for f in (1, 2)])).withColumn("cand", F.lit(0))
    weights = spark.createDataFrame([(f, b, (f + b) / 9.0, (2 * f + b) / 11.0) for f in (1, 2) for b in range(4)], "fit_id long, b int, w double, g1 double")
    want = {}
    for f, g in ev.sort_values(["fit_id", "t", "actor", "mark", "event_id"]).groupby("fit_id"):
        last, seen = 0.0, []
        for e in g.itertuples():
            b, dt = int(e.t // 24), e.t - last
            out = [(0.3, 0.2)[a] * np.exp(-0.05 * (last - t)) * (1 - np.exp(-0.05 * dt)) + (0.5, 0.4)[a] * (f + c) / 9.0 * np.exp(-0.3 * (last - t)) * (1 - np.exp(-0.3 * dt))
                   for a, t, c in seen]
            want[e.event_id] = 0.3 * dt + sum(out)
            seen.append((e.actor, e.t, b))
            last = e.t
    for rows in (7, 1000):
        lay = H.layout(spark.createDataFrame(ev), 2, 1, 24.0, 96.0, chunk_rows=rows)
        got = L.rescaled_residuals(lay, params, weights)
        assert {r.event_id: r.residual for r in got.collect()} == pytest.approx(want)
        # before, a window and joins over all events lay behind the pass
        assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_parameter_rows_move_in_bounded_groups(spark):
    from flockwise.plans import rows as R

    n = 1300
    params = spark.range(n).select(F.col("id").alias("fit_id"), F.lit(0).alias("cand"), *[F.array_repeat(F.col("id") / 7.0, 4 if a in ("a0", "a1") else 2 if a in ("nu", "g", "h", "u", "v") else 1).alias(a) for a in R.ARRAYS],
                                   *[F.lit(0.1).alias(s) for s in R.SCALARS]).coalesce(1)
    grown = R.update(params, 2, 1, lambda p: [{**p, "beta0": 0.0 * p["beta0"] + len(p["fit_id"])}], "").collect()
    assert sorted((r.fit_id, r.a0) for r in grown) == [(i, [i / 7.0] * 4) for i in range(n)]
    assert max(r.beta0 for r in grown) <= R.TOGETHER < n  # before, a batch of 10,000 rows and all its candidates stood in memory at once
