"""Fits over every session: EM steps, variants, baselines, held-out scores, diagnostics.

Every fit runs up to the limit of its preset or operator and stops earlier by its own rule.
"""

from pyspark.sql import functions as F

from flockwise.operators import graph as G
from flockwise.operators import intervals as I
from flockwise.operators import likelihood as L
from flockwise.operators import smoothing as S
from flockwise.plans import baselines as B
from flockwise.plans import diagnostics as D
from flockwise.plans import em as EM
from flockwise.plans import heldout as HO
from flockwise.plans import pairs as PR
from flockwise.plans import rows as R
from flockwise.plans import selection as SE
from flockwise.plans import steps as ST
from flockwise.plans import study as SY
from flockwise.session import cut_lineage, scratch_path
from workload import canon as C
from workload.aggregates import binned
from workload.processes import EMIT, GATES, NB, OFF, ON, P00, P11, SMOOTHED, SMOOTHED_PRESENT, fits, fixed_params, gates, laid_out, named, setup
from workload.registry import query, rounded


def start(spark, sf, **kw):
    lay = laid_out(spark, sf)
    return lay, cut_lineage(EM.init_params(lay.events, C.K, C.M, C.HORIZON, **kw))


def summary(params, *more):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return named(params.select("fit_id", *[total(c).alias(f"sum_{c}") for c in ("nu", "a0", "a1", "g", "h")], "beta0", "beta1", "eta_on", "eta_off", *more))


@query("estep", SMOOTHED)
def estep(spark, sf):
    return named(S.estep(*setup(spark, sf)).select("fit_id", "b", "g0", "g1", "loglik"))


@query("estep_present", SMOOTHED_PRESENT)
def estep_present(spark, sf):
    lay, params, _ = setup(spark, sf)
    return named(S.estep(lay, params, None, present=True).select("fit_id", "b", "g0", "g1", "loglik"))


@query("init_params")
def init_params(spark, sf):
    return summary(start(spark, sf, adaptive=True)[1])


def clamped(spark, sf):
    lay, init = start(spark, sf)
    w = cut_lineage(setup(spark, sf)[2])
    vec = L.score_and_gradient(lay, init, w).select("fit_id", "vec")
    cur = init.join(vec, "fit_id").withColumn("pen", F.lit(0.0)).withColumn("stop", F.lit(False))
    return lay, cur, w


def moved(lay, cur, w, propose, tol):
    return EM._choose(EM._score(lay, R.update(cur, C.K, C.M, propose, EM.WORK), w), tol)


@query("gate_step")
def gate_step(spark, sf):
    return summary(moved(*clamped(spark, sf), lambda p: EM.gate_candidates(p, C.K, C.M, 0.02, 0.02, 0.01, 0.01), EM.GATE_TOL))


@query("nuisance_step")
def nuisance_step(spark, sf):
    """Every block from the same start."""
    lay, cur, w = clamped(spark, sf)
    cur, out = cut_lineage(cur), None
    for name in ("a0", "rho0", "rho1"):
        one = moved(lay, cur, w, lambda p, name=name: EM.block_candidates(p, C.K, C.M, name, 0.0025, 0.05, False), 0.0)
        one = summary(one, "rho0", "rho1").withColumn("block", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("decay_step")
def decay_step(spark, sf):
    """All steps of the decays' ascent."""
    lay, cur, w = clamped(spark, sf)
    for _ in range(ST.DECAY_STEPS):
        cur = cut_lineage(EM.decay_step(lay, cur, w, EM.REPLICATION))
    return summary(cur)


def lse(a, b):
    return f"(greatest({a}, {b}) + ln(1 + exp(-abs(({a}) - ({b})))))"


def moves(a: float, b: float, c: float, d: float) -> str:
    """Forward and backward sums over ``em`` (session_id, b, e0, e1) with the given transition, and the expected moves as ``mv``."""
    p = {k: f"ln({v!r}::DOUBLE)" for k, v in zip(("00", "01", "10", "11"), (a, b, c, d))}
    return f"""fw AS (SELECT session_id, b, s0 + e0 AS x0, s1 + e1 AS x1 FROM em, st0 WHERE b = 0
  UNION ALL SELECT f.session_id, e.b, e.e0 + {lse(f"x0 + {p['00']}", f"x1 + {p['10']}")}, e.e1 + {lse(f"x0 + {p['01']}", f"x1 + {p['11']}")} FROM fw f JOIN em e ON e.session_id = f.session_id AND e.b = f.b + 1),
bw AS (SELECT session_id, b, 0::DOUBLE AS y0, 0::DOUBLE AS y1 FROM em WHERE b = {NB - 1}
  UNION ALL SELECT k.session_id, e.b - 1, {lse(f"{p['00']} + e.e0 + y0", f"{p['01']} + e.e1 + y1")}, {lse(f"{p['10']} + e.e0 + y0", f"{p['11']} + e.e1 + y1")}
  FROM bw k JOIN em e ON e.session_id = k.session_id AND e.b = k.b WHERE k.b > 0),
ll AS (SELECT session_id, {lse('x0', 'x1')} AS ll FROM fw WHERE b = {NB - 1}),
mv AS (SELECT f.session_id, sum(exp(x0 + {p['00']} + e0 + y0 - ll)) AS x00, sum(exp(x0 + {p['01']} + e1 + y1 - ll)) AS x01, sum(exp(x1 + {p['10']} + e0 + y0 - ll)) AS x10, sum(exp(x1 + {p['11']} + e1 + y1 - ll)) AS x11
  FROM fw f JOIN em e ON e.session_id = f.session_id AND e.b = f.b + 1 JOIN bw k ON k.session_id = e.session_id AND k.b = e.b JOIN ll ON ll.session_id = f.session_id GROUP BY 1)"""


RATES = f"""
WITH RECURSIVE {EMIT.replace('em AS (', 'em_all AS (')}, em AS (SELECT session_id, b, ell0 AS e0, ell1 AS e1 FROM em_all), st0 AS (SELECT ln({OFF / (ON + OFF)!r}::DOUBLE) AS s0, ln({ON / (ON + OFF)!r}::DOUBLE) AS s1),
{moves(P00, 1 - P00, 1 - P11, P11)},
p AS (SELECT session_id, x01 / (x00 + x01) AS up, x10 / (x10 + x11) AS down, (x01 + x11) / (x00 + x01 + x10 + x11) AS ones FROM mv),
r AS (SELECT session_id, CASE WHEN up + down < 1 THEN -ln(1 - up - down) / 24.0::DOUBLE ELSE 50.0::DOUBLE END AS rate, CASE WHEN up + down < 1 THEN up / (up + down) ELSE ones END AS share FROM p)
SELECT session_id, round(ll, 6) AS loglik, round(greatest(least(share * rate, 5.0::DOUBLE), 1e-4::DOUBLE), 6) AS eta_on, round(greatest(least((1 - share) * rate, 5.0::DOUBLE), 1e-4::DOUBLE), 6) AS eta_off
FROM r JOIN ll USING (session_id)"""


@query("switch_rate_step", RATES)
def switch_rate_step(spark, sf):
    lay, params, weights = setup(spark, sf)
    xi = S.xi_sums(S.estep(lay, params, weights))
    return named(EM.switch_rate_table(xi, 0.03, 0.3, C.DT, EM.REPLICATION))


@query("mstep")
def mstep(spark, sf):
    lay, init = start(spark, sf)
    post = cut_lineage(S.estep(lay, init, EM.start_weights(lay, init, 0.15)))
    return summary(EM.mstep(lay, init, post.select("fit_id", "b", F.col("g1").alias("w"), "g1"), S.xi_sums(post), EM.REPLICATION))


def squared(key: str, times: int) -> str:
    """The matrices ``m0`` (key, i, j, x) raised to the power 2^times, scaled on the way; ``lead``: their leading eigenvectors."""
    steps = [f"""
q{k} AS (SELECT a.{key}, a.i, b.j, sum(a.x * b.x) AS x FROM m{k} a JOIN m{k} b ON a.{key} = b.{key} AND a.j = b.i GROUP BY 1, 2, 3),
m{k + 1} AS (SELECT {key}, i, j, x / max(x) OVER (PARTITION BY {key}) AS x FROM q{k}),""" for k in range(times)]
    return "".join(steps) + f"""
lead AS (SELECT {key}, i, sum(x) AS v FROM m{times} GROUP BY 1, 2)"""


PROJECTION = f"""
WITH {GATES}, w AS (SELECT session_id, src AS i, dst AS j, 0.05::DOUBLE + g * h * (ln(1 + exp(-abs(d))) + greatest(d, 0)) AS x FROM dot),
c AS (SELECT session_id, avg(o) AS c FROM (SELECT session_id, i, sum(x) AS o FROM w GROUP BY 1, 2) GROUP BY 1),
m0 AS (SELECT * FROM w UNION ALL SELECT DISTINCT session_id, i, i, c FROM w JOIN c USING (session_id)),
{squared("session_id", 14)},
s AS (SELECT session_id, sum(v) AS total FROM lead GROUP BY 1),
r AS (SELECT w.session_id, sum(w.x * v.v) / max(s.total) AS radius FROM w JOIN lead v ON v.session_id = w.session_id AND v.i = w.j JOIN s ON s.session_id = w.session_id GROUP BY 1)
SELECT session_id, round(radius, 6) AS radius, round(CASE WHEN radius > 0.95 THEN least(0.8::DOUBLE / radius, 1) ELSE 1.0::DOUBLE END, 6) AS scale FROM r"""


@query("stability_projection", PROJECTION)
def stability_projection(spark, sf):
    """Radius of each session's joint coupling, and its scale factor; the SQL raises matrices to a high power instead."""
    a = G.active_coupling(gates(spark, sf), ["session_id"])
    routine = a.withColumn("w", F.lit(0.05))
    return rounded(G.stability_scale(routine, a, ["session_id"]))


@query("fit_regime_model")
def fit_regime_model(spark, sf):
    lay, init = start(spark, sf)
    return named(EM.fit_regime_model(lay, init, EM.REPLICATION).trace)


@query("fit_variant")
def fit_variant(spark, sf):
    """All variants side by side in one job."""
    lay = laid_out(spark, sf)
    runs = []
    for variant in EM.VARIANTS:
        init = cut_lineage(EM.init_params(lay.events, C.K, C.M, C.HORIZON, dense=variant == "dense_active_block"))
        runs.append(EM.local.Run(init, EM.with_settings(EM.REPLICATION, variant=variant)))
    out = None
    for variant, fit in zip(EM.VARIANTS, EM.fit_all(lay, runs), strict=True):
        one = fit.trace.withColumn("variant", F.lit(variant))
        out = one if out is None else out.unionByName(one)
    return named(out)


@query("fit_static_gates")
def fit_static_gates(spark, sf):
    lay, init = start(spark, sf)
    return named(EM.fit_static_gates(lay, init, EM.REPLICATION).trace)


def count_grid(spark, sf):
    ev = binned(C.events(spark, sf))
    return I.interval_counts(ev, I.interval_grid(C.sessions(ev), C.DT).select("session_id", "b"), ["session_id"]).withColumnRenamed("session_id", "fit_id")


@query("fit_count_hmm")
def fit_count_hmm(spark, sf):
    counts = count_grid(spark, sf)
    return named(B.fit_count_hmm(counts, NB, counts.select("fit_id").distinct().count())[0])


PMF = "n * ln({r}) - {r} - lf"
HMM_ROUND = f"""
WITH RECURSIVE {C.EV}, {C.GRID}, {C.EVB}, ct AS (SELECT g.session_id, g.b, CAST(count(e.event_id) AS BIGINT) AS n FROM grid g LEFT JOIN evb e USING (session_id, b) GROUP BY 1, 2),
mn AS (SELECT session_id, greatest(avg(n), 1e-3::DOUBLE) AS m FROM ct GROUP BY 1),
st AS (SELECT session_id, greatest(0.5::DOUBLE * m, 1e-3::DOUBLE) AS r0, greatest(1.5::DOUBLE * m, greatest(0.5::DOUBLE * m, 1e-3::DOUBLE) + 1e-3::DOUBLE) AS r1 FROM mn),
em AS (SELECT session_id, b, n, {PMF.format(r='r0')} AS e0, {PMF.format(r='r1')} AS e1 FROM (SELECT *, lgamma(n + 1) AS lf FROM ct) JOIN st USING (session_id)),
st0 AS (SELECT ln(0.9::DOUBLE) AS s0, ln(0.1::DOUBLE) AS s1),
{moves(0.95, 0.05, 0.1, 0.9)},
g AS (SELECT e.session_id, e.b, n, exp(x0 + y0 - ll) AS g0, exp(x1 + y1 - ll) AS g1 FROM em e JOIN fw USING (session_id, b) JOIN bw USING (session_id, b) JOIN ll ON ll.session_id = e.session_id),
r AS (SELECT session_id, greatest(sum(g0 * n) / sum(g0), 1e-3::DOUBLE) AS r0, greatest(sum(g1 * n) / sum(g1), 1e-3::DOUBLE) AS r1 FROM g GROUP BY 1),
o AS (SELECT session_id, ll, r0, r1, x00 / (x00 + x01) AS p00, x11 / (x10 + x11) AS p11 FROM r JOIN mv USING (session_id) JOIN ll USING (session_id))
SELECT session_id, round(ll, 6) AS loglik, CAST(1 AS INTEGER) AS iterations, round(least(r0, r1), 6) AS rate0, round(greatest(r0, r1), 6) AS rate1,
  round(CASE WHEN r0 > r1 THEN p11 ELSE p00 END, 6) AS p00, round(CASE WHEN r0 > r1 THEN p00 ELSE p11 END, 6) AS p11 FROM o"""


@query("count_hmm_round", HMM_ROUND)
def count_hmm_round(spark, sf):
    """One round of the count HMM from its first start."""
    counts = count_grid(spark, sf)
    return named(B.fit_count_hmm(counts, NB, counts.select("fit_id").distinct().count(), restarts=1, max_iters=1)[0].drop("failed"))


@query("pairwise_coupling")
def pairwise_coupling(spark, sf):
    ev = fits(spark, sf)
    win = C.windows(spark, C.events(spark, sf)).withColumnRenamed("session_id", "fit_id")
    seg = PR.pair_segments(ev, win, ["fit_id"], C.M, C.DT)
    return named(PR.pairwise_coupling(seg, win, ["fit_id"], C.M))


@query("modular_pipeline")
def modular_pipeline(spark, sf):
    counts = count_grid(spark, sf)
    n = counts.select("fit_id").distinct().count()
    return named(B.modular_pipeline(fits(spark, sf), counts, C.DT, C.HORIZON, C.K, C.M, n, 3)["roles"])


@query("fit_full_matrix")
def fit_full_matrix(spark, sf):
    return summary(B.fit_full_matrix(laid_out(spark, sf)))


SPECTRAL = f"""
WITH {C.EV}, {C.ES.split('et AS (SELECT')[0].rstrip().rstrip(',')}, m0 AS (SELECT a.seed, a.dst AS i, b.dst AS j, sum(a.score * b.score) AS x FROM es a JOIN es b ON a.seed = b.seed AND a.src = b.src GROUP BY 1, 2, 3),
{squared("seed", 14)},
rt AS (SELECT seed, i AS actor, v / sqrt(sum(v * v) OVER (PARTITION BY seed)) AS v FROM lead),
lf AS (SELECT es.seed, src AS actor, sum(score * v) AS u FROM es JOIN rt ON rt.seed = es.seed AND rt.actor = es.dst GROUP BY 1, 2),
n AS (SELECT seed, actor, u / sqrt(sum(u * u) OVER (PARTITION BY seed)) AS u, v, sqrt(u / sqrt(sum(u * u) OVER (PARTITION BY seed)) * v) AS score FROM lf JOIN rt USING (seed, actor))
SELECT seed, actor, round(u, 6) AS u, round(v, 6) AS v, round(score, 6) AS score, CAST(CASE WHEN row_number() OVER (PARTITION BY seed ORDER BY score DESC, actor DESC) <= 3 THEN 1 ELSE 0 END AS INTEGER) AS member,
  CAST(CASE WHEN row_number() OVER (PARTITION BY seed ORDER BY u DESC, actor DESC) <= 1 THEN 1 ELSE 0 END AS INTEGER) AS hub FROM n"""


@query("spectral_members", SPECTRAL)
def spectral_members(spark, sf):
    e = C.edge_table(spark, sf).withColumnRenamed("score", "w")
    return rounded(G.spectral_members(e, ["seed"], 3))


@query("select_mixture")
def select_mixture(spark, sf):
    return rounded(SE.select_mixture(gates(spark, sf), ["session_id"]))


@query("select_posterior_ring")
def select_posterior_ring(spark, sf):
    a = gates(spark, sf)
    return rounded(SE.select_posterior_ring(a, G.active_coupling(a, ["session_id"]), ["session_id"]))


@query("heldout_regime")
def heldout_regime(spark, sf):
    return named(HO.heldout_regime(fits(spark, sf), C.K, C.M, C.DT, C.HORIZON, 0.2, EM.REAL_DATA))


@query("heldout_static")
def heldout_static(spark, sf):
    b1 = HO.heldout_static_gates(fits(spark, sf), C.K, C.M, C.DT, C.HORIZON, 0.2, EM.REAL_DATA).withColumn("method", F.lit("static_gates"))
    b3 = HO.heldout_full_matrix(fits(spark, sf), C.K, C.M, C.DT, C.HORIZON, 0.2, iters=200).withColumn("method", F.lit("full_matrix"))
    return named(b1.unionByName(b3))


@query("oracle_posterior")
def oracle_posterior(spark, sf):
    lay = laid_out(spark, sf)
    return named(D.oracle_posterior(lay, fixed_params(lay)).select("fit_id", "b", "g1", "loglik"))


@query("fit_clamped")
def fit_clamped(spark, sf):
    lay, init = start(spark, sf)
    star = cut_lineage(S.estep(lay, fixed_params(lay), setup(spark, sf)[2]))
    clamp = D.corrupt_posterior(star.select("fit_id", "b", "g1"), F.lit(0.2), "flatten", 1, ["fit_id", "b"])
    return summary(D.fit_clamped(lay, init, clamp, cut_lineage(S.xi_sums(star)), EM.REPLICATION).params)


@query("dose_response")
def dose_response(spark, sf):
    lay, init = start(spark, sf)
    ev = binned(C.events(spark, sf))
    truth = I.active_event_truth(ev, I.interval_grid(C.sessions(ev), C.DT), ["session_id"]).select(
        F.col("session_id").alias("fit_id"), "b", F.coalesce("birth_fraction", F.lit(0.0)).alias("birth"), F.col("n_events").alias("n"))
    out = D.dose_response(lay, fixed_params(lay), init, cut_lineage(truth), [0, 1], 0, 0.25, EM.REPLICATION)
    return named(out)


@query("study_run", f"""
WITH {C.EV}, n AS (SELECT session_id, count(*) FILTER (WHERE t < 576) AS early, count(*) FILTER (WHERE t >= 576) AS late FROM ev WHERE t BETWEEN 0 AND 720 GROUP BY 1),
s AS (SELECT session_id, early, late FROM n UNION ALL SELECT -1, NULL, NULL),
m AS (SELECT * FROM (VALUES ('b1'), ('b2'), ('b3'), ('proposed')) m(method))
SELECT session_id, method, CASE WHEN least(early, late) >= 10 THEN 'ok' ELSE 'error' END AS status, CASE WHEN least(early, late) >= 10 THEN late END AS test_events,
  CAST(CASE WHEN least(early, late) < 10 OR early IS NULL THEN CASE WHEN method IN ('b2', 'b3') THEN 2 ELSE 1 END ELSE 1 END AS INTEGER) AS attempt,
  CASE WHEN early IS NULL THEN 'no events inside the model' WHEN least(early, late) < 10 THEN 'fewer than 10 events on a side: ' || early || ' and ' || late END AS message
FROM s, m""")
def study_run(spark, sf):
    """All methods on all sessions and one without events, begun with two methods, then resumed with all of them."""
    shape, path = SY.Shape(C.K, C.M, C.DT, C.HORIZON), scratch_path(spark, "study")
    ev = fits(spark, sf)
    sessions = ev.select("fit_id").distinct().unionByName(spark.range(1).select((F.col("id") - 1).alias("fit_id")))
    SY.run_study(sessions, ev, path, shape, EM.REAL_DATA, ("b2", "b3"))
    out = SY.run_study(sessions, ev, path, shape, EM.REAL_DATA)
    return named(out.select("fit_id", "method", "status", "test_events", "attempt", "message"))


@query("study_summary")
def study_summary(spark, sf):
    """Held-out scores of the two quick methods over all sessions, as means, deviations and counts."""
    shape, path = SY.Shape(C.K, C.M, C.DT, C.HORIZON), scratch_path(spark, "study")
    ev = fits(spark, sf)
    return rounded(SY.summary(SY.run_study(ev.select("fit_id").distinct(), ev, path, shape, EM.REAL_DATA, ("b2", "b3"))))
