"""Point-process operators under fixed, rule-made parameters, one fit per session."""

import numpy as np
from pyspark.sql import functions as F

from flockwise.operators import events as E
from flockwise.operators import graph as G
from flockwise.operators import intervals as I
from flockwise.operators import likelihood as L
from flockwise.operators import profile as P
from flockwise.operators import ranking as K
from flockwise.operators import smoothing as S
from flockwise.operators.history import layout
from flockwise.plans import pairs as PR
from flockwise.plans import heldout as HO
from workload import canon as C
from workload.registry import query, rounded

B0, B1, ON, OFF = 0.05, 0.3, 0.01, 0.03
NB = 30


def a0(j, i):
    return 0.0 if j == i else 0.02 + 0.01 * ((j + 2 * i) % 3)


def a1(j, i):
    return 0.0 if j == i else 0.05 * ((2 * j + i) % 4 + 1)


def nu(i, m):
    return 0.004 + 0.0005 * i + 0.0002 * m


def rho0(a, b):
    return (1 + (a + b) % 3) / 6.0


def rho1(a, b):
    return (1 + (a + 2 * b) % 3) / 6.0


def s_a0(j, i):
    return f"(CASE WHEN {j} = {i} THEN 0 ELSE 0.02 + 0.01 * (({j} + 2 * {i}) % 3) END)::DOUBLE"


def s_a1(j, i):
    return f"(CASE WHEN {j} = {i} THEN 0 ELSE 0.05 * ((2 * {j} + {i}) % 4 + 1) END)::DOUBLE"


S_RHO0 = "((1 + (h.mk + h.m) % 3) / 6.0)::DOUBLE"
S_RHO1 = "((1 + (h.mk + 2 * h.m) % 3) / 6.0)::DOUBLE"
S_NU = "(0.004 + 0.0005 * {i} + 0.0002 * {m})::DOUBLE"
S_W = "(((session_id + 3 * {b}) % 7 + 1) / 10.0)::DOUBLE"
S_G = "(((2 * session_id + {b}) % 9 + 0.5) / 10.0)::DOUBLE"


def fits(spark, sf, session=True):
    return C.events(spark, sf, session).withColumnRenamed("session_id", "fit_id")


def laid_out(spark, sf, session=True, **kw):
    return layout(fits(spark, sf, session), C.K, C.M, C.DT, C.HORIZON, **kw)


def fixed_params(lay):
    k, m = range(C.K), range(C.M)
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    return lay.events.select("fit_id").distinct().select(
        "fit_id", F.lit(0).alias("cand"), arr(nu(i, q) for i in k for q in m).alias("nu"), arr(a0(j, i) for j in k for i in k).alias("a0"),
        arr(a1(j, i) for j in k for i in k).alias("a1"), arr(rho0(a, b) for a in m for b in m).alias("rho0"), arr(rho1(a, b) for a in m for b in m).alias("rho1"),
        F.lit(B0).alias("beta0"), F.lit(B1).alias("beta1"), F.lit(ON).alias("eta_on"), F.lit(OFF).alias("eta_off"))


def fixed_weights(lay):
    g = lay.events.select("fit_id").distinct().select("fit_id", F.explode(F.sequence(F.lit(0), F.lit(NB - 1))).alias("b"))
    return g.select("fit_id", "b", (((F.col("fit_id") + 3 * F.col("b")) % 7 + 1) / 10.0).alias("w"), (((2 * F.col("fit_id") + F.col("b")) % 9 + 0.5) / 10.0).alias("g1"))


def setup(spark, sf, session=True, **kw):
    lay = laid_out(spark, sf, session, **kw)
    return lay, fixed_params(lay), fixed_weights(lay)


def named(df):
    return rounded(df.withColumnRenamed("fit_id", "session_id"))


HIST = f"""{C.EV}, evb AS (SELECT *, CAST(floor(t / 24.0) AS INTEGER) AS b FROM ev),
h AS (SELECT n.session_id, n.event_id, n.b, n.actor AS i, n.mark AS m, k.actor AS j, k.mark AS mk, k.b AS kb, n.t - k.t AS dt, {S_W.format(b='k.b').replace('session_id', 'n.session_id')} AS w
  FROM evb n JOIN evb k ON n.session_id = k.session_id AND (k.t, k.actor, k.mark, k.event_id) < (n.t, n.actor, n.mark, n.event_id))"""

RATE = f"""{HIST}, x AS (SELECT event_id, sum({s_a0('h.j', 'h.i')} * {S_RHO0} * {B0} * exp(-{B0} * dt)) AS routine,
  sum(CASE WHEN kb < b THEN w * {s_a1('h.j', 'h.i')} * {S_RHO1} * {B1} * exp(-{B1} * dt) ELSE 0 END) AS act_pre,
  sum(CASE WHEN kb = b THEN {s_a1('h.j', 'h.i')} * {S_RHO1} * {B1} * exp(-{B1} * dt) ELSE 0 END) AS act_same,
  sum({s_a1('h.j', 'h.i')} * {S_RHO1} * {B1} * exp(-{B1} * dt)) AS act_all, sum(w * {s_a1('h.j', 'h.i')} * {S_RHO1} * {B1} * exp(-{B1} * dt)) AS act_weighted FROM h GROUP BY 1),
lam AS (SELECT e.session_id, e.event_id, e.b, e.t, e.actor, e.mark, {S_NU.format(i='e.actor', m='e.mark')} AS base, coalesce(routine, 0) AS routine, coalesce(act_pre, 0) AS act_pre,
  coalesce(act_same, 0) AS act_same, coalesce(act_all, 0) AS act_all, coalesce(act_weighted, 0) AS act_weighted FROM evb e LEFT JOIN x USING (event_id))"""

OUT = f"o AS (SELECT CAST(j.range AS INTEGER) AS j, sum({s_a0('j.range', 'i.range')}) AS o0, sum({s_a1('j.range', 'i.range')}) AS o1 FROM range(5) j, range(5) i GROUP BY 1)"
NU_SUM = sum(nu(i, m) for i in range(C.K) for m in range(C.M))

COMP = f"""{OUT}, {C.GRID}, cp AS (SELECT g.session_id, g.b,
  coalesce(sum(CASE WHEN e.b < g.b THEN o0 * (exp(-{B0} * (g.t_start - e.t)) - exp(-{B0} * (g.t_end - e.t))) END), 0) AS car0,
  coalesce(sum(CASE WHEN e.b < g.b THEN {S_W.format(b='e.b').replace('session_id', 'e.session_id')} * o1 * (exp(-{B1} * (g.t_start - e.t)) - exp(-{B1} * (g.t_end - e.t))) END), 0) AS car1,
  coalesce(sum(CASE WHEN e.b < g.b THEN o1 * (exp(-{B1} * (g.t_start - e.t)) - exp(-{B1} * (g.t_end - e.t))) END), 0) AS car1_all,
  coalesce(sum(CASE WHEN e.b = g.b THEN o0 * (1 - exp(-{B0} * (g.t_end - e.t))) END), 0) AS wit0,
  coalesce(sum(CASE WHEN e.b = g.b THEN o1 * (1 - exp(-{B1} * (g.t_end - e.t))) END), 0) AS wit1
  FROM grid g LEFT JOIN evb e ON e.session_id = g.session_id AND e.b <= g.b LEFT JOIN o ON o.j = e.actor GROUP BY 1, 2)"""

EMIT = f"""{RATE}, {COMP}, ls AS (SELECT session_id, b, count(*) AS n, sum(ln(base + routine + act_pre)) AS log0, sum(ln(base + routine + act_pre + act_same)) AS log1,
  sum(ln(base + routine)) AS plog0, sum(ln(base + routine + act_all)) AS plog1 FROM lam GROUP BY 1, 2),
em AS (SELECT c.session_id, c.b, coalesce(n, 0) AS n, coalesce(log0, 0) AS log0, coalesce(log1, 0) AS log1, {NU_SUM} * 24.0 AS comp_base, car0 + car1 AS comp_carried, wit0 AS comp_routine, wit1 AS comp_active,
  coalesce(log0, 0) - ({NU_SUM} * 24.0 + car0 + car1 + wit0) AS ell0, coalesce(log1, 0) - ({NU_SUM} * 24.0 + car0 + car1 + wit0 + wit1) AS ell1,
  coalesce(plog0, 0) - ({NU_SUM} * 24.0 + car0 + wit0) AS pell0, coalesce(plog1, 0) - ({NU_SUM} * 24.0 + car0 + wit0 + car1_all + wit1) AS pell1
  FROM cp c LEFT JOIN ls USING (session_id, b))"""


@query("pair_excitation", f"""
WITH top AS (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS r FROM events GROUP BY 1),
{HIST}, p AS (SELECT j AS src, i AS dst, sum({B0} * exp(-{B0} * dt)) AS mass, count(*) FILTER (WHERE dt <= 12.0) AS followed FROM h WHERE i <> j GROUP BY 1, 2)
SELECT src, dst, round(mass, 6) AS mass, CAST(row_number() OVER (ORDER BY round(mass, 6) DESC, src, dst) AS INTEGER) AS rank FROM p""")
def pair_excitation(spark, sf):
    """Flagship: decayed history of every event, summed by source and target actor."""
    lay, params, weights = setup(spark, sf)
    tr = L.decayed_traces(lay, params, None).select("fit_id", "event_id", F.posexplode("routine").alias("src", "x")).filter("x > 0")
    ev = lay.events.select(F.col("event_id").alias("__id"), F.col("actor").alias("dst"))
    mass = tr.join(ev, F.col("event_id") == F.col("__id")).withColumn("src", F.floor(F.col("src") / C.M).cast("int")).filter("src <> dst")
    out = mass.groupBy("src", "dst").agg(F.round(F.sum("x"), 6).alias("mass"))
    return K.actor_rank(out.withColumn("__o", -(F.col("src") * C.K + F.col("dst"))), [], "mass", tie="__o").drop("__o")


@query("decayed_traces", f"""
WITH {HIST} SELECT session_id, event_id, CAST(j * 3 + mk AS INTEGER) AS source, round(sum({B0} * exp(-{B0} * dt)), 6) AS routine, round(sum(w * {B1} * exp(-{B1} * dt)), 6) AS active FROM h GROUP BY 1, 2, 3""")
def decayed_traces(spark, sf):
    lay, params, weights = setup(spark, sf)
    tr = L.decayed_traces(lay, params, weights)
    long = tr.select("fit_id", "event_id", F.posexplode(F.arrays_zip("routine", "active")).alias("source", "x"))
    return named(long.select("fit_id", "event_id", "source", F.col("x.routine").alias("routine"), F.col("x.active").alias("active")).filter("routine > 0"))


@query("interval_start_traces", f"""
WITH {HIST}, {C.GRID} SELECT g.session_id, g.b, e.actor, e.mark, round(sum({B0} * exp(-{B0} * (g.t_start - e.t))), 6) AS routine,
  round(sum({S_W.format(b='e.b').replace('session_id', 'e.session_id')} * {B1} * exp(-{B1} * (g.t_start - e.t))), 6) AS active FROM grid g JOIN evb e ON e.session_id = g.session_id AND e.b < g.b GROUP BY 1, 2, 3, 4""")
def interval_start_traces(spark, sf):
    lay, params, weights = setup(spark, sf)
    return named(S.interval_start_traces(lay, lay.events, params.select("fit_id", "beta0", "beta1"), weights))


@query("event_intensity", f"""
WITH {RATE} SELECT session_id, event_id, b, round(base + routine + act_pre, 6) AS lam0, round(base + routine + act_pre + act_same, 6) AS lam1, round(base, 6) AS base, round(routine, 6) AS routine,
  round(act_pre, 6) AS active_pre, round(act_pre + act_same, 6) AS active_full FROM lam""")
def event_intensity(spark, sf):
    return named(L.event_intensity(*setup(spark, sf)))


@query("event_intensity_stream", f"""
WITH {RATE.replace('SELECT user_id AS session_id', 'SELECT 0::BIGINT AS session_id')} SELECT session_id, event_id, b, round(base + routine + act_pre, 6) AS lam0, round(base + routine + act_pre + act_same, 6) AS lam1, round(routine, 6) AS routine FROM lam""")
def event_intensity_stream(spark, sf):
    """All events as one stream: the history crosses chunks."""
    return named(L.event_intensity(*setup(spark, sf, session=False)).select("fit_id", "event_id", "b", "lam0", "lam1", "routine"))


@query("interval_compensator", f"""
WITH {EMIT} SELECT session_id, b, round(comp_base + comp_carried, 6) AS shared, round(comp_routine, 6) AS routine_within, round(comp_active, 6) AS active_within FROM em""")
def interval_compensator(spark, sf):
    em = S.interval_emissions(*setup(spark, sf))
    return named(em.select("fit_id", "b", (F.col("comp_base") + F.col("comp_carried")).alias("shared"), F.col("comp_routine").alias("routine_within"), F.col("comp_active").alias("active_within")))


@query("interval_emissions", f"WITH {EMIT} SELECT session_id, b, n, round(ell0, 6) AS ell0, round(ell1, 6) AS ell1 FROM em")
def interval_emissions(spark, sf):
    return named(S.interval_emissions(*setup(spark, sf)).select("fit_id", "b", "n", "ell0", "ell1"))


@query("interval_emissions_present", f"WITH {EMIT} SELECT session_id, b, round(pell0, 6) AS ell0, round(pell1, 6) AS ell1 FROM em")
def interval_emissions_present(spark, sf):
    lay, params, _ = setup(spark, sf)
    return named(S.interval_emissions(lay, params, None, present=True).select("fit_id", "b", "ell0", "ell1"))


@query("emission_diagnostics", f"""
WITH {EMIT} SELECT session_id, count(*) AS intervals, count(*) FILTER (WHERE n > 0) AS nonempty, CAST(sum(n) AS BIGINT) AS events, max(n) AS max_events, round(min(ell1 - ell0), 6) AS min_delta, round(avg(ell1 - ell0), 6) AS mean_delta,
  round(max(ell1 - ell0), 6) AS max_delta, count(*) FILTER (WHERE round(ell1 - ell0, 9) > 0) AS active_favor, count(*) FILTER (WHERE round(ell1 - ell0, 9) < 0) AS dormant_favor, round(sum(log0), 6) AS log0, round(sum(log1), 6) AS log1,
  round(sum(comp_base + comp_carried), 6) AS comp_shared, round(sum(comp_routine), 6) AS comp_routine, round(sum(comp_active), 6) AS comp_active,
  round(max(CASE WHEN n > 0 THEN comp_active / greatest(abs(log1), 1e-9) END), 6) AS max_active_ratio FROM em GROUP BY 1""")
def emission_diagnostics(spark, sf):
    return named(S.emission_diagnostics(S.interval_emissions(*setup(spark, sf))))


@query("top_intervals", f"""
WITH {EMIT}, d AS (SELECT session_id, b, n, round(ell1 - ell0, 9) AS delta FROM em WHERE n > 0), r AS (
  SELECT session_id, 'events' AS measure, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, b) AS rank, b, n FROM d
  UNION ALL SELECT session_id, 'separation', row_number() OVER (PARTITION BY session_id ORDER BY abs(delta) DESC, b), b, n FROM d
  UNION ALL SELECT session_id, 'active', row_number() OVER (PARTITION BY session_id ORDER BY delta DESC, b), b, n FROM d)
SELECT session_id, measure, CAST(rank AS INTEGER) AS rank, b, n FROM r WHERE rank <= 8""")
def top_intervals(spark, sf):
    return named(S.top_intervals(S.interval_emissions(*setup(spark, sf))).drop("delta"))


@query("forensic_intervals", f"""
WITH {EMIT}, d AS (SELECT session_id, b, round(ell1 - ell0, 9) AS delta, round(comp_active / greatest(abs(log1), 1e-9), 9) AS ratio FROM em WHERE n > 0),
c AS (SELECT session_id, b, delta AS score, 'strong_active' AS reason FROM d WHERE delta >= 2.5 UNION ALL SELECT session_id, b, ratio, 'active_compensator_large' FROM d WHERE ratio >= 1),
oc AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY session_id, b ORDER BY score DESC, reason DESC) = 1),
u AS (SELECT *, score AS key FROM oc UNION ALL SELECT session_id, b, delta, 'top_state_sep', abs(delta) FROM d WHERE session_id NOT IN (SELECT session_id FROM oc)),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY key DESC, b) AS rank FROM u)
SELECT session_id, b, round(score, 6) AS score, reason, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def forensic_intervals(spark, sf):
    return named(S.forensic_intervals(S.interval_emissions(*setup(spark, sf))))


@query("excitation_attribution", f"""
WITH {HIST}, s AS (SELECT *, {s_a1('h.j', 'h.i')} * {S_RHO1} * {B1} * exp(-{B1} * dt) AS x FROM h WHERE kb = b),
u AS (SELECT session_id, b, 'sender' AS kind, CAST(j AS VARCHAR) AS route, sum(x) AS mass FROM s WHERE x > 0 GROUP BY ALL UNION ALL SELECT session_id, b, 'receiver', CAST(i AS VARCHAR), sum(x) FROM s WHERE x > 0 GROUP BY ALL
  UNION ALL SELECT session_id, b, 'edge', j || ',' || i, sum(x) FROM s WHERE x > 0 GROUP BY ALL UNION ALL SELECT session_id, b, 'mark', mk || ',' || m, sum(x) FROM s WHERE x > 0 GROUP BY ALL
  UNION ALL SELECT session_id, b, 'full', j || ',' || mk || ',' || i || ',' || m, sum(x) FROM s WHERE x > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, b, kind ORDER BY round(mass, 9) DESC, route) AS rank FROM u)
SELECT session_id, b, kind, route, round(mass, 6) AS mass, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def excitation_attribution(spark, sf):
    lay, params, _ = setup(spark, sf)
    return named(L.top_excitation(lay, params))


_s, _e = ON + OFF, float(np.exp(-(ON + OFF) * 24.0))
P00, P11 = (OFF + ON * _e) / _s, (ON + OFF * _e) / _s


def lse(a, b):
    return f"(greatest({a}, {b}) + ln(exp({a} - greatest({a}, {b})) + exp({b} - greatest({a}, {b}))))"


@query("forward_loglik", f"""
WITH RECURSIVE {EMIT}, fw AS (SELECT session_id, b, ln({OFF / _s}) + ell0 AS x0, ln({ON / _s}) + ell1 AS x1 FROM em WHERE b = 0
  UNION ALL SELECT f.session_id, e.b, e.ell0 + {lse(f'(x0 + ln({P00}))', f'(x1 + ln({1 - P11}))')}, e.ell1 + {lse(f'(x0 + ln({1 - P00}))', f'(x1 + ln({P11}))')} FROM fw f JOIN em e ON e.session_id = f.session_id AND e.b = f.b + 1)
SELECT session_id, round({lse('x0', 'x1')}, 6) AS loglik FROM fw WHERE b = {NB - 1}""")
def forward_loglik(spark, sf):
    return named(S.estep(*setup(spark, sf)).groupBy("fit_id").agg(F.first("loglik").alias("loglik")))


def smoothed(e0: str, e1: str) -> str:
    """Posterior per interval by a forward and a backward recursion over the grid."""
    back = lambda a, b: lse(f"(y0 + e.e0 + ln({a}))", f"(y1 + e.e1 + ln({b}))")
    return f"""
WITH RECURSIVE {EMIT}, sm AS (SELECT session_id, b, {e0} AS e0, {e1} AS e1 FROM em),
fw AS (SELECT session_id, b, ln({OFF / _s}) + e0 AS x0, ln({ON / _s}) + e1 AS x1 FROM sm WHERE b = 0
  UNION ALL SELECT f.session_id, e.b, e.e0 + {lse(f'(x0 + ln({P00}))', f'(x1 + ln({1 - P11}))')}, e.e1 + {lse(f'(x0 + ln({1 - P00}))', f'(x1 + ln({P11}))')} FROM fw f JOIN sm e ON e.session_id = f.session_id AND e.b = f.b + 1),
bw AS (SELECT session_id, b, 0::DOUBLE AS y0, 0::DOUBLE AS y1 FROM sm WHERE b = {NB - 1}
  UNION ALL SELECT k.session_id, p.b, {back(P00, 1 - P00)}, {back(1 - P11, P11)} FROM bw k JOIN sm e ON e.session_id = k.session_id AND e.b = k.b JOIN sm p ON p.session_id = k.session_id AND p.b = k.b - 1),
met AS (SELECT session_id, b, x0 + y0 AS z0, x1 + y1 AS z1 FROM fw JOIN bw USING (session_id, b)), total AS (SELECT *, {lse('z0', 'z1')} AS ll FROM met)
SELECT session_id, b, round(exp(z0 - ll), 6) AS g0, round(exp(z1 - ll), 6) AS g1, round(ll, 6) AS loglik FROM total"""


SMOOTHED, SMOOTHED_PRESENT = smoothed("ell0", "ell1"), smoothed("pell0", "pell1")


@query("forward_backward", SMOOTHED)
def forward_backward(spark, sf):
    """Smoothing with the grid cut into blocks of eight intervals."""
    lay, params, weights = setup(spark, sf)
    em = S.interval_emissions(lay, params, weights)
    return named(S.forward_backward(em, S.ctmc_chains(params, C.DT), NB, lay.n_fits, block=8).select("fit_id", "b", "g0", "g1", "loglik"))


@query("gate_features", f"""
WITH {RATE}, y AS (SELECT *, {S_RHO1} * {B1} * exp(-{B1} * dt) AS x FROM h),
f AS (SELECT event_id, sum(CASE WHEN kb < b THEN w * x ELSE 0 END) AS f0, sum(CASE WHEN kb < b THEN w * x ELSE x END) AS f1 FROM y GROUP BY 1)
SELECT session_id, l.event_id, l.b, actor, round(base + routine, 6) AS routine_base, round(coalesce(f0, 0), 6) AS feat0, round(coalesce(f1, 0), 6) AS feat1,
  round((1 - exp(-{B1} * ((l.b + 1) * 24.0 - l.t))) / {B1}, 6) AS comp_within FROM lam l LEFT JOIN f USING (event_id)""")
def gate_features(spark, sf):
    f = L.gate_features(*setup(spark, sf))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return named(f.select("fit_id", "event_id", "b", "actor", "routine_base", total("feat0").alias("feat0"), total("feat1").alias("feat1"), "comp_within"))


@query("baseline_update", f"""
WITH {RATE}, r AS (SELECT session_id, actor, mark, (1 - {S_G.format(b='b')}) * base / (base + routine) + {S_G.format(b='b')} * base / (base + routine + act_weighted) AS x FROM lam)
SELECT session_id, actor, mark, round(sum(x) / 720.0, 6) AS nu FROM r GROUP BY 1, 2, 3""")
def baseline_update(spark, sf):
    lay, params, weights = setup(spark, sf)
    v = L.baseline_sums(lay, params, weights).select("fit_id", F.posexplode("vec").alias("i", "x")).filter("x > 0")
    return named(v.select("fit_id", F.floor(F.col("i") / C.M).cast("int").alias("actor"), (F.col("i") % C.M).cast("int").alias("mark"), (F.col("x") / C.HORIZON).alias("nu")))


QSQL = f"""{EMIT}, q AS (SELECT session_id, sum((1 - {S_G.format(b='b')}) * ell0 + {S_G.format(b='b')} * ell1) AS q FROM em GROUP BY 1)"""


@query("expected_loglik", f"WITH {QSQL} SELECT session_id, round(q, 6) AS q FROM q")
def expected_loglik(spark, sf):
    """Q of the event part from one pass, without any interval table."""
    lay, params, weights = setup(spark, sf)
    return named(L.score_and_gradient(lay, params, weights, gradient=False).select("fit_id", (F.col("vec")[0] - F.lit(NU_SUM * C.HORIZON)).alias("q")))


@query("coupling_gradient", f"""
WITH {RATE}, {OUT}, d AS (SELECT l.*, {S_G.format(b='l.b').replace('session_id', 'l.session_id')} AS g, {S_W.format(b='l.b').replace('session_id', 'l.session_id')} AS w, base + routine + act_pre AS l0, base + routine + act_pre + act_same AS l1 FROM lam l),
a AS (SELECT h.session_id, h.j, h.i, sum({S_RHO1} * {B1} * exp(-{B1} * dt) * CASE WHEN kb < h.b THEN h.w * ((1 - g) / l0 + g / l1) ELSE g / l1 END) AS x FROM h JOIN d USING (event_id) GROUP BY 1, 2, 3),
c AS (SELECT session_id, actor AS j, sum(w * (exp(-{B1} * ((b + 1) * 24.0 - t)) - exp(-{B1} * (720.0 - t))) + g * (1 - exp(-{B1} * ((b + 1) * 24.0 - t)))) AS c FROM d GROUP BY 1, 2),
s AS (SELECT DISTINCT session_id FROM ev)
SELECT s.session_id, CAST(j.range AS INTEGER) AS src, CAST(i.range AS INTEGER) AS dst, round(coalesce(x, 0) - coalesce(c, 0), 5) AS grad FROM s CROSS JOIN range(5) j CROSS JOIN range(5) i
LEFT JOIN a ON a.session_id = s.session_id AND a.j = j.range AND a.i = i.range LEFT JOIN c ON c.session_id = s.session_id AND c.j = j.range""")
def coupling_gradient(spark, sf):
    v = L.score_and_gradient(*setup(spark, sf)).select("fit_id", F.posexplode(F.slice("vec", 2, C.K * C.K)).alias("p", "grad"))
    out = v.select(F.col("fit_id").alias("session_id"), F.floor(F.col("p") / C.K).cast("int").alias("src"), (F.col("p") % C.K).cast("int").alias("dst"), "grad")
    return rounded(out, 5)


@query("static_loglik", f"""
WITH {RATE}, {OUT} SELECT session_id, round(sum(ln(base + routine)) - sum(o0 * (1 - exp(-{B0} * (720.0 - t)))) - {NU_SUM} * 720.0, 6) AS loglik, count(*) AS n FROM lam JOIN o ON o.j = actor GROUP BY 1""")
def static_loglik(spark, sf):
    lay, params, _ = setup(spark, sf)
    return named(L.static_loglik(lay, params).drop("cand"))


@query("rescaled_residuals", f"""
WITH {HIST}, {OUT}, p AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY session_id ORDER BY t, actor, mark, event_id), 0) AS pt FROM evb),
r AS (SELECT p.session_id, p.event_id, p.b, p.t - p.pt AS dt, coalesce(sum(o0 * exp(-{B0} * (p.pt - k.t))), 0) AS s0,
  coalesce(sum({S_W.format(b='k.b').replace('session_id', 'k.session_id')} * o1 * exp(-{B1} * (p.pt - k.t))), 0) AS s1
  FROM p LEFT JOIN evb k ON k.session_id = p.session_id AND (k.t, k.actor, k.mark, k.event_id) < (p.t, p.actor, p.mark, p.event_id) LEFT JOIN o ON o.j = k.actor GROUP BY ALL)
SELECT session_id, event_id, b, round({NU_SUM} * dt + s0 * (1 - exp(-{B0} * dt)) + s1 * (1 - exp(-{B1} * dt)), 6) AS residual FROM r""")
def rescaled_residuals(spark, sf):
    return named(L.rescaled_residuals(*setup(spark, sf)))


@query("rescaled_residuals_present", f"""
WITH {HIST}, {OUT}, p AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY session_id ORDER BY t, actor, mark, event_id), 0) AS pt FROM evb),
r AS (SELECT p.session_id, p.event_id, p.b, p.t - p.pt AS dt, coalesce(sum(o0 * exp(-{B0} * (p.pt - k.t))), 0) AS s0, coalesce(sum(o1 * exp(-{B1} * (p.pt - k.t))), 0) AS s1
  FROM p LEFT JOIN evb k ON k.session_id = p.session_id AND (k.t, k.actor, k.mark, k.event_id) < (p.t, p.actor, p.mark, p.event_id) LEFT JOIN o ON o.j = k.actor GROUP BY ALL)
SELECT session_id, event_id, b, round({NU_SUM} * dt + s0 * (1 - exp(-{B0} * dt)) + {S_G.format(b='b')} * s1 * (1 - exp(-{B1} * dt)), 6) AS residual FROM r""")
def rescaled_residuals_present(spark, sf):
    lay, params, weights = setup(spark, sf)
    return named(L.rescaled_residuals(lay, params, weights.withColumn("w", F.lit(1.0)), present=True))


@query("pair_segments", f"""
WITH {C.EV}, {C.WIN}, a AS (SELECT DISTINCT session_id, actor FROM ev), p AS (SELECT x.session_id, x.actor AS src, y.actor AS dst FROM a x JOIN a y ON x.session_id = y.session_id AND x.actor < y.actor)
SELECT p.session_id, src, dst, s, event_id, round(t - s, 6) AS t_rel, CAST(CASE WHEN actor = src THEN mark ELSE 3 + mark END AS INTEGER) AS dim FROM p JOIN ev ON ev.session_id = p.session_id AND (actor = src OR actor = dst) JOIN win ON t > s AND t <= e""")
def pair_segments(spark, sf):
    ev = C.events(spark, sf)
    seg = PR.pair_segments(ev, C.windows(spark, ev), ["session_id"], C.M, width=24.0)
    return rounded(seg.select("session_id", "src", "dst", "s", "event_id", "t_rel", "dim"))


def transition_edges(spark, sf):
    return C.edge_table(spark, sf).withColumnRenamed("score", "w")


@query("degree_members", f"""
WITH {C.EV}, {C.ES}, n AS (SELECT seed, actor, sum(o) AS out_degree, sum(i) AS in_degree FROM (SELECT seed, src AS actor, score AS o, 0 AS i FROM es UNION ALL SELECT seed, dst, 0, score FROM es) GROUP BY 1, 2),
r AS (SELECT *, sqrt(out_degree * in_degree) AS score FROM n)
SELECT seed, actor, round(out_degree, 6) AS out_degree, round(in_degree, 6) AS in_degree, round(score, 6) AS score, CAST(CASE WHEN row_number() OVER (PARTITION BY seed ORDER BY score DESC, actor DESC) <= 3 THEN 1 ELSE 0 END AS INTEGER) AS member,
  CAST(CASE WHEN row_number() OVER (PARTITION BY seed ORDER BY out_degree DESC, actor DESC) <= 1 THEN 1 ELSE 0 END AS INTEGER) AS hub FROM r""")
def degree_members(spark, sf):
    return rounded(G.degree_members(transition_edges(spark, sf), ["seed"], 3))


@query("role_scores", f"""
WITH {C.EV}, {C.ES}, n AS (SELECT seed, actor, sum(o) AS sender, sum(i) AS receiver FROM (SELECT seed, src AS actor, score AS o, 0 AS i FROM es UNION ALL SELECT seed, dst, 0, score FROM es) GROUP BY 1, 2)
SELECT seed, actor, round(sender, 6) AS sender, round(receiver, 6) AS receiver, round(greatest(sender / max(sender) OVER w, receiver / max(receiver) OVER w), 6) AS member FROM n WINDOW w AS (PARTITION BY seed)""")
def role_scores(spark, sf):
    return rounded(G.role_scores(transition_edges(spark, sf), ["seed"], "max"))


def gates(spark, sf):
    """Per session and actor: gate values and embeddings from the events' values."""
    v = C.events(spark, sf).groupBy("session_id", "actor").agg((F.avg("value") / 50).alias("g"), (F.count(F.lit(1)) / 20).alias("h"), F.avg("mark").alias("x"))
    return v.select("session_id", "actor", "g", "h", F.array(F.col("x") - 1, F.col("g") - 0.5).alias("u"), F.array(F.col("h") - 0.5, F.col("x") - 0.8).alias("v"))


GATES = f"""{C.EV}, gt AS (SELECT session_id, actor, avg(value) / 50 AS g, count(*) / 20 AS h, avg(mark) AS x FROM ev GROUP BY 1, 2),
dot AS (SELECT a.session_id, a.actor AS src, b.actor AS dst, a.g, b.h, (a.x - 1) * (b.h - 0.5) + (a.g - 0.5) * (b.x - 0.8) AS d FROM gt a JOIN gt b ON a.session_id = b.session_id AND a.actor <> b.actor)"""


@query("active_coupling", f"""
WITH {GATES} SELECT session_id, src, dst, round(g * h * (ln(1 + exp(-abs(d))) + greatest(d, 0)), 6) AS w, round(least(least(g, 5) * least(h, 5) * (ln(1 + exp(-abs(d))) + greatest(d, 0)), 2.0), 6) AS w_hard FROM dot""")
def active_coupling(spark, sf):
    a = gates(spark, sf)
    hard = G.active_coupling(a, ["session_id"], hardened=True).withColumnRenamed("w", "w_hard")
    return rounded(G.active_coupling(a, ["session_id"]).join(hard, ["session_id", "src", "dst"]))


@query("select_topk", f"""
WITH {GATES}, n AS (SELECT session_id, actor, sqrt(g / max(g) OVER w * (h / max(h) OVER w)) AS score FROM gt WINDOW w AS (PARTITION BY session_id))
SELECT session_id, actor, round(score, 6) AS score, CAST(CASE WHEN row_number() OVER (PARTITION BY session_id ORDER BY score DESC, actor DESC) <= 2 THEN 1 ELSE 0 END AS INTEGER) AS selected FROM n""")
def select_topk(spark, sf):
    from flockwise.plans.selection import gate_scores

    return rounded(K.top_flag(gate_scores(gates(spark, sf), ["session_id"]), ["session_id"], "score", 2, "selected").select("session_id", "actor", "score", "selected"))


@query("evaluate_fit", f"""
WITH {GATES}, n AS (SELECT session_id, actor, sqrt(g / max(g) OVER w * (h / max(h) OVER w)) AS score, g FROM gt WINDOW w AS (PARTITION BY session_id)),
p AS (SELECT session_id, actor, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, actor DESC) <= 2 AS pred, row_number() OVER (PARTITION BY session_id ORDER BY g DESC, actor DESC) = 1 AS hub FROM n),
m AS (SELECT session_id, count(*) FILTER (WHERE pred AND actor IN (0, 1)) AS tp, count(*) FILTER (WHERE pred) AS np, max(CASE WHEN hub AND actor = 0 THEN 1 ELSE 0 END) AS hub_correct FROM p GROUP BY 1),
{C.GRID}, {C.EVB}, po AS (SELECT g.session_id, g.b, coalesce(max(e.z), 0) AS y, count(e.event_id) AS s FROM grid g LEFT JOIN evb e ON e.session_id = g.session_id AND e.b = g.b GROUP BY 1, 2),
k AS (SELECT session_id, y, rank() OVER (PARTITION BY session_id ORDER BY s) + (count(*) OVER (PARTITION BY session_id, s) - 1) / 2.0 AS mid FROM po),
a AS (SELECT session_id, (sum(mid) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM k GROUP BY 1)
SELECT session_id, round(auc, 6) AS field_auc, round(tp / np, 6) AS precision, round(tp / 2, 6) AS recall, round(2 * (tp / np) * (tp / 2) / greatest(tp / np + tp / 2, 1e-12), 6) AS f1, CAST(hub_correct AS INTEGER) AS hub_correct FROM m JOIN a USING (session_id)""")
def evaluate_fit(spark, sf):
    from flockwise.plans.selection import evaluate_fit as run
    from workload.aggregates import _truth

    post = _truth(spark, sf).withColumn("g1", F.col("n_events").cast("double"))
    return rounded(run(gates(spark, sf), post, ["session_id"], [0, 1], 0, "topk", k=2))


@query("heldout_count_hmm", f"""
WITH RECURSIVE {C.EV}, tr AS (SELECT s.session_id, r.range AS b, count(e.event_id) AS n FROM (SELECT DISTINCT session_id FROM ev) s CROSS JOIN range(24) r LEFT JOIN ev e ON e.session_id = s.session_id AND e.t >= r.range * 24 AND e.t < (r.range + 1) * 24 GROUP BY 1, 2),
te AS (SELECT s.session_id, r.range AS b, count(e.event_id) AS n FROM (SELECT DISTINCT session_id FROM ev) s CROSS JOIN range(6) r LEFT JOIN ev e ON e.session_id = s.session_id AND e.t >= 576 + r.range * 24 AND e.t < 576 + (r.range + 1) * 24 GROUP BY 1, 2),
q AS (SELECT session_id, quantile_cont(n::DOUBLE, 0.75) AS q FROM tr GROUP BY 1), z AS (SELECT tr.*, CASE WHEN n >= q THEN 1 ELSE 0 END AS z FROM tr JOIN q USING (session_id)),
l AS (SELECT *, lag(z) OVER (PARTITION BY session_id ORDER BY b) AS pz FROM z),
p AS (SELECT session_id, greatest(coalesce(avg(n) FILTER (WHERE z = 0), avg(n)), 1e-6) AS l0, coalesce(avg(n) FILTER (WHERE z = 1), avg(n)) AS hi, count(*) FILTER (WHERE pz = 0 AND z = 0) + 1.0 AS n00, count(*) FILTER (WHERE pz = 0 AND z = 1) + 1.0 AS n01,
  count(*) FILTER (WHERE pz = 1 AND z = 0) + 1.0 AS n10, count(*) FILTER (WHERE pz = 1 AND z = 1) + 1.0 AS n11, greatest(avg(1 - z), 1e-6) AS a, greatest(avg(z), 1e-6) AS c FROM l GROUP BY 1),
p2 AS (SELECT session_id, l0, greatest(hi, l0 + 1e-6) AS l1, n00 / (n00 + n01) AS p00, n11 / (n10 + n11) AS p11, a / (a + c) AS pi0, c / (a + c) AS pi1 FROM p),
e AS (SELECT te.session_id, b, n * ln(l0) - l0 - lgamma(n + 1) AS e0, n * ln(l1) - l1 - lgamma(n + 1) AS e1 FROM te JOIN p2 USING (session_id)),
fw AS (SELECT session_id, 0 AS b, ln(pi0) + e0 AS x0, ln(pi1) + e1 AS x1 FROM e JOIN p2 USING (session_id) WHERE b = 0
  UNION ALL SELECT f.session_id, f.b + 1, e.e0 + {lse('(x0 + ln(p00))', '(x1 + ln(1 - p11))')}, e.e1 + {lse('(x0 + ln(1 - p00))', '(x1 + ln(p11))')} FROM fw f JOIN e ON e.session_id = f.session_id AND e.b = f.b + 1 JOIN p2 ON p2.session_id = f.session_id)
SELECT f.session_id, round({lse('x0', 'x1')}, 6) AS heldout_loglik, round(l0, 6) AS lambda0, round(l1, 6) AS lambda1, round(p00, 6) AS p00, round(p11, 6) AS p11, round(l1 / (l0 + l1), 6) AS rate_share FROM fw f JOIN p2 USING (session_id) WHERE f.b = 5""")
def heldout_count_hmm(spark, sf):
    ev = C.events(spark, sf)
    side = E.split_by_time(ev, ["session_id"], C.HORIZON, 0.2, min_rows=0).withColumnRenamed("session_id", "fit_id")
    return named(HO.heldout_count_hmm(side, 576.0, 144.0, 24.0))


def regime_rho(spark, sf):
    """Mark transitions of unlabelled and labelled events as the two regimes' routes."""
    ev = C.events(spark, sf)
    parts = [P.mark_transitions(ev.filter(f"z = {r}"), ["session_id"], C.M, C.DT).withColumn("regime", F.lit(r)) for r in (0, 1)]
    return parts[0].unionByName(parts[1])


RHO = f"""{C.EV}, l AS (SELECT session_id, z, lag(mark) OVER (PARTITION BY session_id, z, actor ORDER BY t, mark, event_id) AS p, mark FROM ev),
c AS (SELECT session_id, z, p, mark, count(*) AS n FROM l WHERE p IS NOT NULL GROUP BY ALL), w AS (SELECT s.session_id, s.z, a.range AS a, b.range AS b, coalesce(n, 0) + 1.0 AS w FROM (SELECT DISTINCT session_id, z FROM ev) s CROSS JOIN range(3) a CROSS JOIN range(3) b
  LEFT JOIN c ON c.session_id = s.session_id AND c.z = s.z AND c.p = a.range AND c.mark = b.range),
r AS (SELECT session_id, z, a, b, w / sum(w) OVER (PARTITION BY session_id, z, a) AS p FROM w),
x AS (SELECT session_id, a, b, max(p) FILTER (WHERE z = 0) AS r0, max(p) FILTER (WHERE z = 1) AS r1 FROM r GROUP BY 1, 2, 3)"""


@query("mark_lift", f"WITH {RHO} SELECT session_id, CAST(a AS INTEGER) AS src_mark, CAST(b AS INTEGER) AS dst_mark, round(r0, 6)::DOUBLE AS rho0, round(r1, 6)::DOUBLE AS rho1, round(r1 - r0, 6)::DOUBLE AS lift FROM x")
def mark_lift(spark, sf):
    return rounded(G.mark_lift(regime_rho(spark, sf), ["session_id"], C.M)[0])


@query("mark_lift_summary", f"""
WITH {RHO} SELECT session_id, round(sum(r0) FILTER (WHERE a = b), 6)::DOUBLE AS same_mark_mass0, round(sum(r1) FILTER (WHERE a = b), 6)::DOUBLE AS same_mark_mass1, round(sum(r1 - r0) FILTER (WHERE a = b), 6)::DOUBLE AS same_mark_lift,
  round(avg(r1 - r0) FILTER (WHERE a < 2 AND b = 2), 6)::DOUBLE AS escalation_lift FROM x GROUP BY 1""")
def mark_lift_summary(spark, sf):
    return rounded(G.mark_lift(regime_rho(spark, sf), ["session_id"], C.M)[1])


@query("edge_scores", f"""
WITH {C.EV}, {C.ES}, p AS (SELECT seed, src, dst, y_true FROM et WHERE src < 4 AND dst < 4) SELECT p.seed, p.src, p.dst, round(coalesce(score, 0), 6) AS score, y_true FROM p LEFT JOIN es USING (seed, src, dst)""")
def edge_scores(spark, sf):
    e = transition_edges(spark, sf)
    members = P.dense_cells(e.select("seed").distinct(), actor=4)
    truth = C.edge_truth(e).filter("y_true = 1").drop("y_true")
    return rounded(G.edge_scores(e, members, truth, ["seed"]))


@query("corrupt_posterior", """
WITH """ + f"""{C.EV}, {C.GRID}, p AS (SELECT session_id, b, {S_G.format(b='b')} AS g, ('0x' || substr(md5(concat_ws('|', '4', 'noise', CAST(session_id AS VARCHAR), CAST(b AS VARCHAR))), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM grid)
SELECT session_id, b, round(greatest(least(0.7 * g + 0.3 * 0.5, 1 - 1e-3), 1e-3), 6) AS flat, round(greatest(least(0.7 * g + 0.3 * u, 1 - 1e-3), 1e-3), 6) AS noisy FROM p""")
def corrupt_posterior(spark, sf):
    from flockwise.plans.diagnostics import corrupt_posterior as run

    ev = C.events(spark, sf)
    g = I.interval_grid(C.sessions(ev), C.DT).select("session_id", "b", (((2 * F.col("session_id") + F.col("b")) % 9 + 0.5) / 10.0).alias("g1"))
    a = run(g, F.lit(0.3), "flatten", 4, ["session_id", "b"]).withColumnRenamed("g1", "flat")
    b = run(g, F.lit(0.3), "noise", 4, ["session_id", "b"]).withColumnRenamed("g1", "noisy")
    return rounded(a.join(b, ["session_id", "b"]))
