"""Aggregations."""

from pyspark.sql import functions as F

from flockwise.operators import events as E
from flockwise.operators import intervals as I
from flockwise.operators import profile as P
from flockwise.operators import ranking as K
from flockwise.operators import statistics as T
from workload import canon as C
from workload.joins import PATH, REMOVAL, removal, state_path
from workload.registry import query, rounded


def binned(ev, mode="clip"):
    return ev.withColumn("b", I.interval_index(F.col("t"), C.DT, F.lit(C.HORIZON), mode))


@query("interval_counts", f"""
WITH {C.EV}, {C.GRID}, {C.EVB} SELECT g.session_id, g.b, count(e.event_id) AS n, count(e.event_id) FILTER (WHERE e.t <= 700) AS n_hist
FROM grid g LEFT JOIN evb e ON e.session_id = g.session_id AND e.b = g.b GROUP BY 1, 2""")
def interval_counts(spark, sf):
    ev = binned(C.events(spark, sf))
    grid = I.interval_grid(C.sessions(ev), C.DT).select("session_id", "b")
    every = I.interval_counts(ev, grid, ["session_id"])
    early = I.interval_counts(ev.filter("t <= 700"), grid, ["session_id"]).withColumnRenamed("n", "n_hist")
    return every.join(early, ["session_id", "b"])


@query("actor_mark_counts", f"""
WITH {C.EV} SELECT s.session_id, CAST(a.range AS INTEGER) AS actor, CAST(m.range AS INTEGER) AS mark, count(e.event_id) AS n
FROM (SELECT DISTINCT session_id FROM ev) s CROSS JOIN range(5) a CROSS JOIN range(3) m LEFT JOIN ev e ON e.session_id = s.session_id AND e.actor = a.range AND e.mark = m.range GROUP BY 1, 2, 3""")
def actor_mark_counts(spark, sf):
    return P.actor_mark_counts(C.events(spark, sf), ["session_id"], C.K, C.M)


NU = """cnt AS (SELECT s.session_id, a.range AS actor, m.range AS mark, count(e.event_id) / 720.0 AS rate
  FROM (SELECT DISTINCT session_id FROM ev) s CROSS JOIN range(5) a CROSS JOIN range(3) m LEFT JOIN ev e ON e.session_id = s.session_id AND e.actor = a.range AND e.mark = m.range GROUP BY 1, 2, 3),
low AS (SELECT session_id, quantile_cont(rate, 0.05) FILTER (WHERE rate > 0) AS p FROM cnt GROUP BY 1),
nu AS (SELECT session_id, CAST(actor AS INTEGER) AS actor, CAST(mark AS INTEGER) AS mark, greatest(rate, greatest(coalesce(p * 0.05, 1e-6), 1e-6)) AS nu FROM cnt JOIN low USING (session_id))"""


@query("rate_matrix", f"WITH {C.EV}, {NU} SELECT session_id, actor, mark, round(nu, 6) AS nu FROM nu")
def rate_matrix(spark, sf):
    return rounded(P.rate_matrix(C.events(spark, sf), ["session_id"], C.K, C.M, C.HORIZON))


@query("mark_transitions", f"""
WITH {C.EV}, l AS (SELECT session_id, lag(mark) OVER (PARTITION BY session_id, actor ORDER BY t, mark, event_id) AS p, mark FROM ev),
c AS (SELECT session_id, p, mark, count(*) AS n FROM l WHERE p IS NOT NULL GROUP BY 1, 2, 3),
w AS (SELECT s.session_id, CAST(a.range AS INTEGER) AS src_mark, CAST(b.range AS INTEGER) AS dst_mark, coalesce(n, 0) + 1.0 AS w
  FROM (SELECT DISTINCT session_id FROM ev) s CROSS JOIN range(3) a CROSS JOIN range(3) b LEFT JOIN c ON c.session_id = s.session_id AND c.p = a.range AND c.mark = b.range)
SELECT session_id, src_mark, dst_mark, round(w / sum(w) OVER (PARTITION BY session_id, src_mark), 6)::DOUBLE AS p FROM w""")
def mark_transitions(spark, sf):
    return rounded(P.mark_transitions(C.events(spark, sf), ["session_id"], C.M, C.DT))


@query("decay_rate_init", f"""
WITH {C.EV}, g AS (SELECT session_id, t - lag(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS gap FROM ev),
q AS (SELECT session_id, quantile_cont(gap, 0.5) AS m, quantile_cont(gap, 0.1) AS p10, quantile_cont(gap, 0.75) AS p75, quantile_cont(gap, 0.25) AS p25 FROM g WHERE gap > 1e-8 GROUP BY 1),
r AS (SELECT session_id, greatest(least(1 / m, 1.0), 0.1) AS a, p10, greatest(least(1 / p75, 1.0), 0.03) AS c, p25 FROM q),
s AS (SELECT session_id, a AS beta0, greatest(least(1 / p10, 8.0), a + 0.1) AS beta1, c AS beta0_day, greatest(least(1 / p25, 4.0), c + 0.05) AS beta1_day FROM r)
SELECT session_id, round(coalesce(beta0, 1.0), 6) AS beta0, round(coalesce(beta1, 2.0), 6) AS beta1, round(coalesce(beta0_day, 0.2), 6) AS beta0_day, round(coalesce(beta1_day, 0.8), 6) AS beta1_day
FROM (SELECT DISTINCT session_id FROM ev) LEFT JOIN s USING (session_id)""")
def decay_rate_init(spark, sf):
    ev = C.events(spark, sf)
    day = P.decay_rate_init(ev, ["session_id"], C.DT, day_scale=True).withColumnsRenamed({"beta0": "beta0_day", "beta1": "beta1_day"})
    return rounded(P.decay_rate_init(ev, ["session_id"], C.DT).join(day, "session_id"))


@query("quantile_filter", f"""
WITH {C.TR}, q AS (SELECT symbol, quantile_cont(price * quantity, 0.99) AS q FROM tr GROUP BY 1)
SELECT symbol, round(price * quantity, 4) AS notional FROM tr JOIN q USING (symbol) WHERE price * quantity >= q""")
def quantile_filter(spark, sf):
    t = C.trades(spark, sf).select("symbol", (F.col("price") * F.col("quantity")).alias("notional"))
    return rounded(P.quantile_filter(t, ["symbol"], "notional", 0.99), 4)


@query("precision_levels", f"WITH {C.CF} SELECT date_prec, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM cf GROUP BY 1")
def precision_levels(spark, sf):
    return rounded(_precision(spark, sf)[0])


@query("precision_report", f"""
WITH {C.CF} SELECT round(avg(CASE WHEN date_prec = 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS exact_share,
  round(1.0 - count(DISTINCT date_start) / count(*), 6)::DOUBLE AS tied_share, quantile_cont(date_diff('day', date_start, date_end)::DOUBLE, 0.5) AS median_width FROM cf""")
def precision_report(spark, sf):
    return rounded(_precision(spark, sf)[1])


def _precision(spark, sf):
    c = E.day_axis(C.conflicts(spark, sf).withColumn("g", F.lit(0)), ["g"])
    return P.precision_report(c, "date_prec", "interval_days", "event_time")


@query("screen_windows", f"""
WITH {C.CF}, s AS (SELECT country, min(year(date_start)) AS lo, max(year(date_start)) AS hi FROM cf GROUP BY 1),
w AS (SELECT country, CAST(lo + r.range AS INTEGER) AS y0 FROM s, range(20) r WHERE lo + r.range <= hi - 2),
x AS (SELECT w.country, w.y0, cf.* EXCLUDE (country) FROM w JOIN cf ON cf.country = w.country AND year(date_start) >= y0 AND year(date_start) < y0 + 3),
p AS (SELECT country, y0, stream, count(*) AS n, count(*) FILTER (WHERE date_prec = 1) AS ex FROM x GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY country, y0 ORDER BY n DESC, stream) AS rn FROM p),
a AS (SELECT country, y0, CAST(sum(n) AS BIGINT) AS total_events, count(*) AS n_streams, CAST(sum(n) FILTER (WHERE rn <= 4) AS BIGINT) AS topk_events,
  count(*) FILTER (WHERE rn <= 4) AS topk_streams, quantile_cont(n::DOUBLE, 0.5) FILTER (WHERE rn <= 4) AS median_topk_count, min(n) FILTER (WHERE rn <= 4) AS min_topk_count,
  max(n) FILTER (WHERE rn <= 4) AS max_topk_count, round(sum(ex) / sum(n), 6)::DOUBLE AS exact_pct,
  '{{' || string_agg('"' || stream || '":' || n, ',' ORDER BY rn) FILTER (WHERE rn <= 4) || '}}' AS top_streams_json FROM r GROUP BY 1, 2),
l AS (SELECT country, y0, string_agg(CAST(type_of_violence AS VARCHAR), '; ' ORDER BY rn) AS top_labels FROM
  (SELECT country, y0, type_of_violence, row_number() OVER (PARTITION BY country, y0 ORDER BY count(*) DESC, type_of_violence) AS rn FROM x GROUP BY 1, 2, 3) WHERE rn <= 3 GROUP BY 1, 2)
SELECT a.*, l.top_labels, row_number() OVER (ORDER BY topk_events DESC, total_events DESC, country, y0) - 1 AS rank
FROM a JOIN l USING (country, y0) WHERE total_events >= 100 AND n_streams >= 3 AND topk_events >= 90""")
def screen_windows(spark, sf):
    c = C.conflicts(spark, sf).withColumn("year", F.year("date_start")).withColumn("type_of_violence", F.col("type_of_violence").cast("string"))
    return rounded(P.screen_windows(c, "country", "stream", "year", "date_prec", "type_of_violence", 3, 1, 4, 100, 3, 90))


@query("active_event_truth", f"""
WITH {C.EV}, {C.GRID}, {C.EVB} SELECT g.session_id, g.b, CAST(coalesce(max(e.z), 0) AS INTEGER) AS truth FROM grid g LEFT JOIN evb e ON e.session_id = g.session_id AND e.b = g.b GROUP BY 1, 2""")
def active_event_truth(spark, sf):
    return _truth(spark, sf).select("session_id", "b", "truth")


def _truth(spark, sf):
    ev = binned(C.events(spark, sf))
    return I.active_event_truth(ev, I.interval_grid(C.sessions(ev), C.DT), ["session_id"])


@query("birth_fraction", f"""
WITH {C.EV}, {C.GRID}, {C.EVB} SELECT g.session_id, g.b, round(avg(e.z), 6)::DOUBLE AS birth_fraction, count(e.event_id) AS n_events FROM grid g LEFT JOIN evb e ON e.session_id = g.session_id AND e.b = g.b GROUP BY 1, 2""")
def birth_fraction(spark, sf):
    return rounded(_truth(spark, sf).select("session_id", "b", "birth_fraction", "n_events"))


@query("effective_count", f"""
WITH {C.EV}, a AS (SELECT session_id, count(*) FILTER (WHERE z = 1 AND actor IN (0, 1, 2)) AS n_eff FROM ev GROUP BY 1)
SELECT session_id, n_eff, CASE WHEN n_eff > 0 THEN round(sqrt(ln(25.0 / 0.05) / n_eff), 6) ELSE 'infinity'::DOUBLE END AS lambda_t FROM a""")
def effective_count(spark, sf):
    out = P.effective_count(C.events(spark, sf), ["session_id"], [0, 1, 2], C.K)
    return out.withColumn("lambda_t", F.when(F.col("n_eff") > 0, F.round("lambda_t", 6)).otherwise(F.col("lambda_t")))


@query("active_exposure", f"""
WITH {C.EV}, {PATH} SELECT session_id, round(coalesce(sum(e - s) FILTER (WHERE z = 1), 0), 6)::DOUBLE AS active_time, round(coalesce(sum(e - s) FILTER (WHERE z = 1), 0) / 720.0, 6)::DOUBLE AS active_share,
  count(*) FILTER (WHERE z = 1) AS episodes FROM path GROUP BY 1""")
def active_exposure(spark, sf):
    return rounded(P.active_exposure(state_path(C.events(spark, sf)), ["session_id"], C.HORIZON))


@query("overlay_diagnostics", f"""
WITH {REMOVAL}, both_kinds AS (SELECT session_id, actor, 0 AS inj, inside, removed FROM fl UNION ALL SELECT session_id, actor, 1, 0, 0 FROM ev WHERE z = 1),
a AS (SELECT s.session_id, k.range AS actor, count(b.inj) FILTER (WHERE inj = 0) AS orig, count(b.inj) FILTER (WHERE inj = 1) AS signal,
  count(b.inj) FILTER (WHERE inj = 0 AND removed = 1) AS conv, count(b.inj) FILTER (WHERE inj = 0 AND inside = 1) AS act
  FROM (SELECT DISTINCT session_id FROM both_kinds) s CROSS JOIN range(5) k LEFT JOIN both_kinds b ON b.session_id = s.session_id AND b.actor = k.range GROUP BY 1, 2)
SELECT session_id, CAST(sum(orig) AS BIGINT) AS orig_background, CAST(sum(signal) FILTER (WHERE actor < 3) AS BIGINT) AS signal_member_total, min(signal) FILTER (WHERE actor IN (1, 2)) AS signal_receiver_min,
  round(avg(orig - conv) FILTER (WHERE actor < 3), 6) AS left_member_mean, CAST(sum(conv) AS BIGINT) AS removed_background,
  round(sum(orig) / 720.0 * 288.0, 6) AS expected_bg_active, CAST(sum(act) AS BIGINT) AS orig_bg_active,
  round(sum(signal) FILTER (WHERE actor < 3) / greatest(sum(orig) / 720.0 * 288.0, 1e-9), 6) AS signal_to_expected,
  round(max(signal) FILTER (WHERE actor = 2) / greatest(sum(signal) FILTER (WHERE actor IN (1, 2)), 1), 6) AS weak_share,
  round(sqrt(ln(25.0 / 0.05) / greatest(sum(signal) FILTER (WHERE actor < 3), 1)), 6) AS nominal_lambda,
  CAST(CASE WHEN sum(conv) < sum(signal) THEN 1 ELSE 0 END AS INTEGER) AS conversion_cap_hit FROM a GROUP BY 1""")
def overlay_diagnostics(spark, sf):
    bg, _ = removal(spark, sf)
    over = C.events(spark, sf).filter("z = 1").withColumn("inside", F.lit(0)).withColumn("removed", F.lit(0))
    both = E.overlay_events(bg, over)
    out = P.overlay_diagnostics(both, ["session_id"], [0, 1, 2], 0, 2, C.K, C.HORIZON, 288.0)
    return rounded(out.select(
        "session_id", "orig_background", "signal_member_total", "signal_receiver_min", "left_member_mean", "removed_background", "expected_bg_active",
        "orig_bg_active", "signal_to_expected", "weak_share", "nominal_lambda", "conversion_cap_hit"))


@query("replicate_summary", f"""
WITH {C.RES} SELECT method, window_id, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std, count(f1) AS f1_count,
  round(avg(auc), 6) AS auc_mean, round(stddev_samp(auc), 6) AS auc_std, count(auc) AS auc_count FROM res GROUP BY 1, 2""")
def replicate_summary(spark, sf):
    return rounded(T.replicate_summary(C.results(spark, sf), ["method", "window_id"], ["f1", "auc"]))


@query("report_tables", f"""
WITH {C.RES}, t AS (SELECT 'late' AS "table", '199' AS part UNION ALL SELECT 'y2k', '200' UNION ALL SELECT 'all', ''), r AS (SELECT *, CAST(window_id AS VARCHAR) AS session FROM res)
SELECT "table", method, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std, count(f1) AS f1_count FROM r JOIN t ON contains(session, part) GROUP BY 1, 2""")
def report_tables(spark, sf):
    r = C.results(spark, sf).withColumn("session", F.col("window_id").cast("string"))
    return rounded(T.report_tables(r, "session", {"late": "199", "y2k": "200", "all": ""}, ["method"], ["f1"]))


@query("pivot_methods", f"""
WITH {C.RES} SELECT seed, round(arg_min(f1, window_id) FILTER (WHERE method = 'F'), 6) AS F, round(arg_min(f1, window_id) FILTER (WHERE method = 'O'), 6) AS O,
  round(arg_min(f1, window_id) FILTER (WHERE method = 'P'), 6) AS P FROM res GROUP BY 1""")
def pivot_methods(spark, sf):
    return rounded(T.pivot_methods(C.results(spark, sf), ["seed"], "method", ["F", "O", "P"], "f1", order="window_id"))


@query("lag_correlation", f"""
WITH {C.TR}, c AS (SELECT symbol, CAST(floor((transact_time - 788918400000) / 86400000.0 / 30.0) AS INTEGER) AS b, count(*) AS n FROM tr GROUP BY 1, 2),
d AS (SELECT s.symbol, r.range AS b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT symbol FROM c) s CROSS JOIN range(84) r LEFT JOIN c ON c.symbol = s.symbol AND c.b = r.range),
x AS (SELECT a.symbol AS source, e.symbol AS target, CAST(l.range AS INTEGER) AS lag, CASE WHEN stddev_pop(a.n) > 0 AND stddev_pop(e.n) > 0 AND count(*) >= 3 THEN corr(a.n, e.n) END AS r
  FROM d a JOIN d e ON a.symbol <> e.symbol CROSS JOIN range(7) l WHERE e.b = a.b + l.range GROUP BY 1, 2, 3)
SELECT source, target, arg_max(lag, (round(r, 12), -lag)) AS best_lag, round(arg_max(r, (round(r, 12), -lag)), 6) AS best_r, round(max(r) FILTER (WHERE lag = 0), 6) AS zero_lag_r,
  round(arg_max(r, (round(r, 12), -lag)) - max(r) FILTER (WHERE lag = 0), 6) AS lift_vs_zero FROM x GROUP BY 1, 2""")
def lag_correlation(spark, sf):
    t = C.trades(spark, sf)
    b = F.floor((F.col("transact_time") - F.lit(788_918_400_000.0)) / F.lit(86_400_000.0) / F.lit(30.0)).cast("int")
    counts = t.groupBy("symbol", b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(T.lag_correlation(counts, [], "symbol", "b", "n", 84, range(7))[1])


@query("band_summary", f"""
WITH {C.RES}, r AS (SELECT *, CASE WHEN f1 / 2 <= 0.5 THEN 0 WHEN f1 / 2 <= 1 THEN 1 WHEN f1 / 2 <= 1.5 THEN 2 ELSE 3 END::INTEGER AS band FROM res)
SELECT window_id, band, count(*) AS n, round(avg(f1 / 2), 6) AS ratio_mean, round(avg(auc), 6) AS auc_mean FROM r GROUP BY 1, 2""")
def band_summary(spark, sf):
    r = C.results(spark, sf).withColumn("ratio", F.col("f1") / 2)
    return rounded(T.band_summary(r, ["window_id"], "ratio", ["auc"]))


@query("gini_support", f"""
WITH {C.EV}, r AS (SELECT session_id, greatest(value - 10, 0) AS x, row_number() OVER (PARTITION BY session_id ORDER BY greatest(value - 10, 0), event_id) AS i FROM ev)
SELECT session_id, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 6) AS gini, round(sum(x) * sum(x) / sum(x * x), 6) AS effective_support FROM r GROUP BY 1""")
def gini_support(spark, sf):
    ev = C.events(spark, sf).withColumn("x", F.col("value") - 10)
    return rounded(K.gini_support(ev, ["session_id"], "x", ["event_id"]))


def posteriors(spark, sf):
    """Two data-derived activity scores in [0, 1] per interval, with truth and counts."""
    ev = binned(C.events(spark, sf)).withColumn("hot", (F.col("value") > 40).cast("double"))
    per = ev.groupBy("session_id", "b").agg(
        ((F.sum("hot") + 1.0) / (F.count(F.lit(1)) + 2.0)).alias("hat"), ((F.sum("z") + 0.5) / (F.count(F.lit(1)) + 1.0)).alias("star"),
        F.max("z").alias("truth"), F.count(F.lit(1)).alias("n"),
    )
    grid = I.interval_grid(C.sessions(ev), C.DT).select("session_id", "b")
    return grid.join(per, ["session_id", "b"], "left").fillna({"hat": 0.5, "star": 0.5, "truth": 0, "n": 0})


POST = f"""{C.EV}, {C.GRID}, {C.EVB}, post AS (SELECT g.session_id, g.b, (count(e.event_id) FILTER (WHERE e.value > 40) + 1.0) / (count(e.event_id) + 2.0) AS hat,
  (coalesce(sum(e.z), 0) + 0.5) / (count(e.event_id) + 1.0) AS star, coalesce(max(e.z), 0) AS truth, count(e.event_id) AS n
  FROM grid g LEFT JOIN evb e ON e.session_id = g.session_id AND e.b = g.b GROUP BY 1, 2)"""


@query("posterior_gap", f"""
WITH {POST}, o AS (SELECT * FROM post WHERE n > 0), f AS (SELECT session_id, sum((hat - star) ** 2) > sum((1 - hat - star) ** 2) AS flip FROM o GROUP BY 1),
g AS (SELECT o.*, CASE WHEN flip THEN 1 - hat ELSE hat END AS h FROM o JOIN f USING (session_id))
SELECT session_id, round(max(abs(h - star)), 6) AS gap_max, round(avg(abs(h - star)), 6) AS gap_mean, round(sum(n * abs(h - star)) / sum(n), 6) AS gap_wmean,
  round(sum(n * abs(star - truth)) / sum(n), 6) AS bayes_gap_wmean, round(sum(n * (h - truth) ** 2) / sum(n), 6) AS brier_hat, round(sum(n * (star - truth) ** 2) / sum(n), 6) AS brier_star,
  round(CASE WHEN stddev_pop(h) > 1e-12 AND stddev_pop(truth) > 1e-12 THEN corr(h, truth) END, 6) AS truth_corr, round(quantile_cont(abs(h - star), 0.95), 6) AS gap_p95,
  round(sum(n * abs(h - star)) / sum(n) / 0.25, 6) AS gap_over_lambda FROM g GROUP BY 1""")
def posterior_gap(spark, sf):
    return rounded(K.posterior_gap(posteriors(spark, sf), ["session_id"], "hat", "star", "truth", "n", F.lit(0.25)))


@query("nearest_level", f"WITH {C.RES} SELECT arg_min(CAST(seed AS DOUBLE), (abs(seed - 7.4), seed)) AS level FROM res")
def nearest_level(spark, sf):
    return T.nearest_level(C.results(spark, sf), "seed", 7.4)
