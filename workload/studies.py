"""Paired statistics, thresholds, task grids and display tables."""

from pyspark.sql import functions as F

from flockwise.operators import statistics as T
from workload import canon as C
from workload.registry import SQL, query, rounded

PAIRS = f"{C.RES}, pr AS (SELECT a.window_id, a.seed, a.f1 - b.f1 AS d FROM res a JOIN res b ON a.window_id = b.window_id AND a.seed = b.seed WHERE a.method = 'F' AND b.method = 'O')"


#: The reference's number of resamples of a slope.
RESAMPLES = 1000


def pairs(spark, sf):
    return T.paired_methods(C.results(spark, sf), ["window_id", "seed"], "f1", "F", "O")


@query("paired_bootstrap", f"""
WITH {PAIRS}, p AS (SELECT d, row_number() OVER (ORDER BY window_id, seed) - 1 AS pos FROM pr), n AS (SELECT count(*) AS n, avg(d) AS mean_delta FROM pr),
dr AS (SELECT r.range AS boot, CAST(floor(('0x' || substr(md5(concat_ws('|', '0', 'boot', CAST(r.range AS VARCHAR), CAST(j.range AS VARCHAR))), 1, 13))::BIGINT / 4503599627370496.0 * n) AS BIGINT) AS pos
  FROM range(2000) r CROSS JOIN range(1000) j CROSS JOIN n WHERE j.range < n),
b AS (SELECT boot, avg(d) AS m FROM dr JOIN p USING (pos) GROUP BY 1)
SELECT max(n) AS n_pairs, round(max(mean_delta), 6) AS mean_delta, round(quantile_cont(m, 0.025), 6) AS ci_lo, round(quantile_cont(m, 0.975), 6) AS ci_hi FROM b, n""")
def paired_bootstrap(spark, sf):
    return rounded(T.paired_bootstrap(pairs(spark, sf), ["window_id", "seed"], "d", 2000, 0))


@query("paired_t_test", f"""
WITH {PAIRS} SELECT window_id, count(d) AS n, round(avg(d), 6) AS mean_d, round(stddev_samp(d), 6) AS sd_d, round(stddev_samp(d) / sqrt(count(d)), 6) AS se, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t FROM pr GROUP BY 1""")
def paired_t_test(spark, sf):
    return rounded(T.paired_t_test(pairs(spark, sf), ["window_id"], "d").drop("p"))


@query("paired_t_test_p", f"""
WITH {PAIRS}, s AS (SELECT window_id, count(d) AS n, avg(d) AS mean_d, stddev_samp(d) AS sd_d, stddev_samp(d) / sqrt(count(d)) AS se FROM pr GROUP BY 1),
a AS (SELECT *, mean_d / se AS t, atan(abs(mean_d / se) / sqrt(n - 1)) AS th FROM s),
b AS (SELECT window_id, sum(CASE WHEN (n - 1) % 2 = 0 THEN exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0)) * pow(cos(th), 2 * k)
  ELSE exp(lgamma(0.5) + lgamma(k + 1.0) - ln(2) - lgamma(k + 1.5)) * pow(cos(th), 2 * k + 1) END) AS q
  FROM (SELECT *, unnest(range(0, greatest((n - 1) // 2, 0))) AS k FROM a) GROUP BY 1)
SELECT window_id, n, round(mean_d, 6) AS mean_d, round(sd_d, 6) AS sd_d, round(se, 6) AS se, round(t, 6) AS t,
  round(1 - CASE WHEN (n - 1) % 2 = 0 THEN sin(th) * q ELSE (th + sin(th) * coalesce(q, 0)) * 2 / pi() END, 6) AS p FROM a LEFT JOIN b USING (window_id)""")
def paired_t_test_p(spark, sf):
    return rounded(T.paired_t_test(pairs(spark, sf), ["window_id"], "d"))


@query("wilcoxon_signed", f"""
WITH {PAIRS}, m AS (SELECT window_id, d, rank() OVER (PARTITION BY window_id ORDER BY abs(d)) + (count(*) OVER (PARTITION BY window_id, abs(d)) - 1) / 2.0 AS mid FROM pr WHERE d <> 0)
SELECT window_id, count(*) AS n, coalesce(sum(mid) FILTER (WHERE d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(mid) FILTER (WHERE d < 0), 0)::DOUBLE AS w_minus FROM m GROUP BY 1""")
def wilcoxon_signed(spark, sf):
    return rounded(T.signed_ranks(pairs(spark, sf), ["window_id"], "d").drop("tie_term", "n_zero"))


@query("wilcoxon_signed_p")
def wilcoxon_signed_p(spark, sf):
    return rounded(T.wilcoxon_signed(pairs(spark, sf), ["window_id"], "d"))


THRESH = f"""{C.WK}, cell AS (SELECT level, exposure, avg(recovered) AS rec, avg(n_eff) AS ne, count(*) AS n FROM wk GROUP BY 1, 2),
th AS (SELECT level, level AS alpha, min(exposure) FILTER (WHERE rec >= 0.9) AS threshold, arg_min(ne, exposure) FILTER (WHERE rec >= 0.9) AS threshold_n_eff FROM cell GROUP BY 1)"""


def weak(spark, sf):
    return C.weak_runs(spark, sf).withColumn("alpha", F.col("level"))


@query("recovery_threshold", f"""
WITH {THRESH} SELECT round(level, 6) AS level, round(alpha, 6) AS alpha, threshold, round(threshold_n_eff, 6) AS threshold_n_eff, CAST(CASE WHEN threshold IS NULL THEN 1 ELSE 0 END AS INTEGER) AS censored FROM th""")
def recovery_threshold(spark, sf):
    return rounded(T.recovery_threshold(weak(spark, sf), [], "level", "exposure", "recovered", "alpha", "n_eff"))


@query("loglog_slope", f"""
WITH {THRESH} SELECT count(*) AS n_levels, count(threshold) AS n_uncensored, round(regr_slope(ln(threshold), ln(alpha)), 6) AS slope, round(regr_intercept(ln(threshold), ln(alpha)), 6) AS intercept FROM th""")
def loglog_slope(spark, sf):
    th = T.recovery_threshold(weak(spark, sf), [], "level", "exposure", "recovered", "alpha", "n_eff")
    return rounded(T.loglog_slope(th, []))


@query("seed_bootstrap_slope", f"""
WITH {C.WK}, seeds AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS pos FROM (SELECT DISTINCT seed FROM wk)), n AS (SELECT count(*) AS n FROM seeds),
dr AS (SELECT r.range AS boot, CAST(floor(('0x' || substr(md5(concat_ws('|', '1', 'seedboot', CAST(r.range AS VARCHAR), CAST(j.range AS VARCHAR))), 1, 13))::BIGINT / 4503599627370496.0 * n) AS BIGINT) AS pos FROM range(1000) r, n, range(1000) j WHERE j.range < n),
w AS (SELECT boot, seed, count(*) AS w FROM dr JOIN seeds USING (pos) GROUP BY 1, 2), c AS (SELECT seed, level, exposure, sum(recovered) AS s, count(*) AS k FROM wk GROUP BY 1, 2, 3),
cell AS (SELECT boot, level, exposure, sum(w * s) / sum(w * k) AS rec FROM c JOIN w USING (seed) GROUP BY 1, 2, 3), th AS (SELECT boot, level, min(exposure) FILTER (WHERE rec >= 0.9) AS threshold FROM cell GROUP BY 1, 2),
sl AS (SELECT boot, CASE WHEN count(threshold) >= 3 THEN regr_slope(ln(threshold), CASE WHEN threshold IS NOT NULL THEN ln(level) END) END AS slope FROM th GROUP BY 1),
f AS (SELECT count(slope) AS n_boot_ok, quantile_cont(slope, 0.025) AS lo, quantile_cont(slope, 0.975) AS hi FROM sl)
SELECT n_boot_ok, round(CASE WHEN n_boot_ok >= 20 THEN lo END, 6) AS ci_lo, round(CASE WHEN n_boot_ok >= 20 THEN hi END, 6) AS ci_hi, coalesce(n_boot_ok >= 20 AND lo <= -2 + 1e-6 AND hi >= -2 - 1e-6, false) AS covers_neg2 FROM f""")
def seed_bootstrap_slope(spark, sf):
    return rounded(T.seed_bootstrap_slope(weak(spark, sf), "seed", "level", "exposure", "recovered", "alpha", "n_eff", RESAMPLES, 1))


@query("seed_bootstrap_slope_full", SQL["seed_bootstrap_slope"])
def seed_bootstrap_slope_full(spark, sf):
    return rounded(T.seed_bootstrap_slope(weak(spark, sf), "seed", "level", "exposure", "recovered", "alpha", "n_eff", RESAMPLES, 1))


@query("task_grid", f"""
WITH {C.EV}, s AS (SELECT DISTINCT session_id FROM ev) SELECT session_id, seed, strength, method, CAST(hash_ok AS INTEGER) AS is_new FROM s, (SELECT unnest([0, 1, 2]) AS seed), (SELECT unnest([0.5, 1.0]::DOUBLE[]) AS strength),
(SELECT unnest(['proposed', 'b1', 'b2', 'b3', 'b4']) AS method), (SELECT 1 AS hash_ok) WHERE NOT (seed = 0 AND method = 'b1')""")
def task_grid(spark, sf):
    from flockwise.sources.writers import resume_filter

    base = C.events(spark, sf).select("session_id").distinct()
    grid = T.task_grid(spark, base, seed=[0, 1, 2], strength=[0.5, 1.0], method=T.resolve_methods("ours,static,all"))
    done = grid.filter("seed = 0 AND method = 'b1'").withColumn("status", F.lit("ok"))
    return resume_filter(grid, done, ["session_id", "seed", "strength", "method"]).withColumn("is_new", F.lit(1))


@query("phase_grid", f"""
WITH {C.RES} SELECT window_id % 3 AS share, seed % 4 AS horizon, round(avg(f1), 6) AS f1_mean, round(avg(auc), 6) AS auc_mean, count(*) AS n FROM res GROUP BY 1, 2""")
def phase_grid(spark, sf):
    r = C.results(spark, sf).withColumn("share", (F.col("window_id") % 3).cast("int")).withColumn("horizon", F.col("seed") % 4)
    return rounded(T.phase_grid(r, "share", "horizon", ["f1", "auc"]))


@query("weaklink_role", f"""
WITH {C.RES}, w AS (SELECT method, window_id, seed, CAST(f1 > 2 AS INTEGER) AS weak_recovered, CAST(auc > 0.1 AS INTEGER) AS member_exact, CAST(f1 < 4 AS INTEGER) AS hub_exact FROM res)
SELECT *, CAST(weak_recovered = 1 AND member_exact = 1 AND hub_exact = 1 AS INTEGER) AS weak_role_recovered FROM w""")
def weaklink_role(spark, sf):
    r = C.results(spark, sf)
    return T.weaklink_role(r.select(
        "method", "window_id", "seed", (F.col("f1") > 2).cast("int").alias("weak_recovered"), (F.col("auc") > 0.1).cast("int").alias("member_exact"),
        (F.col("f1") < 4).cast("int").alias("hub_exact")))


LABELS = {"F": "Regime", "O": "Static gates", "P": "Full matrix"}


@query("exposure_table", f"""
WITH {C.RES}, s AS (SELECT method, window_id, avg(f1) AS f1_mean, CASE WHEN window_id = 2001 THEN NULL ELSE avg(auc) END AS auc_mean FROM res GROUP BY 1, 2)
SELECT CASE method WHEN 'F' THEN 'Regime' WHEN 'O' THEN 'Static gates' ELSE 'Full matrix' END AS label, window_id, printf('%.3f', round(f1_mean, 6)) AS f1_mean, coalesce(printf('%.3f', round(auc_mean, 6)), '---') AS auc_mean FROM s""")
def exposure_table(spark, sf):
    s = T.replicate_summary(C.results(spark, sf), ["method", "window_id"], ["f1", "auc"])
    s = s.withColumn("auc_mean", F.when(F.col("window_id") != 2001, F.round("auc_mean", 6))).withColumn("f1_mean", F.round("f1_mean", 6))
    return T.display_table(s, LABELS, "method", ["window_id"], ["f1_mean", "auc_mean"])


@query("method_table", f"""
WITH {C.RES} SELECT CASE method WHEN 'F' THEN 'Regime' WHEN 'O' THEN 'Static gates' ELSE 'Full matrix' END AS label, printf('%.3f', round(avg(f1), 6)) AS f1_mean, printf('%.3f', round(avg(auc), 6)) AS auc_mean FROM res GROUP BY method""")
def method_table(spark, sf):
    s = T.replicate_summary(C.results(spark, sf), ["method"], ["f1", "auc"])
    s = s.withColumn("auc_mean", F.round("auc_mean", 6)).withColumn("f1_mean", F.round("f1_mean", 6))
    return T.display_table(s, LABELS, "method", [], ["f1_mean", "auc_mean"])
