"""Ranks, selections, ordered statistics and sets."""

from pyspark.sql import functions as F

from flockwise.operators import events as E
from flockwise.operators import intervals as I
from flockwise.operators import profile as P
from flockwise.operators import ranking as K
from workload import canon as C
from workload.aggregates import POST, posteriors
from workload.registry import query, rounded

U = "('0x' || substr(md5(concat_ws('|', {})), 1, 13))::BIGINT / 4503599627370496.0"


@query("top_k_streams", """
SELECT user_id, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS INTEGER) AS actor FROM events GROUP BY user_id QUALIFY actor < 25""")
def top_k_streams(spark, sf):
    return E.top_k_labels(C.table(spark, sf, "events"), "user_id", 25)


@query("top_k_per_group", f"""
WITH {C.CF} SELECT country, stream, count(*) AS n, CAST(row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, stream) - 1 AS INTEGER) AS actor FROM cf GROUP BY 1, 2 QUALIFY actor < 3""")
def top_k_per_group(spark, sf):
    return E.top_k_labels(C.conflicts(spark, sf), "stream", 3, ["country"])


@query("inter_arrivals", f"""
WITH {C.EV}, g AS (SELECT session_id, event_id, t - lag(t) OVER (PARTITION BY session_id ORDER BY t, event_id) AS gap FROM ev) SELECT session_id, event_id, round(gap, 6) AS gap FROM g WHERE gap IS NOT NULL""")
def inter_arrivals(spark, sf):
    return rounded(P.inter_arrivals(C.events(spark, sf), ["session_id"], C.DT).select("session_id", "event_id", "gap"))


@query("active_runs", f"""
WITH {POST}, best AS (SELECT session_id, arg_min(b, (-star, b)) AS best, count(*) FILTER (WHERE star >= 0.5) AS passing FROM post GROUP BY 1),
o AS (SELECT p.*, p.b - row_number() OVER (PARTITION BY session_id ORDER BY b) AS island FROM post p JOIN best USING (session_id) WHERE star >= 0.5 OR (passing < 1 AND b = best))
SELECT session_id, min(b) * 24.0::DOUBLE AS s, (max(b) + 1) * 24.0::DOUBLE AS e FROM o GROUP BY session_id, island""")
def active_runs(spark, sf):
    p = posteriors(spark, sf).withColumn("t_start", F.col("b") * F.lit(C.DT)).withColumn("t_end", (F.col("b") + 1) * F.lit(C.DT))
    return I.active_runs(p, ["session_id"], "star", 0.5)


@query("stratified_cap", f"""
WITH {C.TR}, g AS (SELECT *, row_number() OVER (PARTITION BY symbol, is_buyer_maker ORDER BY {U.format("'3', 'cap', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)")}, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rn FROM tr),
s AS (SELECT symbol, is_buyer_maker, count(*) AS size, sum(count(*)) OVER () AS total FROM tr GROUP BY 1, 2),
a AS (SELECT *, greatest(floor(1003 * size / total), 1)::BIGINT AS a FROM s), o AS (SELECT *, 1003 - sum(a) OVER () AS off FROM a),
d AS (SELECT symbol, is_buyer_maker, off, row_number() OVER (ORDER BY size - a - r.range DESC, symbol, is_buyer_maker) AS dr FROM o, range(1, 100) r WHERE r.range <= off),
k AS (SELECT symbol, is_buyer_maker, max(a) + count(dr) AS keep FROM o LEFT JOIN (SELECT * FROM d WHERE dr <= off) USING (symbol, is_buyer_maker) GROUP BY 1, 2)
SELECT g.symbol, g.is_buyer_maker, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM g JOIN k USING (symbol, is_buyer_maker) WHERE rn <= keep""")
def stratified_cap(spark, sf):
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return E.stratified_cap(C.trades(spark, sf), ["symbol", "is_buyer_maker"], 1003, ids, 3).select("symbol", "is_buyer_maker", *ids)


@query("stable_order", f"""
WITH {C.EV} SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY {U.format("'9', 'perm', CAST(event_id AS VARCHAR)")}, event_id) AS pos FROM ev""")
def stable_order(spark, sf):
    return E.stable_order(C.events(spark, sf), ["session_id"], ["event_id"], 9, "perm").select("session_id", "event_id", "pos")


@query("ks_exp1", f"""
WITH {C.EV}, x AS (SELECT session_id, value / 40.0 AS x, row_number() OVER (PARTITION BY session_id ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM ev)
SELECT session_id, round(max(greatest(i / n - (1 - exp(-x)), (1 - exp(-x)) - (i - 1) / n)), 6) AS ks, max(n) AS n FROM x GROUP BY 1""")
def ks_exp1(spark, sf):
    return rounded(K.ks_exp1(C.events(spark, sf).withColumn("x", F.col("value") / 40.0), ["session_id"], "x", ["event_id"]))


@query("qq_points", f"""
WITH {C.EV}, x AS (SELECT session_id, value / 40.0 AS x, row_number() OVER (PARTITION BY session_id ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM ev)
SELECT session_id, i, round(x, 6) AS x, round(-ln(1 - (i - 0.5) / n), 6) AS theory, round(i / n, 6) AS ecdf FROM x""")
def qq_points(spark, sf):
    return rounded(K.qq_points(C.events(spark, sf).withColumn("x", F.col("value") / 40.0), ["session_id"], "x", ["event_id"]))


AUC_SQL = """SELECT {k} count(*) FILTER (WHERE z = 1) AS positives, count(*) FILTER (WHERE z <> 1) AS negatives,
  CASE WHEN count(*) FILTER (WHERE z = 1) > 0 AND count(*) FILTER (WHERE z <> 1) > 0 THEN
  round((sum(mid) FILTER (WHERE z = 1) - count(*) FILTER (WHERE z = 1) * (count(*) FILTER (WHERE z = 1) + 1) / 2.0) / (count(*) FILTER (WHERE z = 1)::DOUBLE * count(*) FILTER (WHERE z <> 1)), 6) END AS auc"""


@query("roc_auc", f"""
WITH {C.EV}, s AS (SELECT session_id, z, floor(value / 5) AS s FROM ev), r AS (SELECT session_id, z, rank() OVER (PARTITION BY session_id ORDER BY s) + (count(*) OVER (PARTITION BY session_id, s) - 1) / 2.0 AS mid FROM s)
{AUC_SQL.format(k='session_id,')} FROM r GROUP BY session_id""")
def roc_auc(spark, sf):
    return rounded(K.roc_auc(C.events(spark, sf).withColumn("s", F.floor(F.col("value") / 5)), ["session_id"], "z", "s"))


@query("roc_auc_whole", f"""
WITH {C.EV}, r AS (SELECT z, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS mid FROM ev) {AUC_SQL.format(k='')} FROM r""")
def roc_auc_whole(spark, sf):
    return rounded(K.roc_auc(C.events(spark, sf), [], "z", "value"))


SCORES = f"{C.EV}, sc AS (SELECT session_id, actor, sum(value) AS s, sum(z) AS truth_n FROM ev GROUP BY 1, 2)"


def actor_scores(spark, sf):
    return C.events(spark, sf).groupBy("session_id", "actor").agg(F.sum("value").alias("s"), F.sum("z").alias("truth_n"))


@query("largest_gap_select", f"""
WITH {SCORES}, r AS (SELECT *, row_number() OVER w AS rn, s - lead(s) OVER w AS gap, ln(greatest(s, 1e-12)) - ln(greatest(lead(s) OVER w, 1e-12)) AS lgap FROM sc WINDOW w AS (PARTITION BY session_id ORDER BY s DESC, actor DESC)),
c AS (SELECT session_id, greatest(coalesce(arg_min(rn, (-gap, rn)) FILTER (WHERE gap IS NOT NULL), 1), 2) AS cut, greatest(coalesce(arg_min(rn, (-lgap, rn)) FILTER (WHERE gap IS NOT NULL), 1), 1) AS lcut FROM r GROUP BY 1)
SELECT session_id, actor, CAST(CASE WHEN rn <= cut THEN 1 ELSE 0 END AS INTEGER) AS selected, CAST(CASE WHEN rn <= lcut THEN 1 ELSE 0 END AS INTEGER) AS selected_log FROM r JOIN c USING (session_id)""")
def largest_gap_select(spark, sf):
    s = actor_scores(spark, sf)
    a = K.largest_gap_select(s, ["session_id"], "s", min_k=2).select("session_id", "actor", "selected")
    b = K.largest_gap_select(s, ["session_id"], "s", use_log=True).select("session_id", "actor", F.col("selected").alias("selected_log"))
    return a.join(b, ["session_id", "actor"])


@query("actor_rank", f"WITH {SCORES} SELECT session_id, actor, CAST(row_number() OVER (PARTITION BY session_id ORDER BY s DESC, actor DESC) AS INTEGER) AS rank FROM sc")
def actor_rank(spark, sf):
    return K.actor_rank(actor_scores(spark, sf), ["session_id"], "s").select("session_id", "actor", "rank")


@query("receiver_support", f"""
WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s DESC, actor DESC) AS rn FROM sc WHERE actor <> 0),
a AS (SELECT session_id, count(*) FILTER (WHERE rn <= 2 AND actor IN (1, 3))::DOUBLE AS tp, count(*) FILTER (WHERE rn <= 2)::DOUBLE AS p, max(CASE WHEN rn <= 2 THEN 1 ELSE 0 END) FILTER (WHERE actor = 3) AS wr,
  max(rn) FILTER (WHERE actor = 3) AS wk, max(s) FILTER (WHERE actor = 3) AS ws, array_to_string(list(actor ORDER BY actor) FILTER (WHERE rn <= 2), ',') AS predicted FROM r GROUP BY 1)
SELECT session_id, round(2 * (tp / greatest(p, 1)) * (tp / 2) / greatest(tp / greatest(p, 1) + tp / 2, 1e-12), 6) AS receiver_f1, CAST(coalesce(wr, 0) AS INTEGER) AS weak_recovered,
  CAST(coalesce(wk, -1) AS INTEGER) AS weak_rank, round(ws, 6) AS weak_score, predicted FROM a""")
def receiver_support(spark, sf):
    out = K.receiver_diagnostics(actor_scores(spark, sf), ["session_id"], "s", 0, [1, 3], 3)
    return rounded(out.withColumn("predicted", F.array_join(F.col("predicted").cast("array<string>"), ",")))


@query("metrics_at_edge_count", f"""
WITH {C.EV}, {C.ES}, j AS (SELECT seed, src, dst, score, y_true FROM es JOIN et USING (seed, src, dst)),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, src, dst) AS rn, sum(y_true) OVER (PARTITION BY seed) AS m, count(*) OVER (PARTITION BY seed) AS n,
  rank() OVER (PARTITION BY seed ORDER BY score) + (count(*) OVER (PARTITION BY seed, score) - 1) / 2.0 AS mid FROM j),
a AS (SELECT seed, max(n) AS n, CAST(max(m) AS BIGINT) AS m, count(*) FILTER (WHERE rn <= m AND y_true = 1) AS tp, (sum(mid) FILTER (WHERE y_true = 1) - max(m) * (max(m) + 1) / 2.0) / (max(m) * (max(n) - max(m))) AS auc FROM r GROUP BY 1)
SELECT seed, n AS n_pairs, m AS n_edges, n - m AS n_non_edges, round(m / n, 6) AS edge_density, round(tp / m, 6) AS precision_at_m, round(tp / m, 6) AS recall_at_m, round(tp / m, 6) AS f1_at_m, round(auc, 6) AS auc,
  round(m / n, 6) AS chance_f1_at_m, 0.5::DOUBLE AS chance_auc, round(tp / m - m / n, 6) AS f1_lift_over_chance, round(auc - 0.5, 6) AS auc_lift_over_chance, round(1.0 / (m * (n - m)), 6)::DOUBLE AS auc_granularity FROM a""")
def metrics_at_edge_count(spark, sf):
    s = C.edge_table(spark, sf)
    return rounded(K.metrics_at_edge_count(K.one_to_one_join(s, C.edge_truth(s), ["seed", "src", "dst"]), ["seed"]))


@query("sort_limit", f"""
WITH {C.RES} SELECT method, window_id, seed, round(f1, 6) AS f1 FROM res ORDER BY f1 DESC, method, window_id, seed LIMIT 50""")
def sort_limit(spark, sf):
    r = C.results(spark, sf)
    return rounded(r.orderBy(F.desc("f1"), "method", "window_id", "seed").limit(50).select("method", "window_id", "seed", "f1"))


@query("union_events", f"""
WITH {C.EV}, {C.TR} SELECT 'event' AS kind, CAST(event_id AS BIGINT) AS id, round(t, 6) AS t, NULL::VARCHAR AS symbol FROM ev UNION ALL SELECT 'trade', l_orderkey, round(transact_time / 3.6e6, 6), symbol FROM tr""")
def union_events(spark, sf):
    e = C.events(spark, sf).select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "t")
    t = C.trades(spark, sf).select(F.lit("trade").alias("kind"), F.col("l_orderkey").alias("id"), (F.col("transact_time") / F.lit(3.6e6)).alias("t"), "symbol")
    return rounded(e.unionByName(t, allowMissingColumns=True))


ROLES = f"""{SCORES}, rk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s DESC, actor DESC) AS rn FROM sc),
fl AS (SELECT session_id, actor, CASE WHEN rn <= 2 THEN 1 ELSE 0 END AS pred, CASE WHEN truth_n >= 5 THEN 1 ELSE 0 END AS truth, rn FROM rk)"""


def role_flags(spark, sf):
    placed = K.top_flag(actor_scores(spark, sf), ["session_id"], "s", 2, "pred")
    return K.actor_rank(placed, ["session_id"], "s").withColumn("truth", (F.col("truth_n") >= 5).cast("int"))


@query("set_prf", f"""
WITH {ROLES}, a AS (SELECT session_id, sum(pred * truth)::DOUBLE AS tp, sum(pred) AS p, sum(truth) AS t FROM fl GROUP BY 1), b AS (SELECT session_id, tp / greatest(p, 1) AS precision, tp / greatest(t, 1) AS recall, p, t FROM a)
SELECT session_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN p = 0 AND t = 0 THEN 1 ELSE 2 * precision * recall / greatest(precision + recall, 1e-12) END, 6)::DOUBLE AS f1 FROM b""")
def set_prf(spark, sf):
    f = role_flags(spark, sf)
    sets = f.groupBy("session_id").agg(
        F.collect_set(F.when(F.col("pred") == 1, F.col("actor"))).alias("p"), F.collect_set(F.when(F.col("truth") == 1, F.col("actor"))).alias("t")
    )
    prec, rec, f1 = K.set_prf(F.col("p"), F.col("t"), empty_is_one=True)
    return rounded(sets.select("session_id", prec.alias("precision"), rec.alias("recall"), f1.alias("f1")))


@query("exact_support", f"""
WITH {ROLES}, a AS (SELECT session_id, bool_and(pred = truth) AS me, bool_and((CASE WHEN rn = 2 THEN 1 ELSE 0 END) = (CASE WHEN truth = 1 AND actor <> 0 THEN 1 ELSE 0 END)) AS re, bool_or(rn = 1 AND actor = 0) AS he FROM fl GROUP BY 1)
SELECT session_id, CAST(me AS INTEGER) AS member_exact, CAST(re AS INTEGER) AS receiver_exact, CAST(he AS INTEGER) AS hub_exact, CAST(me AND re AS INTEGER) AS member_receiver_exact, CAST(me AND re AND he AS INTEGER) AS all_role_exact FROM a""")
def exact_support(spark, sf):
    pick = lambda c: F.collect_set(F.when(c, F.col("actor")))
    f = role_flags(spark, sf).groupBy("session_id").agg(
        pick(F.col("pred") == 1).alias("pred_ring"), pick(F.col("truth") == 1).alias("true_ring"), pick(F.col("rank") == 2).alias("pred_receivers"),
        pick((F.col("truth") == 1) & (F.col("actor") != 0)).alias("true_receivers"), F.max(F.when(F.col("rank") == 1, F.col("actor"))).alias("hub_pred"),
        F.lit(0).alias("true_hub"),
    )
    return K.exact_support(f).select("session_id", "member_exact", "receiver_exact", "hub_exact", "member_receiver_exact", "all_role_exact")


@query("distinct_keys", f"WITH {C.TR} SELECT symbol, is_buyer_maker FROM tr GROUP BY 1, 2")
def distinct_keys(spark, sf):
    return C.trades(spark, sf).select("symbol", "is_buyer_maker").distinct()
