"""Joins."""

from pyspark.sql import functions as F

from flockwise.operators import events as E
from flockwise.operators import graph as G
from flockwise.operators import intervals as I
from flockwise.operators import profile as P
from flockwise.operators import ranking as K
from flockwise.operators import statistics as T
from workload import canon as C
from workload.registry import query, rounded

PATH = """path AS (SELECT session_id, CAST(floor(t / 48) AS INTEGER) * 48.0 AS s, (CAST(floor(t / 48) AS INTEGER) + 1) * 48.0 AS e, CAST(max(z) AS INTEGER) AS z
  FROM ev GROUP BY session_id, floor(t / 48))"""


def state_path(ev):
    """Piecewise-constant states per session on two-day steps (some steps missing)."""
    step = F.floor(F.col("t") / 48)
    return ev.groupBy("session_id", step.alias("__k")).agg(F.max("z").cast("int").alias("z")).select(
        "session_id", (F.col("__k") * F.lit(48.0)).alias("s"), ((F.col("__k") + 1) * F.lit(48.0)).alias("e"), "z"
    )


@query("encode_actors", """
WITH top AS (SELECT user_id, CAST(row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS INTEGER) AS actor FROM events GROUP BY user_id)
SELECT event_id, actor FROM events JOIN top USING (user_id) WHERE actor < 20""")
def encode_actors(spark, sf):
    return E.encode_actors(C.table(spark, sf, "events"), "user_id", k=20).select("event_id", "actor")


@query("score_truth_join", f"WITH {C.EV}, {C.ES} SELECT seed, src, dst, round(score, 6) AS score, y_true FROM es JOIN et USING (seed, src, dst)")
def score_truth_join(spark, sf):
    s = C.edge_table(spark, sf)
    return rounded(K.one_to_one_join(s, C.edge_truth(s), ["seed", "src", "dst"]))


@query("in_window", f"WITH {C.EV}, {C.WIN} SELECT event_id, CAST(CASE WHEN EXISTS (SELECT 1 FROM win WHERE t >= s AND t < e) THEN 1 ELSE 0 END AS INTEGER) AS inside FROM ev")
def in_window(spark, sf):
    return I.in_window(C.events(spark, sf), C.windows(spark), [], ["event_id"]).select("event_id", "inside")


@query("interval_overlap", f"""
WITH {C.EV}, {C.GRID}, {PATH} SELECT g.session_id, g.b, CAST(coalesce(bool_or(p.z = 1), false) AS INTEGER) AS active
FROM grid g LEFT JOIN path p ON g.session_id = p.session_id AND g.t_end > p.s AND g.t_start < p.e GROUP BY 1, 2""")
def interval_overlap(spark, sf):
    ev = C.events(spark, sf)
    return I.interval_overlap(I.interval_grid(C.sessions(ev), C.DT), state_path(ev), ["session_id"], 48.0).select("session_id", "b", "active")


@query("state_at_time", f"""
WITH {C.EV}, {C.GRID}, {PATH}, m AS (SELECT session_id, b, 0.5 * (t_start + t_end) AS mid FROM grid)
SELECT m.session_id, m.b, coalesce(p.z, 0) AS state_zero, coalesce(p.z, (SELECT arg_max(z, s) FROM path q WHERE q.session_id = m.session_id)) AS state_last
FROM m LEFT JOIN path p ON p.session_id = m.session_id AND m.mid >= p.s AND m.mid < p.e""")
def state_at_time(spark, sf):
    ev = C.events(spark, sf)
    mid = I.interval_grid(C.sessions(ev), C.DT).select("session_id", "b", (0.5 * (F.col("t_start") + F.col("t_end"))).alias("mid"))
    a = I.state_at_time(mid, state_path(ev), ["session_id"], ["b"], "mid", 48.0, name="state_zero")
    out = I.state_at_time(a, state_path(ev), ["session_id"], ["b"], "mid", 48.0, "last", "state_last")
    return out.select("session_id", "b", "state_zero", "state_last")


@query("switch_intervals", f"""
WITH {C.EV}, {PATH} SELECT DISTINCT session_id, CAST(least(floor(e / 24.0), 29) AS INTEGER) AS b, 1 AS switch FROM path WHERE e > 0 AND e < 720""")
def switch_intervals(spark, sf):
    return I.switch_intervals(state_path(C.events(spark, sf)), C.HORIZON, C.DT, ["session_id"])


@query("ordered_pairs", f"""
WITH {C.EV}, a AS (SELECT DISTINCT session_id, actor FROM ev) SELECT x.session_id, x.actor AS src, y.actor AS dst, CAST(CASE WHEN x.actor < y.actor THEN 1 ELSE 0 END AS INTEGER) AS upper
FROM a x JOIN a y ON x.session_id = y.session_id AND x.actor <> y.actor""")
def ordered_pairs(spark, sf):
    items = C.events(spark, sf).select("session_id", "actor").distinct()
    up = G.ordered_pairs(items, ["session_id"], "actor", directed=False).withColumn("upper", F.lit(1))
    every = G.ordered_pairs(items, ["session_id"], "actor")
    return every.join(up, ["session_id", "src", "dst"], "left").fillna(0, ["upper"])


@query("group_windows", f"""
WITH {C.CF}, s AS (SELECT country, CAST(min(year(date_start)) AS INTEGER) AS lo, CAST(max(year(date_start)) AS INTEGER) AS hi FROM cf GROUP BY 1)
SELECT country, CAST(lo + r.range AS INTEGER) AS y0 FROM s, range(20) r WHERE lo + r.range <= hi - 2""")
def group_windows(spark, sf):
    c = C.conflicts(spark, sf).withColumn("year", F.year("date_start"))
    return P.group_windows(c, "country", "year", 3, 1)


@query("paired_methods", f"""
WITH {C.RES} SELECT a.window_id, a.seed, round(a.f1 - b.f1, 6) AS d FROM res a JOIN res b ON a.window_id = b.window_id AND a.seed = b.seed WHERE a.method = 'F' AND b.method = 'O'""")
def paired_methods(spark, sf):
    r = C.results(spark, sf).withColumn("strength", F.lit(1.0) + F.lit(1e-12))
    return rounded(T.paired_methods(r, ["window_id", "seed"], "f1", "F", "O", close={"strength": 1.0}).select("window_id", "seed", "d"))


@query("overlay_events", f"""
WITH {C.EV} SELECT event_id, session_id, round(t, 6) AS t, actor, mark, CASE WHEN z = 0 THEN NULL ELSE round(value, 6) END AS value, z AS is_injected FROM ev""")
def overlay_events(spark, sf):
    e = C.events(spark, sf)
    both = E.overlay_events(e.filter("z = 0").drop("value", "z"), e.filter("z = 1").drop("z"))
    return rounded(both.select("event_id", "session_id", "t", "actor", "mark", "value", "is_injected"))


REMOVAL = f"""{C.EV}, {C.WIN}, bg AS (SELECT *, CAST(CASE WHEN EXISTS (SELECT 1 FROM win WHERE t >= s AND t < e) THEN 1 ELSE 0 END AS INTEGER) AS inside FROM ev WHERE z = 0),
pl AS (SELECT *, row_number() OVER (PARTITION BY session_id, actor ORDER BY inside,
  ('0x' || substr(md5(concat_ws('|', '5', 'remove', CAST(inside AS VARCHAR), CAST(event_id AS VARCHAR))), 1, 13))::BIGINT / 4503599627370496.0, event_id) AS rn FROM bg),
need AS (SELECT session_id, actor, count(*) AS need FROM ev WHERE z = 1 GROUP BY 1, 2),
fl AS (SELECT pl.*, CAST(CASE WHEN rn <= coalesce(need, 0) THEN 1 ELSE 0 END AS INTEGER) AS removed FROM pl LEFT JOIN need USING (session_id, actor))"""


def removal(spark, sf):
    e = C.events(spark, sf)
    return E.volume_neutral_removal(e.filter("z = 0"), e.filter("z = 1"), C.windows(spark, e), ["session_id"], 5)


@query("volume_neutral_removal", f"WITH {REMOVAL} SELECT event_id, inside, removed FROM fl")
def volume_neutral_removal(spark, sf):
    return removal(spark, sf)[0].select("event_id", "inside", "removed")


@query("volume_neutral_report", f"""
WITH {REMOVAL}, r AS (SELECT session_id, actor, count(*) AS background, sum(removed) AS removed FROM fl GROUP BY 1, 2)
SELECT session_id, actor, need AS overlay, coalesce(background, 0) AS background, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(CASE WHEN coalesce(removed, 0) < need THEN 1 ELSE 0 END AS INTEGER) AS cap_hit FROM need LEFT JOIN r USING (session_id, actor)""")
def volume_neutral_report(spark, sf):
    return removal(spark, sf)[1]


@query("session_lookup", f"""
WITH {C.EV}, m AS (SELECT session_id, arg_max(actor, (n, -actor)) AS true_hub FROM (SELECT session_id, actor, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1),
{C.WIN} SELECT event_id, true_hub, CAST(CASE WHEN EXISTS (SELECT 1 FROM win WHERE t >= s AND t < e) THEN 1 ELSE 0 END AS INTEGER) AS inside, CAST(CASE WHEN actor = true_hub THEN 1 ELSE 0 END AS INTEGER) AS is_hub
FROM ev LEFT JOIN m USING (session_id)""")
def session_lookup(spark, sf):
    """Events with their session's truth and windows attached."""
    e = C.events(spark, sf)
    hub = e.groupBy("session_id", "actor").agg(F.count(F.lit(1)).alias("n")).groupBy("session_id").agg(
        F.max_by("actor", F.struct("n", -F.col("actor"))).alias("true_hub")
    )
    out = I.in_window(e.join(hub, "session_id", "left"), C.windows(spark, e), ["session_id"], ["event_id"])
    return out.select("event_id", "true_hub", "inside", (F.col("actor") == F.col("true_hub")).cast("int").alias("is_hub"))
