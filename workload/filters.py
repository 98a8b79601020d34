"""Projections, filters and time handling."""

from datetime import datetime

from pyspark.sql import functions as F

from flockwise.operators import events as E
from flockwise.operators import intervals as I
from workload import canon as C
from workload.registry import query, rounded


@query("coerce_numeric", """
WITH t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS a,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS b FROM events)
SELECT event_id, try_cast(a AS DOUBLE) AS a, try_cast(b AS DOUBLE) AS b FROM t WHERE try_cast(b AS DOUBLE) IS NOT NULL""")
def coerce_numeric(spark, sf):
    e = C.table(spark, sf, "events")
    t = e.select(
        "event_id", F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("a"),
        F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("user_id").cast("string")).alias("b"),
    )
    return E.coerce_numeric(t, ["a", "b"], ["b"])


@query("parse_dates", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders WHERE o_orderkey % 4 <> 3""")
def parse_dates(spark, sf):
    o = C.table(spark, sf, "orders")
    d = F.col("o_orderdate").cast("timestamp")
    k = F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, F.date_format(d, "M/d/yyyy")).otherwise(F.lit("unknown"))
    )
    return E.parse_dates(o.select("o_orderkey", text.alias("d")), ["d"]).withColumn("d", F.col("d").cast("date").cast("string"))


@query("valid_label", """
WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' ' || event_type || ' ' WHEN 1 THEN 'NaN' WHEN 2 THEN '  ' WHEN 3 THEN NULL ELSE event_type END AS label FROM events)
SELECT event_id, trim(label) AS label FROM t WHERE label IS NOT NULL AND trim(label) <> '' AND lower(trim(label)) <> 'nan'""")
def valid_label(spark, sf):
    e = C.table(spark, sf, "events")
    k = F.col("event_id") % 6
    label = (
        F.when(k == 0, F.concat(F.lit(" "), "event_type", F.lit(" "))).when(k == 1, "NaN").when(k == 2, "  ")
        .when(k == 3, F.lit(None).cast("string")).otherwise(F.col("event_type"))
    )
    return E.valid_label(e.select("event_id", label.alias("label")), "label")


@query("type_precision_filter", f"WITH {C.CF} SELECT id, type_of_violence, date_prec FROM cf WHERE type_of_violence IN (1, 3) AND date_prec = 1")
def type_precision_filter(spark, sf):
    return E.type_precision_filter(C.conflicts(spark, sf), [1, 3], True).select("id", "type_of_violence", "date_prec")


@query("attribute_filter", f"WITH {C.CF} SELECT id, country, region, stream FROM cf WHERE country = 'NATION_7' AND stream = 'BUILDING'")
def attribute_filter(spark, sf):
    got = E.attribute_filter(C.conflicts(spark, sf), country="NATION_7", region=None, stream="BUILDING")
    return got.select("id", "country", "region", "stream")


@query("date_window", f"""
WITH {C.CF}, w AS (SELECT * FROM cf WHERE date_start >= TIMESTAMP '1996-01-01' AND date_start < TIMESTAMP '1998-01-01')
SELECT country, count(*) AS n, CAST(CAST(min(date_start) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(date_start) + INTERVAL 1 DAY AS DATE) AS VARCHAR) AS open_end FROM w GROUP BY country""")
def date_window(spark, sf):
    w = E.date_window(C.conflicts(spark, sf), "date_start", datetime(1996, 1, 1), datetime(1998, 1, 1))
    return w.groupBy("country").agg(
        F.count(F.lit(1)).alias("n"), F.min("date_start").cast("date").cast("string").alias("first_day"),
        (F.max("date_start") + F.expr("INTERVAL 1 DAY")).cast("date").cast("string").alias("open_end"),
    )


@query("event_domain_filter", f"""
WITH {C.EV} SELECT session_id, count(*) FILTER (WHERE t >= 24 AND t <= 700 AND actor < 4 AND mark < 2) AS kept,
  count(*) FILTER (WHERE NOT (t >= 24 AND t <= 700 AND actor < 4 AND mark < 2)) AS dropped FROM ev GROUP BY session_id""")
def event_domain_filter(spark, sf):
    return E.domain_report(C.events(spark, sf), ["session_id"], 24.0, 700.0, 4, 2)


@query("time_slice", f"WITH {C.EV}, {C.WIN} SELECT event_id, s, round(t - s, 6) AS t_rel FROM ev JOIN win ON t >= s AND t < e")
def time_slice(spark, sf):
    return rounded(E.time_slice(C.events(spark, sf), C.windows(spark)).select("event_id", "s", "t_rel"))


@query("rebase_time", f"WITH {C.EV} SELECT session_id, event_id, round(t - min(t) OVER (PARTITION BY session_id), 6) AS t FROM ev")
def rebase_time(spark, sf):
    return rounded(E.rebase_time(C.events(spark, sf), ["session_id"]).select("session_id", "event_id", "t"))


@query("day_axis", f"""
WITH {C.CF}, a AS (SELECT *, (epoch_us(date_start) - min(epoch_us(date_start)) OVER (PARTITION BY country)) / 8.64e10 AS event_time FROM cf)
SELECT id, round(event_time, 6) AS event_time, CAST(date_diff('day', date_start, date_end) AS INTEGER) AS interval_days,
  greatest(365.0, max(event_time) OVER (PARTITION BY country) + 1.0, 1.0)::DOUBLE AS T FROM a""")
def day_axis(spark, sf):
    d = E.day_axis(C.conflicts(spark, sf), ["country"])
    return rounded(d.join(E.day_horizon(d, ["country"], 365.0), "country").select("id", "event_time", "interval_days", "T"))


@query("trade_features", f"""
WITH {C.TR} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(price * quantity, 4) AS notional,
  round((transact_time - 788918400000) / 60000.0, 6) AS time, CAST(CASE WHEN lower(is_buyer_maker) IN ('true', '1') THEN 1 ELSE 0 END AS INTEGER) AS mark FROM tr""")
def trade_features(spark, sf):
    t = E.trade_features(C.trades(spark, sf), 788_918_400_000.0)
    return rounded(t.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("notional", 4).alias("notional"), "time", "mark"))


@query("severity_mark", f"""
WITH {C.CF} SELECT id, CAST(CASE WHEN coalesce(best, 1) < 2 THEN 0 WHEN coalesce(best, 1) < 5 THEN 1 ELSE 2 END AS INTEGER) AS mark FROM cf""")
def severity_mark(spark, sf):
    return C.conflicts(spark, sf).select("id", E.severity_mark("best").cast("int").alias("mark"))


@query("dense_code", f"WITH {C.CF} SELECT id, CAST(dense_rank() OVER (ORDER BY coalesce(best, 1)) - 1 AS INTEGER) AS code FROM cf")
def dense_code(spark, sf):
    return E.dense_code(C.conflicts(spark, sf), "best").select("id", F.col("code").cast("int").alias("code"))


@query("coarsen_time", f"""
WITH {C.EV}, u AS (SELECT event_id, greatest(t, 0.0) AS t,
  ('0x' || substr(md5(concat_ws('|', '11', 'coarsen', CAST(event_id AS VARCHAR))), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM ev)
SELECT event_id, round(greatest(least(floor(t / 72.0) * 72.0 + u * 72.0, 720.0 - 1e-6), 0.0), 6) AS t_coarse,
  round(greatest(least(floor(t / 24.0) * 24.0 + u * 0.5, 720.0 - 1e-6), 0.0), 6) AS t_exact FROM u""")
def coarsen_time(spark, sf):
    e = C.events(spark, sf)
    a = E.coarsen_time(e, C.HORIZON, 24.0, 72.0, seed=11).withColumnRenamed("t_obs", "t_coarse")
    b = E.coarsen_time(a, C.HORIZON, 24.0, 0.0, 0.5, seed=11).withColumnRenamed("t_obs", "t_exact")
    return rounded(b.select("event_id", "t_coarse", "t_exact"))


@query("head_n_events", f"""
WITH {C.EV} SELECT session_id, event_id, rn FROM (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY t, actor, mark, event_id) AS rn FROM ev) WHERE rn <= 20""")
def head_n_events(spark, sf):
    return E.head_n_events(C.events(spark, sf), ["session_id"], 20, C.DT).select("session_id", "event_id", "rn")


@query("split_by_time", f"""
WITH {C.EV}, g AS (SELECT session_id FROM ev GROUP BY session_id HAVING count(*) FILTER (WHERE t < 720.0 * 0.8) >= 10 AND count(*) FILTER (WHERE t >= 720.0 * 0.8) >= 10)
SELECT session_id, event_id, CASE WHEN t >= 720.0 * 0.8 THEN 'test' ELSE 'train' END AS split, round(CASE WHEN t >= 720.0 * 0.8 THEN t - 720.0 * 0.8 ELSE t END, 6) AS t
FROM ev WHERE session_id IN (SELECT session_id FROM g)""")
def split_by_time(spark, sf):
    return rounded(E.split_by_time(C.events(spark, sf), ["session_id"], C.HORIZON, 0.2).select("session_id", "event_id", "split", "t"))


@query("ok_rows", f"WITH {C.RES} SELECT method, window_id, seed FROM res WHERE auc >= 0.2")
def ok_rows(spark, sf):
    r = C.results(spark, sf)
    r = r.withColumn("status", F.when(F.col("auc") >= 0.3, F.lit(None).cast("string")).when(F.col("auc") >= 0.2, "ok").otherwise("error"))
    return E.ok_rows(r).select("method", "window_id", "seed")


@query("interval_grid", f"""
WITH {C.EV}, h AS (SELECT session_id, max(t) AS T FROM ev GROUP BY 1)
SELECT session_id, CAST(r.range AS INTEGER) AS b, r.range * 36.0 AS t_start, round(least((r.range + 1) * 36.0, T), 6) AS t_end, CAST(1 AS INTEGER) AS closed
FROM h, range(25) r WHERE r.range < ceil(T / 36.0)
UNION ALL SELECT session_id, CAST(r.range AS INTEGER), r.range * 36.0, (r.range + 1) * 36.0, CAST(0 AS INTEGER) FROM h, range(25) r WHERE r.range < floor(T / 36.0 + 1e-9)""")
def interval_grid(spark, sf):
    h = C.events(spark, sf).groupBy("session_id").agg(F.max("t").alias("T"))
    both = I.interval_grid(h, 36.0).withColumn("closed", F.lit(1)).unionByName(I.interval_grid(h, 36.0, closed=False).withColumn("closed", F.lit(0)))
    return rounded(both.drop("T"))


@query("assign_interval", f"""
WITH {C.EV} SELECT event_id, CAST(greatest(least(floor(t / 7.0), 99), 0) AS INTEGER) AS b_clip,
  CASE WHEN t >= 0 AND t < 700 THEN CAST(floor(t / 7.0) AS INTEGER) END AS b_drop, CASE WHEN t >= 0 AND t <= 700 THEN CAST(least(floor(t / 7.0), 99) AS INTEGER) END AS b_hist FROM ev""")
def assign_interval(spark, sf):
    e = C.events(spark, sf)
    T = F.lit(700.0)
    return e.select("event_id", *[I.interval_index(F.col("t"), 7.0, T, m).alias(f"b_{m}") for m in ("clip", "drop", "hist")])
