"""Scans and sinks."""

from pyspark.sql import functions as F

from flockwise.session import scratch_path
from flockwise.sources import readers as R
from flockwise.sources import writers as W
from workload import canon as C
from workload.registry import query, rounded


def raw_events(spark, sf):
    """The canonical events under the file layout's column names."""
    e = C.events(spark, sf)
    return e.select("session_id", "event_id", F.col("t").alias("time"), "actor", "mark", F.col("z").alias("is_injected"))


@query("read_events", f"WITH {C.EV} SELECT session_id, event_id, round(t, 6) AS t, actor, mark, z FROM ev")
def read_events(spark, sf):
    path = scratch_path(spark, "events")
    raw_events(spark, sf).write.parquet(path)
    return rounded(R.read_events(spark, path, extra=["session_id", "event_id"]))


@query("read_events_aliased", f"""
WITH {C.EV} SELECT round(t, 6) AS t, CAST(session_id AS INTEGER) AS actor, 0 AS mark FROM ev WHERE session_id % 10 <> 3""")
def read_events_aliased(spark, sf):
    """Spike-table layout written as CSV, with unreadable times on some units."""
    path = scratch_path(spark, "spikes") + ".csv"
    e = C.events(spark, sf)
    spike = F.when(F.col("session_id") % 10 == 3, F.lit("bad")).otherwise(F.col("t").cast("string"))
    e.select(spike.alias("spike_time"), F.col("session_id").alias("cluster")).write.option("header", True).csv(path)
    return rounded(R.read_events_aliased(spark, path, "csv"))


@query("read_trades", f"""
WITH {C.TR} SELECT symbol, count(*) AS n, round(sum(price * quantity), 2) AS notional, min(transact_time)::DOUBLE AS first_ms
FROM tr GROUP BY symbol""")
def read_trades(spark, sf):
    path = scratch_path(spark, "trades")
    t = C.trades(spark, sf)
    t.select(
        "symbol", "l_orderkey", "price", "quantity", F.col("l_partkey"), F.col("l_suppkey"), "transact_time", "is_buyer_maker"
    ).write.partitionBy("symbol").option("header", False).csv(path)
    got = R.read_trades(spark, f"{path}/*/*.csv", symbol_pattern=r"symbol=([^/]+)/")
    return got.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("price") * F.col("quantity")), 2).alias("notional"),
        F.min("transact_time").alias("first_ms"),
    )


@query("read_conflict_events", f"""
WITH {C.CF} SELECT CAST(id AS VARCHAR) AS id, CAST(CAST(date_start AS DATE) AS VARCHAR) AS date_start, CAST(date_prec AS VARCHAR) AS date_prec,
  country, CAST(best AS VARCHAR) AS best FROM cf""")
def read_conflict_events(spark, sf):
    path = scratch_path(spark, "conflicts") + ".csv"
    c = C.conflicts(spark, sf)
    c.select(
        F.col("id").alias(" ID"), F.date_format("date_start", "yyyy-MM-dd").alias("Date_Start "), F.col("date_prec").alias("DATE_PREC"),
        F.col("country").alias("Country"), F.col("best").alias("best"), F.col("stream").alias("Unknown_Column"),
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return R.read_conflict_events(spark, path)


@query("read_sessions", f"""
WITH {C.EV} SELECT 'day' || CAST(CAST(floor(t / 24) AS INTEGER) % 7 AS VARCHAR) AS session, 'real' AS condition, actor, count(*) AS n, round(sum(t), 4) AS total_t
FROM ev GROUP BY 1, 2, 3""")
def read_sessions(spark, sf):
    path = scratch_path(spark, "sessions")
    e = raw_events(spark, sf).withColumn("day", (F.floor(F.col("time") / 24) % 7).cast("int"))
    e.write.partitionBy("day").parquet(path)
    manifest = e.select("day").distinct().select(
        F.concat(F.lit("day"), F.col("day").cast("string")).alias("session"), F.lit("real").alias("condition"),
        F.concat(F.lit(f"{path}/day="), F.col("day").cast("string")).alias("path"),
    )
    got = R.read_sessions(spark, manifest, path, "parquet")
    return got.groupBy("session", "condition", "actor").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("t"), 4).alias("total_t"))


@query("read_truth", f"""
WITH {C.EV}, a AS (SELECT session_id % 7 AS seed, actor, count(*) AS n FROM ev GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY n DESC, actor) AS rn FROM a)
SELECT seed, min(actor) FILTER (WHERE rn = 1) AS true_hub, CASE WHEN seed < 3 THEN array_to_string(list(actor ORDER BY actor) FILTER (WHERE rn <= 3), ',')
  WHEN seed < 5 THEN '1,2' ELSE '0,1,2,3' END AS ring FROM r GROUP BY seed""")
def read_truth(spark, sf):
    """Sidecars carry a ring for some seeds, the manifest for others; the rest fall back."""
    path = scratch_path(spark, "truth")
    e = C.events(spark, sf).groupBy((F.col("session_id") % 7).alias("seed"), "actor").agg(F.count(F.lit(1)).alias("n"))
    top = e.groupBy("seed").agg(F.slice(F.array_sort(F.collect_list(F.struct(-F.col("n"), "actor"))), 1, 3).alias("__top"))
    truth = top.select(
        "seed", F.col("__top")[0]["actor"].alias("true_hub"),
        F.when(F.col("seed") < 3, F.array_sort(F.transform("__top", lambda s: s["actor"]))).alias("true_ring"),
    )
    truth.write.json(path)
    manifest_ring = F.when(F.col("seed") < 5, F.lit("[1, 2]"))
    # part files hold one object per line, so the line reader is used here
    got = R.read_truth(spark, path, one_per_file=False)
    ring = R.resolve_ring(F.col("true_ring"), manifest_ring, F.lit(C.K), 4)
    return got.select("seed", "true_hub", F.array_join(ring.cast("array<string>"), ",").alias("ring"))


@query("read_active_windows", f"""
WITH {C.EV} SELECT session_id, round(min(t), 6) AS s, round(max(t), 6) AS e, 1 AS z FROM ev WHERE z = 1 GROUP BY session_id""")
def read_active_windows(spark, sf):
    path = scratch_path(spark, "windows") + ".csv"
    e = C.events(spark, sf).filter("z = 1").groupBy("session_id").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"))
    e.write.option("header", True).csv(path)
    got = R.read_active_windows(spark, path, extra=["session_id"])
    return rounded(got.withColumn("session_id", F.col("session_id").cast("long")))


@query("read_candidate_windows", f"""
WITH {C.CF}, w AS (SELECT country, year(date_start) AS y0, count(*) AS n FROM cf GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, country, y0) - 1 AS rank FROM w)
SELECT country, CAST(y0 AS INTEGER) AS y0, n, rank FROM r WHERE rank IN (0, 2, 5, 7)""")
def read_candidate_windows(spark, sf):
    path = scratch_path(spark, "candidates") + ".csv"
    c = C.conflicts(spark, sf).groupBy("country", F.year("date_start").alias("y0")).agg(F.count(F.lit(1)).alias("n"))
    c.write.option("header", True).csv(path)
    raw = R.read_table(spark, path, "csv").select("country", F.col("y0").cast("int").alias("y0"), F.col("n").cast("long").alias("n"))
    return R.candidate_windows(raw, [F.desc("n"), F.asc("country"), F.asc("y0")], ranks=[0, 2, 5, 7])


@query("write_event_table", f"WITH {C.EV}, f AS (SELECT unnest(['csv','parquet']) AS fmt) SELECT fmt, event_id, round(t, 6) AS t, actor, mark FROM ev, f")
def write_event_table(spark, sf):
    paths = W.write_event_table(C.events(spark, sf).drop("value"), scratch_path(spark, "tidy"))
    cols = [F.col("event_id").cast("long"), F.col("t").cast("double"), F.col("actor").cast("int"), F.col("mark").cast("int")]
    parts = [R.read_table(spark, p, f).select(F.lit(f).alias("fmt"), *cols) for f, p in paths.items()]
    return rounded(parts[0].unionByName(parts[1]))


@query("write_streams", f"""
WITH {C.CF} SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY date_start, id) AS seq, epoch_us(date_start) / 8.64e10 AS t FROM cf""")
def write_streams(spark, sf):
    c = C.conflicts(spark, sf).select("stream", "id", (F.unix_micros("date_start") / F.lit(8.64e10)).alias("t"))
    path, _ = W.write_streams(c, scratch_path(spark, "streams"), "stream", "t", 7.0, ["id"])
    return spark.read.parquet(path)


@query("write_sessions", f"WITH {C.EV} SELECT session_id, count(*) AS events, round(sum(t), 4) AS total_t FROM ev GROUP BY session_id")
def write_sessions(spark, sf):
    path = scratch_path(spark, "by-session")
    e = C.events(spark, sf).drop("value")
    manifest = W.write_sessions(e, path)
    back = spark.read.parquet(path).groupBy("session_id").agg(F.round(F.sum("t"), 4).alias("total_t"))
    return manifest.join(back.withColumn("session_id", F.col("session_id").cast("long")), "session_id").select("session_id", "events", "total_t")


@query("append_results", f"""
WITH {C.RES} SELECT method, CAST(window_id AS INTEGER) AS window_id, seed, round(f1, 6) AS f1, CASE WHEN method = 'F' THEN round(auc, 6) END AS auc FROM res""")
def append_results(spark, sf):
    """The first method fixes the schema; later ones lack a column or bring an unknown one."""
    path = scratch_path(spark, "results")
    r = C.results(spark, sf)
    W.append_results(r.filter("method = 'F'"), path)
    W.append_results(r.filter("method = 'O'").drop("auc"), path)
    W.append_results(r.filter("method = 'P'").drop("auc").withColumn("extra", F.lit(1)), path)
    return rounded(spark.read.parquet(path))


@query("resume_filter", f"""
WITH {C.RES} SELECT method, window_id, seed FROM res WHERE NOT (auc >= 0.2)""")
def resume_filter(spark, sf):
    r = C.results(spark, sf)
    done = r.withColumn("status", F.when(F.col("auc") >= 0.3, F.lit(None).cast("string")).when(F.col("auc") >= 0.2, "ok").otherwise("error"))
    return W.resume_filter(r.select("method", "window_id", "seed"), done, ["method", "window_id", "seed"])
