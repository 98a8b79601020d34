"""The driver tables in the library's shapes, in Spark and as SQL fragments.

Every event is used: a session is a user, an actor is one of the five event types, a mark is
one of three value bands, ``z`` is a 0/1 label from the event's properties, and ``t`` counts
hours from 2024-01-01.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K, M = 5, 3
HORIZON = 720.0
DT = 24.0
ACTORS = ["click", "error", "purchase", "signup", "view"]
WINDOWS = [(60.0, 132.0), (300.0, 372.0), (480.0, 552.0), (600.0, 672.0)]
EPOCH_US = 1_704_067_200_000_000
TRUE_EDGES = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (0, 2)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str, session: bool = True) -> DataFrame:
    e = table(spark, sf, "events")
    band = F.when(F.col("value") < 20, 0).when(F.col("value") < 60, 1).otherwise(2)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return e.select(
        (F.col("user_id") if session else F.lit(0).cast("long")).alias("session_id"),
        "event_id",
        ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)) / F.lit(3.6e9)).alias("t"),
        (F.array_position(F.array(*[F.lit(a) for a in ACTORS]), F.col("event_type")) - 1).cast("int").alias("actor"),
        band.alias("mark"),
        F.when(k >= 70, 1).otherwise(0).alias("z"),
        "value",
    )


EV = """ev AS (
  SELECT user_id AS session_id, event_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t,
    CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS INTEGER) AS actor,
    CAST(CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END AS INTEGER) AS mark,
    CAST(CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) >= 70 THEN 1 ELSE 0 END AS INTEGER) AS z,
    value
  FROM events)"""

GRID = """grid AS (
  SELECT s.session_id, CAST(r.range AS INTEGER) AS b, r.range * 24.0 AS t_start, (r.range + 1) * 24.0 AS t_end
  FROM (SELECT DISTINCT session_id FROM ev) s CROSS JOIN range(30) r)"""

EVB = "evb AS (SELECT *, CAST(floor(t / 24.0) AS INTEGER) AS b FROM ev)"

WIN = "win AS (SELECT * FROM (VALUES (60.0::DOUBLE, 132.0::DOUBLE, 1), (300.0, 372.0, 1), (480.0, 552.0, 1), (600.0, 672.0, 1)) w(s, e, z))"


def windows(spark: SparkSession, ev: DataFrame | None = None) -> DataFrame:
    """The fixed active windows, as one table or once per session of ``ev``."""
    w = spark.createDataFrame([(s, e, 1) for s, e in WINDOWS], "s double, e double, z int")
    if ev is None:
        return w
    arr = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(1).alias("z")) for s, e in WINDOWS])
    return ev.select("session_id").distinct().select("session_id", F.inline(arr))


def sessions(ev: DataFrame) -> DataFrame:
    return ev.select("session_id").distinct().withColumn("T", F.lit(HORIZON))


def trades(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    return l.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1000).alias("transact_time"),
        F.when(F.col("l_linenumber") % 2 == 1, "True").otherwise("false").alias("is_buyer_maker"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    )


TR = """tr AS (
  SELECT concat(l_returnflag, l_linestatus) AS symbol, l_extendedprice AS price, l_quantity AS quantity,
    epoch_us(l_shipdate) / 1000 AS transact_time,
    CASE WHEN l_linenumber % 2 = 1 THEN 'True' ELSE 'false' END AS is_buyer_maker,
    l_orderkey, l_partkey, l_suppkey, l_linenumber
  FROM lineitem)"""


def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    p = F.col("o_orderpriority")
    best = F.when(p == "1-URGENT", 9).when(p == "2-HIGH", 5).when(p == "3-MEDIUM", 3).when(p == "5-LOW", 1)
    start = F.col("o_orderdate").cast("timestamp")
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            start.alias("date_start"),
            (start + F.make_dt_interval(days=(F.col("o_orderkey") % 4).cast("int"))).alias("date_end"),
            F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("date_prec"),
            (F.col("o_custkey") % 3 + 1).cast("int").alias("type_of_violence"),
            F.col("c_mktsegment").alias("stream"),
            F.col("n_name").alias("country"),
            F.col("n_regionkey").alias("region"),
            best.alias("best"),
        )
    )


CF = """cf AS (
  SELECT o_orderkey AS id, o_orderdate AS date_start, o_orderdate + to_days(CAST(o_orderkey % 4 AS INTEGER)) AS date_end,
    CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS INTEGER) AS date_prec,
    CAST(o_custkey % 3 + 1 AS INTEGER) AS type_of_violence, c_mktsegment AS stream, n_name AS country,
    n_regionkey AS region,
    CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 9 WHEN '2-HIGH' THEN 5 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 1 END AS INTEGER) AS best
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Method results: one row per (method, window, seed)."""
    o = table(spark, sf, "orders")
    return o.groupBy(
        F.col("o_orderstatus").alias("method"),
        F.year("o_orderdate").alias("window_id"),
        (F.col("o_custkey") % 20).alias("seed"),
    ).agg(
        (F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1)) / 1e5).alias("f1"),
        (F.count_if(F.col("o_orderpriority") == "2-HIGH") / F.count(F.lit(1))).alias("auc"),
    )


RES = """res AS (
  SELECT o_orderstatus AS method, CAST(year(o_orderdate) AS INTEGER) AS window_id, o_custkey % 20 AS seed,
    round(sum(o_totalprice), 2) / count(*) / 1e5 AS f1,
    count(*) FILTER (WHERE o_orderpriority = '2-HIGH') / count(*) AS auc
  FROM orders GROUP BY 1, 2, 3)"""


def edge_table(spark: SparkSession, sf: str) -> DataFrame:
    """Pair scores: how quickly events of one type follow events of another, per seed."""
    from flockwise.operators import ordered

    ev = events(spark, sf)
    rows = ordered.lag(ev.select("session_id", "t", "event_id", "actor"), ["session_id"], [F.asc("t"), F.asc("event_id")],
                       ordered.time_bucket(F.col("t"), 24.0), ["t", "actor"])
    return (
        rows.filter("prev_t IS NOT NULL AND prev_actor <> actor")
        .groupBy((F.col("session_id") % 7).alias("seed"), F.col("prev_actor").alias("src"), F.col("actor").alias("dst"))
        .agg(F.round(F.avg(1.0 / (1.0 + F.col("t") - F.col("prev_t"))), 9).alias("score"))
    )


ES = """es AS (
  SELECT session_id % 7 AS seed, prev_actor AS src, actor AS dst, round(avg(1.0 / (1.0 + t - prev_t)), 9) AS score
  FROM (SELECT *, lag(t) OVER w AS prev_t, lag(actor) OVER w AS prev_actor FROM ev
        WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id))
  WHERE prev_t IS NOT NULL AND prev_actor <> actor GROUP BY 1, 2, 3),
et AS (SELECT s.seed, a.range::INTEGER AS src, b.range::INTEGER AS dst,
    CAST(CASE WHEN (a.range, b.range) IN ((0,1),(1,2),(2,3),(3,4),(4,0),(0,2)) THEN 1 ELSE 0 END AS INTEGER) AS y_true
  FROM (SELECT DISTINCT session_id % 7 AS seed FROM ev) s, range(5) a, range(5) b WHERE a.range <> b.range)"""


def edge_truth(edges: DataFrame) -> DataFrame:
    from flockwise.operators.graph import ordered_pairs
    from flockwise.operators.profile import dense_cells

    actors = dense_cells(edges.select("seed").distinct(), actor=K)
    pair = F.struct(F.col("src"), F.col("dst"))
    true = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in TRUE_EDGES])
    return ordered_pairs(actors, ["seed"], "actor").withColumn("y_true", F.array_contains(true, pair).cast("int"))


def weak_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Weak-link runs: recovery of a level at an exposure, per seed."""
    o = table(spark, sf, "orders")
    level = (F.col("o_custkey") % 5 + 1) / F.lit(10.0)
    exposure = (F.year("o_orderdate") - 1994).cast("double")
    return o.select(
        (F.col("o_custkey") % 20).alias("seed"), level.alias("level"), exposure.alias("exposure"),
        (F.col("o_totalprice") > F.lit(60000.0) / (exposure * level)).cast("int").alias("recovered"),
        (exposure * 10.0).alias("n_eff"),
    )


WK = """wk AS (
  SELECT o_custkey % 20 AS seed, (o_custkey % 5 + 1) / 10.0 AS level, CAST(year(o_orderdate) - 1994 AS DOUBLE) AS exposure,
    CAST(CASE WHEN o_totalprice > 60000.0 / (CAST(year(o_orderdate) - 1994 AS DOUBLE) * ((o_custkey % 5 + 1) / 10.0)) THEN 1 ELSE 0 END AS INTEGER) AS recovered,
    CAST(year(o_orderdate) - 1994 AS DOUBLE) * 10.0 AS n_eff
  FROM orders)"""
