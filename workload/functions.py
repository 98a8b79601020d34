"""Scalar functions over whole columns."""

from pyspark.sql import functions as F

from flockwise.functions import scalar as S
from flockwise.operators import intervals as I
from workload import canon as C
from workload.aggregates import binned
from workload.registry import query, rounded


@query("softplus", f"WITH {C.EV} SELECT event_id, round(ln(1 + exp(-abs(value / 10 - 5))) + greatest(value / 10 - 5, 0), 6) AS y FROM ev")
def softplus(spark, sf):
    return rounded(C.events(spark, sf).select("event_id", S.softplus(F.col("value") / 10 - 5).alias("y")))


@query("sigmoid_logit", f"""
WITH {C.EV} SELECT event_id, round(1 / (1 + exp(-greatest(least(value - 50, 60.0), -60.0))), 6) AS p, round(ln(greatest(least(value / 400, 1 - 1e-6), 1e-6) / (1 - greatest(least(value / 400, 1 - 1e-6), 1e-6))), 6) AS l FROM ev""")
def sigmoid_logit(spark, sf):
    return rounded(C.events(spark, sf).select("event_id", S.sigmoid(F.col("value") - 50).alias("p"), S.logit(F.col("value") / 400, 1e-6).alias("l")))


@query("logsumexp", f"WITH {C.EV} SELECT event_id, round(greatest(value, t) + ln(exp(value - greatest(value, t)) + exp(t - greatest(value, t))), 6) AS y FROM ev")
def logsumexp(spark, sf):
    return rounded(C.events(spark, sf).select("event_id", S.logsumexp2("value", "t").alias("y")))


@query("poisson_logpmf", f"""
WITH {C.EV}, {C.GRID}, {C.EVB}, n AS (SELECT g.session_id, g.b, count(e.event_id) AS k FROM grid g LEFT JOIN evb e ON e.session_id = g.session_id AND e.b = g.b GROUP BY 1, 2)
SELECT session_id, b, k, round(k * ln(2.2) - 2.2 - lgamma(k + 1), 6) AS lp FROM n""")
def poisson_logpmf(spark, sf):
    ev = binned(C.events(spark, sf))
    n = I.interval_counts(ev, I.interval_grid(C.sessions(ev), C.DT).select("session_id", "b"), ["session_id"]).withColumnRenamed("n", "k")
    table = S.log_factorials(n)
    return rounded(n.join(table, "k").select("session_id", "b", "k", S.poisson_logpmf("k", F.lit(2.2), "log_factorial").alias("lp")))


@query("decay_functions", f"WITH {C.EV} SELECT event_id, round(exp(-0.01 * t), 6) AS d, round((1 - exp(-0.01 * t)) / 0.01, 6) AS i FROM ev")
def decay_functions(spark, sf):
    return rounded(C.events(spark, sf).select("event_id", S.decay(F.lit(0.01), "t").alias("d"), S.decay_integral(F.lit(0.01), "t").alias("i")))


@query("ctmc_transition", f"""
WITH {C.EV}, p AS (SELECT event_id, 0.01 + 0.001 * actor AS a, 0.03 + 0.002 * mark AS c, value AS d FROM ev), q AS (SELECT event_id, (c + a * exp(-(a + c) * d)) / (a + c) AS p00, (a + c * exp(-(a + c) * d)) / (a + c) AS p11 FROM p)
SELECT event_id, round(p00, 6) AS p00, round(1 - p00, 6) AS p01, round(1 - p11, 6) AS p10, round(p11, 6) AS p11 FROM q""")
def ctmc_transition(spark, sf):
    e = C.events(spark, sf)
    p = S.ctmc_transition(F.lit(0.01) + F.lit(0.001) * F.col("actor"), F.lit(0.03) + F.lit(0.002) * F.col("mark"), "value")
    return rounded(e.select("event_id", *[x.alias(n) for x, n in zip(p, ("p00", "p01", "p10", "p11"))]))


@query("normalise_combine", f"""
WITH {C.EV}, s AS (SELECT session_id, actor, sum(value) AS a, sum(z)::DOUBLE AS b FROM ev GROUP BY 1, 2), n AS (SELECT session_id, actor, a / greatest(max(a) OVER w, 1e-12) AS a, b / greatest(max(b) OVER w, 1e-12) AS b FROM s WINDOW w AS (PARTITION BY session_id))
SELECT session_id, actor, round(a, 6) AS a, round(b, 6) AS b, round(sqrt(a * b), 6) AS geometric, round(greatest(a, b), 6) AS largest, round(a + b, 6) AS total FROM n""")
def normalise_combine(spark, sf):
    s = C.events(spark, sf).groupBy("session_id", "actor").agg(F.sum("value").alias("a"), F.sum("z").cast("double").alias("b"))
    n = S.max_normalise(s, ["session_id"], ["a", "b"])
    return rounded(n.withColumn("geometric", S.combine_scores("a", "b")).withColumn("largest", S.combine_scores("a", "b", "max")).withColumn("total", S.combine_scores("a", "b", "sum")))


@query("row_stochastic", f"""
WITH {C.EV}, s AS (SELECT session_id, actor, mark, greatest(sum(value) - 50, 1e-9) AS x FROM ev GROUP BY 1, 2, 3) SELECT session_id, actor, mark, round(x / sum(x) OVER (PARTITION BY session_id, actor), 6) AS x FROM s""")
def row_stochastic(spark, sf):
    s = C.events(spark, sf).groupBy("session_id", "actor", "mark").agg((F.sum("value") - 50).alias("x"))
    return rounded(S.row_stochastic(s, ["session_id", "actor"], "x"))


@query("string_functions", """
SELECT event_id, lower(trim(' ' || event_type || ' ')) AS label, CAST(contains(props, '7') AS INTEGER) AS has7, CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS INTEGER) + CAST(user_id AS INTEGER) AS total FROM events""")
def string_functions(spark, sf):
    e = C.table(spark, sf, "events")
    text = F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(", "), F.col("user_id").cast("string"), F.lit("]"))
    return e.select(
        "event_id", F.lower(F.trim(F.concat(F.lit(" "), "event_type", F.lit(" ")))).alias("label"), F.col("props").contains("7").cast("int").alias("has7"),
        F.aggregate(S.json_int_array(text), F.lit(0), lambda a, x: a + x).alias("total"),
    )


@query("date_functions", f"""
WITH {C.CF} SELECT id, CAST(year(date_start) AS INTEGER) AS y, CAST(date_diff('day', date_start, date_end) AS INTEGER) AS d, round((epoch_us(date_start) - epoch_us(TIMESTAMP '1995-01-01')) / 8.64e10, 6) AS days FROM cf""")
def date_functions(spark, sf):
    c = C.conflicts(spark, sf)
    return rounded(c.select("id", F.year("date_start").alias("y"), F.datediff("date_end", "date_start").alias("d"), S.to_days("date_start", F.lit("1995-01-01").cast("timestamp")).alias("days")))


@query("uniform_draw", """
SELECT event_id, ('0x' || substr(md5(concat_ws('|', '42', 'draw', CAST(event_id AS VARCHAR))), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM events""")
def uniform_draw(spark, sf):
    return C.table(spark, sf, "events").select("event_id", S.uniform_draw(42, "draw", F.col("event_id")).alias("u"))
