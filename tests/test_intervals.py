"""Interval joins by disjoint pieces against brute force."""

import random

from flockwise.operators import events as E
from flockwise.operators import intervals as I


def tables(spark):
    rng = random.Random(7)
    windows = [(k, s := rng.uniform(0, 90), s + rng.choice([0.0, 1.0, 5.0, 30.0]), rng.choice([0, 1])) for k in (0, 1) for _ in range(12)]
    points = [(i % 3, i, rng.uniform(-5, 130)) for i in range(150)] + [(0, 900, None), (0, 901, 50.0), (0, 901, 50.0)]
    return windows, points, spark.createDataFrame(windows, "k long, s double, e double, z int"), spark.createDataFrame(points, "k long, id long, t double")


def test_flags_and_states(spark):
    windows, points, w, p = tables(spark)
    inside = sorted((r.k, r.id, r.inside) for r in I.in_window(p, w, ["k"], ["id"], width=7.0).collect())
    assert inside == sorted((k, i, int(t is not None and any(a == k and s <= t < e for a, s, e, _ in windows))) for k, i, t in points)
    got = sorted((r.k, r.id, r.state) for r in I.state_at_time(p, w, ["k"], ["id"], "t", 7.0).collect())

    def first(k, t):
        hits = sorted((s, z) for a, s, e, z in windows if a == k and t is not None and s <= t < e)
        return hits[0][1] if hits else 0

    assert got == sorted((k, i, first(k, t)) for k, i, t in points)
    no_key = sorted((r.id, r.inside) for r in I.in_window(p, w.drop("k"), [], ["id"], width=7.0).collect())
    assert no_key == sorted((i, int(t is not None and any(s <= t < e for _, s, e, _ in windows))) for _, i, t in points)


def test_overlap_of_intervals(spark):
    windows, _, w, _ = tables(spark)
    grid = [(k, b, b * 4.0, min(b * 4.0 + 4.0, 125.0)) for k in (0, 1, 2) for b in range(32)]
    g = spark.createDataFrame(grid, "k long, b int, t_start double, t_end double")
    got = sorted((r.k, r.b, r.active) for r in I.interval_overlap(g, w, ["k"], 6.0).collect())
    assert got == sorted((k, b, int(any(a == k and z == 1 and s < e and y > s and x < e for a, s, e, z in windows))) for k, b, x, y in grid)


def test_codes_of_any_type(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("10",), ("9",)], "x string")
    got = {(r.x, r.code) for r in E.dense_code(df, "x", null_as="zz").collect()}
    assert got == {("10", 0), ("9", 1), ("a", 2), ("b", 3), (None, 4)}
    df = spark.createDataFrame([(5,), (None,), (-3,), (10,)], "x int")
    assert {(r.x, r.code) for r in E.dense_code(df, "x").collect()} == {(-3, 0), (None, 1), (5, 2), (10, 3)}
