"""A file per session, whatever the session's name."""

import glob

from pyspark.sql import functions as F

from flockwise.sources import writers as W


def test_sessions_are_written_whole_and_again(spark, tmp_path):
    path = str(tmp_path / "by-session")
    names = ["a/b", "x=1 %:é", "10", None, "z'", ""]
    rows = [(names[i % 6], i, i / 7.0) for i in range(600)]
    df = spark.createDataFrame(rows, "session_id string, event_id long, t double")
    W.write_sessions(spark.createDataFrame([("gone", 1, 1.0)], df.schema), path)
    manifest = {r.session_id: r for r in W.write_sessions(df.repartition(7), path).collect()}
    assert {k: r.events for k, r in manifest.items()} == {n: 100 for n in names} and manifest["a/b"].path == f"{path}/session_id=a/b"
    back = spark.read.parquet(path).select("session_id", "event_id", "t")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[1]) == [(s or None, *r) for s, *r in rows]
    assert len(glob.glob(f"{path}/*/part-*.parquet")) == 5  # before, every task wrote a file for each session


def test_session_larger_than_a_batch_is_one_file(spark, tmp_path):
    path = str(tmp_path / "by-session")
    df = spark.range(25_000).select(F.floor(F.col("id") % 10 / 9).alias("session_id"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"))
    assert sorted((r.session_id, r.events) for r in W.write_sessions(df, path).collect()) == [(0, 22_500), (1, 2_500)]
    back = spark.read.parquet(path)
    assert back.agg(F.sum("event_id"), F.count_distinct("event_id"), F.sum(F.unix_seconds("ts"))).first()[:] == (312_487_500, 25_000, 312_487_500)
    assert len(glob.glob(f"{path}/*/part-*.parquet")) == 2
