"""Mixing against brute force, and the edges of its contract."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flockwise.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, weights, share, cap, quality, seed=0):
    """(doc_id, taken, target) by one sorted pass per source."""
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, sizes):
        total[s] += n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + ([None] if None in total else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = dict.fromkeys(names, 0.0), set()
    while True:  # deal, cap, and deal the excess again
        left = share * sum(total.values()) - sum(cap * total[s] for s in full)
        free = [s for s in names if s not in full]
        for s in free:
            target[s] = left * w[s] / sum(w[x] for x in free)
        over = {s for s in free if target[s] > cap * total[s]}
        if not over:
            break
        for s in over:
            target[s] = cap * total[s]
        full |= over
    out = []
    for s in names:
        mine = [(i, n) for (i, _, x), n in zip(rows, sizes) if x == s]

        def key(row):
            i, n = row
            text = ":".join(str(x) for x in (seed, i, n) if x is not None)
            u = (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return (-math.log(u) / quality.get(i, 1.0), i is not None, i or 0, n)

        budget = min(math.floor(target[s] + 0.5), math.floor(cap * total[s]))
        epochs = budget // total[s] if total[s] else 0
        rest = budget - epochs * total[s]
        for i, n in sorted(mine, key=key):
            part = max(min(rest, n), 0)
            rest -= part
            out.append((i, n, epochs * n + part, round(target[s], 6)))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r.doc_id, r.size, r.taken, round(r.target, 6)) for r in df.collect()), key=str)


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return df.withColumn("size", F.lit("x")).withColumn("key", F.lit(1)).withColumn("target", F.lit(None).cast("double"))


def test_equals_brute_force_with_a_hot_source_and_ties(spark):
    rows = [(i, " ".join(["w"] * (i % 9)), "hot" if i % 3 else f"s{i % 7}") for i in range(300)]
    rows += [(5, "w w w", "hot")] * 20 + [(1000, None, None), (1001, "a \x0b b\tc\nd", None), (None, "a b", "s1"), (None, "a b c", "s1"), (1002, "", ""), (1003, "é x y", "ä"), (1004, "w " * 5000, "long")]
    quality = {i: 2.0 if i % 2 else 0.5 for i in range(200)}
    table = spark.createDataFrame([*quality.items(), (7, 0.1)], "doc_id long, weight double")
    got = shown(mixing.mix(docs_of(spark, rows), quality=table, buckets=16))
    assert got == brute(rows, (3, 1, 2), 1.5, 2.0, quality)
    assert shown(mixing.mix(docs_of(spark, rows).repartition(7), quality=table, buckets=500)) == got  # buckets and partitions don't matter


def test_words_come_to_the_target_and_no_document_exceeds_its_cap(spark):
    rows = [(i, " ".join(["w"] * (i % 50 + 1)), f"s{i % 5}") for i in range(500)]
    out = mixing.mix(docs_of(spark, rows))
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect():
        assert abs(r.taken - r.target) <= 0.5 and r.target <= 2 * r["size"]
    assert out.where("taken > 2 * size OR taken < 0").count() == 0
    total = out.agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).first()
    assert total.t == pytest.approx(1.5 * total.s, abs=3)


def test_good_documents_are_likelier(spark):
    rows = [(i, "w w w w", "s") for i in range(2000)]
    quality = spark.createDataFrame([(i, 4.0 if i % 2 else 1.0) for i in range(2000)], "doc_id long, weight double")
    out = mixing.mix(docs_of(spark, rows), weights=(1,), share=0.3, quality=quality)
    taken = {bool(r.good): r.n for r in out.where("taken > 0").groupBy((F.col("doc_id") % 2 == 1).alias("good")).agg(F.count("*").alias("n")).collect()}
    assert 2.0 < taken[True] / taken[False] < 6.0


def test_empty_tables_and_tables_without_words(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert shown(mixing.mix(docs_of(spark, [(1, None, None), (2, " ", "a")]))) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    assert shown(mixing.mix(docs_of(spark, [(1, "a b c", None)]))) == [(1, 3, 5, 4.5)]


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(f"k{i:04d}",) for i in range(500)] + [(None,)], "source string").repartition(5)
    got = {r.source: r.n for r in mixing.numbered(df, F.col("source").asc_nulls_last(), "n").collect()}
    assert got == {**{f"k{i:04d}": i for i in range(500)}, None: 500}
