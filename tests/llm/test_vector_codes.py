"""Codes along a trie and hard negatives against brute force."""

import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flockwise.llm import hard_negatives, trie_codes


def vectors_of(spark, rows):
    rows = [(i, v if v is None else [x if x is None else float(x) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.withColumn("v", F.lit("clash")).withColumn("code", F.lit(1)).withColumn("error", F.lit(1)).withColumn("anchor", F.lit(None).cast("string"))


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def ints(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


# --- trie -------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60), st.integers(1, 4), st.integers(1, 5), st.integers(1, 3), st.integers(0, 10**6))
def test_a_trie_finds_what_plain_search_finds(n, width, entries, spread, seed):
    rng = np.random.default_rng(seed)
    rows, book = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (entries, width))
    trie = trie_codes.Trie(rows)
    pick, least = trie.nearest(book)
    far = ((rows[:, None] - book[None]) ** 2).sum(2)
    assert (trie.leaves[trie.leaf_of] == rows).all() and trie.counts.sum() == n and len(np.unique(rows, axis=0)) == len(trie.leaves)
    if n:
        assert (pick[trie.leaf_of] == far.argmin(1)).all() and (least[trie.leaf_of] == far.min(1)).all()


def test_large_subtrees_go_down_one_by_one(monkeypatch):
    monkeypatch.setattr(trie_codes, "SUBTREE", 3)
    rng = np.random.default_rng(1)
    rows, book = rng.integers(-2, 3, (500, 4)), rng.integers(-2, 3, (7, 4))
    trie = trie_codes.Trie(rows)
    pick, least = trie.nearest(book)
    far = ((rows[:, None] - book[None]) ** 2).sum(2)
    assert (pick[trie.leaf_of] == far.argmin(1)).all() and (least[trie.leaf_of] == far.min(1)).all()


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, ints(v), label) for i, v, label in rows if fine(v)]
    width = -(-max(map(len, (v for _, v, _ in kept)), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((dist(x, e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            got = {}
            for _, v, _ in kept:
                got.setdefault(near(p, cut(v, p))[1], []).append(cut(v, p))
            new.append([[sum(c) // len(got[j]) for c in zip(*got[j])] if j in got else e for j, e in enumerate(books[p])])
        books = new
    out = []
    for i, v, label in kept:
        best = [near(p, cut(v, p)) for p in range(parts)]
        out.append((i, label, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best)))
    total = {}
    for _, label, _, e in out:
        total[label] = total.get(label, 0) + e
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, c, e, total[label]) for i, label, c, e in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def test_codes_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, -0.5, 0, 0.25, 0.7]) for _ in range(8)], rng.choice([0, 0, 1, None])) for i in range(200)]
    rows += [(300 + i, [0.1] * 8, 0) for i in range(100)]  # a hot vector
    rows += [(500, None, 1), (501, [0.1, None] + [0.0] * 6, 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] + [0.0] * 7, 1)]
    rows += [(3, [0.3] * 8, 1), (3, [0.3] * 8, 1), (None, [0.2] * 8, None), (600, [0.5, -0.5], 1), (601, [], 0)]
    coded = trie_codes.encode(vectors_of(spark, rows), parts=4, entries=6, rounds=2)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in trie_codes.with_label_error(coded.rows).collect()), key=str)
    assert (got, coded.digest()) == brute_codes(rows, 4, 6, 2)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5, -0.25, 1.0], 1), (2, [0.5, -0.25, -1.0], None)]
    coded = trie_codes.encode(vectors_of(spark, rows), parts=2, entries=64)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in trie_codes.with_label_error(coded.rows).collect()), key=str)
    assert (got, coded.digest()) == brute_codes(rows, 2, 64, 2)
    none = trie_codes.encode(vectors_of(spark, []), parts=2)
    assert trie_codes.with_label_error(none.rows).count() == 0 and none.digest() == hashlib.sha256(b"").hexdigest()
    assert trie_codes.encode(vectors_of(spark, [(1, None, 1)])).rows.count() == 0


# --- residues ---------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 200), st.integers(1, 62), st.integers(0, 10**6))
def test_products_are_exact_at_any_size(width, bits, seed):
    rng = np.random.default_rng(seed)
    most = max(1, int((2**bits / width) ** 0.5))
    a, b = rng.integers(-most, most + 1, (5, width)), rng.integers(-most, most + 1, (4, width))
    a[0], b[0] = most, -most
    primes = hard_negatives.moduli(2 * width * most * most + 1)
    got = hard_negatives.products(hard_negatives.Residues(a, primes).parts, hard_negatives.Residues(b, primes).parts, primes)
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    assert got.tolist() == want


def test_primes_keep_float_sums_exact():
    primes = hard_negatives.moduli(2**64)
    assert all(p % d for p in primes for d in range(2, p)) and len(set(primes)) == len(primes)
    assert hard_negatives.DEPTH * (max(primes) // 2) ** 2 + max(primes) < hard_negatives.EXACT


def brute_negatives(rows, k, n, low, high):
    good = [(i, ints(v), label) for i, v, label in rows if i is not None and label is not None and fine(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, label in {(i, tuple(v), label) for i, v, label in good if i % 10 == 0}:
        other = [(-dot(v, w), j, m == label) for j, w, m in good if j != i]
        for s, j, _ in sorted(x for x in other if x[2])[:k]:
            window = sorted((t, x) for t, x, same in other if not same and -low * s <= -100 * t <= -high * s)[:n]
            out += [(i, j, r, x, -s, -t) for r, (t, x) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = hard_negatives.prepared(vectors_of(spark, rows))
    out = hard_negatives.mine(df, df.where("vec_id % 10 = 0"), positives=3, negatives=4, **kw)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out.collect())


def test_hard_negatives_equal_brute_force_in_any_tiles(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, -0.5, 0.2, 0.5, 1]) for _ in range(6)], rng.choice([0, 0, 0, 1, 2])) for i in range(150)]
    rows += [(200 + i, [0.5] * 6, 2) for i in range(60)]  # a hot vector: ties
    rows += [(30, [0.5] * 6, 1), (31, [0.5] * 6, 1), (31, [0.5] * 6, 1), (30, rows[30][1], rows[30][2]), (400, [1.0, 0.5], 0), (410, [], 0), (420, [-1.0] * 6, 5)]
    rows += [(500, None, 1), (510, [None] * 6, 1), (520, [float("nan")] * 6, 1), (530, [0.5] * 6, None), (None, [0.5] * 6, 1)]
    want = brute_negatives(rows, 3, 4, 30, 90)
    assert len(want) > 100
    assert mined(spark, rows) == want
    assert mined(spark, rows, tile_rows=40, tile_anchors=5) == want


def test_no_anchors_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == [] and mined(spark, [(10, [1.0], 1)]) == []
    assert mined(spark, [(10, [0.0], 1), (11, [0.0], 1), (12, [0.0], 2)]) == [(10, 11, 1, 12, 0, 0)]
