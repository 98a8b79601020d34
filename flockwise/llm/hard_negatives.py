"""Hard negatives by exact integer scores from matrix products modulo small primes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockwise.llm.common import stored
from flockwise.llm.vectors import floored, longest, matrix, usable

#: Components that are multiplied before sums are reduced again, and the bound under which sums of float32 are exact.
DEPTH, EXACT = 64, 2**24
#: Scores that a task holds at a time.
HELD = 1 << 20


def moduli(product: int) -> list[int]:
    """The largest primes whose symmetric residues keep ``DEPTH`` products exact, as many as ``product`` takes."""
    out, n, made = [], 2 * int((EXACT / DEPTH) ** 0.5) - 1, 1
    while made < product:
        if all(n % d for d in range(2, int(n**0.5) + 1)):
            out.append(n)
            made *= n
        n -= 1
    return out


def residues(m: np.ndarray, p: int) -> np.ndarray:
    """Residues between -(p-1)/2 and (p-1)/2 as float32."""
    r = np.mod(m, p)
    return (r - p * (r > p // 2)).astype(np.float32)


class Residues:
    """An integer matrix in a residue number system."""

    def __init__(self, m: np.ndarray, primes: list[int]):
        self.parts = [residues(m, p) for p in primes]

    def rows(self, at: slice | np.ndarray) -> list[np.ndarray]:
        return [x[at] for x in self.parts]


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """All inner products of rows of ``left`` and ``right``, exact as 64-bit integers.

    One float32 matrix product per prime and ``DEPTH`` components. Balanced mixed-radix digits follow from one
    another; weighed by the products of the primes before them, they sum to the signed value itself.
    """
    n, m, width = len(left[0]), len(right[0]), left[0].shape[1]
    digits: list[np.ndarray] = []
    total, weight = np.zeros((n, m), np.int64), 1
    for k, p in enumerate(primes):
        r = np.zeros((n, m), np.float32)
        for lo in range(0, width, DEPTH):
            r += left[k][:, lo : lo + DEPTH] @ right[k][:, lo : lo + DEPTH].T
            r -= p * np.rint(r / np.float32(p))
        d = np.rint(r).astype(np.int64)
        before = 1
        for q, e in zip(primes, digits, strict=False):
            d -= e * (before % p)
            before = before * q % p
        d = np.mod(d, p) * pow(before, -1, p) % p
        d -= p * (d > p // 2)
        digits.append(d)
        with np.errstate(over="ignore"):  # wraps modulo 2^64, in which the sum is right again
            total += d * np.array(weight % 2**64, np.uint64).astype(np.int64)
        weight *= p
    return total


class Tile:
    """Rows that a task holds, by ascending id, and the anchors it is asked for."""

    def __init__(self, rows: pa.Table, asked: pa.Table, width: int):
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.width = ids[order], width
        m, q = _matrix(rows, width)[order], _matrix(asked, width)
        bound = width * int(np.abs(m).max(initial=0)) * int(np.abs(q).max(initial=0))
        self.primes = moduli(2 * bound + 1)
        self.m, self.q = Residues(m, self.primes), Residues(q, self.primes)
        self.anchors, self.own = asked.column("anchor").to_numpy(), asked.column("vec_id").to_numpy()
        labels = np.concatenate([rows.column("label").to_numpy(), asked.column("label").to_numpy()])
        code = np.unique(labels, return_inverse=True)[1]
        self.label, self.q_label = code[: len(ids)][order], code[len(ids) :]

    def scores(self, rows: np.ndarray, asked: np.ndarray):
        """Blocks of (anchors, scores by row); a bounded number of scores at a time."""
        right = self.m.rows(rows)
        step = max(1, HELD // max(1, len(rows)))
        for lo in range(0, len(asked), step):
            at = asked[lo : lo + step]
            # no prime is needed where all components are zero
            yield at, products(self.q.rows(at), right, self.primes) if self.primes else np.zeros((len(at), len(rows)), np.int64)

    def positives(self, k: int):
        """(anchor, vec_id, score) of each anchor's best rows of its own label, its own id left out."""
        out = []
        for label in np.intersect1d(self.label, self.q_label):
            rows, asked = np.flatnonzero(self.label == label), np.flatnonzero(self.q_label == label)
            for at, score in self.scores(rows, asked):
                for a, s in zip(at, score, strict=True):
                    best = _first(s, k, self.ids[rows] != self.own[a])[:k]
                    out += [(self.anchors[a], self.ids[rows[i]], s[i]) for i in best]
        return out

    def negatives(self, wanted: list[list[tuple[int, int]]], k: int, low: int, high: int, scale: int):
        """(anchor, place, vec_id, score) of the best rows in each positive's window of scores.

        ``wanted``: per anchor its (place, positive score). An anchor's rows of other labels are sorted
        by score once; a window then begins at a place found by bisection.
        """
        out = []
        for at, score in self.scores(np.arange(len(self.ids)), np.arange(len(self.own))):
            for a, s in zip(at, score, strict=True):
                other = np.flatnonzero(self.label != self.q_label[a])
                # one pass keeps what any window can hold
                least = min((-(-low * p // scale) for _, p in wanted[a]), default=0)
                most = max((high * p // scale for _, p in wanted[a]), default=-1)
                other = other[(s[other] >= least) & (s[other] <= most)]
                other = other[np.argsort(-s[other], kind="stable")]
                down = -s[other]
                for place, p in wanted[a]:
                    # low * p <= scale * score <= high * p, in whole numbers
                    top, bottom = high * p // scale, -(-low * p // scale)
                    i = int(np.searchsorted(down, -top, "left"))
                    j = min(i + k, int(np.searchsorted(down, -bottom, "right")))
                    out += [(self.anchors[a], place, self.ids[r], s[r]) for r in other[i:j]]
        return out


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return matrix(column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks), width)


def _first(score: np.ndarray, k: int, allowed: np.ndarray) -> np.ndarray:
    """The places of the allowed scores that are at least the ``k``-th highest, highest first, ties to the earlier place."""
    at = np.flatnonzero(allowed)
    if len(at) > 4 * k:
        cut = -np.partition(-score[at], k - 1)[k - 1]
        at = at[score[at] >= cut]
    return at[np.argsort(-score[at], kind="stable")]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)})


def prepared(vectors: DataFrame, factor: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id``, ``label`` and ``v`` = floor(factor * x) of the rows that take part: id, label and vector there, all components finite."""
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(vector_col))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), floored(vector_col, factor).alias("v"))


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 100, tile_rows: int = 4096, tile_anchors: int = 1024
) -> DataFrame:
    """Hard negatives for each anchor and each of its positives.

    Both tables have ``vec_id``, ``label``, ``v`` (see ``prepared``). An anchor's positives are its first ``positives`` rows of the same label
    and another id; of the rows of other labels whose score is between ``low`` and ``high`` (per ``scale``) of the positive's, the first
    ``negatives`` return. Higher integer inner products come first, ties by smaller id. Columns: ``anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score``.

    Rows and anchors are dealt evenly to tiles and groups; every tile meets every group once in a task that multiplies them in a
    residue number system. Tasks return their best only, and these are merged. Positives come first (products of equal labels only), then
    the windows they define.

    Rows that repeat an id are all candidates, never for their own id; equal anchor rows count once, anchors that share an id but differ
    otherwise are mined one by one. Shorter vectors count as filled up with zeros; scores must fit 64 bits. Negative positive
    scores leave an empty window. Anchors without positives, and positives without rows in their window, return nothing, as do empty tables.
    """
    rows = stored(rows.select("vec_id", "label", "v"), "mined")
    asked = stored(anchors.select("vec_id", "label", "v").distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    width = max(longest(rows, "v"), longest(asked, "v"))
    tiles, groups = max(1, -(-rows.count() // tile_rows)), max(1, -(-asked.count() // tile_anchors))
    deal = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = stored(rows.withColumn("tile", deal(tiles)), "dealt").select("*", every(groups).alias("grp"))
    asked = stored(asked.withColumn("grp", deal(groups)), "asked")

    def best_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        found = Tile(left, right, width).positives(positives) if left.num_rows and right.num_rows else []
        return _table(found, pa.schema([("anchor", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())]))

    met = dealt.groupBy("tile", "grp").cogroup(asked.select("*", every(tiles).alias("tile")).groupBy("tile", "grp"))
    found = met.applyInArrow(best_positives, "anchor long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    good = stored(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")
    lists = good.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("wanted"))  # at most ``positives`` each
    ids = asked.select("anchor", F.col("vec_id").alias("anchor_id"))
    asked = asked.join(lists, "anchor").select("*", every(tiles).alias("tile"))

    def best_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            wanted = [[(w["place"], w["positive_score"]) for w in x] for x in right.column("wanted").to_pylist()]
            found = Tile(left, right, width).negatives(wanted, negatives, low, high, scale)
        return _table(found, pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())]))

    met = dealt.groupBy("tile", "grp").cogroup(asked.groupBy("tile", "grp"))
    found = met.applyInArrow(best_negatives, "anchor long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = best.join(good, ["anchor", "place"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
