"""Codes of vectors by nearest codebook entries, found along a trie of their distinct parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.llm.common import stored
from flockwise.llm.vectors import floored, longest, matrix, usable

#: Rows whose parts make one trie; also the leaves below which a subtree is walked level by level.
GATHER, SUBTREE = 32_768, 4_096
#: Copies of the table of label sums, so that a hot label is met in as many tasks.
SALTS = 32


class Trie:
    """Distinct parts in lexicographic order. A node of depth d is a run of rows that share d components."""

    def __init__(self, rows: np.ndarray):
        order = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))
        ordered = rows[order]
        differ = ordered[1:] != ordered[:-1]
        fresh = np.r_[True, differ.any(axis=1)] if len(rows) else np.zeros(0, bool)
        self.leaf_of = np.empty(len(rows), np.int64)
        self.leaf_of[order] = np.cumsum(fresh) - 1
        self.leaves = ordered[fresh]
        self.counts = np.diff(np.r_[np.flatnonzero(fresh), len(rows)])
        # components that a leaf shares with the one before it
        self.shared = np.r_[-1, differ[fresh[1:]].argmax(axis=1)] if len(self.leaves) and rows.shape[1] else np.full(len(self.leaves), -1)

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per leaf the entry of ``book`` at the least squared distance (ties: the lower one) and that distance.

        Depth first: a node adds its component's squared differences to its parent's vector of distances
        to all entries, once for all leaves below. Subtrees of a bounded number of leaves are walked level by level.
        """
        n, width = self.leaves.shape
        pick, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
        stack = [(0, n, 0, np.zeros((1, len(book)), np.int64))] if n else []
        while stack:
            lo, hi, depth, so_far = stack.pop()
            if hi - lo > SUBTREE and depth < width:
                heads = lo + np.flatnonzero(np.r_[True, self.shared[lo + 1 : hi] <= depth])
                for a, b in zip(heads, np.r_[heads[1:], hi], strict=True):
                    stack.append((a, b, depth + 1, so_far + (self.leaves[a, depth] - book[:, depth]) ** 2))
                continue
            shared = self.shared[lo:hi].copy()
            shared[0] = -1
            nodes = np.zeros(1, np.int64)
            for d in range(depth, width):
                below = np.flatnonzero(shared <= d)
                so_far = so_far[np.searchsorted(nodes, below, "right") - 1] + (self.leaves[lo + below, d, None] - book[None, :, d]) ** 2
                nodes = below
            pick[lo:hi] = so_far.argmin(axis=1)
            least[lo:hi] = so_far[np.arange(len(so_far)), pick[lo:hi]]
        return pick, least


@dataclass
class Coded:
    rows: DataFrame  # vec_id, label, code, error
    books: np.ndarray  # part, entry, component

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position, as decimals joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = GATHER) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _vectors(table: pa.Table, width: int) -> np.ndarray:
    column = table.column("v")
    return matrix(column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks), width)


def _part_sums(books: np.ndarray):
    """Per task, part and entry: how many parts are nearest to it, and their sum."""
    parts, entries, width = books.shape

    def run(batches):
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for table in _gathered(batches):
            m = _vectors(table, parts * width)
            for p in range(parts):
                trie = Trie(m[:, p * width : (p + 1) * width])
                pick, _ = trie.nearest(books[p])
                np.add.at(n[p], pick, trie.counts)
                np.add.at(total[p], pick, trie.counts[:, None] * trie.leaves)
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), *[pa.array(total[p, e, i]) for i in range(width)]], ["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    return run


def _coder(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches):
        for table in _gathered(batches):
            m = _vectors(table, parts * width)
            codes, error = np.empty((len(m), parts), np.uint8), np.zeros(len(m), np.int64)
            for p in range(parts):
                trie = Trie(m[:, p * width : (p + 1) * width])
                pick, least = trie.nearest(books[p])
                codes[:, p] = pick[trie.leaf_of]
                error += least[trie.leaf_of]
            out = table.select(["vec_id", "label"]).append_column("code", pa.array([c.tobytes().hex() for c in codes])).append_column("error", pa.array(error))
            yield from out.to_batches()

    return run


def encode(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, factor: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> Coded:
    """Codes of all vectors: per part, the index of the nearest of at most ``entries`` entries (256 at most).

    A component x becomes floor(factor * x). A part's codebook starts as that part of the first vectors by id (null ids last, then by
    components). Each round replaces an entry by its parts' componentwise floor of the mean; unused entries stay. Vectors are stored as
    integers once; a round is one scan, in which each task builds tries over its distinct parts and returns a row per part and entry. The
    driver holds codebooks only: ``entries`` vectors.

    Vectors that are null or hold null or non-finite components go; null ids, null labels and repeated rows stay. Shorter vectors are filled
    up with zeros to the longest, and this to a multiple of ``parts``; scaled components must be below 2^28. Other columns are
    not looked at. With fewer vectors than entries, codebooks are smaller; without vectors there are no rows and codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    kept = vectors.where(usable(vector_col)).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), floored(vector_col, factor).alias("v"))
    kept = stored(kept, "integer-vectors")
    width = -(-longest(kept, "v") // parts)
    first = [r.v for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    books = np.zeros((len(first), parts * width), np.int64)
    for i, v in enumerate(first):
        books[i, : len(v)] = v
    books = np.ascontiguousarray(books.reshape(len(first), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if first else 0):
        sums = [f"s{i}" for i in range(width)]
        found = kept.select("v").mapInArrow(_part_sums(books), "part int, entry int, n long" + "".join(f", {s} long" for s in sums))
        moved = books.copy()
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect():
            moved[r.part, r.entry] = [r[s] // r.n for s in sums]
        books = moved
    kinds = dict(kept.dtypes)
    return Coded(kept.mapInArrow(_coder(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), books)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds ``label_error``: ``error`` summed over equal labels, nulls together.

    Sums are taken within tasks first; they are met by (label, salt), so that a hot label is spread over tasks.
    """
    rows = stored(rows, "codes").withColumn("salt", F.pmod(F.xxhash64("code", "vec_id"), F.lit(SALTS)))
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("__label"), "label_error", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__salt"))
    return rows.join(sums, rows["label"].eqNullSafe(sums["__label"]) & (rows["salt"] == sums["__salt"])).drop("salt", "__salt", "__label")
