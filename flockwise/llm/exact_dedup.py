"""Exact duplicates by recipes of content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockwise.llm.common import slices, stored, text_or_empty

#: Multiplier of the window hash (the golden ratio as a 64-bit fraction).
MIX = np.uint64(0x9E3779B97F4A7C15)
WHITE = b" \t\n\x0b\x0c\r"


def cuts(data: bytes, bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of ``data``: after each 8-byte window whose hash starts with ``bits`` zeros.

    Chunks hold ``least`` to ``most`` bytes (the last may be shorter). Ends depend on the
    content alone, so equal texts have equal chunks and edits move only nearby ends.
    """
    size = len(data)
    if size <= least:
        return [size] if size else []
    windows = np.ndarray((size - 7,), "<u8", data, strides=(1,)) if size >= 8 else np.empty(0, np.uint64)
    ends = np.flatnonzero((windows * MIX) >> np.uint64(64 - bits) == 0) + 8
    out, last = [], 0
    for end in [*ends.tolist(), size]:
        while end - last > most:
            last += most
            out.append(last)
        if end - last >= least or (end == size and end > last):
            out.append(end)
            last = end
    return out


def _chunker(bits: int, least: int, most: int, width: int, contents: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, 1):
            hashes, recipes, digests, chunks = [], [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                data = text.as_py().translate(None, WHITE)
                start, recipe = 0, []
                for end in cuts(data, bits, least, most):
                    piece = data[start:end]
                    digest = hashlib.blake2b(piece, digest_size=width).digest()
                    recipe.append(digest)
                    if contents:
                        digests.append(digest)
                        chunks.append(piece)
                    start = end
                if not contents:
                    hashes.append(hashlib.sha256(data).hexdigest())
                    recipes.append(recipe)
            if contents:
                if len(seen) > 1_000_000:
                    seen.clear()
                keep = []
                for i, piece in enumerate(chunks):  # a copy within the task needs no second trip
                    mark = hashlib.sha256(piece).digest()
                    if mark not in seen:
                        seen.add(mark)
                        keep.append(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digests[i] for i in keep], pa.binary()), pa.array([chunks[i] for i in keep], pa.binary())], ["digest", "content"]
                )
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(hashes, pa.string()), pa.array(recipes, pa.list_(pa.binary()))],
                    ["doc_id", "n_points", "text_sha256", "recipe"],
                )

    return run


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 11, least: int = 256, most: int = 16384, width: int = 16
) -> DataFrame:
    """Group texts that are equal without white space; one row per input row.

    Columns: ``doc_id``, ``keep_id`` (most code points in the original, then smallest id),
    ``group_size``, ``kept``, ``text_sha256`` of the normalised text, ``recipe``.

    Each text becomes an ordered list of chunk identifiers. Chunk contents travel once, to
    prove that an identifier stands for one content; afterwards only the short lists move.
    Should an identifier stand for two contents, its chunks are renamed by their content's
    rank, so that the lists stay exact whatever the digest's width.

    Null texts count as empty, and all empty texts form one group with an empty list. A null
    id loses ties against any other. Rows that repeat an id are rows of their own: all count
    in ``group_size``, and each row with the id that stays is marked kept. An empty table gives
    an empty result. Other columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("n_points", F.length("text").cast("long"))
    recipes = stored(
        rows.mapInArrow(_chunker(bits, least, most, width, False), "doc_id long, n_points long, text_sha256 string, recipe array<binary>"), "recipes"
    )
    chunks = rows.mapInArrow(_chunker(bits, least, most, width, True), "digest binary, content binary")
    variants = chunks.groupBy("digest", "content").agg(F.lit(1).alias("one"))
    unclear = stored(variants.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "unclear")
    if not unclear.isEmpty():
        recipes = _renamed(rows, unclear, bits, least, most, width)
    best = F.max(F.struct(F.col("n_points"), (-F.col("doc_id")).alias("neg"), F.col("doc_id")))
    groups = recipes.groupBy("recipe").agg(F.count("*").alias("group_size"), best.alias("best"))
    out = recipes.join(groups.select("recipe", "group_size", F.col("best.doc_id").alias("keep_id")), "recipe")
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "recipe"
    )


def _renamed(rows: DataFrame, unclear: DataFrame, bits: int, least: int, most: int, width: int) -> DataFrame:
    """Recipes whose unclear identifiers carry their content's rank among the contents of that digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            for key, doc_id, text, points in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode().translate(None, WHITE)
                start, pieces = 0, []
                for end in cuts(data, bits, least, most):
                    pieces.append(data[start:end])
                    start = end
                full = hashlib.sha256(data).hexdigest()
                names = [hashlib.blake2b(p, digest_size=width).digest() for p in pieces] or [None]
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array([points] * n, pa.int64()), pa.array([full] * n), pa.array(range(n), pa.int64()),
                     pa.array(names, pa.binary()), pa.array(pieces or [None], pa.binary())],
                    ["key", "doc_id", "n_points", "text_sha256", "i", "digest", "content"],
                )

    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", "n_points")
    all_chunks = stored(keyed.mapInArrow(run, "key long, doc_id long, n_points long, text_sha256 string, i long, digest binary, content binary"), "chunks")
    named = all_chunks.join(unclear, "digest", "left_semi").select("digest", "content").distinct()
    named = named.withColumn("rank", F.row_number().over(Window.partitionBy("digest").orderBy("content")))
    joined = all_chunks.join(named, ["digest", "content"], "left")
    ident = F.when(F.col("rank").isNull(), F.col("digest")).otherwise(F.concat("digest", F.encode(F.concat(F.lit("#"), F.col("rank").cast("string")), "utf-8")))
    lists = joined.groupBy("key", "doc_id", "n_points", "text_sha256").agg(F.sort_array(F.collect_list(F.struct("i", ident.alias("name")))).alias("l"))
    return stored(lists.select("doc_id", "n_points", "text_sha256", F.expr("filter(l.name, x -> x is not null)").alias("recipe")), "recipes")
