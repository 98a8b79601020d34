"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockwise.session import scratch_path

#: Bytes of text that a Python task handles at a time; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20
#: Deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage that survives lost executors.

    The write's shuffle files go with it; else they fill the disk until the driver's next garbage collection.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that was derived from them is stored itself."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_or_empty(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of a slice stays within ``limit`` bytes, or is one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        array = batch.column(column)
        if array.nbytes <= limit:
            yield batch
            continue
        ends = offsets_of(array)
        start = 0
        while start < batch.num_rows:
            stop = start + 1
            while stop < batch.num_rows and ends[stop + 1] - ends[start] <= limit:
                stop += 1
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(array: pa.Array):
    """The offsets of a string, binary or list array as integers, taking slices into account."""
    import numpy as np

    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) or pa.types.is_large_list(array.type)
    kind = np.int64 if large else np.int32
    whole = np.frombuffer(array.buffers()[1], dtype=kind) if array.buffers()[1] is not None and len(array) else np.zeros(1, kind)
    return whole[array.offset : array.offset + len(array) + 1].astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: longs): ``node``, ``component`` = smallest node reachable.

    Every round hooks each node to its neighbour of least hashed priority, follows two
    pointers, and contracts the edges; hashing the order keeps chains of ascending ids short.
    Edge lists shrink geometrically and are written to the shared folder each round; what the next round replaces is deleted.
    """
    key = lambda c: F.struct(F.xxhash64(F.col(c)).alias("h"), F.col(c).alias("v"))
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    names = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(key("b")).alias("m")).select("a", F.least(F.col("m"), key("a"))["v"].alias("p"))
        hook = stored(hook, "hook")
        for _ in range(2):
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            short, hook = hook, stored(hook.join(up, "p").select("a", F.col("q").alias("p")), "hook")
            discard(short)
        if names is None:
            names = stored(hook.select(F.col("a").alias("node"), F.col("p").alias("root")), "names")
        else:
            old, names = names, stored(names.join(hook.select(F.col("a").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "names")
            discard(old)
        met, left = edges, edges.join(hook.select("a", F.col("p").alias("pa")), "a").join(hook.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        edges = stored(left.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        discard(met, hook)
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = names.groupBy("root").agg(F.min("node").alias("component"))
    return names.join(least, "root").select("node", "component")
