"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockwise.llm.common import stored, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"


def exponential_key(seed: int, weight: Column, *ids: Column) -> Column:
    """``-ln(u) / weight`` with ``u`` in (0, 1) from a digest of ``ids``: the smallest keys are a weighted sample without replacement."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *[i.cast("string") for i in ids]))
    draw = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(draw) / weight


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``name``: the place of each row in the order, from 0. Ranges are sorted in parallel; their row counts are the offsets."""
    low = (1 << 33) - 1
    placed = stored(
        df.orderBy(order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit(low)).alias("__at")), "numbered"
    )
    # a row per range, of which there are as many as shuffle partitions
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``sources`` (source, source_size).

    Weights repeat along the sources in code point order, null last. The targets share ``share`` times all
    sizes by weight; none is above ``cap`` times its source's size, and the excess goes to the others by weight.
    So a target is ``min(level * weight, cap * size)``. The level rises with each round of one aggregate
    (a row reaches the driver), until no more source is at its cap.
    """
    n = len(weights)
    row = numbered(sources, F.col("source").asc_nulls_last(), "position")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    row = stored(row.withColumn("weight", listed[(F.col("position") % n).cast("int")]).withColumn("most", F.lit(float(cap)) * F.col("source_size")), "sources")
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) > F.col("most")
        x = row.agg(
            F.sum(F.lit(float(share)) * F.col("source_size")).alias("total"), F.sum(F.when(full, F.col("most"))).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        risen = (x.total - (x.used or 0.0)) / x.open if x.open else level
        if risen <= level:
            break
        level = risen
    return row.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("most"))).drop("most", "position")


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, quality: DataFrame | None = None, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int = 4096,
) -> DataFrame:
    """How many words of each document the mix takes; one row per row of ``docs``.

    Columns: ``doc_id``, ``source``, ``size`` (words), ``weight`` (of quality), ``key``, ``source_size``, ``target``, ``epochs`` (times that all
    of the source is taken), ``taken``. See ``targets`` for the words that a source gets. Of these, complete epochs come first. The rest is a
    weighted sample: documents by ascending exponential key, as far as the words last; that in which they run out gives its first words only, so
    that a source's taken words are its target, rounded. ``quality`` holds ``doc_id`` and ``weight`` (above 0, about 1); documents that it
    leaves out weigh 1, and of repeated ids the greatest weight counts.

    Sorting is by (source, bucket of the key): buckets ascend with the key, their sums give the words before each, and a hot source
    spreads over ``buckets`` groups. Texts are read once and never shuffled.

    Null texts, texts of white space and sources without words have size 0 and take nothing. Null sources are one source, the last. Rows that
    repeat an id and a size have one key; which of them comes first makes no difference to the rows returned. Null ids are told apart by size
    alone. Other columns of ``docs`` are not looked at. An empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"))
    if quality is None:
        slim = slim.withColumn("weight", F.lit(1.0))
    else:
        best = quality.groupBy("doc_id").agg(F.max(F.col("weight").cast("double")).alias("weight"))
        slim = slim.join(best, "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    key = exponential_key(seed, F.col("weight"), F.col("doc_id"), F.col("size"))
    # null-safe and never null, so that joins, sums and windows share one partitioning
    named = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    rows = stored(slim.withColumn("key", key).withColumn("named", named).withColumn("bucket", F.floor((1.0 - F.exp(-F.col("key"))) * buckets).cast("int")), "sizes")
    sums = stored(rows.groupBy("named", "source", "bucket").agg(F.sum("size").alias("words")), "bucket-sums")
    aims = targets(sums.groupBy("named", "source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    budget = F.least(F.floor(F.col("target") + 0.5), F.floor(F.lit(float(cap)) * F.col("source_size")))
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    aims = aims.withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long")).select("named", "source_size", "target", "epochs", "rest")
    upto = F.sum("words").over(Window.partitionBy("named").orderBy("bucket"))  # at most ``buckets`` rows a source
    plan = stored(sums.select("named", "bucket", (upto - F.col("words")).alias("before")).join(aims, "named"), "plan")
    within = Window.partitionBy("named", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(plan, ["named", "bucket"]).withColumn("before", F.col("before") + F.sum("size").over(within) - F.col("size"))
    part = F.greatest(F.least(F.col("rest") - F.col("before"), F.col("size")), F.lit(0).cast("long"))
    return met.select("doc_id", "source", "size", "weight", "key", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).alias("taken"))
