"""Ranks, lags, running sums and percentiles that survive a hot key.

A plain window partitioned by a key sorts the whole key in one task. Here each key is cut
into buckets by a monotone function of its first order column; the window runs inside
``(key, bucket)`` and a small per-bucket table carries the offset across buckets. Every
bucket function only has to be monotone, so results never depend on the bucket width.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockwise.session import cut_lineage

BUCKET = "__bucket"


@dataclass(frozen=True)
class Splits:
    """Buckets of a column cut at quantiles of its own values, so that they hold like numbers of rows at any magnitude.

    A key with a share s of all rows is cut into about s * ``parts`` buckets; equal values share one.
    """

    column: Column
    parts: int = 1024


def value_bucket(x: Column, parts: int = 1024) -> Splits:
    return Splits(x.cast("double"), parts)


def with_bucket(df: DataFrame, bucket: Column | Splits) -> DataFrame:
    """Add the bucket; for ``Splits`` one pass fetches at most ``parts`` split points to the driver."""
    if not isinstance(bucket, Splits):
        return df.withColumn(BUCKET, bucket)
    points = F.percentile_approx(bucket.column, [i / bucket.parts for i in range(1, bucket.parts)], 4 * bucket.parts)
    found = df.select(points.alias("p")).first()["p"] or []
    splits = [float("-inf"), *sorted({p for p in found if math.isfinite(p)}), float("inf")]
    marked = df.withColumn("__key", bucket.column)
    if len(splits) < 3:
        return marked.withColumn(BUCKET, F.lit(0).cast("long")).drop("__key")
    cut = Bucketizer(splits=splits, inputCol="__key", outputCol=BUCKET, handleInvalid="keep")
    return cut.transform(marked).withColumn(BUCKET, F.coalesce(F.col(BUCKET).cast("long"), F.lit(-1).cast("long"))).drop("__key")


def time_bucket(t: Column, width: float) -> Column:
    return F.floor(t / F.lit(float(width))).cast("long")


def _offsets(totals: DataFrame, keys: Sequence[str], value: str, descending: bool) -> DataFrame:
    order = F.desc(BUCKET) if descending else F.asc(BUCKET)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("__before", F.coalesce(F.sum(value).over(before), F.lit(0).cast("double" if value != "__n" else "long")))


def _with_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, list(keys)
    return df.withColumn("__all", F.lit(0)), ["__all"]


def rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | Splits,
         name: str = "rn", descending: bool = False) -> DataFrame:
    """``row_number`` over ``keys`` by ``order``; ``bucket`` must be monotone in ``order[0]``."""
    df, ks = _with_keys(df, keys)
    df = with_bucket(df, bucket)
    totals = df.groupBy(*ks, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    offs = _offsets(totals, ks, "__n", descending).drop("__n")
    local = df.withColumn("__local", F.row_number().over(Window.partitionBy(*ks, BUCKET).orderBy(*order)))
    out = local.join(offs, [*ks, BUCKET]).withColumn(name, F.col("__local") + F.col("__before"))
    return out.drop("__local", "__before", BUCKET, "__all")


def sorted_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``row_number`` over the whole table for columns of any type: ranges are sorted in parallel, and their row counts are the offsets."""
    placed = cut_lineage(df.orderBy(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row per shuffle partition
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | Splits,
                value: str, name: str, descending: bool = False, inclusive: bool = True) -> DataFrame:
    df, ks = _with_keys(df, keys)
    df = with_bucket(df, bucket)
    totals = df.groupBy(*ks, BUCKET).agg(F.sum(value).alias("__v"))
    offs = _offsets(totals, ks, "__v", descending).drop("__v")
    frame = Window.partitionBy(*ks, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = df.withColumn("__s", F.coalesce(F.sum(value).over(frame), F.lit(0)))
    out = local.join(offs, [*ks, BUCKET]).withColumn(name, F.col("__s") + F.col("__before"))
    return out.drop("__s", "__before", BUCKET, "__all")


def lag(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | Splits,
        columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Previous row's ``columns`` in the order; null on each key's first row."""
    df, ks = _with_keys(df, keys)
    df = with_bucket(df, bucket)
    inside = Window.partitionBy(*ks, BUCKET).orderBy(*order)
    packed = F.struct(*columns)
    local = (
        df.withColumn("__prev", F.lag(packed).over(inside))
        .withColumn("__last", F.lead(F.lit(1)).over(inside).isNull())
    )
    lasts = local.filter("__last").select(*ks, BUCKET, packed.alias("__tail"))
    heads = lasts.withColumn("__carry", F.lag("__tail").over(Window.partitionBy(*ks).orderBy(BUCKET))).drop("__tail")
    joined = local.join(heads, [*ks, BUCKET])
    prev = F.coalesce("__prev", "__carry")
    out = joined.select("*", *[prev[c].alias(f"{prefix}{c}") for c in columns])
    return out.drop("__prev", "__last", "__carry", BUCKET, "__all")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation percentiles per key, one column per entry of ``points``.

    Values are first reduced to distinct values with counts, so ties cost nothing; only the
    buckets that hold a wanted rank are sorted.
    """
    df, ks = _with_keys(df, keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*ks, F.col(value).cast("double").alias("__x"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    # stored: the split points, the totals and the buckets that hold a wanted rank are taken from it
    counts = with_bucket(cut_lineage(counts), value_bucket(F.col("__x")))
    totals = counts.groupBy(*ks, BUCKET).agg(F.sum("__n").alias("__n"))
    whole = Window.partitionBy(*ks)
    offs = _offsets(totals, ks, "__n", False).withColumn("__total", F.sum("__n").over(whole))
    # zero-based ranks on both sides of each wanted position
    spots = F.array(*[
        F.struct(
            F.lit(n).alias("p"),
            F.floor(F.lit(p) * (F.col("__total") - 1)).alias("lo"),
            F.ceil(F.lit(p) * (F.col("__total") - 1)).alias("hi"),
            (F.lit(p) * (F.col("__total") - 1)).alias("pos"),
        )
        for n, p in points.items()
    ])
    wanted = (
        offs.withColumn("__spot", F.explode(spots))
        .filter((F.col("__spot.hi") >= F.col("__before")) & (F.col("__spot.lo") < F.col("__before") + F.col("__n")))
        .groupBy(*ks, BUCKET).agg(F.first("__before").alias("__before"), F.collect_list("__spot").alias("__spots"))
    )
    frame = Window.partitionBy(*ks, BUCKET).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        counts.join(wanted, [*ks, BUCKET])
        .withColumn("__end", F.sum("__n").over(frame) + F.col("__before"))
        .withColumn("__spot", F.explode("__spots"))
        .withColumn("__start", F.col("__end") - F.col("__n"))
    )
    at_lo = (F.col("__spot.lo") >= F.col("__start")) & (F.col("__spot.lo") < F.col("__end"))
    at_hi = (F.col("__spot.hi") >= F.col("__start")) & (F.col("__spot.hi") < F.col("__end"))

    def at(name: str) -> Column:
        here = F.col("__spot.p") == name
        lo = F.max(F.when(here & at_lo, F.col("__x")))
        hi = F.max(F.when(here & at_hi, F.col("__x")))
        frac = F.max(F.when(here, F.col("__spot.pos") - F.col("__spot.lo")))
        return (lo + (hi - lo) * frac).alias(name)

    return picked.groupBy(*ks).agg(*[at(n) for n in points]).drop("__all")
