"""Scans: event tables, trade files, conflict exports, manifests, truth and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted column names and file layouts.
TIME_NAMES = ("time", "spike_time", "spiketime", "t")
ACTOR_NAMES = ("actor", "unit", "cell", "cluster")
TRADE_COLUMNS = (
    "agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "transact_time", "is_buyer_maker",
)
CONFLICT_COLUMNS = (
    "id", "date_start", "date_end", "date_prec", "type_of_violence", "dyad_new_id", "dyad_name", "conflict_name",
    "side_a", "side_b", "country", "region", "latitude", "longitude", "best",
)


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    lowered = {c.lower(): c for c in df.columns}
    return next((lowered[n] for n in names if n in lowered), None)


def read_table(spark: SparkSession, path: str | Sequence[str], fmt: str | None = None) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    fmt = fmt or ("csv" if paths[0].endswith((".csv", ".csv.gz")) else "parquet")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(paths)


def events_from(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Check ``time, actor, mark`` and cast them; missing columns are an error.

    Row order is a property of later operators, so no global sort is paid here.
    """
    missing = [c for c in ("time", "actor", "mark") if c not in df.columns]
    if missing:
        raise ValueError(f"event table lacks columns {missing}")
    labels = [F.col(c).cast("int") for c in ("Z", "is_injected") if c in df.columns]
    out = df.select(
        *extra,
        F.col("time").cast("double").alias("t"),
        F.col("actor").cast("double").cast("int").alias("actor"),
        F.col("mark").cast("double").cast("int").alias("mark"),
        *([F.coalesce(*labels).alias("z")] if labels else []),
    )
    return out


def read_events(spark: SparkSession, path: str | Sequence[str], fmt: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    return events_from(read_table(spark, path, fmt), extra)


def events_aliased(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Resolve time and actor from their known aliases; bad rows are dropped, mark is 0."""
    time = first_present(df, TIME_NAMES)
    if time is None:
        raise ValueError(f"no time column among {df.columns}")
    actor = first_present(df, ACTOR_NAMES)
    out = df.select(
        *extra,
        F.col(time).try_cast("double").alias("t"),
        (F.col(actor).try_cast("double") if actor else F.lit(0.0)).alias("__actor"),
    )
    return (
        out.filter(F.col("t").isNotNull() & ~F.isnan("t") & F.col("__actor").isNotNull() & ~F.isnan("__actor"))
        .withColumn("actor", F.col("__actor").cast("int"))
        .withColumn("mark", F.lit(0))
        .drop("__actor")
    )


def read_events_aliased(spark: SparkSession, path: str | Sequence[str], fmt: str | None = None) -> DataFrame:
    return events_aliased(read_table(spark, path, fmt))


def read_trades(spark: SparkSession, path: str | Sequence[str], symbol_pattern: str = r"([^/]+?)-[^/]*$") -> DataFrame:
    """Headerless trade files; the symbol and source file come from the file name.

    Lines with fewer than seven fields are dropped (their maker flag is absent).
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in TRADE_COLUMNS])
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(paths)
    file = F.col("_metadata.file_path")
    return (
        df.withColumn("symbol", F.regexp_extract(file, symbol_pattern, 1))
        .withColumn("date_file", F.regexp_extract(file, r"([^/]+)$", 1))
        .filter(F.col("is_buyer_maker").isNotNull())
        .withColumn("price", F.col("price").try_cast("double"))
        .withColumn("quantity", F.col("quantity").try_cast("double"))
        .withColumn("transact_time", F.col("transact_time").try_cast("double"))
        .dropna(subset=["price", "quantity", "transact_time"])
    )


def conflict_columns(df: DataFrame) -> DataFrame:
    """Trim and lower-case the names, then keep the known columns that exist."""
    lowered = df.toDF(*[c.strip().lower() for c in df.columns])
    return lowered.select(*[c for c in CONFLICT_COLUMNS if c in lowered.columns])


def read_conflict_events(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return conflict_columns(read_table(spark, path, "csv"))


def file_key(path: str | Column) -> Column:
    """Compare paths without their scheme."""
    col = F.lit(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_replace(col, r"^[a-z0-9]+:/+", "/"), r"/+", "/")


def read_sessions(spark: SparkSession, manifest: DataFrame, root: str, fmt: str) -> DataFrame:
    """One scan over the folder ``root``, with its manifest row attached to each event.

    Files that the manifest doesn't name fall out in the join, so no file list is collected
    and a manifest may have any number of rows.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    raw = reader.parquet(root) if fmt == "parquet" else reader.option("header", True).csv(root)
    file = F.url_decode(file_key(F.col("_metadata.file_path")))
    # a manifest entry may be a file or a folder of part files
    folder = F.regexp_replace(file, r"/part-[^/]*$", "")
    events = raw.select("*", file.alias("__f"), folder.alias("__d")).withColumn("__file", F.explode(F.array_distinct(F.array("__f", "__d"))))
    keyed = manifest.withColumn("__file", file_key(F.col("path")))
    joined = events.join(keyed, "__file").drop("__file", "__f", "__d")
    return events_from(joined, extra=[c for c in manifest.columns if c != "path"])


def read_truth(spark: SparkSession, path: str | Sequence[str], one_per_file: bool = True) -> DataFrame:
    """Truth sidecars: one JSON object per file, or one per line."""
    schema = "true_ring array<int>, true_hub int, alpha1_strength double, seed long"
    return spark.read.schema(schema).option("multiLine", one_per_file).json(path).withColumn(
        "truth_json", F.url_decode(file_key(F.col("_metadata.file_path")))
    )


def resolve_ring(truth_ring: Column, manifest_json: Column, k: Column, ring_size: int) -> Column:
    """Truth ring, else the manifest's JSON list, else the first ``min(ring_size, K)`` actors."""
    fallback = F.sequence(F.lit(0), (F.least(F.lit(ring_size), k) - 1).cast("int"))
    return F.coalesce(truth_ring, F.from_json(manifest_json, "array<int>"), fallback)


def active_windows(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Window table from ``start``/``t_start``/first and ``end``/``t_end``/second column."""
    names = [c for c in df.columns if c not in extra]
    start = first_present(df, ("start", "t_start")) or names[0]
    end = first_present(df, ("end", "t_end")) or names[1]
    return df.select(
        *extra, F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), F.lit(1).alias("z")
    ).dropna(subset=["s", "e"])


def read_active_windows(spark: SparkSession, path: str | Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    return active_windows(read_table(spark, path, "csv"), extra)


def candidate_windows(df: DataFrame, order: Sequence[Column], max_windows: int | None = None,
                      ranks: Sequence[int] | None = None) -> DataFrame:
    """Give windows a rank when they lack one, then keep given ranks or the first ``n``.

    The list is a report of at most a few thousand rows, hence one ordered window.
    """
    if "rank" not in df.columns:
        df = df.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    if ranks:
        return df.filter(F.col("rank").isin(list(ranks)))
    return df.orderBy("rank").limit(max_windows) if max_windows else df
