"""Cleaning, filtering, encoding, slicing and sampling of event tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockwise.functions import scalar as S
from flockwise.operators import ordered
from flockwise.operators.intervals import range_join

EVENT_ORDER = ("t", "actor", "mark", "event_id")


# --- cleaning ---------------------------------------------------------------------------


def coerce_numeric(df: DataFrame, columns: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Unparsable numbers become null; rows with a null required column are dropped."""
    for c in columns:
        df = df.withColumn(c, F.col(c).try_cast("double"))
    return df.dropna(subset=list(required)) if required else df


def parse_dates(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy"),
                required: bool = True) -> DataFrame:
    """Mixed-format dates; unreadable text becomes null and, if required, drops the row."""
    for c in columns:
        text = F.col(c).cast("string")
        df = df.withColumn(c, F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]))
    return df.dropna(subset=list(columns)) if required else df


def valid_label(df: DataFrame, column: str) -> DataFrame:
    label = F.trim(F.col(column).cast("string"))
    return df.withColumn(column, label).filter(
        F.col(column).isNotNull() & (F.col(column) != "") & (F.lower(F.col(column)) != "nan")
    )


def type_precision_filter(df: DataFrame, types: Sequence | None = None, exact_only: bool = False,
                          type_col: str = "type_of_violence", precision_col: str = "date_prec") -> DataFrame:
    if types:
        df = df.filter(F.col(type_col).isin(list(types)))
    return df.filter(F.col(precision_col) == 1) if exact_only else df


def attribute_filter(df: DataFrame, **equal) -> DataFrame:
    """Optional equality per column; a ``None`` value means no filter."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column).cast("string") == str(value))
    return df


def date_window(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Half-open ``[start, end)``. An open end keeps everything up to one day past the maximum,
    which is the same as not filtering, so no pass over the data is spent on finding it."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    return df.filter(F.col(column) < F.lit(end)) if end is not None else df



def in_domain(lo: float, hi: float, k: int, m: int) -> Column:
    t, a, b = F.col("t"), F.col("actor"), F.col("mark")
    ok = ~F.isnan(t) & (t >= lo) & (t <= hi) & (a >= 0) & (a < k) & (b >= 0) & (b < m)
    return F.coalesce(ok, F.lit(False))


def event_domain_filter(df: DataFrame, lo: float, hi: float, k: int, m: int) -> DataFrame:
    return df.filter(in_domain(lo, hi, k, m))


def domain_report(df: DataFrame, keys: Sequence[str], lo: float, hi: float, k: int, m: int) -> DataFrame:
    keep = in_domain(lo, hi, k, m)
    return df.groupBy(*keys).agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


def ok_rows(df: DataFrame, status: str = "status") -> DataFrame:
    return df.filter(F.coalesce(F.col(status), F.lit("ok")) == "ok") if status in df.columns else df


# --- time -------------------------------------------------------------------------------


def time_slice(df: DataFrame, windows: DataFrame, keys: Sequence[str] = (), width: float = 24.0) -> DataFrame:
    """Rows inside each slice ``[s, e)``, with the slice columns and re-zeroed time."""
    return range_join(df, windows, keys, "t", "s", "e", width).withColumn("t_rel", F.col("t") - F.col("s"))


def rebase_time(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Subtract each key's first time; the minima come from a partial aggregate, not a window."""
    first = df.groupBy(*keys).agg(F.min("t").alias("__t0"))
    return df.join(first, list(keys)).withColumn("t", F.col("t") - F.col("__t0")).drop("__t0")


def day_axis(df: DataFrame, keys: Sequence[str], start: str = "date_start", end: str = "date_end") -> DataFrame:
    """Days since each key's earliest date, and the whole-day width of each date interval."""
    first = df.groupBy(*keys).agg(F.min(start).alias("__d0"))
    out = df.join(first, list(keys)).withColumn("event_time", S.to_days(F.col(start), F.col("__d0")))
    if end in df.columns:
        out = out.withColumn("interval_days", F.datediff(F.col(end), F.col(start)))
    return out.drop("__d0")


def day_horizon(df: DataFrame, keys: Sequence[str], window_days: float = 0.0) -> DataFrame:
    """``T = max(window days, latest event + 1, 1)``."""
    return df.groupBy(*keys).agg(
        F.greatest(F.lit(float(window_days)), F.max("event_time") + 1.0, F.lit(1.0)).alias("T")
    )


def coarsen_time(df: DataFrame, horizon: float, grid: float, coarse: float = 0.0, jitter: float = 0.0,
                 seed: int = 0, ids: Sequence[str] = ("event_id",)) -> DataFrame:
    """Observed times: floor to the grid plus jitter, or a uniform place in the coarse bin."""
    t = F.greatest(F.col("t"), F.lit(0.0))
    u = S.uniform_draw(seed, "coarsen", *[F.col(i) for i in ids])
    if coarse > grid:
        seen = F.floor(t / coarse) * F.lit(float(coarse)) + u * F.lit(float(coarse))
    else:
        seen = F.floor(t / grid) * F.lit(float(grid)) + (u * F.lit(float(jitter)) if jitter > 0 else F.lit(0.0))
    top = max(horizon - 1e-6, 0.0)
    return df.withColumn("t_obs", F.greatest(F.least(seen, F.lit(top)), F.lit(0.0)))


def head_n_events(df: DataFrame, keys: Sequence[str], n: int, width: float, order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """The first ``n`` events of each key.

    Time cells are counted first; only cells that can hold one of the first ``n`` rows are
    ranked, so a hot key never sorts as a whole.
    """
    cell = ordered.time_bucket(F.col("t"), width)
    sizes = df.groupBy(*keys, cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.withColumn("__before", F.coalesce(before, F.lit(0))).filter(F.col("__before") < n).select(*keys, "__cell", "__before")
    rows = df.withColumn("__cell", cell).join(first, [*keys, "__cell"])
    inside = F.row_number().over(Window.partitionBy(*keys, "__cell").orderBy(*[F.asc(c) for c in order]))
    return rows.withColumn("rn", F.col("__before") + inside).filter(F.col("rn") <= n).drop("__cell", "__before")


def split_by_time(df: DataFrame, keys: Sequence[str], horizon: float, fraction: float, min_rows: int = 10) -> DataFrame:
    """Train before ``T(1-fraction)``, test after with re-zeroed time; short sides drop the key."""
    if not 0.0 < fraction < 0.9:
        raise ValueError("held-out fraction must lie strictly between 0 and 0.9")
    cut = horizon * (1.0 - fraction)
    is_test = F.col("t") >= cut
    sides = df.groupBy(*keys).agg(F.count_if(~is_test).alias("__a"), F.count_if(is_test).alias("__b"))
    good = sides.filter((F.col("__a") >= min_rows) & (F.col("__b") >= min_rows)).select(*keys)
    return (
        df.join(good, list(keys), "left_semi")
        .withColumn("split", F.when(is_test, "test").otherwise("train"))
        .withColumn("t", F.when(is_test, F.col("t") - F.lit(cut)).otherwise(F.col("t")))
    )


# --- features and codes -----------------------------------------------------------------


def trade_features(df: DataFrame, start_ms: float) -> DataFrame:
    maker = F.lower(F.trim(F.col("is_buyer_maker").cast("string"))).isin("true", "1")
    return (
        df.withColumn("notional", F.col("price") * F.col("quantity"))
        .withColumn("time", (F.col("transact_time") - F.lit(start_ms)) / F.lit(60000.0))
        .withColumn("mark", maker.cast("int"))
    )


def severity_mark(best) -> Column:
    """0 below two, 1 for two to four, 2 from five; unknown counts as one casualty level 0..2."""
    x = F.coalesce(F.col(best) if isinstance(best, str) else best, F.lit(1))
    return F.when(x < 2, 0).when(x < 5, 1).otherwise(2)


def dense_code(df: DataFrame, column: str, name: str = "code", null_as=1) -> DataFrame:
    """Codes 0..M-1 over the sorted distinct values of any type, nulls taken as ``null_as``."""
    kind = dict(df.dtypes)[column]
    value = F.coalesce(F.col(column), F.lit(null_as).cast(kind))
    coded = df.withColumn("__v", value)
    table = ordered.sorted_rank(coded.select("__v").distinct(), [F.asc("__v")], name).withColumn(name, (F.col(name) - 1).cast("int"))
    return coded.join(table, "__v").drop("__v")


def top_k_labels(df: DataFrame, label: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most frequent labels with codes 0..k-1, by count then label.

    Null labels are neither counted nor ranked. Without keys this is a top-k of the aggregated
    labels (sorted and cut per task first).
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc(label))
        return counts.withColumn("actor", (F.row_number().over(w) - 1).cast("int")).filter(F.col("actor") < k)
    top = counts.orderBy(F.desc("n"), F.asc(label)).limit(k)
    return top.withColumn("actor", (F.row_number().over(Window.orderBy(F.desc("n"), F.asc(label))) - 1).cast("int"))


def encode_actors(df: DataFrame, label: str, k: int | None = None, table: DataFrame | None = None) -> DataFrame:
    """Inner join to a label table, or to the top-k labels (at most ``k`` rows, so broadcast)."""
    if table is None:
        if k is None:
            raise ValueError("give k or a label table")
        top = top_k_labels(df, label, k).select(label, "actor")
        return df.join(F.broadcast(top) if k <= 100_000 else top, label)
    return df.join(table.select(label, "actor"), label)


def overlay_events(background: DataFrame, overlay: DataFrame) -> DataFrame:
    """Union with a 0/1 injection label; columns missing on a side become null."""
    return background.withColumn("is_injected", F.lit(0)).unionByName(
        overlay.withColumn("is_injected", F.lit(1)), allowMissingColumns=True
    )


# --- reproducible sampling --------------------------------------------------------------


def stable_order(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int, label: str, name: str = "pos") -> DataFrame:
    """A fixed pseudo-random order inside each key; any prefix of it is nested in longer ones."""
    drawn = df.withColumn("__u", S.uniform_draw(seed, label, *[F.col(c) for c in ids]))
    return ordered.rank(drawn, keys, [F.asc("__u"), *[F.asc(c) for c in ids]], ordered.value_bucket(F.col("__u")), name).drop("__u")


def volume_neutral_removal(background: DataFrame, overlay: DataFrame, windows: DataFrame, keys: Sequence[str],
                           seed: int, width: float = 24.0) -> tuple[DataFrame, DataFrame]:
    """Remove per actor as many background rows as the overlay adds.

    Rows outside the active windows go first, each group in a fixed order, so a weaker
    overlay removes a prefix of what a stronger one removes. Returns the background flagged
    with ``removed`` and a per-actor report with ``cap_hit``.
    """
    from flockwise.operators.intervals import in_window

    group = [*keys, "actor"]
    flagged = in_window(background, windows, keys, ["event_id"], width=width)
    u = S.uniform_draw(seed, "remove", F.col("inside"), F.col("event_id"))
    flagged = flagged.withColumn("__u", u)
    bucket = ordered.value_bucket(F.col("inside") + F.col("__u"))
    placed = ordered.rank(flagged, group, [F.asc("inside"), F.asc("__u"), F.asc("event_id")], bucket, "__rn")
    need = overlay.groupBy(*group).agg(F.count(F.lit(1)).alias("__need"))
    out = (
        placed.join(need, group, "left")
        .withColumn("removed", (F.col("__rn") <= F.coalesce("__need", F.lit(0))).cast("int"))
        .drop("__rn", "__u", "__need")
    )
    report = (
        need.join(out.groupBy(*group).agg(F.sum("removed").alias("removed"), F.count(F.lit(1)).alias("background")), group, "left")
        .select(
            *group,
            F.col("__need").alias("overlay"),
            F.coalesce("background", F.lit(0)).cast("long").alias("background"),
            F.coalesce("removed", F.lit(0)).cast("long").alias("removed"),
        )
        .withColumn("cap_hit", (F.col("removed") < F.col("overlay")).cast("int"))
    )
    return out, report


def stratum_allocation(sizes: DataFrame, strata: Sequence[str], cap: int) -> DataFrame:
    """Rows to keep per stratum: proportional floor with at least one, overflow taken from the
    largest allocations, leftovers given to the largest deficits.

    The repeated take-one and give-one steps are expressed as one ranked list: unit ``j`` of a
    stratum with allocation ``a`` would be taken when the largest allocation is ``a-j``, and
    unit ``j`` of a deficit ``d`` would be given when the largest deficit is ``d-j``. At most
    one unit per stratum and unit of imbalance is listed, and the imbalance is below the
    number of strata.
    """
    everything = Window.partitionBy(F.lit(0))
    base = (
        sizes.withColumn("__total", F.sum("size").over(everything))
        .withColumn("a", F.greatest(F.floor(F.lit(cap) * F.col("size") / F.col("__total")), F.lit(1)).cast("long"))
        .withColumn("__off", F.lit(cap) - F.sum("a").over(everything))
    )
    steps = F.abs(F.col("__off")).cast("long")
    take = F.sequence(F.lit(1).cast("long"), F.least(F.col("a") - 1, steps))
    give = F.sequence(F.lit(1).cast("long"), F.least(F.col("size") - F.col("a"), steps))
    units = base.filter("__off <> 0").withColumn(
        "__j",
        F.explode(
            F.when((F.col("__off") < 0) & (F.col("a") > 1), take)
            .when((F.col("__off") > 0) & (F.col("size") > F.col("a")), give)
        ),
    )
    level = F.when(F.col("__off") < 0, F.col("a")).otherwise(F.col("size") - F.col("a")) - F.col("__j")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("__level"), *[F.asc(c) for c in strata])
    chosen = (
        units.withColumn("__level", level)
        .withColumn("__rn", F.row_number().over(order))
        .filter(F.col("__rn") <= F.abs(F.col("__off")))
        .groupBy(*strata).agg(F.count(F.lit(1)).alias("__moves"))
    )
    return (
        base.join(chosen, list(strata), "left")
        .withColumn("keep", F.col("a") + F.signum("__off").cast("long") * F.coalesce("__moves", F.lit(0)))
        .select(*strata, "size", "keep")
    )


def stratified_cap(df: DataFrame, strata: Sequence[str], cap: int, ids: Sequence[str], seed: int) -> DataFrame:
    """At most ``cap`` rows with the strata's shares kept; the sample is reproducible."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    keep = stratum_allocation(sizes, strata, cap).withColumn(
        "keep", F.when(F.sum("size").over(Window.partitionBy(F.lit(0))) <= cap, F.col("size")).otherwise(F.col("keep"))
    )
    placed = stable_order(df, strata, ids, seed, "cap", "__pos")
    return placed.join(keep.select(*strata, "keep"), list(strata)).filter("__pos <= keep").drop("__pos", "keep")
