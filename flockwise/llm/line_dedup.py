"""Repeated line runs by a suffix array over line ids, built by prefix doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockwise.llm.common import discard, stored, text_or_empty

RANGES = "array<struct<first:int,last:int>>"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line: document key, place, a 128-bit id of its content (two hashes of it, from unlike seeds) and its words."""
    text = text_or_empty(text_col)
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.posexplode(F.split(text, "\n", -1)).alias("line", "s"))
    words = F.size(F.filter(F.split("s", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return lines.select("doc_id", "h", "line", F.xxhash64("s").alias("a"), F.xxhash64(F.lit(1), "s").alias("b"), words.alias("words"))


def _repeated(lines: DataFrame, min_words: int) -> DataFrame:
    """Stretches of lines that all occur more than once and hold ``min_words`` words together."""
    place = F.struct("doc_id", "h", "line")
    often = lines.groupBy("a", "b").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("a", "b")
    hits = met = stored(lines.join(often, ["a", "b"], "left_semi").distinct(), "lines")
    by = Window.partitionBy("doc_id", "h").orderBy("line")
    hits = hits.withColumn("isle", F.col("line") - F.row_number().over(by))
    whole = Window.partitionBy("doc_id", "h", "isle")
    hits = hits.withColumn("total", F.sum("words").over(whole)).where(F.col("total") >= min_words)
    before = F.sum("words").over(whole.orderBy("line")) - F.col("words")
    long = stored(hits.withColumn("before", before).withColumn("end", F.max("line").over(whole) + 1), "stretches")
    discard(met)
    return long


def _windows(hits: DataFrame, min_words: int) -> DataFrame:
    """The shortest windows of ``min_words`` words that start or that end at each line, as (line, size).

    Places and questions are merged in one order, so a running extreme answers them in one pass.
    """
    event = lambda value, kind, line: F.struct(value.alias("value"), F.lit(kind).alias("kind"), line.alias("line"))
    c = F.col
    events = [event(c("before"), 1, c("line")), event(c("before") + min_words, 2, c("line")), event(c("before") + c("words") - min_words, 3, c("line"))]
    close = F.when(c("line") + 1 == c("end"), F.array(event(c("total"), 1, c("end")))).otherwise(F.array().cast("array<struct<value:bigint,kind:int,line:int>>"))
    rows = hits.select("doc_id", "h", "isle", F.explode(F.concat(F.array(*events), close)).alias("e")).select("doc_id", "h", "isle", "e.*")
    isle = Window.partitionBy("doc_id", "h", "isle")
    run = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.when(c("kind") == 1, c("line"))
    rows = rows.withColumn("next", F.min(place).over(run(isle.orderBy(F.desc("value"), "kind", F.desc("line")))))
    rows = rows.withColumn("prev", F.max(place).over(run(isle.orderBy("value", "kind", "line"))))
    fore = rows.where("kind = 2 AND next IS NOT NULL").select("doc_id", "h", "isle", "line", (c("next") - c("line")).alias("size"))
    back = rows.where("kind = 3 AND prev IS NOT NULL").select("doc_id", "h", "isle", c("prev").alias("line"), (c("line") + 1 - c("prev")).alias("size"))
    return fore.unionByName(back).distinct()


def _ranked(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Ranks of the distinct keys ``parts`` that occur more than once, in key order, as ``rank``."""
    place = F.struct("doc_id", "h", "line")
    keys = rows.groupBy(*parts).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select(*parts)
    return stored(keys.orderBy(*parts).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def suffix_ranks(hits: DataFrame, deepest: int) -> DataFrame:
    """The suffix array's ranks: ``ranks[k]`` orders each place by its next 2^k lines, null where no other place has them.

    Each round pairs the rank of a place with that of the place 2^k lines on, and ranks the
    pairs; equal ranks are the intervals whose common prefix is at least 2^k lines. Rounds end
    once ``deepest`` lines are reached: longer runs are unions of overlapping windows.
    """
    first = _ranked(hits, ["a", "b"])
    rows = hits.join(first, ["a", "b"], "left").select("doc_id", "h", "isle", "line", F.array("rank").alias("ranks"))
    rows, k = stored(rows, "depth"), 0
    discard(first)
    while 2 ** (k + 1) <= deepest:
        isle = Window.partitionBy("doc_id", "h", "isle").orderBy("line")
        here, last = F.element_at("ranks", k + 1), rows
        rows = rows.withColumn("r1", here).withColumn("r2", F.lead(here, 2**k).over(isle))
        pairs = rows.where("r1 IS NOT NULL AND r2 IS NOT NULL")
        ranks = _ranked(pairs, ["r1", "r2"])
        rows = rows.join(ranks, ["r1", "r2"], "left").select("doc_id", "h", "isle", "line", F.concat("ranks", F.array("rank")).alias("ranks"))
        rows, k = stored(rows, "depth"), k + 1
        discard(last, ranks)
    return rows


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Lines to delete, as ranges of a document: ``doc_id``, ``h`` (hash of its text), ``first``, ``last``."""
    hits = _repeated(_lines(docs, id_col, text_col), min_words)
    windows = stored(_windows(hits, min_words), "windows")
    deepest = windows.agg(F.max("size")).first()[0]
    depth = suffix_ranks(hits, deepest or 0)
    ranks = depth.select("doc_id", "h", "line", "ranks")
    level = F.floor(F.log2("size") + F.lit(1e-9)).cast("int")
    both = windows.withColumn("level", level).withColumn("far", (F.col("line") + F.col("size") - F.pow(F.lit(2), level)).cast("int"))
    at = ["doc_id", "h"]
    null_safe = lambda left, right: F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.h") == F.col(f"{right}.h"))
    both = both.alias("w").join(ranks.alias("r"), null_safe("w", "r") & (F.col("w.line") == F.col("r.line")))
    both = both.select("w.*", F.element_at("r.ranks", F.col("level") + 1).alias("r1"))
    both = both.alias("w").join(ranks.alias("r"), null_safe("w", "r") & (F.col("w.far") == F.col("r.line")))
    both = both.select(*[f"w.{c}" for c in [*at, "line", "size", "r1"]], F.element_at("r.ranks", F.col("level") + 1).alias("r2"))
    both = stored(both.where("r1 IS NOT NULL AND r2 IS NOT NULL"), "intervals")
    discard(hits, windows, depth)
    place = F.struct("doc_id", "h", "line")
    heads = both.groupBy("size", "r1", "r2").agg(F.min(place).alias("head"))
    later = both.join(heads, ["size", "r1", "r2"]).where(F.struct("doc_id", "h", "line") > F.col("head"))
    return later.select("doc_id", "h", F.col("line").alias("first"), (F.col("line") + F.col("size") - 1).alias("last"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Delete later copies of maximal repeated line runs; all columns of ``docs`` and ``dropped_lines``, ``n_lines``.

    A run is a sequence of whole lines (text between newlines, compared exactly) with at
    least ``min_words`` words. Where the same sequence occurs at an earlier place, its lines are
    deleted; places are ordered by document id (null first), hash of the text and line. The
    first place of every line stays, so no content is lost. Shorter repeated runs stay.
    ``dropped_lines`` lists merged ranges of line numbers from 0. Only built-in functions run.

    A null text stays null and counts as empty, which is one line without words. Rows with
    equal id and equal text are one document to this operator: each gets that document's
    result. Other columns pass through, whatever their names. An empty table gives an empty result.
    """
    gone = repeats(docs, id_col, text_col, min_words)
    spans = gone.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    none = F.array().cast(RANGES)

    def merge(acc, x):
        top = F.element_at(acc, -1)
        wider = F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))
        return F.when((F.size(acc) > 0) & (x["first"] <= top["last"] + 1), grown).otherwise(F.concat(acc, F.array(x)))

    spans = spans.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.aggregate("spans", none, merge).alias("__gone"))
    text = text_or_empty(text_col)
    marked = docs.withColumn("__t", F.xxhash64(text)).alias("d").join(
        spans.alias("s"), F.col(f"d.{id_col}").eqNullSafe(F.col("s.__id")) & (F.col("d.__t") == F.col("s.__h")), "left"
    )
    lines = F.split(F.col(f"d.{text_col}"), "\n", -1)
    ranges = F.coalesce(F.col("s.__gone"), none)
    left = F.filter(lines, lambda s, i: ~F.exists(ranges, lambda r: (i >= r["first"]) & (i <= r["last"])))
    cleaned = F.when(F.size(ranges) == 0, F.col(f"d.{text_col}")).otherwise(F.array_join(left, "\n"))
    columns = [cleaned.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns]
    n_lines = F.when(F.size(ranges) == 0, F.lit(0)).otherwise(F.size(lines) - F.size(left))
    return marked.select(*columns, F.size(F.split(F.coalesce(F.col(f"d.{text_col}"), F.lit("")), "\n", -1)).alias("n_lines"), n_lines.alias("n_dropped"), ranges.alias("dropped_lines"))
