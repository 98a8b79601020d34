"""Secret scans by an incremental ledger of blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockwise.llm.common import stored, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the smallest length of ``group`` that counts; ``likely`` is a cheap test before."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base kinds and their least lengths, in the order in which spans of one start are listed.
# A maximal run of the hex and access classes starts at its first possible character, so a
# least length in the pattern finds the spans of the unbounded pattern that are long enough.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
#: Further kinds.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("grant", 1, r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"),
)
RULES = BASE + MORE
SPAN = "array<struct<start:int,rank:int,rule:string,stop:int>>"
LEDGER = f"blob binary, rules array<string>, spans {SPAN}"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in code points: the parts between matches and the matches alternate, so lengths add up to places."""
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x))
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x))
    parts = F.arrays_zip(between.alias("gap"), whole.alias("whole"), value.alias("value"))
    none = F.lit(None).cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["whole"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.name).alias("rule"), end.alias("stop"))
        out = F.when(x["value"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(F.coalesce(end, begin).alias("at"), out.alias("out"))

    found = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.coalesce(F.when(text.rlike(rule.pattern), found).otherwise(none), F.array().cast(SPAN))


def blob_of(text_col: str) -> Column:
    return F.unhex(F.sha2(text_or_empty(text_col), 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after a scan of ``docs``: ``blob`` (SHA-256 of the text), ``rules`` it was scanned with, ``spans``.

    Each distinct text is one blob; copies are folded before the shuffle. A blob is scanned
    with those rule versions only that the earlier ``ledger`` doesn't hold for it; spans of
    versions that are no longer among ``rules`` stay in the ledger. Earlier blobs that ``docs``
    lacks are kept unchanged. Only built-in functions run.

    Null texts count as empty. Without a row the ledger is what it was.
    """
    blobs = docs.select(blob_of(text_col).alias("blob"), text_or_empty(text_col).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    none = F.array().cast("array<string>")
    if ledger is None:
        todo = blobs.withColumn("seen", none).withColumn("old", F.array().cast(SPAN))
    else:
        before = ledger.select("blob", F.col("rules").alias("seen"), F.col("spans").alias("old"))
        todo = blobs.join(before, "blob", "full_outer").withColumns({"seen": F.coalesce("seen", none), "old": F.coalesce("old", F.array().cast(SPAN))})
    found = F.col("old")
    for rank, rule in enumerate(rules):
        unseen = F.col("text").isNotNull() & ~F.array_contains("seen", rule.name)
        found = F.concat(found, F.when(unseen, _spans(F.col("text"), rule, rank)).otherwise(F.array().cast(SPAN)))
    names = F.array(*[F.lit(r.name) for r in rules])
    scanned = F.when(F.col("text").isNull(), F.col("seen")).otherwise(F.array_distinct(F.concat("seen", names)))
    return todo.select("blob", scanned.alias("rules"), F.array_sort(found).cast(SPAN).alias("spans"))


def update(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``scan`` written to the shared folder, so that several readers don't repeat it."""
    return stored(scan(docs, ledger, text_col, rules), "ledger")


def current(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The spans of the given rule versions, by start, then by the order of the rules."""
    wanted = F.array(*[F.lit(r.name) for r in rules])
    return F.filter(spans, lambda s: F.array_contains(wanted, s["rule"]))


def findings(docs: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings joined back to all rows that hold a blob: ``doc_id``, ``blob``, ``spans`` (empty if none).

    Rows with one hot blob meet a single small ledger row; only blobs with spans take part in the join.
    """
    hits = ledger.select("blob", current(F.col("spans"), rules).alias("spans")).where(F.size("spans") > 0)
    paths = docs.select(F.col(id_col).alias("doc_id"), blob_of(text_col).alias("blob"))
    return paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every span replaced by ``mark``; overlapping spans share one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = s["start"] - acc["at"]
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, gap), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out")
        )

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def labelled(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.substring_index(s["rule"], "@", 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
