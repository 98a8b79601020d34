"""A training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of
``docs``, whatever their names and values. ``run`` writes each stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockwise.llm import jaccard, line_dedup, packing, secrets, toxicity
from flockwise.llm.common import stored, table


def _recounted(changed, columns: list[str]) -> list:
    """The columns of documents; ``n_chars`` follows a changed text."""
    return [F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns]


#: Columns that the stages work on; all others only pass through.
USED = ("doc_id", "text", "n_chars")


def passing(stage):
    """A stage for tables with any further columns: they are renamed for its time, so that no name of theirs meets one of the stage's own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in USED else f"column_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run


@passing
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go (score of 0.3 or more). A null text is judged as an empty one."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("toxic = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


@passing
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more are deleted; documents left without a line go."""
    out = line_dedup.line_dedup(docs, min_words=50).where("n_dropped < n_lines")
    return out.select(*_recounted(F.col("n_dropped") > 0, docs.columns))


@passing
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, that with the smallest id stays.

    Rows are judged one by one, by a key of their own: of a group one row stays, that with the smallest
    id, of equal ids that with the smallest key. A row without an id stays only if none of its group has one.
    """
    keyed = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")
    groups = jaccard.jaccard_components(keyed.select(F.col("__row").alias("doc_id"), "text"), words=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("__row"), "component_id").join(keyed.select("__row", "doc_id"), "__row")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first"))
    return keyed.join(first.select("first.__row"), "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


@passing
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; all documents stay. A null text holds none and stays null."""
    ledger = secrets.update(docs)
    hits = ledger.select(F.col("blob").alias("__blob"), secrets.current(F.col("spans")).alias("__spans")).where(F.size("__spans") > 0)
    found = docs.withColumn("__blob", secrets.blob_of("text")).join(hits, "__blob", "left")
    spans = F.coalesce("__spans", F.array().cast(secrets.SPAN))
    clean = found.withColumn("text", secrets.redact(F.col("text"), spans))
    return clean.select(*_recounted(F.size(spans) > 0, docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining tokens in sequences of at most 4096, one row per piece with its ids."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

#: Language-model scoring, components and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
