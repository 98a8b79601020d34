"""Sinks: event tables, streams, per-session files, appended results, resume filter."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockwise.operators import ordered


def write_event_table(df: DataFrame, prefix: str, formats: Sequence[str] = ("csv", "parquet"), mode: str = "overwrite") -> dict[str, str]:
    """Write the tidy table in each format and return the paths."""
    out = {}
    for fmt in formats:
        path = f"{prefix}.{fmt}"
        writer = df.write.mode(mode)
        (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))
        out[fmt] = path
    return out


def streams(df: DataFrame, stream: str, t: str, width: float, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Each stream as ordered rows ``(stream, seq, t)``; no stream is ever held as one array."""
    order = [F.asc(t), *[F.asc(c) for c in tiebreak]]
    out = ordered.rank(df.select(stream, t, *tiebreak), [stream], order, ordered.time_bucket(F.col(t), width), name="seq")
    return out.select(stream, F.col("seq"), t)


def write_streams(df: DataFrame, prefix: str, stream: str, t: str, width: float, tiebreak: Sequence[str] = ()) -> tuple[str, str]:
    """Stream rows sorted by time and an index of counts."""
    path, index = f"{prefix}.streams", f"{prefix}.index"
    rows = streams(df, stream, t, width, tiebreak)
    rows.repartitionByRange(stream, "seq").sortWithinPartitions(stream, "seq").write.mode("overwrite").parquet(path)
    df.groupBy(stream).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(index)
    return path, index


#: What a folder name of ``partitionBy`` holds as ``%`` and two hex digits.
ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")


def session_folder(session: str | None) -> str:
    """The folder name that ``partitionBy`` gives to a session."""
    return "session_id=" + ("__HIVE_DEFAULT_PARTITION__" if session is None else ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", session))


def session_files(batches, path: str):
    """Write rows that come sorted by ``__session`` as a file per session, a batch at a time; yields the number of files.

    A file gets its name when it is complete, so a task that runs again leaves the same files.
    """
    session, writer, temp, files = None, None, "", 0

    def finish() -> None:
        writer.close()
        os.replace(temp, f"{os.path.dirname(temp)}/part-0.parquet")

    for batch in batches:
        rows, start = pa.Table.from_batches([batch]), 0
        keys, rows = pc.run_end_encode(batch.column("__session")), rows.drop_columns("__session")
        for key, end in zip(keys.values.to_pylist(), keys.run_ends.to_pylist(), strict=True):
            if writer is None or key != session:
                if writer is not None:
                    finish()
                folder = f"{path}/{session_folder(key)}"
                os.makedirs(folder, exist_ok=True)
                session, temp, files = key, f"{folder}/.{uuid.uuid4().hex}", files + 1
                writer = pq.ParquetWriter(temp, rows.schema, store_schema=False)
            writer.write_table(rows.slice(start, end - start))
            start = end
    if writer is not None:
        finish()
    yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})


def write_sessions(df: DataFrame, path: str, meta: Sequence[str] = ()) -> DataFrame:
    """Events partitioned by session, a file each, plus the manifest rows with their counts.

    In a folder of the file system the tasks write the files themselves, because Hadoop starts processes for every file there.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    place = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri()
    if place.getScheme() == "file":
        folder = place.getPath()
        empty = spark.createDataFrame([], df.schema).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", False)
        empty.partitionBy("session_id").parquet(path)
        # as in ``partitionBy``, an empty name is a null
        rows = df.withColumn("__session", F.nullif(F.col("session_id").cast("string"), F.lit(""))).drop("session_id")
        rows = rows.repartition(parts, "__session").sortWithinPartitions("__session")
        rows.mapInArrow(lambda batches: session_files(batches, folder), "files long").agg(F.sum("files")).first()
        Path(folder, "_SUCCESS").touch()
    else:
        df.repartition(parts, "session_id").write.mode("overwrite").partitionBy("session_id").parquet(path)
    return df.groupBy("session_id", *meta).agg(F.count(F.lit(1)).alias("events")).withColumn(
        "path", F.concat(F.lit(f"{path}/session_id="), F.col("session_id").cast("string"))
    )


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def append_results(df: DataFrame, path: str) -> None:
    """Append rows; when the table exists its schema wins and absent columns become null."""
    spark = df.sparkSession
    if table_exists(spark, path):
        schema = spark.read.parquet(path).schema
        df = df.select(*[
            (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ])
    df.write.mode("append").parquet(path)


def resume_filter(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop tasks whose key already has a finished row."""
    finished = done.filter(F.coalesce(F.col("status"), F.lit("ok")) == "ok").select(*keys).distinct()
    return tasks.join(finished, list(keys), "left_anti")
