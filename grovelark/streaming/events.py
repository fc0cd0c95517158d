"""Progress event rows: envelope, builders and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import percentage
from ..sources.quarantine import json_reason, sort_out

#: payload fields of all event types; absent ones are null
DATA = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("current", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("percentage", T.DoubleType()),
        T.StructField("current_file", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("total_files", T.LongType()),
        T.StructField("total_dirs", T.LongType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("completed", T.LongType()),
        T.StructField("failed", T.LongType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("doc_path", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("stats", T.MapType(T.StringType(), T.StringType())),
    ]
)
ENVELOPE = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("data", DATA), T.StructField("timestamp", T.StringType())]
)


def read_event_files(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of JSON-lines messages from a folder that receives files."""
    return from_messages(spark.readStream.text(folder))


def from_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed event rows from message texts; for unreadable ones see :func:`sorted_messages`."""
    e = lines.select(F.from_json(column, ENVELOPE).alias("e")).where("e.type is not null")
    return e.select(
        F.col("e.data.task_id").alias("task_id"), F.to_timestamp("e.timestamp").alias("ts"),
        F.col("e.type").alias("type"), F.col("e.data").alias("data"),
    )


def sorted_messages(lines: DataFrame, source: Column, position: Column, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Typed event rows of a batch, and the messages that can't be read with where they were and why."""
    kept = lines.select(source.cast("string").alias("source"), position.cast("bigint").alias("position"), F.col(column).alias("value"))
    reason = json_reason(F.col("value"), {"type": "string", "data": "variant"})
    typed = F.from_json("value", ENVELOPE)
    reason = reason.when(typed["type"].isNull() | typed["data"].isNull(), "fields of other types")
    good, bad = sort_out(kept, reason, F.col("value"), F.col("source"), F.col("position"))
    return from_messages(good), bad


def message(event_type: Column | str, fields: dict[str, Column | str], at: Column) -> Column:
    """``{"type", "data", "timestamp"}`` as one JSON text."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    data = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()])
    return F.to_json(F.struct(kind.alias("type"), data.alias("data"), at.alias("timestamp")))


def started(rows: DataFrame, at: Column) -> DataFrame:
    fields = {n: n for n in ("task_id", "source_path", "total_files", "total_dirs")}
    return rows.select("task_id", message("analysis_started", fields, at).alias("value"))


def progressed(rows: DataFrame, at: Column) -> DataFrame:
    fields: dict[str, Column | str] = {n: n for n in ("task_id", "current", "total")}
    fields |= {"percentage": percentage("current", "total"), "current_file": "current_file", "status": "status"}
    return rows.select("task_id", message("analysis_progress", fields, at).alias("value"))


def level_completed(rows: DataFrame, at: Column) -> DataFrame:
    fields = {n: n for n in ("task_id", "depth", "completed", "failed", "total")}
    return rows.select("task_id", message("analysis_level_complete", fields, at).alias("value"))


def file_finished(results: DataFrame, at: Column) -> DataFrame:
    """One message per result row: file completed with its document, or failed with its error."""
    good = message("analysis_file_complete", {n: n for n in ("task_id", "file_path", "doc_path")}, at)
    bad = message("analysis_file_failed", {n: n for n in ("task_id", "file_path", "error")}, at)
    return results.select("task_id", F.when(F.col("success"), good).otherwise(bad).alias("value"))


def finished(rows: DataFrame, at: Column) -> DataFrame:
    """Task end: ``stats`` when ``error`` is null, else the error."""
    good = message("analysis_complete", {"task_id": "task_id", "stats": "stats"}, at)
    bad = message("analysis_error", {"task_id": "task_id", "error": "error"}, at)
    return rows.select("task_id", F.when(F.col("error").isNull(), good).otherwise(bad).alias("value"))


def of_task(events: DataFrame, task_id: object) -> DataFrame:
    return events.where(F.col("task_id") == task_id)
