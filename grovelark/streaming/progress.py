"""State folded from progress events.

The folds are plain aggregates over ``(task_id, ts, seq, type, …)`` rows, so
one definition serves a batch table and a stream. ``(ts, seq)`` is the event
order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percentage
from ..sources.durable import fresh_dir

TERMINAL = {"analysis_complete": "completed", "analysis_error": "failed", "task_cancelled": "cancelled"}
FILE_DONE = ("analysis_file_complete", "analysis_file_failed")


def _when(kind: str, value: Column) -> Column:
    return F.when(F.col("type") == kind, value)


def _order() -> Column:
    return F.struct("ts", "seq")


def _order_of(*kinds: str) -> Column:
    return F.when(F.col("type").isin(*kinds), _order())


def _status_of(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in TERMINAL.items() for x in kv])
    return F.element_at(names, kind)


def task_state(events: DataFrame) -> DataFrame:
    """Latest progress, and status with error by the latest complete or error event."""
    ends = _order_of("analysis_complete", "analysis_error")
    return (
        events.groupBy("task_id")
        .agg(
            F.max_by(F.struct(percentage("current", "total").alias("p"), F.col("file_path").alias("f")), _order_of("analysis_progress")).alias("_p"),
            F.max_by("type", ends).alias("_end"),
            F.max_by("error", _order_of("analysis_error")).alias("_error"),
        )
        .select(
            "task_id", F.col("_p.p").alias("percentage"), F.col("_p.f").alias("current_file"),
            F.coalesce(_status_of(F.col("_end")), F.lit("running")).alias("status"), F.col("_error").alias("error"),
        )
    )


def node_status(events: DataFrame) -> DataFrame:
    done = events.where(F.col("type").isin(*FILE_DONE))
    latest = done.groupBy("task_id", "file_path").agg(F.max_by("type", _order()).alias("_t"))
    return latest.select("task_id", "file_path", F.when(F.col("_t") == FILE_DONE[0], "completed").otherwise("failed").alias("status"))


def lifecycle(events: DataFrame) -> DataFrame:
    """Created, started and completed times; the first terminal event decides."""
    ends = _order_of(*TERMINAL)
    return (
        events.groupBy("task_id")
        .agg(
            F.min("ts").alias("created_at"),
            F.min(_when("analysis_started", F.col("ts"))).alias("started_at"),
            F.min_by(F.struct("type", "ts"), ends).alias("_end"),
        )
        .select(
            "task_id", "created_at", "started_at", F.col("_end.ts").alias("completed_at"),
            F.coalesce(_status_of(F.col("_end.type")), F.when(F.col("started_at").isNotNull(), "running"), F.lit("pending")).alias("status"),
        )
    )


def level_counters(events: DataFrame) -> DataFrame:
    """Finished files and directories and failures per task and level."""
    ok, bad = F.col("type") == FILE_DONE[0], F.col("type") == FILE_DONE[1]
    is_file = F.col("node_type") == "file"
    return events.groupBy("task_id", "depth").agg(
        F.count_if(ok & is_file).alias("completed_files"),
        F.count_if(ok & ~is_file).alias("completed_dirs"),
        F.count_if(bad).alias("failed"),
    )


def level_progress(events: DataFrame) -> DataFrame:
    """Finished nodes since the latest start of each level: a level start resets the count."""
    starts = events.where("type = 'analysis_started'").groupBy("task_id", "depth").agg(F.max(_order()).alias("_since"))
    done = events.where(F.col("type").isin(*FILE_DONE)).join(starts, ["task_id", "depth"])
    return done.where(_order() > F.col("_since")).groupBy("task_id", "depth").agg(F.count(F.lit(1)).alias("level_completed"))


def active_nodes(events: DataFrame, as_of: Column) -> DataFrame:
    """Nodes whose latest event is a start, with seconds since then."""
    kinds = ("analysis_file_started", *FILE_DONE)
    latest = (
        events.where(F.col("type").isin(*kinds))
        .groupBy("task_id", "file_path")
        .agg(F.max_by(F.struct("type", "ts"), _order()).alias("_l"))
        .where("_l.type = 'analysis_file_started'")
    )
    seconds = F.timestamp_diff("SECOND", F.col("_l.ts"), as_of)
    return latest.select("task_id", "file_path", seconds.alias("elapsed_seconds"))


def run_to_table(
    stream: DataFrame, fold: Callable[[DataFrame], DataFrame], key: list[str], name: str
) -> DataFrame:
    """Fold a finite stream into a table: all available input, update mode.

    Each micro-batch is written under its own number, so a repeated batch
    overwrites itself; the newest row of each key is the state.
    """
    spark = stream.sparkSession
    base = fresh_dir(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    query = (
        fold(stream).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/rows")
    values = [c for c in rows.columns if c not in (*key, "batch")]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*key, *[F.col(f"_v.{c}").alias(c) for c in values])
