"""Counts and summaries of runs, levels and file types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V


def extension_histogram(files: DataFrame) -> DataFrame:
    ext = F.when(F.col("ext") == "", V.NO_EXTENSION_LABEL).otherwise(F.col("ext"))
    return files.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext")


def queue_stats(tasks: DataFrame, by: list[str]) -> DataFrame:
    """Counts by state over the latest status of each task."""
    s = F.col("status")
    counted = tasks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(s == k).alias(k) for k in ("queued", "running", "completed", "failed")],
    )
    return counted.withColumn("pending", F.col("queued") + F.col("running"))


def run_stats(nodes: DataFrame) -> DataFrame:
    s, is_file = F.col("status"), F.col("node_type") == "file"
    return nodes.groupBy("repo").agg(
        F.count_if(is_file).alias("total_files"),
        F.count_if(~is_file).alias("total_dirs"),
        F.count_if(s.isin("completed", "skipped")).alias("processed"),
        F.count_if(s == "failed").alias("failed"),
        F.max("depth").alias("max_depth"),
    )


def with_elapsed(runs: DataFrame, started: str = "started_at", ended: str = "completed_at", now: Column | None = None) -> DataFrame:
    """Whole seconds that each run took, or has taken up to ``now`` if it goes on; null where it has not started."""
    until = F.col(ended) if now is None else F.coalesce(F.col(ended), now)
    return runs.withColumn("elapsed", F.timestamp_diff("SECOND", F.col(started), until))


def with_remaining(stats: DataFrame, total: Column | str = "total", processed: str = "processed", failed: str = "failed") -> DataFrame:
    t = F.col(total) if isinstance(total, str) else total
    return stats.withColumn("remaining", t - F.col(processed) - F.col(failed))


def final_summary(runs: DataFrame) -> DataFrame:
    """Throughput of ``(task_id, completed, failed, elapsed)``; null without elapsed time."""
    return runs.select(
        "task_id", "completed", "failed", "elapsed", F.try_divide("completed", "elapsed").alias("throughput")
    )


def level_summary(nodes: DataFrame) -> DataFrame:
    s = F.col("status")
    return nodes.groupBy("repo", "depth").agg(
        F.count_if(s == "completed").alias("completed"),
        F.count_if(s == "failed").alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )


def level_failures(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("status") == "failed").select("repo", "depth", "relative_path", "error_message")
