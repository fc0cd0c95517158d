"""Incremental re-runs over arriving snapshots; state grows by what each of them changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff as X
from ..sources.change_log import ChangeLog, Folder

_KEY = ["repo", "path"]
_PRINT = "size BIGINT, mtime BIGINT, content_hash STRING"
_STATE = "repo STRING, path STRING, value STRUCT<size: BIGINT, mtime: BIGINT, content_hash: STRING, last_analyzed: TIMESTAMP>"
_WAITING = f"batch BIGINT, snapshot BIGINT, repo STRING, path STRING, {_PRINT}, last_analyzed TIMESTAMP, expected BIGINT"


def state_log(spark, base: str, buckets: int = 64) -> ChangeLog:
    """The fingerprints of ``base``: ``(repo, path, value)``."""
    return ChangeLog(spark, f"{base}/state", _STATE, _KEY, buckets)


def stored_fingerprints(log: ChangeLog, before: int | None = None) -> DataFrame:
    """Fingerprint rows as they stand, or as they stood before a run."""
    return log.newest(before).select(*_KEY, "value.*", "run")


def import_fingerprints(log: ChangeLog, prints: DataFrame, run: int = 0) -> bool:
    """Start a log from fingerprint rows saved elsewhere, for instance :func:`..sources.saved_state.load_fingerprints`."""
    value = F.struct("size", F.col("mtime").cast("bigint").alias("mtime"), "content_hash", F.col("last_analyzed").cast("timestamp").alias("last_analyzed"))
    return log.append(run, prints.select(*_KEY, value.alias("value")))


def apply_fingerprints(prints: DataFrame, run: int, base: str, buckets: int = 64, note: str = "") -> None:
    """Compare the fingerprints of a complete snapshot with the stored ones; write changes and affected nodes, append the changes.

    What is written grows with the changes, not with the state. A run that is committed is not repeated.
    """
    spark = prints.sparkSession
    log = state_log(spark, base, buckets)
    if log.record(run) is not None:
        return  # its changes were written before it was committed
    value = F.struct("size", "mtime", "content_hash", "last_analyzed")
    same = F.col("new.content_hash").eqNullSafe(F.col("old.content_hash"))
    found = log.compare(prints.select(*_KEY, value.alias("value")), same)
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified")
    target = f"{base}/changes/run={run}"
    found.select(*_KEY, kind.alias("change_type"), "old", "new").write.mode("overwrite").parquet(target)
    changes = spark.read.parquet(target)
    X.affected_nodes(changes).write.mode("overwrite").parquet(f"{base}/affected/run={run}")
    analysed = F.when(F.col("new").isNotNull(), F.struct("new.size", "new.mtime", "new.content_hash", F.current_timestamp().alias("last_analyzed")))
    log.append(run, changes.select(*_KEY, analysed.alias("value")), note)


def apply_snapshot(files: DataFrame, run: int, base: str, buckets: int = 64) -> None:
    """As :func:`apply_fingerprints`, from file rows."""
    apply_fingerprints(X.fingerprints(files), run, base, buckets)


# ---------------------------------------------------------------- arrival


def closing_marks(files: DataFrame) -> DataFrame:
    """One more row per snapshot, without a path, whose ``size`` is how many rows the snapshot has."""
    marks = files.groupBy("snapshot").agg(F.count(F.lit(1)).alias("size"))
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in files.schema if f.name not in ("snapshot", "size")]
    return marks.select("snapshot", "size", *nulls).select(*files.columns)


def apply_batch(batch: DataFrame, number: int, base: str, marked: bool, buckets: int = 64) -> None:
    """Take in a micro-batch and apply, in the order of their numbers, the snapshots that are complete.

    With ``marked`` a snapshot is complete once its closing mark and as many rows as it names have come, in any number of
    micro-batches; until then its fingerprints wait below ``inbox``, and later snapshots wait for it. Without marks a
    micro-batch must hold whole snapshots: one that comes again in another is refused.
    """
    spark = batch.sparkSession
    inbox, log = Folder(spark, f"{base}/inbox"), state_log(spark, base, buckets)
    rows = X.fingerprints(batch.where("relative_path IS NOT NULL").withColumn("mtime", F.col("mtime").cast("bigint")), "snapshot")
    marks = batch.where("relative_path IS NULL").select("snapshot", F.col("size").cast("bigint").alias("expected"))
    here = rows.unionByName(marks, allowMissingColumns=True).persist()  # texts are hashed once
    waiting = spark.read.schema(_WAITING).option("basePath", f"{base}/inbox").parquet(f"{base}/inbox") if inbox.names() else spark.createDataFrame([], _WAITING)
    waiting = waiting.where(F.col("batch") != number)  # a repeated micro-batch brings its rows again
    every = waiting.drop("batch").unionByName(here)
    state = every.groupBy("snapshot").agg(F.count("path").alias("n"), F.max("expected").alias("expected")).collect()  # a row per waiting snapshot
    ready, late = [], []
    for r in sorted(state, key=lambda r: r["snapshot"]):
        n, known = r["snapshot"], log.record(r["snapshot"])
        if known is not None:
            if not marked and known.get("note", "") not in ("", f"batch {number}"):
                raise ValueError(f"snapshot {n} came in more than one micro-batch: send closing marks")
        elif marked and (late or r["expected"] is None or r["n"] < r["expected"]):
            late.append(n)
        else:
            ready.append(n)
    if late:
        here.where(F.col("snapshot").isin(late)).write.mode("overwrite").partitionBy("snapshot").parquet(f"{base}/inbox/batch={number}")
    for n in ready:
        own = every.where(F.col("snapshot") == n).where("path IS NOT NULL")
        apply_fingerprints(own.select(*_KEY, "size", "mtime", "content_hash", "last_analyzed"), n, base, buckets, f"batch {number}")
    for name in inbox.names():
        for n in {r["snapshot"] for r in state} - set(late):
            inbox.drop(f"{name}/snapshot={n}")  # applied: what waited is not needed any more
    here.unpersist()


def run_snapshots(stream: DataFrame, base: str, marked: bool = False, buckets: int = 64) -> None:
    """``stream`` has file rows with the number of their ``snapshot``; see :func:`apply_batch` for when one is complete."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, n: apply_batch(batch, n, base, marked, buckets))
        .option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    )
    query.awaitTermination()
