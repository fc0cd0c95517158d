"""Fingerprints, snapshot comparison and what a change affects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

_KEY = ["repo", "path"]
_PRINT = ["size", "mtime", "content_hash"]


def fingerprints(files: DataFrame, *keep: str) -> DataFrame:
    """Size, time and MD5 of the raw bytes (``raw`` where a reader gives them); an unreadable file hashes to ``''``."""
    return files.select(
        *keep,
        "repo",
        P.normalise("relative_path").alias("path"),
        "size",
        "mtime",
        F.coalesce(F.md5("raw" if "raw" in files.columns else "content"), F.lit("")).alias("content_hash"),
        F.lit(None).cast("timestamp").alias("last_analyzed"),
    )


def detect_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """Added, modified (hash differs) and deleted paths with both fingerprints."""
    a = new.select(*_KEY, F.struct(*_PRINT).alias("new"))
    b = old.select(*_KEY, F.struct(*_PRINT).alias("old"))
    kind = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "deleted")
        .when(~F.col("new.content_hash").eqNullSafe(F.col("old.content_hash")), "modified")
    )
    return a.join(b, _KEY, "full_outer").select(*_KEY, kind.alias("change_type"), "old", "new").where("change_type is not null")


def affected_nodes(changes: DataFrame) -> DataFrame:
    """Changed files that still exist, and every directory above any change."""
    def node(kind: str, path: Column) -> Column:
        return F.struct(F.lit(kind).alias("node_type"), path.alias("relative_path"))

    dirs = F.transform(P.prefixes_of("path"), lambda d: node("directory", d))
    own = F.when(F.col("change_type") != "deleted", F.array(node("file", F.col("path"))))
    found = F.concat(dirs, F.coalesce(own, F.slice(dirs, 1, 0)))
    return changes.select("repo", F.inline(found)).distinct()


def affected_summary(changes: DataFrame) -> DataFrame:
    return (
        affected_nodes(changes)
        .groupBy("repo")
        .agg(
            F.count_if(F.col("node_type") == "file").alias("affected_files"),
            F.count_if(F.col("node_type") == "directory").alias("affected_dirs"),
        )
    )


def mark_for_reanalysis(nodes: DataFrame, affected: DataFrame) -> DataFrame:
    hit = affected.select("repo", "node_type", "relative_path").withColumn("_hit", F.lit(True))
    status = F.when(F.col("_hit"), "pending").otherwise("completed")
    return nodes.drop("status").join(hit, ["repo", "node_type", "relative_path"], "left").withColumn("status", status).drop("_hit")


def marked_count(marked: DataFrame) -> DataFrame:
    return marked.groupBy("repo").agg(F.count_if(F.col("status") == "pending").alias("marked"))


def upsert_fingerprints(base: DataFrame, changes: DataFrame, analyzed_at: Column) -> DataFrame:
    """Next snapshot: changed rows replaced, deleted rows gone, the rest kept."""
    delta = changes.select(*_KEY, "change_type", "new")
    fresh = F.col("change_type").isNotNull()
    return (
        base.join(delta, _KEY, "full_outer")
        .where(~F.col("change_type").eqNullSafe(F.lit("deleted")))
        .select(
            *_KEY,
            *[F.when(fresh, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in _PRINT],
            F.when(fresh, analyzed_at).otherwise(F.col("last_analyzed")).alias("last_analyzed"),
        )
    )


def change_counts(changes: DataFrame) -> DataFrame:
    kind = F.col("change_type")
    return changes.groupBy("repo").agg(
        *[F.count_if(kind == k).alias(k) for k in ("added", "modified", "deleted")],
        F.count(F.lit(1)).alias("total"),
    )


