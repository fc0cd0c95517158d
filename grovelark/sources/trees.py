"""Node tables as JSON, and nested JSON trees as node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .durable import cut
from .quarantine import json_reason, sort_out

_FIELDS = ("name", "node_type", "relative_path", "status", "doc_path", "error_message", "api_info")


def node_json(nodes: DataFrame) -> DataFrame:
    """One flat JSON object per node."""
    return nodes.select("repo", F.to_json(F.struct(*[c for c in nodes.columns if c != "repo"])).alias("json"))


def sorted_trees(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees that :func:`flatten_trees` can read, and the others with why not; ``trees (repo, json)`` in the order of their texts' hashes."""
    reason = json_reason(F.col("json"), {"relative_path": "string"})
    return sort_out(trees.select("repo", "json"), reason, F.col("json"), F.col("repo"), F.xxhash64("json"))


def flatten_trees(trees: DataFrame) -> DataFrame:
    """Node rows of nested trees ``(repo, json)``, one level per round; for texts that are no trees see :func:`sorted_trees`.

    Each child becomes its own row, so later rounds spread a large tree over
    the cluster.
    """
    spark = trees.sparkSession
    level = trees.select("repo", F.try_parse_json("json").alias("v")).where("v is not null")
    out: DataFrame | None = None
    while True:
        level = cut(level)
        if out is not None and level.isEmpty():
            return out
        texts = [F.variant_get("v", f"$.{f}", "string").alias(f) for f in _FIELDS]
        rows = level.select(
            "repo", *texts, F.variant_get("v", "$.depth", "int").alias("depth"),
            F.coalesce(F.variant_get("v", "$.has_api", "boolean"), F.lit(False)).alias("has_api"),
        ).withColumn("parent_path", P.parent_of("relative_path"))
        out = rows if out is None else out.unionByName(rows)
        level = spark.sql(
            "SELECT f.repo, c.value AS v FROM {f} f, LATERAL variant_explode(variant_get(f.v, '$.children', 'variant')) c", f=level
        )
