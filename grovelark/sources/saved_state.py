"""Saved state: older JSON files read in, tables written out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import paths as P

_FINGERPRINTS = (
    "source_root string, last_scan_time string, version string, "
    "fingerprints map<string, struct<path:string,size:bigint,mtime:double,content_hash:string,last_analyzed:string>>"
)
_CHECKPOINT = (
    "source_root string, docs_root string, completed_files array<string>, completed_dirs array<string>, "
    "failed_files array<string>, readme_completed boolean, reading_guide_completed boolean, api_doc_completed boolean, "
    "api_usage_doc_completed boolean, api_files array<string>, api_info_map map<string,string>, "
    "api_details_map map<string,string>, api_usage_details_map map<string,string>, version string"
)


def load_fingerprints(spark: SparkSession, path: str, repo: str, source_root: str) -> DataFrame:
    """Fingerprint rows of a JSON state file; none when it belongs to another root."""
    state = spark.read.schema(_FINGERPRINTS).json(path, multiLine=True).where(F.col("source_root") == source_root)
    rows = state.select(F.explode("fingerprints").alias("key", "f"))
    return rows.select(
        F.lit(repo).alias("repo"),
        P.normalise("key").alias("path"),
        "f.size",
        F.timestamp_seconds("f.mtime").alias("mtime"),
        F.coalesce("f.content_hash", F.lit("")).alias("content_hash"),
        F.to_timestamp("f.last_analyzed").alias("last_analyzed"),
    )


def save_fingerprints(prints: DataFrame, base: str, version: int) -> str:
    """Write one snapshot version; returns its folder."""
    folder = f"{base}/version={version}"
    prints.withColumn("scanned_at", F.current_timestamp()).write.mode("overwrite").parquet(folder)
    return folder


def load_checkpoint(spark: SparkSession, path: str, repo: str, source_root: str, seq: int = 0) -> DataFrame:
    """State-log rows of a JSON checkpoint; missing fields count as empty."""
    state = spark.read.schema(_CHECKPOINT).json(path, multiLine=True).where(F.col("source_root") == source_root)

    def items(kind: str, column: str, value: str) -> DataFrame:
        return state.select(F.lit(kind).alias("kind"), F.explode(column).alias("key"), F.lit(value).alias("value"))

    def texts(kind: str, column: str) -> DataFrame:
        return state.select(F.lit(kind).alias("kind"), F.explode(column).alias("key", "value"))

    flags = F.array(*[
        F.struct(F.lit(k).alias("key"), F.coalesce(F.col(f"{k}_completed"), F.lit(False)).cast("string").alias("value"))
        for k in V.FINAL_DOC_NAMES
    ])
    rows = (
        items("file", "failed_files", "failed")
        .unionByName(items("file", "completed_files", "completed"))
        .unionByName(items("directory", "completed_dirs", "completed"))
        .unionByName(texts("api_info", "api_info_map"))
        .unionByName(texts("api_details", "api_details_map"))
        .unionByName(texts("api_usage_details", "api_usage_details_map"))
        .withColumn("key", P.normalise("key"))
        .unionByName(state.select(F.lit("flag").alias("kind"), F.inline(flags)))
    )
    order = F.when(F.col("value") == "failed", 1).otherwise(0)
    return rows.select(F.lit(repo).alias("repo"), "kind", "key", "value", (F.lit(seq) + order).cast("long").alias("seq"))


def append_state(rows: DataFrame, path: str) -> None:
    rows.select("repo", "kind", "key", "value", "seq").write.mode("append").parquet(path)

