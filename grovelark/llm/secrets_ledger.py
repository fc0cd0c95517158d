"""Secret scans over every historical version of every path, with a ledger of what has been scanned.

A text is a *blob*, named by the SHA-256 of its bytes. The ledger is a table of ``(blob_id, rule_version, findings)``. A
scan takes versions ``(path, text)``, keeps one version of each blob that the ledger lacks under the present rule version,
scans those alone, adds them to the ledger and joins the findings back to every path. Copies are scanned once; a new rule
version scans all blobs again; a run that broke off leaves whole ledger files only, and the next one goes on from them.

Results for odd input: a null text is an empty one; a null path is kept as such; repeated rows get a row each; an empty
table gives none; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_dir, pick, table, text_or_empty
from .identifiers import count_of, spans_text

#: Base kinds first, then those of the method.
KINDS = ("assign", "access", "hex", "private_key", "jwt", "host_token", "chat_token", "api_key")
N_BASE = 3
RULE_VERSION = 1

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_MORE = (
    (3, "PRIVATE KEY-----", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")),
    (4, "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    (5, "gh", re.compile(r"\bgh[opsur]_[A-Za-z0-9]{36,}")),
    (6, "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    (7, "AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}")),
)
SPANS = "array<struct<s:bigint,k:int,e:bigint>>"
LEDGER = f"blob_id string, rule_version int, findings {SPANS}"


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; offsets are code points."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for k, sign, rule in _MORE:
        if sign in text:
            out += [(m.start(), k, m.end()) for m in rule.finditer(text)]
    return sorted(out)


def open_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger at ``folder``; an empty one where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def scan_blobs(blobs: DataFrame, rule_version: int) -> DataFrame:
    """Ledger rows of ``(blob_id, text)``."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[{"s": s, "k": k, "e": e} for s, k, e in secret_spans(t)] for t in b["text"]]
            yield pd.DataFrame({"blob_id": b["blob_id"], "rule_version": rule_version, "findings": found})

    return blobs.select("blob_id", "text").mapInPandas(scan, LEDGER)


def scan_versions(versions: DataFrame, ledger: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """``(path, blob_id, findings)`` for every row of ``versions (path, text)``; the ledger at ``ledger`` grows by what is new.

    Which row stands for a blob is decided on keys alone; texts move once, to the rows chosen.
    """
    spark = versions.sparkSession
    texts = versions.select("path", text_or_empty().alias("text")).withColumn("blob_id", F.sha2(F.col("text").cast("binary"), 256))
    keys = cut(texts.select("path", "blob_id"))
    done = open_ledger(spark, ledger).where(F.col("rule_version") == rule_version).select("blob_id")
    unseen = keys.groupBy("blob_id").agg(F.min("path").alias("path")).join(done, "blob_id", "left_anti")
    marked = unseen.select(F.col("blob_id").alias("b"), F.col("path").alias("p"))
    chosen = texts.join(marked, texts["path"].eqNullSafe(marked["p"]) & (texts["blob_id"] == marked["b"]), "left_semi")
    scan_blobs(chosen, rule_version).write.mode("append").parquet(ledger)
    # rows that share path and text are scanned once each: one of them counts
    findings = cut(open_ledger(spark, ledger).where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).groupBy("blob_id").agg(F.first("findings").alias("findings")))
    return keys.join(findings, "blob_id", "left").select("path", "blob_id", F.coalesce("findings", F.array().cast(SPANS)).alias("findings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a version of the path that is its ``doc_id``; the ledger starts empty."""
    versions = pick(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "path")
    found = scan_versions(versions, fresh_dir(spark, "ledger"))
    base = F.filter("findings", lambda x: x["k"] < N_BASE)
    counts = [count_of("findings", k).alias(f"n_{KINDS[k]}") for k in range(N_BASE)]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(spans_text(base, KINDS).cast("binary"), 256).alias("base_sha256"), spans_text("findings", KINDS).alias("spans"))
