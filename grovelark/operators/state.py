"""Resume state as an append-only log ``(repo, kind, key, value, seq)``.

``kind`` is ``file`` or ``directory`` (value = status), ``flag`` (key = final
document, value = ``true``/``false``), or a stored text kind such as
``api_info``, ``api_details``, ``api_usage_details`` and ``error`` (null value = cleared).
Nothing is rewritten in place: the newest ``seq`` of a key is its state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import paths as P
from . import endpoints as E
from .ranking import ordinal

_KEY = ["repo", "kind", "key"]
NODE_KINDS = ("file", "directory")


def current_state(log: DataFrame) -> DataFrame:
    """Newest value per key; a plain aggregate, so hot keys combine map-side."""
    return log.groupBy(*_KEY).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def stored_texts(log: DataFrame, kind: str) -> DataFrame:
    """Live texts of one kind: ``(repo, key, value)``; cleared keys are absent."""
    newest = log.where(F.col("kind") == kind).groupBy("repo", "key").agg(F.max_by(F.struct("value"), "seq").alias("s"))
    return newest.select("repo", "key", F.col("s.value").alias("value")).where("value is not null")


def save_texts(rows: DataFrame, kind: str) -> DataFrame:
    """Log rows that store texts; input ``(repo, key, value, seq)``."""
    return rows.select("repo", F.lit(kind).alias("kind"), "key", "value", "seq")


def clear_texts(keys: DataFrame, kind: str) -> DataFrame:
    """Log rows that clear texts; input ``(repo, key, seq)``."""
    return keys.select("repo", F.lit(kind).alias("kind"), "key", F.lit(None).cast("string").alias("value"), "seq")


def node_records(log: DataFrame) -> DataFrame:
    """Per node: ever completed, and failed since the last completion."""
    done, bad = F.col("value") == "completed", F.col("value") == "failed"
    last_done = F.max(F.when(done, F.col("seq")))
    last_bad = F.max(F.when(bad, F.col("seq")))
    return (
        log.where(F.col("kind").isin(*NODE_KINDS))
        .groupBy("repo", F.col("kind").alias("node_type"), F.col("key").alias("relative_path"))
        .agg(
            F.coalesce(F.bool_or(done), F.lit(False)).alias("completed"),
            (last_bad.isNotNull() & (last_bad > F.coalesce(last_done, F.lit(-1)))).alias("failed"),
            F.max_by("value", "seq").alias("status"),
        )
    )


def error_rows(results: DataFrame, log: DataFrame, seq: Column) -> DataFrame:
    """Log rows of kind ``error``: the text for each failed node, and a clearing row for each that has one and is completed now.

    ``results (repo, relative_path, status, error)``.
    """
    failed = results.where("status = 'failed'").select("repo", F.col("relative_path").alias("key"), F.col("error").alias("value"), seq.alias("seq"))
    known = stored_texts(log, "error").select("repo", "key")
    mended = results.where("status <> 'failed'").select("repo", F.col("relative_path").alias("key"), seq.alias("seq")).join(known, ["repo", "key"], "left_semi")
    return save_texts(failed, "error").unionByName(clear_texts(mended, "error"))


def failed_with_error(log: DataFrame) -> DataFrame:
    """Failed nodes with the text of their last failure: ``(repo, relative_path, node_type, error)``."""
    errors = stored_texts(log, "error").select("repo", F.col("key").alias("relative_path"), F.col("value").alias("error"))
    return node_records(log).where("failed").select("repo", "relative_path", "node_type").join(errors, ["repo", "relative_path"], "left")


def none_yet(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """No fingerprints and no documents: what a first run compares with."""
    prints = spark.createDataFrame([], "repo string, path string, size bigint, mtime bigint, content_hash string, last_analyzed timestamp")
    documents = spark.createDataFrame([], "repo string, relative_path string, node_type string, digest string, content string")
    return prints, documents


def missing_nodes(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Nodes whose document does not exist; ``docs(repo, doc_path)``."""
    return nodes.join(docs.select("repo", "doc_path"), ["repo", "doc_path"], "left_anti")


def completed_nodes(nodes: DataFrame, log: DataFrame, docs: DataFrame | None) -> DataFrame:
    """Nodes recorded as completed and, when ``docs`` is given, with their document present."""
    records = node_records(log).where("completed")
    hit = nodes.join(records, ["repo", "node_type", "relative_path"], "left_semi")
    return hit if docs is None else hit.join(docs, ["repo", "doc_path"], "left_semi")


def restore_status(nodes: DataFrame, log: DataFrame, docs: DataFrame) -> DataFrame:
    """Status from state: completed (with document), else failed, else as it was."""
    records = node_records(log).select("repo", "node_type", "relative_path", "completed", "failed")
    present = docs.select("repo", "doc_path").distinct().withColumn("_doc", F.lit(True))
    info = stored_texts(log, "api_info").select("repo", F.col("key").alias("relative_path"), F.col("value").alias("_info"))
    done = F.coalesce(F.col("completed") & F.col("_doc"), F.lit(False))
    return (
        nodes.join(records, ["repo", "node_type", "relative_path"], "left")
        .join(present, ["repo", "doc_path"], "left")
        .join(info, ["repo", "relative_path"], "left")
        .select(
            *[c for c in nodes.columns if c not in ("status", "doc_path", "has_api", "api_info")],
            F.when(done, "completed").when(F.col("failed"), "failed").otherwise(F.col("status")).alias("status"),
            F.when(done, F.col("doc_path")).alias("doc_path"),
            (done & F.col("_info").isNotNull()).alias("has_api"),
            F.when(done, F.col("_info")).alias("api_info"),
        )
    )


def restored_count(restored: DataFrame) -> DataFrame:
    return restored.groupBy("repo").agg(F.count_if(F.col("status") == "completed").alias("restored"))


def invalidated_repos(new_api: DataFrame, old_api: DataFrame) -> DataFrame:
    """Repos where some file newly has APIs: their API documents are stale."""
    fresh = new_api.select("repo", "relative_path").join(old_api, ["repo", "relative_path"], "left_anti")
    return fresh.groupBy("repo").agg(F.count(F.lit(1)).alias("new_api_files"))


def invalidation_rows(stale: DataFrame, seq: Column) -> DataFrame:
    """Log rows that reset both API document flags of stale repos."""
    return stale.select(
        "repo", F.lit("flag").alias("kind"), F.explode(F.array(F.lit("api_doc"), F.lit("api_usage_doc"))).alias("key"),
        F.lit("false").alias("value"), seq.alias("seq"),
    )


def missing_details(api: DataFrame, log: DataFrame, kind: str) -> DataFrame:
    """API files without a live text of ``kind``: the work list and the strict gate."""
    have = stored_texts(log, kind).select("repo", F.col("key").alias("relative_path"))
    return api.select("repo", "relative_path").join(have, ["repo", "relative_path"], "left_anti")


def details_progress(api: DataFrame, log: DataFrame, kind: str) -> DataFrame:
    """``done`` of ``total`` API files per repo."""
    have = stored_texts(log, kind).select("repo", F.col("key").alias("relative_path"), F.lit(True).alias("_have"))
    return (
        api.select("repo", "relative_path")
        .join(have, ["repo", "relative_path"], "left")
        .groupBy("repo")
        .agg(F.count_if("_have").alias("done"), F.count(F.lit(1)).alias("total"))
    )


def document_gate(repos: DataFrame, api: DataFrame, log: DataFrame, docs: DataFrame, flag: str, kind: str) -> DataFrame:
    """A project document counts as done when flagged, complete for all API files and present."""
    flags = current_state(log.where((F.col("kind") == "flag") & (F.col("key") == flag)))
    done = flags.where(F.col("value") == "true").select("repo", F.lit(True).alias("_flag"))
    lacking = missing_details(api, log, kind).groupBy("repo").agg(F.count(F.lit(1)).alias("_lack"))
    present = docs.where(F.col("doc_path") == f"docs/{V.FINAL_DOC_NAMES[flag]}").select("repo", F.lit(True).alias("_doc")).distinct()
    return (
        repos.join(done, "repo", "left").join(lacking, "repo", "left").join(present, "repo", "left")
        .select("repo", F.coalesce(F.col("_flag") & F.col("_doc") & F.col("_lack").isNull(), F.lit(False)).alias("completed"))
    )


def split_completed(nodes: DataFrame, log: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files still to do, and completed ones as ready success results."""
    files = nodes.where(F.col("node_type") == "file")
    done = completed_nodes(files, log, docs)
    todo = files.join(done.select("repo", "relative_path"), ["repo", "relative_path"], "left_anti")
    return todo, done.select("repo", "relative_path", F.lit(True).alias("success"), "doc_path")


def final_document_flags(log: DataFrame, docs: DataFrame) -> DataFrame:
    """Per repo and project document: flagged, present, and usable (both)."""
    flags = current_state(log.where(F.col("kind") == "flag")).select(
        "repo", "key", (F.col("value") == "true").alias("flagged"), F.lit(False).alias("present")
    )
    names = F.create_map(*[F.lit(x) for k, n in V.FINAL_DOC_NAMES.items() for x in (f"docs/{n}", k)])
    found = docs.select(
        "repo", F.element_at(names, F.col("doc_path")).alias("key"), F.lit(False).alias("flagged"), F.lit(True).alias("present")
    ).where("key is not null")
    merged = flags.unionByName(found).groupBy("repo", "key").agg(
        F.bool_or("flagged").alias("flagged"), F.bool_or("present").alias("present")
    )
    return merged.withColumn("usable", F.col("flagged") & F.col("present"))


def recovered_flags(docs: DataFrame, seq: Column) -> DataFrame:
    """Flag rows for project documents found on disk, used when no log exists."""
    names = F.create_map(*[F.lit(x) for k, n in V.FINAL_DOC_NAMES.items() for x in (f"docs/{n}", k)])
    return docs.select(
        "repo", F.lit("flag").alias("kind"), F.element_at(names, F.col("doc_path")).alias("key"),
        F.lit("true").alias("value"), seq.alias("seq"),
    ).where("key is not null")


def recover_from_documents(docs: DataFrame, docs_root: str = "docs") -> DataFrame:
    """Node records read back from a document tree.

    ``x/_dir_summary.md`` completes directory ``x``; ``x/a.py.md`` completes
    file ``x/a.py``. The four project documents are not file documents.
    """
    inner = F.substring(P.normalise("doc_path"), len(docs_root) + 2, 1 << 30)
    name = P.name_of(inner)
    is_dir = name == V.DIR_DOC_NAME
    return (
        docs.where(F.endswith("doc_path", F.lit(".md")) & ~inner.isin(*V.FINAL_DOC_NAMES.values()))
        .withColumn("node_type", F.when(is_dir, "directory").otherwise("file"))
        .withColumn("relative_path", F.when(is_dir, P.parent_of(inner)).otherwise(F.left(inner, F.length(inner) - 3)))
    )


def recovered_log(docs: DataFrame, seq: Column, docs_root: str = "docs") -> DataFrame:
    """The whole log read back from a document tree ``docs (repo, doc_path, content)``, where none was kept.

    Nodes with a document are completed, project documents are flagged, and endpoint notes are taken from the documents.
    """
    nodes = recover_from_documents(docs, docs_root)
    states = nodes.select("repo", F.col("node_type").alias("kind"), F.col("relative_path").alias("key"), F.lit("completed").alias("value"), seq.alias("seq"))
    noted = E.with_api_info(nodes.where("node_type = 'file'")).where("has_api AND api_info <> ''")
    infos = save_texts(noted.select("repo", F.col("relative_path").alias("key"), F.col("api_info").alias("value"), seq.alias("seq")), "api_info")
    return states.distinct().unionByName(recovered_flags(docs, seq).distinct()).unionByName(infos)


def status_report(log: DataFrame) -> DataFrame:
    files, dirs = F.col("node_type") == "file", F.col("node_type") == "directory"
    return node_records(log).groupBy("repo").agg(
        F.count_if(files & F.col("completed")).alias("completed_files"),
        F.count_if(dirs & F.col("completed")).alias("completed_dirs"),
        F.count_if("failed").alias("failed"),
    )


def failed_in_order(log: DataFrame) -> DataFrame:
    """Failed nodes of every repo with their ``position`` in path order."""
    return ordinal(node_records(log).where("failed").select("repo", "relative_path", "node_type"), ["repo"], ["relative_path", "node_type"], "position")


