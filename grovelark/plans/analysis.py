"""The whole run: documents bottom-up, then each repo's project documents, their gates, flags and verification.

Every step is a stage kept by the digest of what it was made from (:mod:`.stages`), so a run that broke off calls no function
again for what it had finished. All repos go through a stage together; what a repo lacks shows in ``gates``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import documents as D
from ..operators import endpoints as E
from ..operators import enrichment as G
from ..operators import reconcile as C
from ..operators import state as Z
from ..operators.ranking import parts_of
from . import api_documents as A
from . import flows
from . import fold
from .stages import Stages, content_digest

KINDS = ("readme", "reading_guide", "api_doc", "api_usage_doc")
DETAILS = {"api_doc": "api_details", "api_usage_doc": "api_usage_details"}
_PART = ["repo", "kind", "doc_path", "block", "part", "text"]


def standin_readme(inputs: DataFrame) -> DataFrame:
    return inputs.select("repo").distinct().select("repo", G.standin_project("repo", "repo").alias("summary"))


def standin_guide(inputs: DataFrame) -> DataFrame:
    """Counts the lines of the tree that it is given."""
    lines = F.sum(F.when(F.col("kind") == "structure", F.size(F.split("text", "\n"))))
    return inputs.groupBy("repo").agg(F.format_string("[模拟指南] 结构行数: %d", lines).alias("summary"))


def standin_modules(details: DataFrame) -> DataFrame:
    """Counts the files whose details it is given."""
    return details.groupBy("repo").agg(F.format_string("## 二、按模块分类\n\n[模拟汇总] 文件数: %d", F.sum("n_rows")).alias("summary"))


def standin_details(batch) -> list[str]:
    return [f"[模拟详情] 文件: {p}" for p in batch["source_file"]]


@dataclass(frozen=True)
class Functions:
    """What is called for texts; ``version`` names them, so that results of other functions are not used again.

    ``readme`` and ``guide`` take the parts of a repo's inputs ``(repo, kind, part, text)``, ``modules`` the parts of all its
    details ``(repo, part, text, n_rows)``; all return ``(repo, summary)``. ``details`` and ``usage`` are batch functions over
    ``(repo, source_file, api_info)``.
    """

    file: fold.FileFunction = fold.standin_files
    dir: fold.DirFunction = field(default=G.standin_directories)
    readme: Callable[[DataFrame], DataFrame] = standin_readme
    guide: Callable[[DataFrame], DataFrame] = standin_guide
    modules: Callable[[DataFrame], DataFrame] = standin_modules
    details: G.BatchFunction = standin_details
    usage: G.BatchFunction = standin_details
    version: str = "1"


def _rows(rows: DataFrame, kind: str, block: str, text: Column | str, part: Column | None = None, docs_root: str = "docs") -> DataFrame:
    path = f"{docs_root}/{V.FINAL_DOC_NAMES[kind]}"
    number = F.lit(0).cast("bigint") if part is None else part
    own = F.col(text) if isinstance(text, str) else text
    return rows.select("repo", F.lit(kind).alias("kind"), F.lit(path).alias("doc_path"), F.lit(block).alias("block"), number.alias("part"), own.alias("text"))


def _header_footer(kind: str, generator: str, generated_at: Column) -> tuple[Column, Column]:
    """What stands before and after the content of a project document."""
    mark = "\x00"
    whole = D.project_document(F.lit(kind), "repo", F.lit(mark), generator, generated_at)
    return F.substring_index(whole, mark, 1), F.substring_index(whole, mark, -1)


def overview_document(infos: DataFrame, modules: DataFrame, generator: str, generated_at: Column, rows_per_part: int = 256, docs_root: str = "docs") -> DataFrame:
    """The endpoint list of every repo of ``infos (repo, source_file, info_text)`` in ordered parts.

    Blocks: 0 title and table head, 1 table rows, 2 total and what ``modules (repo, summary)`` says by module.
    """
    head, foot = _header_footer("api_doc", generator, generated_at)
    apis = E.endpoints(infos)
    frame = D.overview_frame(infos.select("repo").distinct(), apis)
    title = F.concat(head, F.lit("# "), "repo", F.lit(" API接口文档\n\n"))
    opening = _rows(frame, "api_doc", "0", F.concat(title, F.col("head"), F.when(F.col("total") > 0, F.lit("\n")).otherwise(F.lit(""))), docs_root=docs_root)
    lines = parts_of(D.overview_rows(apis), ["repo"], "line", "\n", rows_per_part)
    table = _rows(lines, "api_doc", "1", F.concat("text", F.lit("\n")), F.col("part"), docs_root)
    own = D.module_section("summary")
    said = F.when(own.isNotNull(), F.concat(F.lit("\n"), own)).otherwise(F.concat(F.lit("\n\n"), F.col("summary")))
    total = F.coalesce(F.concat(F.lit("\n"), F.col("foot"), F.lit("\n")), F.lit(""))
    closing = _rows(frame.join(modules, "repo"), "api_doc", "2", F.concat(total, said, foot), docs_root=docs_root)
    return reduce(DataFrame.unionByName, [opening, table, closing])


def usage_document(repos: DataFrame, details: DataFrame, generator: str, generated_at: Column, rows_per_part: int = 256, docs_root: str = "docs") -> DataFrame:
    """The usage document of every repo in ordered parts, from its files' usage details ``(repo, source_file, details)``."""
    _, foot = _header_footer("api_usage_doc", generator, generated_at)
    parts = A.usage_document_parts(repos, details, rows_per_part)
    text = F.when(F.col("block") == "2", F.concat("text", foot)).otherwise(F.col("text"))
    path = f"{docs_root}/{V.FINAL_DOC_NAMES['api_usage_doc']}"
    return parts.select("repo", F.lit("api_usage_doc").alias("kind"), F.lit(path).alias("doc_path"), "block", "part", text.alias("text"))


def verification(parts: DataFrame) -> DataFrame:
    """Do the endpoint list and the usage document of a repo name the same endpoints: one row per repo with both."""
    listed = parts.where("kind = 'api_doc' AND block = '1'").select("repo", F.col("repo").alias("doc"), F.col("text").alias("content"))
    used = parts.where("kind = 'api_usage_doc' AND startswith(block, '1')").select("repo", F.col("repo").alias("doc"), F.col("text").alias("content"))
    both = parts.groupBy("repo").agg(F.count_distinct("kind").alias("_n")).where("_n = 2").select("repo")
    own = C.consistency(E.overview_endpoints(listed), E.usage_endpoints(used), ["repo"])
    zero = ["n_overview", "n_usage", "missing", "extra"]
    return both.join(own, "repo", "left").fillna(0, zero).withColumn("consistent", F.coalesce("consistent", F.lit(True)))


def analyse_all(
    files: DataFrame,
    log: DataFrame,
    docs: DataFrame,
    generated_at: Column,
    seq: int,
    base: str,
    options: flows.Options = flows.Options(),
    functions: Functions = Functions(),
    generator: str = "grovelark",
    rows_per_part: int = 256,
) -> dict[str, DataFrame]:
    """Everything a run leaves: ``documents``, ``project_documents`` (ordered parts), ``gates``, ``verification``, ``log``, ``failures``.

    ``log`` and ``docs (repo, doc_path, content)`` are what earlier runs left. ``base`` is the folder of the run's stages: the
    same call with the same ``base`` goes on with what is there. A repo with a failed node gets no project documents.
    """
    stages = Stages(files.sparkSession, base)
    given = [content_digest(files), content_digest(log), content_digest(docs), repr(options), functions.version, str(seq), generator, str(rows_per_part)]
    documents = stages.run("documents", given, lambda: flows.documents(files, log, docs, generated_at, options, functions.file, functions.dir))
    log_a = stages.run("log-nodes", [documents, *given], lambda: flows.run_log(documents.rows, log, seq)["log"])
    so_far = log.unionByName(log_a.rows)
    repos = documents.rows.select("repo").distinct()
    alive = repos.join(documents.rows.where("status = 'failed'").select("repo").distinct(), "repo", "left_anti")
    usable = Z.final_document_flags(so_far, docs).where("usable").select("repo", F.col("key").alias("kind"))

    def open_repos(kind: str) -> DataFrame:
        return alive.join(usable.where(F.col("kind") == kind), "repo", "left_anti")

    nodes = documents.rows.select("repo", "relative_path", "parent_path", "name", "node_type", "depth")
    texts = documents.rows.where("content IS NOT NULL").select("repo", "relative_path", "content")
    inputs = stages.run("inputs", [documents], lambda: A.project_inputs(nodes, texts, rows_per_part))
    told = inputs.rows.join(inputs.rows.where("kind = 'children'").select("repo").distinct(), "repo")

    def project(kind: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
        made = fn(told.join(open_repos(kind), "repo")).where("summary IS NOT NULL AND trim(summary) <> ''")
        return _rows(made, kind, "0", D.project_document(F.lit(kind), "repo", "summary", generator, generated_at), docs_root=options.docs_root)

    readme = stages.run("readme", [inputs, log_a, *given], lambda: project("readme", functions.readme))
    guide = stages.run("guide", [inputs, log_a, *given], lambda: project("reading_guide", functions.guide))

    api = Z.stored_texts(so_far, "api_info").select("repo", F.col("key").alias("relative_path"), F.col("value").alias("info_text")).join(alive, "repo")
    file_docs = documents.rows.where("node_type = 'file' AND content IS NOT NULL").join(alive, "repo")

    def details(kind: str, fn: G.BatchFunction) -> DataFrame:
        found, lost = A.extract_details(file_docs, so_far, fn, DETAILS[kind], seq)
        errors = lost.select("repo", F.lit(f"error:{DETAILS[kind]}").alias("kind"), F.col("source_file").alias("key"), F.col("error").alias("value"), F.lit(seq).cast("bigint").alias("seq"))
        return found.unionByName(errors)

    told_api = stages.run("api-details", [documents, log_a, *given], lambda: details("api_doc", functions.details))
    told_use = stages.run("usage-details", [documents, log_a, *given], lambda: details("api_usage_doc", functions.usage))
    so_far = so_far.unionByName(told_api.rows).unionByName(told_use.rows)

    def lacking(kind: str) -> DataFrame:
        return Z.missing_details(api, so_far, DETAILS[kind]).groupBy("repo").agg(F.count(F.lit(1)).alias("n_missing"))

    def complete(kind: str) -> DataFrame:
        done = Z.document_gate(alive, api, so_far, docs, kind, DETAILS[kind]).where("completed")
        return api.select("repo").distinct().join(done, "repo", "left_anti").join(lacking(kind), "repo", "left_anti")

    def known(kind: str) -> DataFrame:
        own = Z.stored_texts(so_far, DETAILS[kind]).select("repo", F.col("key").alias("source_file"), F.col("value").alias("details"))
        files_of = api.select("repo", F.col("relative_path").alias("source_file"))
        return own.join(files_of, ["repo", "source_file"], "left_semi").join(complete(kind), "repo", "left_semi")

    infos = api.withColumnRenamed("relative_path", "source_file").join(complete("api_doc"), "repo", "left_semi")
    modules = stages.run("modules", [told_api, *given], lambda: functions.modules(D.combined_details(known("api_doc"), rows_per_part)).where("summary IS NOT NULL AND trim(summary) <> ''"))
    api_doc = stages.run("api-doc", [modules, log_a, *given], lambda: overview_document(infos.join(modules.rows.select("repo"), "repo", "left_semi"), modules.rows, generator, generated_at, rows_per_part, options.docs_root))
    usage_doc = stages.run("usage-doc", [told_use, log_a, *given], lambda: usage_document(complete("api_usage_doc"), known("api_usage_doc"), generator, generated_at, rows_per_part, options.docs_root))

    parts = reduce(DataFrame.unionByName, [s.rows.select(*_PART) for s in (readme, guide, api_doc, usage_doc)])
    written = parts.select("repo", "kind").distinct()
    checked = stages.run("verification", [api_doc, usage_doc], lambda: verification(api_doc.rows.unionByName(usage_doc.rows.select(*api_doc.rows.columns))))
    flags = written.select("repo", F.lit("flag").alias("kind"), F.col("kind").alias("key"), F.lit("true").alias("value"), F.lit(seq + 1).cast("bigint").alias("seq"))

    every = repos.select("repo", F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"))
    has = lambda rows, name: rows.select("repo", F.lit(True).alias(name)).distinct()
    lack = reduce(DataFrame.unionByName, [lacking(k).withColumn("kind", F.lit(k)) for k in DETAILS])
    gates = (
        every.join(has(alive, "_alive"), "repo", "left").join(has(told, "_told"), "repo", "left").join(has(api, "_api"), "repo", "left")
        .join(usable.withColumn("_kept", F.lit(True)), ["repo", "kind"], "left").join(written.withColumn("_new", F.lit(True)), ["repo", "kind"], "left")
        .join(lack, ["repo", "kind"], "left")
    )
    is_api = F.col("kind").isin(*DETAILS)
    state = (
        F.when(F.col("_alive").isNull(), "stopped").when(F.col("_new"), "written").when(is_api & F.col("_api").isNull(), "no endpoints")
        .when(F.col("n_missing") > 0, "details missing").when(F.col("_kept"), "kept").when(~is_api & F.col("_told").isNull(), "no documents").otherwise("failed")
    )
    gates = gates.select("repo", "kind", state.alias("state"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"))
    new_log = reduce(DataFrame.unionByName, [log_a.rows, told_api.rows, told_use.rows, flags])
    return {
        "documents": documents.rows, "project_documents": parts, "gates": gates, "verification": checked.rows, "log": new_log,
        "failures": Z.failed_with_error(log.unionByName(new_log)),
    }
