"""Project documents built from per-file texts: extract per file, then assemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import documents as D
from ..operators import endpoints as E
from ..operators import enrichment as G
from ..operators import hierarchy as H
from ..operators import state as Z
from ..operators.ranking import parts_of


def extraction_work(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Documents with endpoints whose details are not extracted yet."""
    todo = E.with_api_info(docs).where("has_api").select("repo", F.col("relative_path").alias("source_file"), "api_info")
    return todo.join(done.select("repo", "source_file"), ["repo", "source_file"], "left_anti")


def extract_details(
    docs: DataFrame, log: DataFrame, fn: G.BatchFunction, kind: str, seq: int
) -> tuple[DataFrame, DataFrame]:
    """Phase one: run ``fn`` on the open files; new log rows, and the failures."""
    have = Z.stored_texts(log, kind).select("repo", F.col("key").alias("source_file"))
    work = extraction_work(docs, have)
    out = G.run_with_retries(work, fn, ["repo", "source_file"])
    ok, bad = G.split_outcomes(out)
    rows = ok.select("repo", F.col("source_file").alias("key"), F.col("summary").alias("value"), F.lit(seq).cast("long").alias("seq"))
    return Z.save_texts(rows, kind), bad


def summarise_details(details: DataFrame, fn: G.BatchFunction, max_concurrent: int = 8) -> DataFrame:
    """Phase two: one text per repo from all its details; large repos in stages."""
    parts = D.combined_details(details).withColumns({"relative_path": F.lit(""), "name": F.col("repo")})
    return G.staged(fn)(parts).select("repo", "summary")


def usage_document_parts(repos: DataFrame, details: DataFrame, rows_per_part: int = 256, common: DataFrame | None = None) -> DataFrame:
    """The usage document of each repo as rows in order ``(repo, block, part, text)``.

    ``common(repo, content)`` gives the opening and closing sections; without it
    the fixed defaults are used. Blocks: 0 title and opening, then one block per
    group of files, last the closing sections.
    """
    base = repos if common is None else repos.join(common, "repo", "left")
    text = F.coalesce(F.col("content"), F.lit("")) if common is not None else F.lit("")
    opening = base.select(
        "repo", F.lit("").alias("block"), F.lit(0).cast("long").alias("part"),
        F.concat(F.lit("# "), "repo", F.lit(" API使用文档\n\n"), D.quick_start(text), F.lit("\n" + V.DETAILS_HEAD)).alias("text"),
    )
    groups = D.grouped_details(details, rows_per_part).select(
        "repo", F.concat(F.lit("1"), "group").alias("block"), "part",
        F.when(F.col("part") == 0, F.concat("heading", F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"),
    )
    closing = base.select(
        "repo", F.lit("2").alias("block"), F.lit(0).cast("long").alias("part"), D.errors_and_examples(text).alias("text")
    )
    return opening.unionByName(groups).unionByName(closing)


def project_inputs(nodes: DataFrame, docs: DataFrame, rows_per_part: int = 256) -> DataFrame:
    """Inputs of a project document: the root's child documents and the tree text, in parts."""
    rooted = nodes.where(F.col("parent_path") == "")
    children = H.child_documents(rooted, docs, rows_per_part).select("repo", F.lit("children").alias("kind"), "part", "text")
    lines = H.tree_listing(nodes)
    tree = parts_of(lines, ["repo"], "line", "\n", rows_per_part, "line_no")
    return children.unionByName(tree.select("repo", F.lit("structure").alias("kind"), "part", "text"))
