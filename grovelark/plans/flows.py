"""The runs a user starts: scan, dependencies, analysis with resume, re-run after changes.

Each returns named DataFrames; nothing is collected here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import pystr as S
from ..operators import diff as X
from ..operators import documents as D
from ..operators import endpoints as E
from ..operators import graph as R
from ..operators import hierarchy as H
from ..operators import imports as I
from ..operators import predicates as B
from ..operators import reconcile as C
from ..operators import reports as A
from ..operators import state as Z
from ..sources.durable import cut
from ..sources.lister import list_corpus, with_contents
from . import fold


@dataclass(frozen=True)
class Options:
    """What a run may be told; the defaults are those of a plain scan."""

    patterns: tuple[str, ...] = V.IGNORE_PATTERNS
    extensions: tuple[str, ...] = V.INCLUDE_EXTENSIONS
    max_file_size: int | None = None
    docs_root: str = "docs"
    max_cycle: int = 3
    top_imports: int = 10
    partitions: int | None = None


def corpus(roots: DataFrame, options: Options = Options()) -> DataFrame:
    """Files with text, straight from source trees ``roots(repo, root)``."""
    found = list_corpus(roots, options.patterns, options.extensions, options.max_file_size, options.partitions)
    read = with_contents(found.where("node_type = 'file'"), options.partitions)
    return B.with_path_columns(read).withColumns({"raw": F.col("content"), "content": S.text_of("content")})


def scan(files: DataFrame, options: Options = Options()) -> dict[str, DataFrame]:
    kept = B.keep_files(files, options.patterns, options.extensions, options.max_file_size)
    nodes = cut(H.build_nodes(kept))
    return {
        "nodes": nodes,
        "totals": H.tree_totals(nodes),
        "types": A.extension_histogram(B.of_type(nodes, "file")),
        "listing": H.tree_listing(nodes),
    }


def dependencies(files: DataFrame, options: Options = Options(), by_syntax: bool = False) -> dict[str, DataFrame]:
    """Edges and what follows from them; ``by_syntax`` reads Python files by their syntax tree instead of by line patterns."""
    edges = I.parse_edges_by_syntax(files) if by_syntax else I.parse_edges(files)
    edges = cut(I.resolve_targets(edges, files))
    inside = edges.where("resolved is not null").select("repo", "source", F.col("resolved").alias("target"))
    nodes = R.numbered_nodes(edges)
    members = cut(R.cyclic_components(inside))
    return {
        "edges": edges,
        "totals": R.graph_totals(edges),
        "top_imports": R.top_imports(edges, options.top_imports),
        "cyclic_components": members,
        "component_cycles": R.cycle_nodes(inside, members),
        "cycles": R.cycles(inside, options.max_cycle),
        "graph_nodes": nodes,
        "graph_edges": R.numbered_edges(edges, nodes),
        "json": R.edge_json(edges),
        "json_nodes": R.node_json(edges),
    }


def analyse(
    files: DataFrame,
    log: DataFrame,
    docs: DataFrame,
    generated_at: Column,
    seq: int,
    options: Options = Options(),
    file_fn: fold.FileFunction = fold.standin_files,
    dir_fn: fold.DirFunction | None = None,
) -> dict[str, DataFrame]:
    """Documents for everything that has none yet, and the log rows of this run."""
    results = documents(files, log, docs, generated_at, options, file_fn, dir_fn)
    return {"documents": results, **run_log(results, log, seq), "levels": A.level_summary(results)}


def documents(
    files: DataFrame,
    log: DataFrame,
    docs: DataFrame,
    generated_at: Column,
    options: Options = Options(),
    file_fn: fold.FileFunction = fold.standin_files,
    dir_fn: fold.DirFunction | None = None,
) -> DataFrame:
    """The folded nodes of a run, with the documents they already have."""
    kept = B.keep_files(files, options.patterns, options.extensions, options.max_file_size)
    nodes = cut(H.build_nodes(kept).withColumn("doc_path", B.doc_path("relative_path", "node_type", options.docs_root)))
    newest = F.max_by("content", "seq") if "seq" in docs.columns else F.max("content")
    present = docs.groupBy("repo", "doc_path").agg(newest.alias("content"))  # a document may be there twice
    finished = Z.completed_nodes(nodes, log, present.select("repo", "doc_path"))
    existing = finished.join(present, ["repo", "doc_path"]).select("repo", "relative_path", "node_type", "content")
    more = {} if dir_fn is None else {"dir_fn": dir_fn}
    return fold.fold_levels(
        nodes, kept.select("repo", "relative_path", "content"), generated_at, file_fn, docs_root=options.docs_root,
        existing=existing, **more,
    )


def run_log(results: DataFrame, log: DataFrame, seq: int) -> dict[str, DataFrame]:
    """The log rows of folded nodes, with their endpoint notes, errors (cleared once a node is completed) and stale flags."""
    at = F.lit(seq).cast("long")
    with_api = E.with_api_info(results.where("node_type = 'file' and content is not null"))
    states = results.select(
        "repo", F.col("node_type").alias("kind"), F.col("relative_path").alias("key"),
        F.when(F.col("status") == "failed", "failed").otherwise("completed").alias("value"), at.alias("seq"),
    )
    infos = with_api.where("has_api").select("repo", F.col("relative_path").alias("key"), F.col("api_info").alias("value"))
    infos = cut(infos)
    old = Z.stored_texts(log, "api_info").select("repo", F.col("key").alias("relative_path"))
    stale = Z.invalidated_repos(infos.select("repo", F.col("key").alias("relative_path")), old)
    rows = (
        states.unionByName(Z.save_texts(infos.withColumn("seq", at), "api_info"))
        .unionByName(Z.invalidation_rows(stale, at))
        .unionByName(Z.error_rows(results, log, at))
    )
    return {"log": rows, "api_info": infos}


def rerun(
    files: DataFrame,
    prints: DataFrame,
    previous: DataFrame,
    generated_at: Column,
    options: Options = Options(),
    file_fn: fold.FileFunction = fold.standin_files,
    dir_fn: fold.DirFunction | None = None,
) -> dict[str, DataFrame]:
    """A run after changes: what changed since ``prints``, and the documents, made again only where what they are made from changed.

    ``previous`` are the ``documents`` of the last such run (``Z.none_yet`` gives empty tables for the first). Affected are all
    directories above a change; made again are those of them whose children's documents came out differently.
    """
    kept = B.keep_files(files, options.patterns, options.extensions, options.max_file_size)
    changes = cut(X.detect_changes(X.fingerprints(kept), prints))
    nodes = cut(H.build_nodes(kept).withColumn("doc_path", B.doc_path("relative_path", "node_type", options.docs_root)))
    affected = X.affected_nodes(changes)
    more = {} if dir_fn is None else {"dir_fn": dir_fn}
    documents = fold.fold_levels(
        nodes, kept.select("repo", "relative_path", "content"), generated_at, file_fn, docs_root=options.docs_root,
        previous=previous.where("content is not null"), **more,
    )
    return {
        "changes": changes,
        "affected": affected,
        "marked": X.mark_for_reanalysis(nodes, affected),
        "documents": documents,
        "removed": previous.join(nodes.select("repo", "relative_path", "node_type"), ["repo", "relative_path", "node_type"], "left_anti"),
        "fingerprints": X.upsert_fingerprints(prints, changes, F.current_timestamp()),
    }


def api_overview(info: DataFrame) -> dict[str, DataFrame]:
    """Overview table of all endpoints; ``info(repo, source_file, info_text)``."""
    apis = E.endpoints(info)
    return {"rows": D.overview_rows(apis), "frame": D.overview_frame(info.select("repo").distinct(), apis)}


def verify(overview_docs: DataFrame, usage_docs: DataFrame) -> dict[str, DataFrame]:
    """Do the two project documents name the same endpoints equally often?"""
    a, b = cut(E.overview_endpoints(overview_docs)), cut(E.usage_endpoints(usage_docs))
    return {
        "summary": C.consistency(a, b, ["repo"]),
        "report": C.report_lines(C.multiset_difference(a, b, ["repo"])),
    }
