"""Row filters and projections over files, nodes, tasks and edges."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import paths as P
from ..functions.globs import ignore_regex
from .ranking import ordinal


def is_ignored(path: Column | str, is_dir: Column | None = None, patterns: Iterable[str] = V.IGNORE_PATTERNS) -> Column:
    """True for ignored paths and for everything below an ignored directory."""
    p = F.col(path) if isinstance(path, str) else path
    tested = p if is_dir is None else F.when(is_dir, F.concat(p, F.lit("/"))).otherwise(p)
    return tested.rlike(ignore_regex(patterns))


def is_supported(name: Column | str, extensions: Iterable[str] = V.INCLUDE_EXTENSIONS) -> Column:
    return P.extension_of(name).isin(*extensions)


def keep_files(
    files: DataFrame,
    patterns: Iterable[str] = V.IGNORE_PATTERNS,
    extensions: Iterable[str] = V.INCLUDE_EXTENSIONS,
    max_file_size: int | None = None,
) -> DataFrame:
    """Scan predicates: extension list, ignores and, if given, a size limit (equal is kept)."""
    kept = files if max_file_size is None else files.where(F.col("size") <= max_file_size)
    return kept.where(is_supported("name", extensions) & ~is_ignored("relative_path", None, patterns))


def drop_own_output(files: DataFrame, docs_dirs: DataFrame) -> DataFrame:
    """Drop files under their repo's document folder; ``docs_dirs(repo, docs_dir)``.

    The folder is an extra ignore entry, so it counts as a directory name at
    any depth, or as the leading path.
    """
    padded = F.concat(F.lit("/"), F.col("relative_path"))
    inside = F.contains(padded, F.concat(F.lit("/"), F.col("docs_dir"), F.lit("/")))
    return files.join(docs_dirs, "repo", "left").where(F.col("docs_dir").isNull() | ~inside).drop("docs_dir")


def with_path_columns(df: DataFrame) -> DataFrame:
    p = P.normalise("relative_path")
    return df.withColumns(
        {
            "relative_path": p,
            "name": P.name_of(p),
            "parent_path": P.parent_of(p),
            "depth": P.depth_of(p),
            "ext": P.extension_of(P.name_of(p)),
        }
    )


def of_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.where(F.col("node_type") == node_type)


def at_depth(nodes: DataFrame, depth: int, node_type: str | None = None) -> DataFrame:
    hit = nodes.where(F.col("depth") == depth)
    return of_type(hit, node_type) if node_type else hit


def with_status(df: DataFrame, status: str) -> DataFrame:
    return df.where(F.col("status") == status)


def api_files(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("node_type") == "file") & F.col("has_api"))


def has_api_files(nodes: DataFrame) -> bool:
    return not api_files(nodes).limit(1).isEmpty()


def is_pathlike(target: Column | str) -> Column:
    t = F.col(target) if isinstance(target, str) else target
    return F.startswith(t, F.lit(".")) | F.contains(t, F.lit("/"))


def edge_view(edges: DataFrame, mode: str = "all") -> DataFrame:
    """Edges as displayed: all, path-like or bare targets."""
    if mode == "all":
        return edges
    return edges.where(is_pathlike("target") if mode == "pathlike" else ~is_pathlike("target"))


def edge_listing(edges: DataFrame, mode: str = "all") -> DataFrame:
    """Every edge of the view with its ``position`` in its repo's display order; a page is a range of positions."""
    keys = ["source", "target", "dep_type"]
    return ordinal(edge_view(edges, mode).select("repo", *keys), ["repo"], keys, "position")


def doc_path(path: Column | str, node_type: Column | str, docs_root: str = "docs") -> Column:
    """``a/b.py`` → ``docs/a/b.py.md``; directory ``a`` → ``docs/a/_dir_summary.md``."""
    p = F.col(path) if isinstance(path, str) else path
    kind = F.col(node_type) if isinstance(node_type, str) else node_type
    below = F.concat(F.lit(docs_root + "/"), p)
    return (
        F.when(kind == "file", F.concat(below, F.lit(".md")))
        .when(p == "", F.lit(f"{docs_root}/{V.DIR_DOC_NAME}"))
        .otherwise(F.concat(below, F.lit("/" + V.DIR_DOC_NAME)))
    )


def look_up(wanted: DataFrame, stored: DataFrame, key: str = "path") -> DataFrame:
    """Stored values for paths written with either slash."""
    return wanted.withColumn(key, P.normalise(key)).join(stored, ["repo", key], "left")
