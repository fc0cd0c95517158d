"""Path-tree operators on flat ``nodes`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import paths as P
from ..sources.durable import cut
from .predicates import of_type
from .ranking import assemble, ordinal, parts_of

ROOT = ""


def ancestors(df: DataFrame, path: str = "relative_path") -> DataFrame:
    """One row per proper ancestor directory of each path, the root included."""
    return df.withColumn("ancestor", F.explode(P.prefixes_of(path)))


def directories_of(files: DataFrame) -> DataFrame:
    """Every directory above some file: ``(repo, relative_path)``.

    Files collapse to their parents before the expansion, so the shuffle
    carries directories, not files.
    """
    parents = files.select("repo", P.parent_of("relative_path").alias("dir")).distinct()
    chain = F.array_append(F.when(F.col("dir") == ROOT, F.array().cast("array<string>")).otherwise(P.prefixes_of("dir")), F.col("dir"))
    return parents.select("repo", F.explode(chain).alias("relative_path")).distinct()


def build_nodes(files: DataFrame) -> DataFrame:
    """Adjacency rows for files and all their directories, root at depth 0."""
    p = F.col("relative_path")
    shape = [
        F.col("repo"), p, P.parent_of(p).alias("parent_path"), P.name_of(p).alias("name"),
        P.depth_of(p).alias("depth"),
    ]
    as_file = files.select(*shape, F.lit("file").alias("node_type"), P.extension_of(P.name_of(p)).alias("ext"))
    as_dir = directories_of(files).select(*shape, F.lit("directory").alias("node_type"), F.lit("").alias("ext"))
    return as_file.unionByName(as_dir)


def prune_empty(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Directories with a surviving file below; the root always stays."""
    alive = directories_of(files)
    roots = dirs.where(F.col("relative_path") == ROOT)
    return dirs.where(F.col("relative_path") != ROOT).join(alive, ["repo", "relative_path"], "left_semi").unionByName(roots)


def pruned_count(dirs: DataFrame, files: DataFrame) -> DataFrame:
    gone = dirs.where(F.col("relative_path") != ROOT).join(directories_of(files), ["repo", "relative_path"], "left_anti")
    return gone.groupBy("repo").agg(F.count(F.lit(1)).alias("pruned"))


def max_depth(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("repo").agg(F.max("depth").alias("max_depth"))


def child_counts(nodes: DataFrame) -> DataFrame:
    """Direct file and directory counts, also for directories without children."""
    counted = (
        nodes.where(F.col("relative_path") != ROOT)
        .groupBy("repo", F.col("parent_path").alias("relative_path"))
        .agg(
            F.count_if(F.col("node_type") == "file").alias("file_count"),
            F.count_if(F.col("node_type") == "directory").alias("dir_count"),
        )
    )
    dirs = of_type(nodes, "directory").select("repo", "relative_path")
    return dirs.join(counted, ["repo", "relative_path"], "left").fillna(0, ["file_count", "dir_count"])


def tree_totals(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("repo").agg(
        F.count_if(F.col("node_type") == "file").alias("total_files"),
        F.count_if(F.col("node_type") == "directory").alias("total_dirs"),
        F.max("depth").alias("max_depth"),
    )


def subtree_totals(files: DataFrame) -> DataFrame:
    """Files and bytes below each directory.

    Files are summed per parent first; only the sums are sent to the ancestors.
    """
    per_dir = files.groupBy("repo", P.parent_of("relative_path").alias("dir")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")
    )
    chain = F.array_append(F.when(F.col("dir") == ROOT, F.array().cast("array<string>")).otherwise(P.prefixes_of("dir")), F.col("dir"))
    return (
        per_dir.select("repo", F.explode(chain).alias("relative_path"), "n", "b")
        .groupBy("repo", "relative_path")
        .agg(F.sum("n").alias("n_files"), F.sum("b").alias("n_bytes"))
    )


def _sort_token(name: Column, is_file: Column) -> Column:
    """Directories first, then case-insensitive name, then the name itself."""
    return F.concat(is_file.cast("int").cast("string"), F.lower(name), F.lit("\x02"), name)


def sibling_key() -> Column:
    return _sort_token(F.col("name"), F.col("node_type") == "file")


def preorder_key() -> Column:
    """Sort key that lists a tree top-down, each directory before its children."""
    parts = F.split("relative_path", "/")
    is_file = F.col("node_type") == "file"
    tokens = F.transform(parts, lambda s, i: _sort_token(s, is_file & (i == F.size(parts) - 1)))
    return F.when(F.col("relative_path") == ROOT, F.lit("")).otherwise(F.array_join(tokens, "\x01"))


def sibling_order(nodes: DataFrame) -> DataFrame:
    below = nodes.where(F.col("relative_path") != ROOT).withColumn("_key", sibling_key())
    return ordinal(below, ["repo", "parent_path"], ["_key"], "sibling_rank").drop("_key")


def tree_listing(
    nodes: DataFrame, *, dirs_only: bool = False, max_depth: int | None = None, show_status: bool = False
) -> DataFrame:
    """One row per printed line: ``(repo, line_no, line, relative_path)``.

    The order comes from the path alone; branch marks need one look-up of the
    parent's prefix, built for directories only.
    """
    if dirs_only:
        nodes = of_type(nodes, "directory")
    if max_depth is not None:
        nodes = nodes.where(F.col("depth") <= max_depth)
    nodes = cut(nodes)
    below = nodes.where(F.col("relative_path") != ROOT).withColumn("_key", sibling_key())
    lasts = below.groupBy("repo", "parent_path").agg(F.max("_key").alias("_key")).withColumn("_last", F.lit(True))
    flagged = below.join(lasts, ["repo", "parent_path", "_key"], "left").withColumn(
        "_last", F.coalesce("_last", F.lit(False))
    )
    dirs = of_type(flagged, "directory")
    bars = dirs.select("repo", F.col("relative_path").alias("step"), F.when(F.col("_last"), "    ").otherwise("│   ").alias("bar"))
    steps = dirs.select(
        "repo",
        F.col("relative_path").alias("dir"),
        F.posexplode(F.array_append(F.slice(P.prefixes_of("relative_path"), F.lit(2), F.col("depth")), F.col("relative_path"))).alias("level", "step"),
    )
    prefixes = (
        steps.join(bars, ["repo", "step"])
        .groupBy("repo", F.col("dir").alias("parent_path"))
        .agg(F.array_sort(F.collect_list(F.struct("level", "bar"))).alias("b"))
        .select("repo", "parent_path", F.array_join(F.transform("b", lambda s: s["bar"]), "").alias("_prefix"))
    )
    mark = F.lit("")
    if show_status:
        marks = F.create_map(*[F.lit(x) for kv in V.STATUS_MARKS.items() for x in kv])
        mark = F.concat(F.coalesce(F.element_at(marks, F.col("status")), F.lit("")), F.lit(" "))
    label = F.concat(mark, F.col("name"), F.when(F.col("node_type") == "directory", "/").otherwise(""))
    drawn = flagged.join(prefixes, ["repo", "parent_path"], "left").select(
        "repo", "relative_path", "node_type",
        F.concat(F.coalesce("_prefix", F.lit("")), F.when(F.col("_last"), "└── ").otherwise("├── "), label).alias("line"),
    )
    root = nodes.where(F.col("relative_path") == ROOT).select(
        "repo", "relative_path", "node_type", F.concat("repo", F.lit("/")).alias("line")
    )
    listed = cut(drawn.unionByName(root).withColumn("_key", preorder_key()))
    return ordinal(listed, ["repo"], ["_key"], "line_no").select("repo", "line_no", "line", "relative_path")


def child_documents(nodes: DataFrame, docs: DataFrame, rows_per_part: int = 256) -> DataFrame:
    """Documents of a directory's direct children, titled by name, in sibling order.

    ``docs(repo, relative_path, content)``. One directory may come in several
    parts; see :func:`assemble`.
    """
    return joined_children(nodes.join(docs, ["repo", "relative_path"]), rows_per_part)


def joined_children(documented: DataFrame, rows_per_part: int = 256) -> DataFrame:
    """As :func:`child_documents`, for node rows that already carry ``content``."""
    titled = documented.where(F.col("relative_path") != ROOT).select("repo", F.col("parent_path").alias("dir"), sibling_key().alias("_key"), _titled())
    return assemble(titled, ["repo", "dir"], ["_key"], "text", V.DOC_SEPARATOR, rows_per_part)


def numbered_children(ranked: DataFrame, rows_per_part: int = 256) -> DataFrame:
    """As :func:`joined_children`, for rows that carry their ``rank`` among all siblings too."""
    titled = ranked.where(F.col("relative_path") != ROOT).select("repo", F.col("parent_path").alias("dir"), "rank", _titled())
    return parts_of(titled, ["repo", "dir"], "text", V.DOC_SEPARATOR, rows_per_part, "rank")


def _titled() -> Column:
    return F.concat(F.lit("### "), "name", F.lit("\n\n"), "content").alias("text")


def all_file_documents(nodes: DataFrame, docs: DataFrame, rows_per_part: int = 256) -> DataFrame:
    """All file documents of a repo, titled by relative path, in tree order."""
    titled = (
        of_type(nodes, "file")
        .join(docs, ["repo", "relative_path"])
        .select(
            "repo",
            preorder_key().alias("_key"),
            F.concat(F.lit("### "), "relative_path", F.lit("\n\n"), "content").alias("text"),
        )
    )
    return assemble(titled, ["repo"], ["_key"], "text", V.DOC_SEPARATOR, rows_per_part)


def display_name(name: Column | str) -> Column:
    """Name with a label for well-known files: exact name, else stem equal to,
    starting with or ending with a key; the first key in the list wins."""
    n = F.col(name) if isinstance(name, str) else name
    base = F.lower(P.stem_of(n))
    exact, fuzzy = F.lit(None).cast("string"), F.lit(None).cast("string")
    for key, label in reversed(V.DISPLAY_NAMES):
        tag = F.concat(n, F.lit(" " + label))
        exact = F.when(n == key, tag).otherwise(exact)
        near = (base == key) | F.endswith(base, F.lit("_" + key)) | F.startswith(base, F.lit(key + "_"))
        fuzzy = F.when(near, tag).otherwise(fuzzy)
    return F.coalesce(exact, fuzzy, n)
