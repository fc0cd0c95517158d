"""Bottom-up run over a tree: files of a level, then directories from their children."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import pystr as S
from ..operators import documents as D
from ..operators import enrichment as G
from ..operators import hierarchy as H
from ..operators.predicates import at_depth, doc_path
from ..operators.ranking import ordinal
from ..sources.durable import cut

#: file rows with ``content`` in, ``(repo, relative_path, summary)`` and, if it likes, ``error`` out; null or blank = failed
FileFunction = Callable[[DataFrame], DataFrame]
#: parts of joined child documents in, ``(repo, relative_path, summary)`` and, if it likes, ``error`` out
DirFunction = Callable[[DataFrame], DataFrame]

_OUT = ["repo", "relative_path", "parent_path", "name", "node_type", "depth", "status", "error", "content", "doc_path"]
_KEY = ["repo", "relative_path"]
#: what :func:`fold_levels` returns besides, given the documents of an earlier run
_MEMO = ["digest", "folded"]


def standin_files(files: DataFrame) -> DataFrame:
    return files.select("repo", "relative_path", G.standin_file().alias("summary"))


def _told(summaries: DataFrame) -> DataFrame:
    return summaries if "error" in summaries.columns else summaries.withColumn("error", F.lit(None).cast("string"))


def _child_digests(done: DataFrame) -> DataFrame:
    """``(repo, relative_path, _made)``: what a directory would be told by its children, in whatever order they are met.

    Two hashes of every child are combined and counted, so a directory with a third of all files is no group of its own.
    The time a document was generated at doesn't count.
    """
    child = ["name", "node_type", D.without_time("content")]
    told = done.where((F.col("relative_path") != H.ROOT) & F.col("content").isNotNull())
    return told.groupBy("repo", F.col("parent_path").alias("relative_path")).agg(
        F.concat_ws("-", F.bit_xor(F.xxhash64(*child)), F.bit_xor(F.xxhash64(F.lit(1), *child)), F.count(F.lit(1))).alias("_made")
    )


def fold_levels(
    nodes: DataFrame,
    texts: DataFrame,
    generated_at: Column,
    file_fn: FileFunction = standin_files,
    dir_fn: DirFunction = G.standin_directories,
    docs_root: str = "docs",
    existing: DataFrame | None = None,
    previous: DataFrame | None = None,
) -> DataFrame:
    """Documents for every node, deepest level first.

    ``texts(repo, relative_path, content)`` are the file contents. Nodes in
    ``existing(repo, relative_path, node_type, content)`` are finished already:
    their documents are used as they are and no function is called for them.

    ``previous(repo, relative_path, node_type, digest, content)`` are documents of an earlier run. One is used again if it
    was made from the same: a file's from the same text, a directory's from the same documents of its children. Then a
    change is folded upwards only as far as it changes documents. The result has ``digest``, what each document was
    made from, and ``folded``, whether it was made now.

    A repo with a failed node stops after that level: its shallower nodes do
    not appear. Files don't depend on levels, so all of them pass through
    ``file_fn`` in one go; siblings are numbered once. The driver loops over
    depths only and keeps no rows; a level of directories is written once and
    read back by the next.
    """
    out_columns = _OUT if previous is None else _OUT + _MEMO
    shape = [c for c in nodes.columns if c in _OUT and c not in ("status", "doc_path", "error")]
    nodes = cut(nodes.select(*shape))
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:  # nothing to fold
        nothing = nodes.withColumns({c: F.lit(None).cast("string") for c in ("status", "error", "content", "doc_path", "digest")})
        return nothing.withColumn("folded", F.lit(None).cast("boolean")).select(*out_columns)
    memo = previous is not None
    counts = cut(H.child_counts(nodes))
    ranks = nodes.where(F.col("relative_path") != H.ROOT).select("repo", "relative_path", "parent_path", H.sibling_key().alias("_key"))
    ranks = cut(ordinal(ranks, ["repo", "parent_path"], ["_key"], "rank").select("repo", "relative_path", "rank"))
    ok = ~S.is_blank("summary")
    failure = F.when(~ok, F.coalesce("error", F.lit("blank output")))
    files, dirs = nodes.where("node_type = 'file'"), nodes.where("node_type = 'directory'")
    ready: list[DataFrame] = []
    more = _MEMO if memo else []

    def used(rows: DataFrame, digest: Column, folded: bool = False) -> DataFrame:
        """Rows that have their document."""
        flags = [digest.alias("digest"), F.lit(folded).alias("folded")] if memo else []
        return rows.select(*shape, F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"), "content", *flags)

    if existing is not None:
        keys = ["repo", "relative_path", "node_type"]
        have = cut(used(nodes.join(existing, keys), F.lit(None).cast("string")))
        ready.append(have)
        files = files.join(have.select(*keys), keys, "left_anti")
        dirs = dirs.join(have.select(*keys), keys, "left_anti")
    files = files.join(texts, _KEY, "left")
    if memo:
        files = files.withColumn("digest", F.md5("content"))
        old_files = previous.where("node_type = 'file'").select(*_KEY, "digest", F.col("content").alias("_doc"))
        keys = [*_KEY, "digest"]
        again = cut(used(nodes.where("node_type = 'file'").join(files.select(*keys).join(old_files, keys), _KEY).withColumnRenamed("_doc", "content"), F.col("digest")))
        ready.append(again)
        files = files.join(again.select(*_KEY), _KEY, "left_anti")
        old_dirs = cut(previous.where("node_type = 'directory'").select(*_KEY, "digest", F.col("content").alias("_doc")))
    asked = files.drop("digest")
    written = files.drop("content").join(_told(file_fn(asked)), _KEY, "left").select(
        *shape,
        F.when(ok, "completed").otherwise("failed").alias("status"),
        failure.alias("error"),
        F.when(ok, D.file_document(generated_at)).alias("content"),
        *(["digest", F.lit(True).alias("folded")] if memo else []),
    )
    for have in ready:
        written = written.unionByName(have)
    written = cut(written)
    counted = cut(
        dirs.withColumn("name", F.when(F.col("relative_path") == "", F.col("repo")).otherwise(F.col("name"))).join(counts, ["repo", "relative_path"], "left")
    )
    levels: list[DataFrame] = []
    stopped: DataFrame | None = None

    def running(rows: DataFrame) -> DataFrame:
        return rows if stopped is None else rows.join(stopped, "repo", "left_anti")

    for depth in range(deepest, -1, -1):
        level = running(at_depth(counted, depth))
        kept: DataFrame | None = None
        if memo:
            made = _child_digests(levels[-1]) if levels else dirs.select(*_KEY, F.lit(None).cast("string").alias("_made")).limit(0)
            digest = F.concat(F.col("_made"), F.format_string(":%d:%d", "file_count", "dir_count"))  # none for a directory without documents below
            level = cut(level.join(made, _KEY, "left").withColumn("digest", digest).drop("_made"))
            same = level.join(old_dirs, [*_KEY, "digest"])
            kept = used(same.withColumnRenamed("_doc", "content"), F.col("digest"))
            level = level.join(old_dirs.select(*_KEY, "digest"), [*_KEY, "digest"], "left_anti")
        if levels:
            parts = H.numbered_children(levels[-1].where("content is not null").join(ranks, ["repo", "relative_path"])).withColumnRenamed("dir", "relative_path")
            told = _told(dir_fn(parts.join(level.select("repo", "relative_path", "name"), ["repo", "relative_path"]))).withColumn("_has", F.lit(True))
            level = level.join(told, ["repo", "relative_path"], "left")
        else:
            level = level.withColumns({"summary": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "_has": F.lit(None).cast("boolean")})
        empty = F.col("_has").isNull()
        folded = level.withColumn("summary", F.when(empty, F.lit(V.EMPTY_DIR_TEXT)).otherwise(F.col("summary"))).select(
            *shape,
            F.when(empty, "skipped").when(ok, "completed").otherwise("failed").alias("status"),
            failure.alias("error"),
            F.when(ok, D.dir_document(generated_at)).alias("content"),
            *(["digest", F.lit(True).alias("folded")] if memo else []),
        )
        done = folded.unionByName(running(at_depth(written, depth)).select(*folded.columns))
        done = cut(done if kept is None else done.unionByName(kept))
        levels.append(done)
        failed = done.where("status = 'failed'").select("repo").distinct()
        if not failed.isEmpty():
            stopped = failed if stopped is None else stopped.unionByName(failed)
    out = levels[0]
    for lower in levels[1:]:
        out = out.unionByName(lower)
    return out.withColumn("doc_path", doc_path("relative_path", "node_type", docs_root)).select(*_OUT, *more)
