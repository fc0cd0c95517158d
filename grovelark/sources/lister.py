"""Listing source trees and reading their files on the executors.

The built-in file sources drop names that start with ``_`` (``__init__.py``),
so directories are listed here, one directory per row: a huge repository is
spread over tasks as well as many small ones. Storage must be visible to the
executors.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.globs import ignore_regex
from .durable import cut

_FOUND = "repo string, root string, relative_path string, name string, node_type string, size bigint, mtime double"
_BATCH = 10_000


def list_corpus(
    roots: DataFrame,
    patterns: Iterable[str] = V.IGNORE_PATTERNS,
    extensions: Iterable[str] = V.INCLUDE_EXTENSIONS,
    max_file_size: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Supported files and all kept directories below ``roots(repo, root)``.

    What cannot be read is a row too, with ``node_type`` ``unreadable``.
    One round per tree level; an ignored directory is never entered. Each
    round's entries are written before its directories are listed.
    """
    ignored = ignore_regex(patterns).replace(r"\z", r"\Z")
    wanted = tuple(extensions)

    def entries(repo: str, root: str, folder: str, skip: re.Pattern[str]) -> Iterator[tuple]:
        base = os.path.join(root, folder) if folder else root
        try:
            scan = os.scandir(base)
        except OSError:
            yield repo, root, folder, os.path.basename(folder), "unreadable", None, None
            return
        with scan:
            for entry in scan:
                path = f"{folder}/{entry.name}" if folder else entry.name
                try:
                    if entry.is_dir():
                        loop = entry.is_symlink() and _inside(os.path.realpath(base), os.path.realpath(entry.path))
                        if not loop and not skip.search(path + "/"):
                            yield repo, root, path, entry.name, "directory", None, None
                    elif entry.is_file() and not skip.search(path):
                        stat = entry.stat()
                        if os.path.splitext(entry.name)[1].lower() in wanted and (max_file_size is None or stat.st_size <= max_file_size):
                            yield repo, root, path, entry.name, "file", stat.st_size, stat.st_mtime
                except OSError:
                    yield repo, root, path, entry.name, "unreadable", None, None

    columns = [c.split()[0] for c in _FOUND.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        skip = re.compile(ignored)
        rows: list[tuple] = []
        for batch in batches:
            for r in batch.itertuples(index=False):
                for row in entries(r.repo, r.root, r.relative_path, skip):
                    rows.append(row)
                    if len(rows) >= _BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    frontier = roots.select("repo", "root", F.lit("").alias("relative_path"))
    found: DataFrame | None = None
    while True:
        spread = frontier.repartition(partitions) if partitions else frontier.repartition("repo", "relative_path")
        listed = spread.mapInPandas(run, _FOUND)
        level = cut(listed.withColumn("mtime", F.timestamp_seconds("mtime")))
        found = level if found is None else found.unionByName(level)
        frontier = level.where("node_type = 'directory'").select("repo", "root", "relative_path")
        if frontier.isEmpty():
            return found


def _inside(path: str, folder: str) -> bool:
    """Whether ``path`` is ``folder`` or lies below it."""
    return path == folder or path.startswith(folder.rstrip(os.sep) + os.sep)


def with_contents(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Raw bytes of listed files; null when a file cannot be read."""
    columns = files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 100):
                piece = batch.iloc[start : start + 100]
                yield piece.assign(content=[_bytes(r, p) for r, p in zip(piece["root"], piece["relative_path"])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", content binary"
    spread = files.repartition(partitions) if partitions else files
    return spread.select(*columns).mapInPandas(run, schema)


def _bytes(root: str, path: str) -> bytes | None:
    try:
        with open(os.path.join(root, path), "rb") as f:
            return f.read()
    except OSError:
        return None
