"""Path algebra on ``/``-separated relative paths; the root is ``''``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pystr import col


def normalise(p: Column | str) -> Column:
    return F.replace(col(p), F.lit("\\"), F.lit("/"))


def name_of(p: Column | str) -> Column:
    return F.substring_index(col(p), "/", -1)


def parent_of(p: Column | str) -> Column:
    return F.left(col(p), F.length(col(p)) - F.length(name_of(p)) - 1)


def depth_of(p: Column | str) -> Column:
    return F.when(col(p) == "", 0).otherwise(F.size(F.split(col(p), "/")))


def extension_of(name: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(name), r"^.+(\.[^.]+)$", 1))


def stem_of(name: Column | str) -> Column:
    return F.regexp_replace(col(name), r"(?<=.)\.[^.]+$", "")


def prefixes_of(p: Column | str) -> Column:
    """All proper ancestors, root first: ``a/b/c`` gives ``['', 'a', 'a/b']``."""
    parts = F.split(col(p), "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )


def first_segment(p: Column | str, bare: Column) -> Column:
    """First directory, or ``bare`` for a path without one."""
    return F.when(F.contains(col(p), F.lit("/")), F.substring_index(col(p), "/", 1)).otherwise(bare)


def last_segment(p: Column | str) -> Column:
    """Last part after ``/`` or ``\\``; the whole value when that part is empty."""
    tail = F.regexp_extract(col(p), r"([^/\\]*)\z", 1)
    return F.when(tail == "", col(p)).otherwise(tail)
