"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import cut, fresh_dir  # noqa: F401  (re-exported)
from ..sources.tables import table  # noqa: F401

DOCUMENT = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of a documents table and no others, so that further columns of any name do no harm."""
    return df.select(*[F.col(n).cast(DOCUMENT[n]).alias(n) for n in names])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_az(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equality of columns that may be null."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint behind a count: beyond ``rows`` rows the planner joins by shuffle.

    Give a frame that is cheap to count, best one that ``cut`` has written.
    """
    return F.broadcast(df) if df.count() <= rows else df


def broadcast_if_light(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """A broadcast hint for a table that ``cut`` has written, if its files are small; else the planner joins as it sees fit."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most_bytes else df


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, which serves many tasks one after another."""
    holder = sys.modules.setdefault("grovelark_worker_cache", types.ModuleType("grovelark_worker_cache"))
    return holder.__dict__.setdefault(name, {})
