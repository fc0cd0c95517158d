"""Positions and assembled texts for groups of any size.

A window over a group would pull the whole group into one task. Here the rows
are range-sorted over the cluster, numbered inside each range, and only the
per-range counts are added up.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import cut

_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null: no row is lost for a missing key."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, same).drop(*[f"_r_{k}" for k in keys])


def ordinal(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """1-based position of each row in its group under a total order.

    The sorted rows are written once, because range bounds are sampled and a
    recomputed task could otherwise number its rows differently.
    """
    keys = [*group, *order]
    rows = cut(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_range", F.shiftright("_at", _BITS))
    runs = rows.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and range: written, so that its size decides how it is joined
    offsets = cut(runs.select(
        *group, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    ))
    return (
        join_on(rows, offsets, [*group, "_range"])
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .drop("_at", "_range", "_shift")
    )


def parts_of(
    numbered: DataFrame, group: Sequence[str], text: str, separator: str, rows_per_part: int, position: str = "ordinal"
) -> DataFrame:
    """Join texts in order into parts of at most ``rows_per_part`` rows each."""
    part = F.floor((F.col(position) - 1) / rows_per_part)
    return (
        numbered.withColumn("part", part)
        .groupBy(*group, "part")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t")))),
                    lambda s: s["t"],
                ),
                separator,
            ).alias("text"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )


def assemble(
    df: DataFrame, group: Sequence[str], order: Sequence[str], text: str, separator: str, rows_per_part: int = 256,
    unique: bool = True,
) -> DataFrame:
    """A document per group as ordered parts ``(…group, part, text, n_rows)``.

    Parts joined by ``separator`` in ``part`` order are the whole document; no
    row ever holds more than ``rows_per_part`` inputs, however large the group.
    With ``unique`` the order is a key of its group: then only the keys are
    sorted and numbered, and the texts are read once.
    """
    if not unique:
        return parts_of(ordinal(df, group, order), group, text, separator, rows_per_part)
    keys = [*group, *order]
    numbered = join_on(df, ordinal(df.select(*keys), group, order), keys)
    return parts_of(numbered, group, text, separator, rows_per_part)
