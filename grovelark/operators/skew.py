"""Joins of a table in which a few keys may hold a large share of the rows.

A frequent-items sketch (built in, merged over all partitions) names the keys that would fill more than half a task. Their
rows stay where they are and meet the few rows of the other side by broadcast, if these are small as written, or by salted
keys if not. All other rows are joined by shuffle as usual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import cut

#: Counters of the sketch for each key it may name.
COUNTERS = 64


def written_bytes(df: DataFrame) -> int:
    """Size of a table as the planner knows it: of its files, for one that was just written."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hot_keys(rows: DataFrame, key: Column, tasks: int, most: int = 64) -> list[tuple[int, int]]:
    """``(key, rows)`` of the at most ``most`` keys that hold more than half of what a task should get; ``key`` is a number."""
    found = rows.select(key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {most}, {most * COUNTERS})").alias("top")).first()
    bar = found["n"] / (2 * max(1, tasks))
    return [(r["item"], r["count"]) for r in found["top"] or [] if r["item"] is not None and r["count"] > max(1.0, bar)]


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", most: int = 64, small_bytes: int = 32 << 20) -> DataFrame:
    """``left.join(right, keys, how)`` for inner and left joins, with the common keys of ``left`` joined on their own.

    ``left`` is read up to three times: give a written table. Rows are joined by the keys themselves; their hash only says
    which way they go, so a key that the sketch misses is no error.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how}: rows of the right side would be asked for twice")
    spark, keys = left.sparkSession, list(keys)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark = F.xxhash64(*keys)
    hot = hot_keys(left, mark, tasks, most)
    if not hot:
        return left.join(right, keys, how)
    is_hot = mark.isin([k for k, _ in hot])
    few = cut(right.where(is_hot))
    rest = left.where(~is_hot).join(right.where(~is_hot), keys, how)
    common = left.where(is_hot)
    if written_bytes(few) <= small_bytes:
        return rest.unionByName(common.join(F.broadcast(few), keys, how))
    salts = max(2, -(-max(n for _, n in hot) * 2 * tasks // max(1, sum(n for _, n in hot))))
    salted = common.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rest.unionByName(salted.join(spread, [*keys, "_salt"], how).drop("_salt"))
