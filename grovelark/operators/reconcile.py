"""Comparison of endpoint lists from different places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import endpoints as E


def _counted(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Occurrences of each normalised endpoint on both sides, in one shuffle."""
    key = E.normalise_endpoint("api").alias("key")
    sides = left.select(*by, key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*by, key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return sides.groupBy(*by, "key").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).withColumns(
        {
            "missing": F.greatest(F.col("l") - F.col("r"), F.lit(0)),
            "extra": F.greatest(F.col("r") - F.col("l"), F.lit(0)),
        }
    )


def multiset_difference(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Endpoints that occur more often on one side: ``(…by, key, missing, extra)``.

    ``missing`` counts what the right side lacks, ``extra`` what it has too many.
    """
    return _counted(left, right, by).where("l <> r").drop("l", "r")


def consistency(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Per group: sizes of both lists, and whether they agree as multisets."""
    out = _counted(left, right, by).groupBy(*by).agg(
        F.sum("l").alias("n_overview"), F.sum("r").alias("n_usage"),
        F.sum("missing").alias("missing"), F.sum("extra").alias("extra"),
    )
    return out.withColumn("consistent", (F.col("missing") == 0) & (F.col("extra") == 0))


def report_lines(gaps: DataFrame) -> DataFrame:
    text = F.when(F.col("missing") > 0, F.format_string("%s (缺少 %d 个)", "key", "missing")).otherwise(
        F.format_string("%s (多出 %d 个)", "key", "extra")
    )
    return gaps.withColumn("line", text)


def set_difference(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Upper-cased endpoints found on one side only."""
    sides = left.select(*by, F.upper("api").alias("key"), F.lit(True).alias("l")).unionByName(
        right.select(*by, F.upper("api").alias("key"), F.lit(False).alias("l"))
    )
    seen = sides.groupBy(*by, "key").agg(F.bool_and("l").alias("only_l"), F.bool_or("l").alias("any_l"))
    return seen.where("only_l or not any_l").select(*by, "key", F.when(F.col("only_l"), "left").otherwise("right").alias("side"))


def missing_by_file(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected endpoints that are nowhere described, with their source file."""
    return expected.select("repo", "source_file", E.endpoint_key().alias("api")).join(
        actual.select("repo", "api").distinct(), ["repo", "api"], "left_anti"
    )


def extra_endpoints(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return actual.select("repo", "api").distinct().join(
        expected.select("repo", E.endpoint_key().alias("api")).distinct(), ["repo", "api"], "left_anti"
    )


def coverage(infos: DataFrame, details: DataFrame) -> DataFrame:
    """Per source file: endpoints whose path or whole key its details mention.

    Works inside each file's row: ``infos(repo, source_file, info_text)``
    against ``details(repo, source_file, details)``.
    """
    apis = E._endpoint_array(F.col("info_text"), True)
    text = F.coalesce(F.col("details"), F.lit(""))
    joined = infos.join(details, ["repo", "source_file"], "left").select("repo", "source_file", text.alias("t"), apis.alias("apis"))
    lost = F.filter("apis", lambda a: ~F.contains(F.col("t"), a["path"]))
    return joined.select("repo", "source_file", F.size("apis").alias("total"), F.transform(lost, lambda a: E.endpoint_key(a["method"], a["path"])).alias("missed")).where(
        "total > 0"
    ).select("repo", "source_file", (F.col("total") - F.size("missed")).alias("covered"), "total", "missed")
