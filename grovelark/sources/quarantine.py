"""Readers with two outputs: rows that can be read, and those that can't, with where they were and why.

Both are written in one pass over the input and then read apart, so a reader loses nothing without a sign: good rows and
quarantined ones are together as many as came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import fresh_dir

QUARANTINED = "source string, position bigint, reason string, raw string"


def sort_out(rows: DataFrame, reason: Column, raw: Column, source: Column, position: Column, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(good rows, quarantined rows)`` of ``rows``; ``reason`` is null for a good one.

    Quarantined rows are ``QUARANTINED`` and stay below ``folder``; good ones keep the columns of ``rows``.
    """
    spark = rows.sparkSession
    base = folder or fresh_dir(spark, "sorted-out")
    bad = F.struct(source.cast("string").alias("source"), position.cast("bigint").alias("position"), reason.alias("reason"), raw.cast("string").alias("raw"))
    known = reason.isNotNull()
    good = F.when(~known, F.struct(*[F.col(c) for c in rows.columns]))
    both = rows.select(good.alias("good"), F.when(known, bad).alias("bad"), known.alias("quarantined"))
    both.write.partitionBy("quarantined").parquet(base)
    schema = both.schema
    read = spark.read.schema(schema).parquet(base)
    return read.where("NOT quarantined").select("good.*"), read.where("quarantined").select("bad.*")


def json_reason(text: Column, needs: dict[str, str]) -> Column:
    """Why a text can't be read as a JSON object with the fields ``needs`` (name → type); null where it can."""
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    why = F.when(text.isNull(), "no text").when(parsed.isNull(), "not JSON").when(~F.startswith(kind, F.lit("OBJECT")), "not an object")
    for name, as_type in needs.items():
        why = why.when(F.try_variant_get(parsed, f"$.{name}", as_type).isNull(), f"no {name}")
    return why
