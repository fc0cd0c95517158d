"""Results of a run kept by what they were made from, so that a broken run goes on where it stopped."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.change_log import Folder


def content_digest(df: DataFrame) -> str:
    """Of the rows and columns of a table, in any order of its rows; one pass that returns one row."""
    names = sorted(df.columns)
    hashes = df.select(F.xxhash64(F.lit(1), *names).alias("a"), F.xxhash64(F.lit(2), *names).alias("b"))
    # sums tell repeated rows apart, which cancel out in an exclusive or
    sums = [f(F.pmod(c, F.lit(1 << 31)) if f is F.sum else F.col(c)) for c in ("a", "b") for f in (F.sum, F.bit_xor)]
    got = hashes.agg(F.count(F.lit(1)), *sums).first()
    return hashlib.sha256("|".join([*names, *[str(v) for v in got]]).encode()).hexdigest()


class Stage:
    """A written result and the digest that stands for it where it is an input."""

    def __init__(self, name: str, rows: DataFrame, digest: str, made: bool):
        self.name, self.rows, self.digest, self.made = name, rows, digest, made


class Stages:
    """Results below ``base``: ``name-digest/``, complete once Spark's ``_SUCCESS`` is there."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.folder = spark, base.rstrip("/"), Folder(spark, base.rstrip("/"))

    def run(self, name: str, inputs: list[Stage | str], make: Callable[[], DataFrame]) -> Stage:
        """The result of ``make``, read back if it was made from the same ``inputs`` (stages, digests, versions) before."""
        said = [name, *[i.digest if isinstance(i, Stage) else i for i in inputs]]
        digest = hashlib.sha256("\x00".join(said).encode()).hexdigest()
        place = f"{name}-{digest[:20]}"
        known = "_SUCCESS" in self.folder.names(place)
        if not known:
            made = make()
            made.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.base}/{place}")
        return Stage(name, self.spark.read.parquet(f"{self.base}/{place}"), digest, not known)
