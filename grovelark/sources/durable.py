"""Cutting lineage in storage that outlives executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only on a local master."""
    sc = spark.sparkContext
    named = sc.getConf().get(_SETTING) or spark.conf.get(_SETTING, None) or sc.getCheckpointDir()
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError(f"set {_SETTING} to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="grovelark-"))
    return sc.getCheckpointDir()


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once to shared storage and continue from the written table.

    A columnar table, so later steps read only the columns they need, and the
    planner sees its true size when it decides whether to broadcast it.
    """
    folder = fresh_dir(df.sparkSession, "cut")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
