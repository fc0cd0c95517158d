"""The newest row of every key, kept as a table of changes.

A run appends the rows it changes; nothing that is stored is rewritten or moved. The rows are one Parquet table clustered into
buckets by the key, so that the newest row of a key, and a comparison with a new snapshot, take no exchange of what is
stored: only the snapshot moves. A run counts from the moment its record appears below ``commits`` by a rename; rows of a
broken attempt have no record and are never seen. When the log has grown to ``growth`` times its largest run, or to
``most_runs`` runs, the newest rows are written as the next generation, bucket by bucket; the one before stays for its readers.

    base/commits/gen=1/run=0.json     {"run", "attempt", "rows", "buckets", "note"}
    base/gen=1/…                      the clustered table
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = -1  # the record of a generation's first rows


class Folder:
    """The few file operations that Spark's readers and writers don't offer, on any storage Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path, spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> bool:
        """Whole or not at all; False where the file is there already."""
        trial, target = self._at(f"{name}.{uuid.uuid4().hex}.part"), self._at(name)
        if self._fs.exists(target):
            return False
        stream = self._fs.create(trial)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(trial, target):
            self._fs.delete(trial, False)
            return False
        return True

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class ChangeLog:
    """``key`` columns, ``value`` (a struct, null where the key is gone), ``run``."""

    def __init__(self, spark: SparkSession, base: str, schema: str, key: Sequence[str], buckets: int = 64, growth: float = 2.0, most_runs: int = 32):
        """``schema`` is that of the key columns and a struct ``value``; ``buckets`` holds for new generations."""
        self.spark, self.base, self.key, self.schema = spark, base.rstrip("/"), list(key), schema
        self.buckets, self.growth, self.most_runs = buckets, growth, most_runs
        self.folder = Folder(spark, self.base)

    # ------------------------------------------------------------ what is committed

    def generation(self) -> int:
        """The newest one with a record of its base; 0 for none."""
        found = [int(n.split("=")[1]) for n in self.folder.names("commits") if "=" in n]
        return max((g for g in found if f"run={BASE}.json" in self.folder.names(f"commits/gen={g}")), default=0)

    def commits(self, generation: int | None = None) -> list[dict]:
        """The records of a generation by run, its base first: one for each run since it began."""
        g = self.generation() if generation is None else generation
        names = [n for n in self.folder.names(f"commits/gen={g}") if n.endswith(".json")]
        return sorted((json.loads(self.folder.read(f"commits/gen={g}/{n}")) for n in names), key=lambda c: c["run"])

    def _table(self, generation: int, buckets: int) -> str:
        """The name under which this session knows the generation's files."""
        place = f"{self.base}/gen={generation}"
        name = f"change_log_{hashlib.md5(place.encode()).hexdigest()[:20]}"
        by = ", ".join(self.key)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({self.schema}, run BIGINT, attempt STRING) USING parquet "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        self.spark.catalog.refreshTable(name)
        return name

    def record(self, run: int) -> dict | None:
        """The record of a run, or of the merge that took it in; None where it is not committed."""
        done = self.commits()
        own = next((c for c in done if c["run"] == run), None)
        return own or (done[0] if done and run <= done[0].get("upto", BASE) else None)

    def rows(self, before: int | None = None) -> DataFrame:
        """Every committed row, those of runs before ``before`` only if given."""
        g = self.generation()
        seen = [c for c in self.commits(g) if before is None or c["run"] < before]
        if not seen:
            return self.spark.createDataFrame([], f"{self.schema}, run BIGINT")
        if before is not None and before <= seen[0].get("upto", BASE):
            raise ValueError(f"run {before} lies before what has been merged into one")
        own = self.spark.table(self._table(g, seen[0]["buckets"]))
        return own.where(F.col("attempt").isin([c["attempt"] for c in seen])).drop("attempt")  # at most ``most_runs`` + 1

    def newest(self, before: int | None = None) -> DataFrame:
        """``(…key, value, run)``: the newest row of every key that is not gone."""
        newest = self.rows(before).groupBy(*self.key).agg(F.max_by(F.struct("value", "run"), "run").alias("r"))
        return newest.select(*self.key, "r.value", "r.run").where("value IS NOT NULL")

    # ------------------------------------------------------------ growing

    def append(self, run: int, changes: DataFrame, note: str = "") -> bool:
        """Add ``changes (…key, value)`` of a run; False, and nothing added, where the run is committed already. ``note`` goes into its record."""
        if run <= BASE:
            raise ValueError("runs are numbered from 0")
        g = self.generation()
        if not g:
            self._commit(1, BASE, {"attempt": "", "rows": 0, "buckets": self.buckets, "upto": BASE})
            g = 1
        done = self.commits(g)
        if self.record(run) is not None:
            return False
        if run < done[-1]["run"]:
            raise ValueError(f"run {run} comes after run {done[-1]['run']}")
        attempt, buckets = uuid.uuid4().hex, done[0]["buckets"]
        own = changes.select(*self.key, "value", F.lit(run).cast("bigint").alias("run"), F.lit(attempt).alias("attempt"))
        own.repartition(buckets, *self.key).write.insertInto(self._table(g, buckets))  # as many rows as there are changes
        n = self.spark.table(self._table(g, buckets)).where(F.col("attempt") == attempt).count()
        added = self._commit(g, run, {"attempt": attempt, "rows": n, "buckets": buckets, "note": note})
        sizes = [c["rows"] for c in done] + [n]
        if added and (len(done) >= self.most_runs or sum(sizes) > self.growth * max(sizes)):
            self.merge()
        return added

    def merge(self) -> int:
        """Write the newest rows as the next generation; each bucket is read and written by one task, without an exchange."""
        g, done = self.generation(), self.commits()
        buckets = done[0]["buckets"]
        attempt, target = uuid.uuid4().hex, self._table(g + 1, buckets)
        rows = self.newest().select(*self.key, "value", "run", F.lit(attempt).alias("attempt"))
        rows.write.insertInto(target)
        n = self.spark.table(target).where(F.col("attempt") == attempt).count()
        self._commit(g + 1, BASE, {"attempt": attempt, "rows": n, "buckets": buckets, "upto": max(done[-1]["run"], done[0]["upto"])})
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(g - 1, buckets)}")  # readers of generation g go on
        self.folder.drop(f"commits/gen={g - 1}")
        self.folder.drop(f"gen={g - 1}")
        return g + 1

    def _commit(self, generation: int, run: int, record: dict) -> bool:
        return self.folder.write_once(f"commits/gen={generation}/run={run}.json", json.dumps({"run": run, **record}))

    def compare(self, snapshot: DataFrame, same: Column, before: int | None = None) -> DataFrame:
        """``(…key, new, old)`` for all keys that are new, gone or not ``same`` (a condition over ``new`` and ``old``).

        ``snapshot (…key, value)`` is complete: what it lacks is gone.
        """
        new = snapshot.select(*self.key, F.col("value").alias("new"))
        old = self.newest(before).select(*self.key, F.col("value").alias("old"))
        both = new.join(old, self.key, "full_outer")
        return both.where(F.col("new").isNull() | F.col("old").isNull() | ~F.coalesce(same, F.lit(False)))
