"""State kept as changes: what is written, what moves, what a broken or repeated run leaves."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from conftest import rows
from grovelark.operators import diff as X
from grovelark.sources.change_log import ChangeLog, Folder
from grovelark.streaming import snapshots as S

SCHEMA = "k string, value struct<v: string>"


def values(spark, items):
    return spark.createDataFrame([(k, None if v is None else (v,)) for k, v in items], SCHEMA)


def prints(spark, n, changed=()):
    hashed = F.when(F.col("id").isin(list(changed)), "y").otherwise("x")
    return spark.range(n).select(
        (F.col("id") % 3).cast("string").alias("repo"), F.concat(F.lit("f"), "id").alias("path"), F.lit(1).cast("bigint").alias("size"),
        F.lit(0).cast("bigint").alias("mtime"), hashed.alias("content_hash"), F.lit(None).cast("timestamp").alias("last_analyzed"))


def test_newest_rows_and_times(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), SCHEMA, ["k"], buckets=3)
    assert log.newest().count() == 0 and log.commits() == []
    assert log.append(0, values(spark, [("a", "1"), ("b", "1")]))
    assert log.append(2, values(spark, [("a", "2"), ("b", None), ("c", "1")]), "why")
    assert rows(log.newest(), "k", "value.v", "run") == [("a", "2", 2), ("c", "1", 2)]
    assert rows(log.newest(before=2), "k", "value.v") == [("a", "1"), ("b", "1")]
    assert log.record(2)["note"] == "why" and log.record(1) is None
    assert not log.append(2, values(spark, [("z", "z")]))  # a repeated run adds nothing
    with pytest.raises(ValueError, match="after run 2"):
        log.append(1, values(spark, [("a", "9")]))
    with pytest.raises(ValueError, match="from 0"):
        log.append(-1, values(spark, []))


def test_rows_of_a_broken_run_are_never_seen(spark, tmp_path, monkeypatch):
    log = ChangeLog(spark, str(tmp_path / "log"), SCHEMA, ["k"], buckets=2)
    log.append(0, values(spark, [("a", "1")]))
    with monkeypatch.context() as m:
        m.setattr(log.folder, "write_once", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            log.append(1, values(spark, [("a", "lost"), ("b", "lost")]))
    assert rows(log.newest(), "k", "value.v") == [("a", "1")]
    assert log.append(1, values(spark, [("a", "2")]))
    assert rows(log.newest(), "k", "value.v") == [("a", "2")]


def test_merge_keeps_the_newest_and_the_next_run(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), SCHEMA, ["k"], buckets=2, most_runs=3)
    for n in range(3):
        log.append(n, values(spark, [("a", str(n)), (f"k{n}", "1")]))
    assert log.generation() == 2 and [c["run"] for c in log.commits()] == [-1]
    assert log.record(1) is not None and not log.append(2, values(spark, [("z", "z")]))
    with pytest.raises(ValueError, match="merged"):
        log.newest(before=1)
    log.append(3, values(spark, [("k0", None)]))
    other = ChangeLog(spark, str(tmp_path / "log"), SCHEMA, ["k"])  # another session's view of the same files
    assert rows(other.newest(), "k", "value.v") == [("a", "2"), ("k1", "1"), ("k2", "1")]


def test_a_run_writes_its_changes_and_moves_the_snapshot_only(spark, tmp_path):
    base = str(tmp_path / "b")
    S.apply_fingerprints(prints(spark, 300), 0, base, 4)
    S.apply_fingerprints(prints(spark, 299, (3, 5)), 1, base, 4)
    log = S.state_log(spark, base)
    assert [c["rows"] for c in log.commits()] == [0, 300, 3]
    assert rows(spark.read.parquet(f"{base}/changes/run=1"), "path", "change_type") == [("f299", "deleted"), ("f3", "modified"), ("f5", "modified")]
    out = io.StringIO()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        snapshot = spark.createDataFrame([("0", "f0", (1, 1, "x", None))], S._STATE)
        with contextlib.redirect_stdout(out):
            log.compare(snapshot, F.lit(True)).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    plan = out.getvalue()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("FileScan")  # on the snapshot's side
    assert rows(S.stored_fingerprints(log).where("content_hash = 'y'"), "path", "run") == [("f3", 1), ("f5", 1)]


def test_equal_to_a_full_comparison(spark, tmp_path):
    base = str(tmp_path / "b")
    states = [prints(spark, 50), prints(spark, 40, range(0, 40, 7)), prints(spark, 60, range(10)), prints(spark, 0), prints(spark, 5)]
    S.import_fingerprints(S.state_log(spark, base, 4), states[0])
    for n in range(1, 5):
        S.apply_fingerprints(states[n], n, base, 4)
        want = X.detect_changes(states[n], states[n - 1])
        assert rows(spark.read.parquet(f"{base}/changes/run={n}"), "repo", "path", "change_type") == rows(want, "repo", "path", "change_type")
    assert rows(S.stored_fingerprints(S.state_log(spark, base)), "path") == rows(states[4], "path")


FILES = "snapshot bigint, repo string, relative_path string, size bigint, mtime bigint, content string"


def arrive(spark, base, n, items, marks=(), marked=True):
    df = spark.createDataFrame([(s, "r", p, 1, 0, c) for s, p, c in items] + [(s, None, None, k, None, None) for s, k in marks], FILES)
    df.write.parquet(f"{base}/in/{n}")
    S.run_snapshots(spark.readStream.schema(FILES).parquet(f"{base}/in/*"), base, marked=marked, buckets=2)


def test_a_snapshot_in_pieces_waits_for_its_mark(spark, tmp_path):
    base = str(tmp_path / "b")
    arrive(spark, base, 0, [(0, "a", "1"), (1, "a", "2")], [(0, 1)])
    arrive(spark, base, 1, [(2, "a", "3")], [(2, 1), (1, 2)])  # 1 lacks a row still, 2 waits for it
    log = S.state_log(spark, base)
    assert [log.record(n) is not None for n in range(3)] == [True, False, False]
    arrive(spark, base, 2, [(1, "b", "2")])
    assert [log.record(n) is not None for n in range(3)] == [True, True, True]
    assert rows(spark.read.parquet(f"{base}/changes/run=1"), "path", "change_type") == [("a", "modified"), ("b", "added")]
    assert rows(spark.read.parquet(f"{base}/changes/run=2"), "path", "change_type") == [("a", "modified"), ("b", "deleted")]
    inbox = Folder(spark, f"{base}/inbox")
    assert not [n for b in inbox.names() for n in inbox.names(b) if "=" in n]  # nothing waits any more


def test_closing_marks_count_the_rows(spark):
    df = spark.createDataFrame([(4, "r", "a", 1, 0, ""), (4, "r", "b", 1, 0, ""), (5, "r", "a", 1, 0, "")], FILES)
    assert rows(S.closing_marks(df), "snapshot", "size", "relative_path") == [(4, 2, None), (5, 1, None)]


def test_without_marks_a_snapshot_in_pieces_is_refused(spark, tmp_path):
    base = str(tmp_path / "b")
    arrive(spark, base, 0, [(0, "a", "1")], marked=False)
    with pytest.raises(Exception, match="closing marks"):
        arrive(spark, base, 1, [(0, "b", "1")], marked=False)
