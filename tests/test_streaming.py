from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from conftest import rows
from grovelark.streaming import active, events, progress, snapshots

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


SCHEMA = "task_id bigint, ts timestamp, seq bigint, type string, file_path string, node_type string, depth int, current bigint, total bigint, error string"


def frame(spark, items):
    return spark.createDataFrame([(1, at(s), i, t, f, "file", 1, c, 10, e) for i, (s, t, f, c, e) in enumerate(items)], SCHEMA)


def test_first_terminal_event_decides_the_lifecycle(spark):
    df = frame(spark, [(0, "analysis_progress", "a", 1, None), (1, "analysis_started", None, 0, None), (5, "analysis_error", None, 0, "x"), (6, "analysis_complete", None, 0, None)])
    r = progress.lifecycle(df).first()
    assert (r["status"], r["started_at"], r["completed_at"]) == ("failed", at(1), at(5))
    s = progress.task_state(df).first()
    assert (s["status"], s["percentage"], s["error"]) == ("completed", 10.0, "x")


def test_level_start_resets(spark):
    df = frame(spark, [(0, "analysis_file_complete", "a", 0, None), (1, "analysis_started", None, 0, None), (2, "analysis_file_failed", "b", 0, None)])
    assert rows(progress.level_progress(df), "level_completed") == [(1,)]
    assert rows(progress.level_counters(df), "completed_files", "failed") == [(1, 1)]


def test_messages_round_trip(spark):
    one = spark.createDataFrame([("t", 3, 8, "f.py", "run", "/s", 5, 2, 1, 4, 0, {"k": "v"}, None)],
                                "task_id string, current bigint, total bigint, current_file string, status string, source_path string, total_files bigint, total_dirs bigint, depth int, completed bigint, failed bigint, stats map<string,string>, error string")
    when = F.lit("2024-01-01T00:00:00")
    sent = [b(one, when) for b in (events.started, events.progressed, events.level_completed, events.finished)]
    got = [json.loads(d.first()["value"]) for d in sent]
    assert [g["type"] for g in got] == ["analysis_started", "analysis_progress", "analysis_level_complete", "analysis_complete"]
    assert got[1]["data"] == {"task_id": "t", "current": 3, "total": 8, "percentage": 37.5, "current_file": "f.py", "status": "run"}
    back = events.from_messages(sent[1].unionByName(spark.createDataFrame([("t", "junk")], "task_id string, value string")))
    assert rows(back, "task_id", "type", "data.percentage") == [("t", "analysis_progress", 37.5)]


def test_event_files_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"type":"analysis_error","data":{"task_id":"t","error":"e"},"timestamp":"2024-01-01T00:00:01"}\n')
    stream = events.of_task(events.read_event_files(spark, str(tmp_path / "in")), "t")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "task_id", "data.error") == [("t", "e")]


def test_active_nodes_expire(spark, tmp_path):
    items = [[(0, "analysis_file_started", "a", 0, None), (1, "analysis_file_started", "b", 0, None)], [(30, "analysis_file_complete", "a", 0, None)],
             [(7200, "analysis_file_started", "c", 0, None)], [(7300, "analysis_file_started", "d", 0, None)]]
    for n, batch in enumerate(items):
        frame(spark, batch).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={n}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = active.track_active(stream, ttl_ms=60_000)
    q = out.writeStream.outputMode("update").foreachBatch(
        lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}")))
    q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "file_path", "state", "seconds")
    assert ("a", "active", 0.0) in got and ("a", "done", 30.0) in got and ("b", "expired", 60.0) in got
    assert ("a", "expired", 60.0) not in got


def test_snapshot_runs(spark, tmp_path):
    schema = "snapshot bigint, repo string, relative_path string, size bigint, mtime bigint, content string"
    base = str(tmp_path / "base")
    for n, items in enumerate([[("a", "1"), ("d/b", "1")], [("a", "2"), ("c", "1")], [("a", "2"), ("c", "1")]]):
        spark.createDataFrame([(n, "r", p, 1, 0, c) for p, c in items], schema).write.parquet(f"{base}/in/{n}")
        if n != 1:  # the second and third wait for one another and arrive together
            snapshots.run_snapshots(spark.readStream.schema(schema).parquet(f"{base}/in/*"), base)
    runs = [rows(spark.read.parquet(f"{base}/changes/run={n}"), "path", "change_type") for n in range(3)]
    assert runs == [[("a", "added"), ("d/b", "added")], [("a", "modified"), ("c", "added"), ("d/b", "deleted")], []]
    assert rows(spark.read.parquet(f"{base}/affected/run=1"), "node_type", "relative_path") == [
        ("directory", ""), ("directory", "d"), ("file", "a"), ("file", "c")]
    # a repeated run gives the same result
    again = spark.createDataFrame([("r", p, 1, 0, c) for p, c in [("a", "2"), ("c", "1")]], schema.partition(", ")[2])
    snapshots.apply_snapshot(again, 1, base)
    assert rows(spark.read.parquet(f"{base}/changes/run=1"), "path", "change_type") == runs[1]
