"""What the physical plans must and must not contain."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from conftest import rows
from grovelark.operators import diff as X
from grovelark.operators import hierarchy as H
from grovelark.operators import predicates as B
from grovelark.operators import ranking as K
from grovelark.plans.catalogue import QUERIES


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


EAGER = ("cyclic", "ledgered", "quarantined", "component", "ring", "rerun", "analysed", "numbered_edges", "edge_display", "first_failed", "module_overview", "streamed", "bottom_up", "retried", "project_inputs", "api_document_parts")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(EAGER)))
def test_no_cross_product_and_no_single_task(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "BatchEvalPython"):
        assert word not in text


def test_scan_reads_and_filters_only_what_it_needs(spark, tmp_path):
    spark.createDataFrame([("r", "a.py", "a.py", 1, "x")], "repo string, relative_path string, name string, size bigint, content string").write.parquet(str(tmp_path / "f"))
    text = plan(B.keep_files(spark.read.parquet(str(tmp_path / "f")), max_file_size=102400).select("repo", "relative_path"))
    assert "LessThanOrEqual(size,102400)" in text and "ReadSchema: struct<repo:string,relative_path:string,name:string,size:bigint>" in text


def test_contents_are_hashed_before_the_shuffle(spark, small):
    files = QUERIES["fingerprints"](spark, small)
    assert "Exchange" not in plan(files)
    a = spark.range(5).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("relative_path"), F.col("id").alias("size"), F.col("id").alias("mtime"), F.lit("text").alias("content"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(X.detect_changes(X.fingerprints(a), X.fingerprints(a.where("id > 1"))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange") and "SortMergeJoin" in text
    for line in text.splitlines():
        if "Exchange" in line:
            assert "content#" not in line


def test_top_k_is_limited_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in plan(QUERIES["top_imports"](spark, small))


def test_positions_need_no_window_over_the_group(spark):
    df = spark.range(100).select(F.lit("hot").alias("g"), "id")
    assert "Window" not in plan(K.ordinal(df, ["g"], ["id"]))


def test_missing_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("x", 1, "c")], "g string, k int, t string")
    assert rows(K.ordinal(df, ["g"], ["k"]), "g", "t", "ordinal") == [("x", "c", 1), (None, "a", 1), (None, "b", 2)]
    assert rows(K.assemble(df, ["g"], ["k"], "t", ","), "g", "text") == [("x", "c"), (None, "a,b")]


def test_a_hot_directory_is_listed_in_full(spark):
    n = 3000
    files = spark.range(n).select(F.lit("r").alias("repo"), F.concat(F.lit("hot/f"), F.col("id"), F.lit(".py")).alias("relative_path"), F.lit(1).cast("bigint").alias("size"))
    listed = H.tree_listing(H.build_nodes(files))
    assert listed.count() == n + 2
    assert listed.agg(F.max("line_no"), F.count_distinct("line_no")).first() == (n + 2, n + 2)
    docs = files.select("repo", "relative_path", F.lit("d").alias("content"))
    parts = H.child_documents(H.build_nodes(files), docs)
    assert parts.where("dir = 'hot'").agg(F.sum("n_rows"), F.max("n_rows")).first() == (n, 256)
