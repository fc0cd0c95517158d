from __future__ import annotations

from pyspark.sql import functions as F

from conftest import rows
from grovelark.functions import fixed_values as V
from grovelark.operators import enrichment as G
from grovelark.plans import api_documents, flows
from grovelark.plans.fold import fold_levels, standin_files
from grovelark.operators import hierarchy as H

def now():
    return F.lit("2024-01-01 00:00:00")


LOG = "repo string, kind string, key string, value string, seq bigint"
DOCS = "repo string, doc_path string, content string"


def corpus(spark, items):
    df = spark.createDataFrame([(r, p, c) for r, p, c in items], "repo string, relative_path string, content string")
    return df.withColumns({"name": F.substring_index("relative_path", "/", -1), "size": F.octet_length("content").cast("bigint")})


FILES = [("r", "a/x.py", "1\n2\n"), ("r", "a/b/y.py", "1"), ("r", "m.py", ""), ("s", "a/z.py", "1\n"), ("s", "t.py", "2")]


def test_fold_text(spark):
    files = corpus(spark, FILES)
    out = {(r["repo"], r["relative_path"], r["node_type"]): r for r in fold_levels(H.build_nodes(files), files.select("repo", "relative_path", "content"), now()).collect()}
    assert len(out) == 10 and {r["status"] for r in out.values()} == {"completed"}
    assert out["r", "a/x.py", "file"]["content"].endswith("---\n\n[模拟分析] 文件: a/x.py\n代码行数: 2")
    # header rule, separator and each child's own header rule are all counted
    assert out["r", "a", "directory"]["content"].endswith("[模拟总结] 目录: a\n子文档数: 3")
    assert out["r", "", "directory"]["doc_path"] == "docs/_dir_summary.md"
    assert "**目录路径**: `r`" in out["r", "", "directory"]["content"]


def test_fold_stops_a_repo_after_a_failed_level(spark):
    files = corpus(spark, FILES)

    def failing(df):
        return standin_files(df).withColumn("summary", F.when(F.col("relative_path") != "a/x.py", F.col("summary")))

    out = rows(fold_levels(H.build_nodes(files), files.select("repo", "relative_path", "content"), now(), failing), "repo", "relative_path", "status")
    assert [r for r in out if r[0] == "r"] == [("r", "a/b", "completed"), ("r", "a/b/y.py", "completed"), ("r", "a/x.py", "failed")]
    assert len([r for r in out if r[0] == "s"]) == 4


def test_empty_directory_is_skipped_but_documented(spark):
    nodes = spark.createDataFrame(
        [("r", "", "", "", 0, "directory"), ("r", "e", "", "e", 1, "directory")],
        "repo string, relative_path string, parent_path string, name string, depth int, node_type string")
    texts = spark.createDataFrame([], "repo string, relative_path string, content string")
    out = {r["relative_path"]: r for r in fold_levels(nodes, texts, now()).collect()}
    assert out["e"]["status"] == "skipped" and out["e"]["content"].endswith(V.EMPTY_DIR_TEXT)
    assert out[""]["status"] == "completed"


def test_analysis_resumes(spark, tmp_path):
    files = corpus(spark, [("r", "a/x.py", "<!-- API_START -->- [GET] /q - d<!-- API_END -->"), ("r", "b.py", "2")])
    log, docs = spark.createDataFrame([], LOG), spark.createDataFrame([], DOCS)

    def echo(df):
        return df.select("repo", "relative_path", F.col("content").alias("summary"))

    first = flows.analyse(files, log, docs, now(), 1, file_fn=echo)
    first["log"].write.parquet(str(tmp_path / "log"))
    first["documents"].select("repo", "doc_path", "content").write.parquet(str(tmp_path / "docs"))
    assert rows(first["api_info"], "key", "value") == [("a/x.py", "- [GET] /q - d")]
    log, docs = spark.read.parquet(str(tmp_path / "log")), spark.read.parquet(str(tmp_path / "docs"))
    docs = docs.where("doc_path <> 'docs/b.py.md'")

    def refuse_a(df):
        return df.select("repo", "relative_path", F.when(F.col("relative_path") != "a/x.py", F.lit("again")).alias("summary"))

    again = {r["relative_path"]: r["content"] for r in flows.analyse(files, log, docs, now(), 2, file_fn=refuse_a)["documents"].where("node_type = 'file'").collect()}
    assert again["b.py"].endswith("again") and "API_START" in again["a/x.py"]


def test_dependency_flow(spark):
    files = corpus(spark, [("r", "p/a.py", "import p.b\nimport os"), ("r", "p/b.py", "from p import a")]).withColumn("ext", F.lit(".py"))
    out = flows.dependencies(files, by_syntax=True)
    assert rows(out["cycles"], "cycle") == [(["p/a.py", "p/b.py", "p/a.py"],)]
    assert rows(out["totals"], "n_edges", "n_external") == [(3, 1)]
    assert rows(out["top_imports"], "module", "n", "rank") == [("os", 1, 2), ("p", 2, 1)]


def test_scan_flow_reads_trees(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.py").write_text("x")
    (tmp_path / "n.js").write_text("y")
    files = flows.corpus(spark.createDataFrame([("r", str(tmp_path))], "repo string, root string"))
    out = flows.scan(files)
    assert rows(out["totals"], "total_files", "total_dirs", "max_depth") == [(2, 2, 2)]
    assert rows(out["types"]) == [(".js", 1), (".py", 1)]
    assert [r["line"] for r in out["listing"].orderBy("line_no").collect()] == ["r/", "├── s/", "│   └── a.py", "└── n.js"]


def test_two_phase_documents(spark):
    docs = spark.createDataFrame([("r", "a.py", "<!-- API_START -->接口列表<!-- API_END -->"), ("r", "b.py", "x"), ("r", "c.py", "<!-- API_START -->接口列表<!-- API_END -->")], "repo string, relative_path string, content string")
    log = spark.createDataFrame([("r", "api_details", "c.py", "old", 1)], LOG)
    rows_, failed = api_documents.extract_details(docs, log, lambda b: [f"details of {p}" for p in b["source_file"]], "api_details", 2)
    assert rows(rows_, "key", "value", "seq") == [("a.py", "details of a.py", 2)] and failed.isEmpty()
    details = spark.createDataFrame([("r", "a.py", "A"), ("r", "c.py", "C")], "repo string, source_file string, details string")
    out = api_documents.summarise_details(details, lambda b: list(b["text"]))
    assert rows(out, "summary") == [("## 文件: a.py\n\nA\n\n---\n\n## 文件: c.py\n\nC",)]


def test_verify(spark):
    a = spark.createDataFrame([("r", "d", "| 1 | m | GET | /a | d | 否 |\n| 2 | m | GET | /b | d | 否 |\n")], "repo string, doc string, content string")
    b = spark.createDataFrame([("r", "d", "### GET /a\n**功能**: x\n")], "repo string, doc string, content string")
    out = flows.verify(a, b)
    assert rows(out["report"], "line") == [("GET /B (缺少 1 个)",)]
    assert rows(out["summary"], "consistent") == [(False,)]


def test_user_function_swap(spark):
    files = corpus(spark, FILES[:2])
    fn = lambda df: G.apply_text_function(df, lambda b: [c.upper() or "-" for c in b["relative_path"]], ["repo", "relative_path"]).select("repo", "relative_path", "summary")
    out = fold_levels(H.build_nodes(files), files.select("repo", "relative_path", "content"), now(), fn, G.staged(lambda b: [f"{len(t)}" for t in b["text"]]))
    got = {r["relative_path"]: r["content"] for r in out.where("node_type = 'file'").collect()}
    assert got["a/x.py"].endswith("A/X.PY")


def test_an_empty_corpus_folds_to_nothing(spark):
    files = spark.createDataFrame([], "repo string, relative_path string, name string, size bigint, content string")
    out = fold_levels(H.build_nodes(files), files.select("repo", "relative_path", "content"), now())
    assert out.count() == 0 and "content" in out.columns
