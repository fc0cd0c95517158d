from __future__ import annotations

import json
import os

import pytest

from conftest import rows
from grovelark.functions import pystr as S
from grovelark.operators import state as Z
from grovelark.sources import document_files as DF
from grovelark.sources import durable, saved_state, trees
from grovelark.sources.lister import list_corpus, with_contents


@pytest.fixture
def tree(tmp_path):
    files = {
        "src/__init__.py": b"", "src/_priv/q.py": b"x = 1\r\n", "src/big.py": b"#" * 200, "src/edge.py": b"#" * 100,
        "node_modules/m/i.js": b"1", "a/b/build/o.py": b"1", "docs/readme.md": b"# no", ".git/c.py": b"1", "src/.h.py": b"1",
        "Main.PY": b"import \xff os\n", "x.egg-info/p.py": b"1", "run.log": b"1", "src/t.pyc": b"1",
    }
    for path, data in files.items():
        target = tmp_path / "tree" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    os.symlink(tmp_path / "tree", tmp_path / "tree" / "src" / "loop")
    return tmp_path / "tree"


def test_listing(spark, tree):
    roots = spark.createDataFrame([("r", str(tree)), ("gone", str(tree / "missing"))], "repo string, root string")
    found = list_corpus(roots, max_file_size=100, partitions=3)
    files = found.where("node_type = 'file'")
    assert rows(files, "repo", "relative_path", "size") == [
        ("r", "Main.PY", 12), ("r", "src/__init__.py", 0), ("r", "src/_priv/q.py", 7), ("r", "src/edge.py", 100)]
    assert rows(found.where("node_type = 'directory'"), "relative_path") == [("a",), ("a/b",), ("docs",), ("src",), ("src/_priv",)]
    read = with_contents(files)
    assert rows(read.where("size between 1 and 12").select("relative_path", S.text_of("content"))) == [
        ("Main.PY", "import  os\n"), ("src/_priv/q.py", "x = 1\n")]


def test_contents_of_a_vanished_file_are_null(spark, tree):
    df = spark.createDataFrame([("r", str(tree), "nope.py")], "repo string, root string, relative_path string")
    assert with_contents(df).first()["content"] is None


def test_fingerprint_state(spark, tmp_path):
    state = {"source_root": "/p", "last_scan_time": "2024-01-01T00:00:00", "version": "1.0", "fingerprints": {
        "a\\b.py": {"path": "a\\b.py", "size": 3, "mtime": 1.5, "content_hash": "h", "last_analyzed": "2024-01-02T03:04:05"},
        "c.py": {"path": "c.py", "size": 1, "mtime": 2.0, "content_hash": "k", "last_analyzed": None}}}
    path = tmp_path / "state.json"
    path.write_text(json.dumps(state))
    got = saved_state.load_fingerprints(spark, str(path), "r", "/p")
    assert rows(got, "path", "size", "content_hash") == [("a/b.py", 3, "h"), ("c.py", 1, "k")]
    assert saved_state.load_fingerprints(spark, str(path), "r", "/other").isEmpty()
    folder = saved_state.save_fingerprints(got, str(tmp_path / "snap"), 1)
    assert rows(spark.read.parquet(folder), "path", "content_hash") == [("a/b.py", "h"), ("c.py", "k")]


def test_checkpoint_import(spark, tmp_path):
    old = {"source_root": "/p", "completed_files": ["a\\b.py", "c.py"], "failed_files": ["c.py", "d.py"], "completed_dirs": [""],
           "readme_completed": True, "api_info_map": {"c.py": "- [GET] /x"}}
    path = tmp_path / "checkpoint.json"
    path.write_text(json.dumps(old))
    log = saved_state.load_checkpoint(spark, str(path), "r", "/p")
    saved_state.append_state(log, str(tmp_path / "log"))
    saved_state.append_state(log.limit(0), str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert rows(Z.node_records(back), "relative_path", "completed", "failed") == sorted(
        [("", True, False), ("a/b.py", True, False), ("c.py", True, True), ("d.py", False, True)], key=str)
    flags = {r["key"]: r["value"] for r in Z.current_state(back.where("kind = 'flag'")).collect()}
    assert flags == {"readme": "true", "reading_guide": "false", "api_doc": "false", "api_usage_doc": "false"}
    assert rows(Z.stored_texts(back, "api_info"), "key", "value") == [("c.py", "- [GET] /x")]


def test_markdown_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("r", "a.py.md", "# 你好\n"), ("r", "s/_dir_summary.md", "d"), ("q", "README.md", "x")], "repo string, doc_path string, content string")
    DF.write_markdown(docs, str(tmp_path / "md"))
    DF.write_markdown(docs, str(tmp_path / "md"))
    roots = spark.createDataFrame([(r, str(tmp_path / "md" / r)) for r in "rq"], "repo string, root string")
    back = DF.read_markdown(roots)
    assert rows(back, "repo", "doc_path", "content") == [
        ("q", "docs/README.md", "x"), ("r", "docs/a.py.md", "# 你好\n"), ("r", "docs/s/_dir_summary.md", "d")]
    recovered = Z.recover_from_documents(back)
    assert rows(recovered, "repo", "node_type", "relative_path") == [("r", "directory", "s"), ("r", "file", "a.py")]
    DF.write_documents(docs, str(tmp_path / "table"))
    assert rows(spark.read.parquet(str(tmp_path / "table")), "repo", "doc_path", "content") == rows(docs)


def test_trees(spark):
    tree = {"name": "r", "node_type": "directory", "relative_path": "", "depth": 0, "status": "pending", "children": [
        {"name": "a", "node_type": "directory", "relative_path": "a", "depth": 1, "children": [
            {"name": "b.py", "node_type": "file", "relative_path": "a/b.py", "depth": 2, "has_api": True, "api_info": "i"}]},
        {"name": "c.py", "node_type": "file", "relative_path": "c.py", "depth": 1}]}
    df = spark.createDataFrame([("r", json.dumps(tree)), ("bad", "{")], "repo string, json string")
    nodes = trees.flatten_trees(df)
    assert rows(nodes, "relative_path", "parent_path", "depth", "node_type", "has_api") == sorted([
        ("", "", 0, "directory", False), ("a", "", 1, "directory", False), ("a/b.py", "a", 2, "file", True), ("c.py", "", 1, "file", False)], key=str)
    assert json.loads(trees.node_json(nodes.where("depth = 2")).first()["json"])["api_info"] == "i"


def test_checkpoint_folder_comes_from_the_session(spark, tmp_path):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert durable.shared_dir(spark) == named
    assert durable.cut(spark.range(3)).count() == 3
    assert durable.fresh_dir(spark, "x").startswith(named)
