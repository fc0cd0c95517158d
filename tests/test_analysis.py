"""Runs after changes, whole runs, and runs that break off between stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from grovelark.operators import state as Z
from grovelark.plans import analysis, flows
from grovelark.plans.fold import standin_files
from grovelark.plans.stages import Stages, content_digest

LOG = "repo string, kind string, key string, value string, seq bigint"
DOCS = "repo string, doc_path string, content string"
API = "<!-- API_START -->\n包含API接口: 是\n接口列表:\n- [GET] /a/{n} - one\n- [POST] /b - two\n<!-- API_END -->"


def corpus(spark, items):
    df = spark.createDataFrame(items, "repo string, relative_path string, content string")
    return df.withColumns({"name": F.substring_index("relative_path", "/", -1), "size": F.octet_length("content").cast("bigint"), "mtime": F.lit(0).cast("bigint")})


def now(text="2024-01-01 00:00:00"):
    return F.lit(text)


def echo(files):
    return files.select("repo", "relative_path", F.col("content").alias("summary"))


OLD = [("r", "a/x.py", "1"), ("r", "a/b/y.py", "1"), ("r", "c/z.py", "1"), ("r", "c/d/w.py", "1\n2"), ("s", "m.py", "1")]


def test_only_what_is_made_from_something_else_is_made_again(spark):
    first = flows.rerun(corpus(spark, OLD), *Z.none_yet(spark), now())
    assert {r["folded"] for r in first["documents"].collect()} == {True}
    # y changes its line count, z its text but not its line count, w goes, q comes
    new = [("r", "a/x.py", "1"), ("r", "a/b/y.py", "1\n2"), ("r", "c/z.py", "9"), ("r", "c/q.py", "1"), ("s", "m.py", "1")]
    calls = []

    def counted(files):
        calls.append(rows(files, "relative_path"))
        return standin_files(files)

    again = flows.rerun(corpus(spark, new), first["fingerprints"], first["documents"], now("2025-05-05 00:00:00"), file_fn=counted)
    made = {(r["repo"], r["relative_path"]): r["folded"] for r in again["documents"].collect()}
    # a/b is made again, but says the same, so that a is not
    assert made == {("r", ""): True, ("r", "a"): False, ("r", "a/b"): True, ("r", "a/b/y.py"): True, ("r", "a/x.py"): False, ("r", "c"): True,
                    ("r", "c/q.py"): True, ("r", "c/z.py"): True, ("s", ""): False, ("s", "m.py"): False}
    assert calls == [[("a/b/y.py",), ("c/q.py",), ("c/z.py",)]]
    assert rows(again["removed"], "relative_path") == [("c/d",), ("c/d/w.py",)]
    assert rows(again["changes"], "path", "change_type") == [("a/b/y.py", "modified"), ("c/d/w.py", "deleted"), ("c/q.py", "added"), ("c/z.py", "modified")]
    full = flows.rerun(corpus(spark, new), *Z.none_yet(spark), now())
    stamped = lambda d: rows(d.select("repo", "relative_path", F.regexp_replace("content", "20\\d\\d-\\d\\d-\\d\\d", "")))
    assert stamped(again["documents"]) == stamped(full["documents"])


def test_a_change_that_leaves_a_document_as_it_was_goes_no_further_up(spark):
    first = flows.rerun(corpus(spark, OLD), *Z.none_yet(spark), now())
    new = [(r, p, "8" if p == "a/b/y.py" else c) for r, p, c in OLD]
    again = flows.rerun(corpus(spark, new), first["fingerprints"], first["documents"], now("2025-05-05 00:00:00"))
    assert rows(again["documents"].where("folded"), "relative_path") == [("a/b/y.py",)]
    assert rows(again["affected"], "relative_path") == [("",), ("a",), ("a/b",), ("a/b/y.py",)]


def test_failures_keep_their_text_until_they_are_mended(spark):
    files = corpus(spark, OLD)
    bad = lambda f: f.select("repo", "relative_path", F.when(F.col("relative_path") != "c/z.py", "ok").alias("summary"), F.when(F.col("relative_path") == "c/z.py", "no answer").alias("error"))
    log, docs = spark.createDataFrame([], LOG), spark.createDataFrame([], DOCS)
    first = flows.analyse(files, log, docs, now(), 1, file_fn=bad)
    assert rows(first["documents"].where("status = 'failed'"), "relative_path", "error") == [("c/z.py", "no answer")]
    assert rows(Z.failed_with_error(first["log"])) == [("r", "c/z.py", "file", "no answer")]
    docs = first["documents"].where("content IS NOT NULL").select("repo", "doc_path", "content")
    again = flows.analyse(files, first["log"], docs.unionByName(docs), now(), 2)  # every document twice
    assert again["documents"].count() == 11 and again["documents"].where("status = 'failed'").isEmpty()
    both = first["log"].unionByName(again["log"])
    assert Z.failed_with_error(both).isEmpty() and Z.stored_texts(both, "error").isEmpty()


def test_a_whole_run_and_its_gates(spark, tmp_path):
    files = corpus(spark, [("r", "api/x.py", API), ("r", "y.py", "1"), ("s", "z.py", "1"), ("t", "w.py", "bad")])
    fail = lambda f: f.select("repo", "relative_path", F.when(F.col("content") != "bad", F.col("content")).alias("summary"))
    out = analysis.analyse_all(files, spark.createDataFrame([], LOG), spark.createDataFrame([], DOCS), now(), 1, str(tmp_path / "run"), functions=analysis.Functions(file=fail))
    gates = {(r["repo"], r["kind"]): r["state"] for r in out["gates"].collect()}
    assert [gates["r", k] for k in analysis.KINDS] == ["written"] * 4
    assert [gates["s", k] for k in analysis.KINDS] == ["written", "written", "no endpoints", "no endpoints"]
    assert {gates["t", k] for k in analysis.KINDS} == {"stopped"}
    text = "".join(r["text"] for r in out["project_documents"].where("repo = 'r' AND kind = 'api_doc'").orderBy("block", "part").collect())
    assert "| 1 | Api | GET | /a/{n} | one | 否 |\n| 2 | Api | POST | /b | two | 否 |\n\n**接口总计：2 个**\n\n## 二、按模块分类" in text
    assert rows(out["verification"], "repo", "n_overview", "n_usage", "consistent") == [("r", 2, 0, False)]
    assert rows(out["failures"], "repo", "relative_path", "error") == [("t", "w.py", "blank output")]
    flags = Z.current_state(out["log"].where("kind = 'flag'"))
    assert set(rows(flags.where("value = 'true'"), "repo", "key")) == {("r", k) for k in analysis.KINDS} | {("s", "readme"), ("s", "reading_guide")}


def test_a_broken_run_goes_on_at_the_first_open_stage(spark, tmp_path):
    files = corpus(spark, [("r", "api/x.py", API), ("r", "y.py", "1")])
    log, docs = spark.createDataFrame([], LOG), spark.createDataFrame([], DOCS)
    calls = []

    def called(name, fn, broken=()):
        def run(*args):
            calls.append(name)
            if name in broken:
                raise RuntimeError(f"{name} is down")
            return fn(*args)

        return run

    def functions(broken=()):
        f = analysis.Functions
        return f(file=called("file", echo, broken), readme=called("readme", analysis.standin_readme, broken), guide=called("guide", analysis.standin_guide, broken), modules=called("modules", analysis.standin_modules, broken))

    def go(*broken):
        calls.clear()
        return analysis.analyse_all(files, log, docs, now(), 1, str(tmp_path / "run"), functions=functions(broken))

    for name, before in (("readme", ["file", "readme"]), ("modules", ["readme", "guide", "modules"])):
        with pytest.raises(RuntimeError, match="down"):
            go(name)
        assert calls == before
    out = go()
    assert calls == ["modules"] and rows(out["gates"].select("state").distinct()) == [("written",)]
    assert go()["gates"].count() == 4 and calls == []
    files = files.unionByName(corpus(spark, [("r", "new.py", "1")]))
    with pytest.raises(RuntimeError, match="down"):
        go("file")  # other input: nothing is used again


def test_digests_and_stages(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "n int, t string")
    same = content_digest(a.repartition(3))
    assert content_digest(a) == same
    assert len({same, content_digest(a.distinct()), content_digest(a.limit(0)), content_digest(a.toDF("n", "u")), content_digest(a.unionByName(a))}) == 5
    stages, made = Stages(spark, str(tmp_path)), []
    make = lambda: made.append(1) or a
    one = stages.run("s", [same, "v1"], make)
    assert one.made and rows(one.rows) == rows(a)
    assert not stages.run("s", [same, "v1"], make).made and stages.run("s", [same, "v2"], make).made and len(made) == 2
    assert stages.run("t", [one], make).digest != stages.run("t", [same], make).digest


def test_a_whole_run_reads_the_endpoint_notes_once(spark, tmp_path, monkeypatch):
    calls, real = [], flows.run_log
    monkeypatch.setattr(flows, "run_log", lambda *given: calls.append(1) or real(*given))
    files = corpus(spark, [("r", "a.py", API)])
    out = analysis.analyse_all(files, spark.createDataFrame([], LOG), spark.createDataFrame([], DOCS), now(), 1, str(tmp_path / "run"), functions=analysis.Functions(file=echo))
    assert len(calls) == 1 and out["documents"].count() == 2
