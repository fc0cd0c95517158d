from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from grovelark.functions import fixed_values as V
from grovelark.operators import diff as X
from grovelark.operators import documents as D
from grovelark.operators import endpoints as E
from grovelark.operators import enrichment as G
from grovelark.operators import graph as R
from grovelark.operators import hierarchy as H
from grovelark.operators import imports as I
from grovelark.operators import predicates as B
from grovelark.operators import ranking as K
from grovelark.operators import reconcile as C
from grovelark.operators import state as Z


def files_of(spark, paths, repo="r"):
    return spark.createDataFrame([(repo, p, 1) for p in paths], "repo string, relative_path string, size bigint")


# ------------------------------------------------------------ ranking


def test_ordinal_numbers_a_hot_group_across_ranges(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("g"), F.hash("id").alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = K.ordinal(df, ["g"], ["k", "id"])
        got = out.where("g = -1").select("k", "id", "ordinal").orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["ordinal"] for r in got] == list(range(1, 20_001))
    assert [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)
    assert out.where("g <> -1 and ordinal <> 1").isEmpty()


def test_assemble_splits_a_large_group_without_loss(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), "id", F.col("id").cast("string").alias("t"))
    for unique in (True, False):
        parts = K.assemble(df, ["g"], ["id"], "t", ",", 64, unique).orderBy("part").collect()
        assert ",".join(p["text"] for p in parts) == ",".join(map(str, range(1000)))
        assert max(p["n_rows"] for p in parts) == 64


# ------------------------------------------------------------ hierarchy


def test_prune_is_idempotent_and_keeps_the_root(spark):
    dirs = H.directories_of(files_of(spark, ["a/b/x.md", "c/y.py"]))
    alive = H.prune_empty(dirs, files_of(spark, ["c/y.py"]))
    assert rows(alive, "relative_path") == [("",), ("c",)]
    assert rows(H.prune_empty(alive, files_of(spark, ["c/y.py"]))) == rows(alive)
    assert rows(H.prune_empty(dirs, files_of(spark, [])), "relative_path") == [("",)]


def test_subtree_of_root_equals_tree_totals(spark):
    files = files_of(spark, ["a/b/x.py", "a/y.py", "z.py"])
    assert rows(H.subtree_totals(files).where("relative_path = ''"), "n_files") == rows(H.tree_totals(H.build_nodes(files)), "total_files")


def test_tree_listing_draws_the_tree(spark):
    nodes = H.build_nodes(files_of(spark, ["b.py", "A.py", "src/z.py", "src/sub/k.py", "lib/m.py"])).withColumn("status", F.lit("completed"))
    lines = [r["line"] for r in H.tree_listing(nodes).orderBy("line_no").collect()]
    assert lines == [
        "r/", "├── lib/", "│   └── m.py", "├── src/", "│   ├── sub/", "│   │   └── k.py", "│   └── z.py", "├── A.py", "└── b.py",
    ]
    marked = [r["line"] for r in H.tree_listing(nodes, show_status=True, max_depth=1).orderBy("line_no").collect()]
    assert marked == ["r/", "├── [+] lib/", "├── [+] src/", "├── [+] A.py", "└── [+] b.py"]


def test_display_names(spark):
    names = ["main.py", "__init__.py", "config.yaml", "app_config.py", "utils_a.py", "MY_TESTS.py", "plain.py", "config_utils.py"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(H.display_name("name")).collect()] == [
        "main.py [程序入口]", "__init__.py [包初始化]", "config.yaml [配置]", "app_config.py [配置]", "utils_a.py [工具函数]",
        "MY_TESTS.py [测试]", "plain.py", "config_utils.py [配置]"]


def test_document_paths(spark):
    df = spark.createDataFrame([("a/b.py", "file"), ("a", "directory"), ("", "directory")], "p string, t string")
    assert [r[0] for r in df.select(B.doc_path("p", "t")).collect()] == ["docs/a/b.py.md", "docs/a/_dir_summary.md", "docs/_dir_summary.md"]


# ------------------------------------------------------------ diff and state


def prints(spark, items):
    return spark.createDataFrame([("r", p, 1, 0, h, None) for p, h in items], "repo string, path string, size bigint, mtime bigint, content_hash string, last_analyzed timestamp")


def test_changes_add_up_and_upsert_reaches_the_new_snapshot(spark):
    old, new = prints(spark, [("a", "1"), ("b", "1"), ("c/d", "1")]), prints(spark, [("a", "1"), ("b", "2"), ("e/f", "1")])
    changes = X.detect_changes(new, old)
    assert rows(changes, "path", "change_type") == [("b", "modified"), ("c/d", "deleted"), ("e/f", "added")]
    nxt = X.upsert_fingerprints(old, changes, F.current_timestamp())
    assert rows(nxt, "path", "content_hash") == rows(new, "path", "content_hash")
    assert X.detect_changes(new, nxt).isEmpty()
    assert rows(X.affected_nodes(changes), "node_type", "relative_path") == [
        ("directory", ""), ("directory", "c"), ("directory", "e"), ("file", "b"), ("file", "e/f")]
    assert rows(X.detect_changes(new, prints(spark, [])), "change_type") == [("added",)] * 3


def test_unreadable_file_has_an_empty_hash(spark):
    df = spark.createDataFrame([("r", "a", 0, 0, None)], "repo string, relative_path string, size bigint, mtime bigint, content binary")
    assert rows(X.fingerprints(df), "content_hash") == [("",)]


def test_failed_after_completed_stays_completed(spark):
    log = spark.createDataFrame(
        [("r", "file", "a", "completed", 1), ("r", "file", "a", "failed", 2), ("r", "file", "b", "failed", 1), ("r", "file", "b", "completed", 2),
         ("r", "api_details", "a", "x", 1), ("r", "api_details", "a", None, 2)], "repo string, kind string, key string, value string, seq bigint")
    assert rows(Z.node_records(log), "relative_path", "completed", "failed", "status") == [("a", True, True, "failed"), ("b", True, False, "completed")]
    assert Z.stored_texts(log, "api_details").isEmpty()


def test_project_documents_are_not_file_documents(spark):
    docs = spark.createDataFrame([("r", p) for p in ["docs/README.md", "docs/a/README.md", "docs/a.py.md", "docs/_dir_summary.md", "docs/a/_dir_summary.md"]], "repo string, doc_path string")
    assert rows(Z.recover_from_documents(docs), "node_type", "relative_path") == [
        ("directory", ""), ("directory", "a"), ("file", "a.py"), ("file", "a/README")]
    assert rows(Z.recovered_flags(docs, F.lit(1)), "key") == [("readme",)]


# ------------------------------------------------------------ imports and graph


def code(spark, items):
    df = spark.createDataFrame([("r", p, c) for p, c in items], "repo string, relative_path string, content string")
    return df.withColumn("ext", F.lower(F.regexp_extract("relative_path", r"(\.[^./]+)$", 1)))


def test_parsers(spark):
    files = code(spark, [
        ("a.py", "import os, sys\n  import x.y as z\nfrom . import q\nfrom .m import n\n"),
        ("b.ts", "import type { A } from './t'\nimport {\n b } from \"c\"\nimport 's'\nconst r = require ( 'k' )"),
        ("C.java", "import static a.b.c;\nimport a.b.*;\n import a.b.C;\npublic class C extends D implements E, F {\n}"),
        ("d.go", 'import f "fmt"\nimport "os"\nimport (\n "a/b"\n c "d"\n)'),
        ("e.rs", "use x;"),
    ])
    assert rows(I.parse_edges(files), "source", "target", "dep_type", "detail") == sorted([
        ("a.py", "os", "import", None), ("a.py", "x.y", "import", None),
        ("a.py", ".", "import", None), ("a.py", ".m", "import", None),
        ("b.ts", "./t", "import", "import type { A } from './t'"), ("b.ts", "./t", "import", "type import"),
        ("b.ts", "s", "import", None), ("b.ts", "k", "import", None),
        ("C.java", "a.b.C", "import", None), ("C.java", "D", "extends", None),
        ("C.java", "E", "implements", None), ("C.java", "F", "implements", None),
        ("d.go", "os", "import", None), ("d.go", "a/b", "import", None), ("d.go", "d", "import", None),
    ], key=str)


def test_syntax_form_and_its_fallback(spark):
    files = code(spark, [
        ("a.py", "import os, sys as s\nfrom . import q\nfrom .m import n, o\ndef f():\n    import late\n"),
        ("bad.py", "import ok\nfrom p.q import r\ndef broken(:\n"),
    ])
    assert rows(I.parse_edges_by_syntax(files), "source", "target", "line", "level", "detail") == sorted([
        ("a.py", "os", 1, 0, "import os"), ("a.py", "sys", 1, 0, "import sys"), ("a.py", "q", 2, 1, "from  import q"),
        ("a.py", "m.n", 3, 1, "from m import n"), ("a.py", "m.o", 3, 1, "from m import o"), ("a.py", "late", 5, 0, "import late"),
        ("bad.py", "ok", None, 0, None), ("bad.py", "p.q", None, 0, None),
    ], key=str)


def test_resolution(spark):
    files = code(spark, [
        ("pkg/__init__.py", ""), ("pkg/a.py", "import pkg.b\nfrom pkg.b import name\nimport pkg\nimport os\nfrom . import b\nfrom ..top import z"),
        ("pkg/b.py", ""), ("top.py", ""), ("web/x.js", "import a from './y'\nimport b from '../lib'\nimport c from 'react'"),
        ("web/y.ts", ""), ("lib/index.js", ""),
    ])
    got = rows(I.resolve_targets(I.parse_edges_by_syntax(files), files), "source", "target", "resolved")
    assert got == sorted([
        ("pkg/a.py", "pkg.b", "pkg/b.py"), ("pkg/a.py", "pkg.b.name", "pkg/b.py"), ("pkg/a.py", "pkg", "pkg/__init__.py"),
        ("pkg/a.py", "os", None), ("pkg/a.py", "b", "pkg/b.py"), ("pkg/a.py", "top.z", "top.py"),
        ("web/x.js", "./y", "web/y.ts"), ("web/x.js", "../lib", "lib/index.js"), ("web/x.js", "react", None),
    ], key=str)
    literal = spark.createDataFrame([("r", "p", "top.py", "import", 0)], "repo string, source string, target string, dep_type string, level int")
    assert rows(I.resolve_targets(literal, files, "none"), "resolved") == [("top.py",)]


def _brute_cycles(edges, k):
    nxt = {}
    for a, b in edges:
        nxt.setdefault(a, set()).add(b)
    out = set()

    def walk(start, path):
        for b in nxt.get(path[-1], ()):
            if b == start:
                out.add(tuple([*path, start]))
            elif b > start and b not in path and len(path) < k:
                walk(start, [*path, b])

    for a in nxt:
        walk(a, [a])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles_equal_brute_force(spark, seed):
    import random

    rnd = random.Random(seed)
    edges = {(f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}") for _ in range(30)} | {("hub", f"n{i}") for i in range(9)} | {(f"n{i}", "hub") for i in range(0, 9, 2)}
    df = spark.createDataFrame([("r", a, b) for a, b in edges], "repo string, source string, target string")
    for k in (3, 5):
        got = R.cycles(df, k).collect()
        assert {tuple(r["cycle"]) for r in got} == _brute_cycles(edges, k)
        assert len(got) == len(_brute_cycles(edges, k))


# ------------------------------------------------------------ endpoints


def test_endpoint_lines(spark):
    text = "\n".join([
        "包含API接口: 是", "接口列表:", "- [POST] /download - 下载", "- [MCP工具] switch_devices(device1: int, device2: int) - 控制",
        "  - [GET] /api/users/{id} - 获取", "- `[GET] /api/sessions` → list", "- [GET] /api/user-list - all", "not - [GET] /x"])
    df = spark.createDataFrame([("r", "apiserver/s.py", text)], "repo string, source_file string, info_text string")
    assert rows(E.endpoints(df), "pos", "method", "path", "desc", "module") == [
        (2, "POST", "/download", "下载", "apiserver"), (3, "MCP工具", "switch_devices(device1: int, device2: int)", "控制", "apiserver"),
        (4, "GET", "/api/users/{id}", "获取", "apiserver"), (5, "GET", "/api/sessions", "list", "apiserver"),
        (6, "GET", "/api/user", "list - all", "apiserver")]
    assert ("GET", "/api/user-list", "all") in rows(E.endpoints(df, strict=False), "method", "path", "desc")


@pytest.mark.parametrize("text, has, info", [
    ("no block", False, None),
    ("<!-- API_START -->\n包含API接口: 否\n/api/\n<!-- API_END -->", False, None),
    ("<!-- API_START -->\n包含API接口：是\n<!-- API_END -->tail", True, "包含API接口：是"),
    ("x<!-- api_start --> see [GET] /a", True, "see [GET] /a"),
    ("<!-- API_START -->- 获取 name<!-- API_END -->", True, "- 获取 name"),
    ("<!-- API_START -->@GetMapping<!-- API_END -->", True, "@GetMapping"),
    ("<!-- API_START -->nothing here<!-- API_END -->", False, None),
])
def test_api_block(spark, text, has, info):
    df = spark.createDataFrame([(text,)], "content string")
    r = E.with_api_info(df).first()
    assert (r["has_api"], r["api_info"]) == (has, info)


def docs_of(spark, *texts):
    return spark.createDataFrame([("r", f"d{i}", t) for i, t in enumerate(texts)], "repo string, doc string, content string")


def test_overview_grammars(spark):
    docs = docs_of(
        spark,
        "| 序号 | 模块 | 方法 | 路径 |\n|--|--|--|--|\n| 1 | m | GET | /a |\n| 1 | m | GET | /dup |\n| 2 | m | POST | /b |\n",
        "| 方法 | 路径 |\n|---|---|\n| GET | /a |\n| GET | /a |\n",
        "- `GET /a`\n- the thing\n- POST /b\n",
        "nothing",
    )
    assert rows(E.overview_endpoints(docs), "doc", "api") == [
        ("d0", "GET /a"), ("d0", "POST /b"), ("d1", "GET /a"), ("d1", "GET /a"), ("d2", "GET /a"), ("d2", "POST /b")]


def test_usage_grammars(spark):
    far = "\n".join(["x"] * 49)
    docs = docs_of(
        spark,
        f"""## POST /schedule
**功能**: a
### MCP工具: switch_devices
**认证要求**：no
#### 接口1: [GET] /health
**功能描述**：b
### 接口2: get /api/sessions
**认证**: no
| 方法 | 路径 |
| GET | /health |
| PUT | /extra |
## GET /near
{far}
**功能**: c
### no path here at all!
**功能**: d
## GET /far
x
{far}
**功能**: late""",
    )
    assert rows(E.usage_endpoints(docs), "origin", "api") == sorted([
        ("heading", "POST /schedule"), ("heading", "MCP工具 switch_devices"), ("heading", "GET /health"),
        ("heading", "get /api/sessions"), ("heading", "GET /near"), ("heading", "no path"), ("table", "PUT /extra")], key=str)


def test_modules(spark):
    docs = docs_of(spark, "| GET | /before |\n### 2.1 核心\n| 方法 | 路径 |\n|---|---|\n| GET | /a |\n| GET | /a |\n### 辅助\n### 3 not one\n| GET | /c |\n"
                          "### 2.1 核心\n| PUT | /z |\n### 空\n text\n  ### 2.1.3 末\n| X | y |")
    assert rows(E.endpoints_by_module(docs), "module", "api") == sorted([("核心", "PUT /z"), ("辅助", "GET /c"), ("末", "X y")], key=str)


def test_heading_endpoints(spark):
    docs = docs_of(spark, "### GET /a\n#### POST /b x\n## PUT /no\n#### MCP工具: tool_a\n")
    assert rows(E.heading_endpoints(docs), "api") == [("GET /a",), ("MCP tool_a",), ("POST /b",)]


def test_multiset_difference_is_empty_iff_equal(spark):
    a, b = ["GET /a", "get /a", "X f(1)"], ["GET /A", "X f(2)"]
    la = spark.createDataFrame([("r", x) for x in a], "repo string, api string")
    lb = spark.createDataFrame([("r", x) for x in b], "repo string, api string")
    assert rows(C.multiset_difference(la, lb, ["repo"])) == [("r", "GET /A", 1, 0)]
    assert rows(C.report_lines(C.multiset_difference(la, lb, ["repo"])), "line") == [("GET /A (缺少 1 个)",)]
    assert C.multiset_difference(la, la, ["repo"]).isEmpty()
    assert rows(C.consistency(la, lb, ["repo"]), "n_overview", "n_usage", "consistent") == [(3, 2, False)]


def test_sections(spark):
    df = spark.createDataFrame([("r", "head\n## 一、快速开始\nrun\n## 三、错误处理\nerr\n## 四、调用示例\nex\n"), ("s", "## 二、X\n## 一、快速开始\nlast"), ("t", "## 三、其他\nz")], "repo string, c string")
    got = {r["repo"]: r for r in df.select("repo", D.quick_start("c").alias("q"), D.errors_and_examples("c").alias("e"), D.merged_quick_start("c").alias("m")).collect()}
    assert got["r"]["q"] == "## 一、快速开始\nrun" and got["r"]["e"] == "\n\n## 三、错误处理\nerr\n## 四、调用示例\nex"
    assert got["s"]["q"] == "## 一、快速开始\nlast" and got["s"]["e"] == V.ERRORS_DEFAULT
    assert got["t"]["q"] == V.QUICK_START_DEFAULT and got["t"]["m"] == V.QUICK_START_MERGED_DEFAULT


def test_filled_templates_do_not_expand_values(spark):
    df = spark.createDataFrame([("{b}", "x")], "a string, b string")
    assert df.select(D.filled("{a}-{b}-{a}", {"a": "a", "b": "b"})).first()[0] == "{b}-x-{b}"


# ------------------------------------------------------------ enrichment


def test_retry_rounds(spark, tmp_path):
    seen = str(tmp_path)

    def flaky(batch):
        import os

        out = []
        for k in batch["k"]:
            tries = len([f for f in os.listdir(seen) if f.startswith(f"{k}-")])
            open(os.path.join(seen, f"{k}-{tries}"), "w").close()
            out.append(f"ok {k}" if k == "a" or (k == "b" and tries >= 1) else "  ")
        return out

    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    out = G.run_with_retries(df, flaky, ["k"], max_retries=2)
    assert rows(out, "k", "attempt", "success", "summary", "error") == [
        ("a", 0, True, "ok a", None), ("b", 1, True, "ok b", None), ("c", 2, False, None, "blank output")]


def test_a_broken_run_asks_only_for_what_is_open(spark, tmp_path, monkeypatch):
    seen = tmp_path / "calls"
    seen.mkdir()

    def counted(batch):
        import uuid

        out = []
        for t in batch["text"]:
            (seen / f"{t}-{uuid.uuid4().hex}").touch()
            out.append(None if t == "bad" else t.upper())
        return out

    rows_ = spark.createDataFrame([(i, f"t{i % 12}" if i else "bad") for i in range(30)], "k int, text string")
    record, left = G._record, [3]

    def broken(calls, base):
        left[0] -= 1
        if left[0] < 0:
            raise RuntimeError("killed")
        record(calls, base)

    monkeypatch.setattr(G, "_record", broken)
    go = lambda version="1": G.run_with_ledger(rows_, counted, ["k"], str(tmp_path / "ledger"), version, max_retries=1, pieces=4)
    with pytest.raises(RuntimeError, match="killed"):
        go()
    monkeypatch.setattr(G, "_record", record)
    first = len(list(seen.iterdir()))
    out = go()
    asked = Counter(f.name.split("-")[0] for f in seen.iterdir())
    assert first >= 3 and asked.pop("bad") == 2 and set(asked.values()) <= {1, 2} and sum(asked.values()) <= 12 + 6  # the lost piece again
    assert rows(out.where("NOT success"), "k", "attempt", "error", "calls") == [(0, 1, "blank output", 2)]
    assert out.where("success").count() == 29 and out.agg(F.max("calls")).first()[0] == 2
    before = len(list(seen.iterdir()))
    assert go().count() == 30 and len(list(seen.iterdir())) == before  # nothing is open
    assert go("2").count() == 30 and len(list(seen.iterdir())) > before  # another function is asked again


def test_retry_delay(spark):
    df = spark.range(8).select(G.retry_delay("id").alias("d"), G.retry_delay("id", F.rand(1)).alias("j"))
    got = df.collect()
    assert [r["d"] for r in got] == [1, 2, 4, 8, 16, 32, 60, 60]
    assert all(r["d"] <= r["j"] <= r["d"] * 1.25 for r in got)


def test_staged_summaries_use_every_child(spark):
    parts = K.parts_of(
        spark.range(1, 41).select(F.lit("r").alias("repo"), F.lit("d").alias("relative_path"), F.lit("n").alias("name"), F.col("id").alias("ordinal"), F.concat(F.lit("x"), "id").alias("t")),
        ["repo", "relative_path", "name"], "t", "|", 4)
    fn = G.staged(lambda b: [str(t.count("x")) if "x" in t else str(sum(int(v) for v in t.split("\n\n---\n\n"))) for t in b["text"]], 4)
    assert rows(fn(parts)) == [("r", "d", "40")]


def test_how_far_below_its_heading_a_field_may_stand(spark):
    far, near = "\n".join(["text"] * 60), "**功能**: x"
    text = f"### GET /far\n{far}\n{near}\n### GET /none\n### GET /near\n{near}"
    df = spark.createDataFrame([("r", "d", text)], "repo string, doc string, content string")
    assert rows(E.usage_endpoints(df), "api") == [("GET /near",), ("GET /none",)]  # the next heading's field is within 50 lines
    assert rows(E.usage_endpoints(df, lookahead=None), "api") == [("GET /far",), ("GET /near",)]
    assert rows(E.usage_endpoints(df, lookahead=1), "api") == [("GET /near",)]


def test_event_lines(spark):
    lines = [
        "event: x", 'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"Hi \\"you\\""}}', "data: {bad",
        'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":""}}', 'data: {"type":"message_delta","delta":{"stop_reason":"end"}}',
        'data: {"type":"message_stop"}', "data: [DONE]", 'data: {"type":"message_stop"}']
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "request_id int, seq int, line string")
    chunks = G.decode_event_lines(df)
    assert rows(chunks, "seq", "content", "finish_reason") == [(1, 'Hi "you"', None), (4, None, "end"), (5, None, "stop")]
    assert rows(G.chunk_totals(chunks)) == [(1, "stop", 3)]


def test_brute_multiset(spark):
    left, right = ["a b", "a b", "c d"], ["a b", "e f"]
    la = spark.createDataFrame([("r", x) for x in left], "repo string, api string")
    lb = spark.createDataFrame([("r", x) for x in right], "repo string, api string")
    want = Counter(x.upper() for x in left)
    want.subtract(Counter(x.upper() for x in right))
    got = {r["key"]: r["missing"] - r["extra"] for r in C.multiset_difference(la, lb, ["repo"]).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_components_of_any_length(spark):
    ring = lambda p, n: [(f"{p}{i}", f"{p}{(i + 1) % n}") for i in range(n)]
    hub = [("hub", f"s{i}") for i in range(20)] + [(f"s{i}", "hub") for i in range(0, 20, 2)]
    tail = [("t0", "t1"), ("t1", "a0"), ("a2", "t2"), ("t2", "t3"), ("b1", "a1"), ("self", "self")]
    df = spark.createDataFrame([("r", *e) for e in ring("a", 4) + ring("b", 7) + hub + tail] + [("q", *e) for e in ring("a", 2)], "repo string, source string, target string")
    got = R.cyclic_components(df)
    want = [("r", "a0", 4, f"a{i}") for i in range(4)] + [("r", "b0", 7, f"b{i}") for i in range(7)] + [("r", "hub", 11, "hub")]
    want += [("r", "hub", 11, f"s{i}") for i in range(0, 20, 2)] + [("r", "self", 1, "self")] + [("q", "a0", 2, "a0"), ("q", "a0", 2, "a1")]
    assert rows(got, "repo", "component", "size", "node") == sorted(want, key=str)
    one = {(r["repo"], r["component"]): r["cycle"] for r in R.component_cycles(df, got).collect()}
    assert one[("r", "a0")] == ["a0", "a1", "a2", "a3", "a0"] and len(one[("r", "b0")]) == 8 and one[("r", "hub")] == ["hub", "s0", "hub"]
    assert one[("r", "self")] == ["self", "self"] and len(one) == 5
    assert R.cyclic_components(df.limit(0)).count() == 0


def test_repeated_documents_restore_a_node_once(spark):
    nodes = spark.createDataFrame([("r", "a.py", "file", "docs/a.py.md", "pending")], "repo string, relative_path string, node_type string, doc_path string, status string")
    log = spark.createDataFrame([("r", "file", "a.py", "completed", 1)], "repo string, kind string, key string, value string, seq bigint")
    docs = spark.createDataFrame([("r", "docs/a.py.md")] * 2, "repo string, doc_path string")
    assert rows(Z.restore_status(nodes, log, docs), "relative_path", "status") == [("a.py", "completed")]
