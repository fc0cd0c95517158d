from __future__ import annotations

import fnmatch
import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grovelark.functions import fixed_values as V
from grovelark.functions import paths as P
from grovelark.functions import pystr as S
from grovelark.functions import scalars as N
from grovelark.functions.globs import ignore_regex
from grovelark.operators import endpoints as E
from grovelark.operators import predicates as B


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


TEXTS = ["", " a ", "　x \n", "a\tb", "\x1cq\x1f", "line\r\n", "a\nb\rc d\x0be\x85", "\n", "a\r\n\r\nb", "---", "-------"]


def test_strip(spark):
    assert apply(spark, TEXTS, S.strip) == [t.strip() for t in TEXTS]


def test_line_count(spark):
    assert apply(spark, TEXTS, S.line_count) == [len(t.splitlines()) for t in TEXTS]


def test_count_literal(spark):
    assert apply(spark, TEXTS, lambda c: S.count_literal(c, "---")) == [t.count("---") for t in TEXTS]


def test_is_blank(spark):
    assert apply(spark, [*TEXTS, None], S.is_blank) == [not t.strip() for t in TEXTS] + [True]


def test_title(spark):
    words = ["api2go", "data hub", "it's", "ABC def", "x1y é"]
    assert apply(spark, words, S.title) == [w.title() for w in words]


def test_text_of_drops_bad_bytes_but_keeps_a_real_replacement_mark(spark):
    raw = [b"ok\r\nx\ry", b"a\xffb", "�".encode(), b"\xe4\xbd"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, b binary")
    got = [r[0] for r in df.orderBy("i").select(S.text_of("b")).collect()]
    assert got == ["ok\nx\ny", "ab", "�", ""]


PATHS = ["", "a", "a/b", "a/b/c.py", "x/.hidden", "noext", "a/b.tar.gz", "A.PY"]


def test_paths(spark):
    assert apply(spark, PATHS, P.parent_of) == ["", "", "a", "a/b", "x", "", "a", ""]
    assert apply(spark, PATHS, P.name_of) == ["", "a", "b", "c.py", ".hidden", "noext", "b.tar.gz", "A.PY"]
    assert apply(spark, PATHS, P.depth_of) == [0, 1, 2, 3, 2, 1, 2, 1]
    assert apply(spark, PATHS, lambda c: P.extension_of(P.name_of(c))) == ["", "", "", ".py", "", "", ".gz", ".py"]
    assert apply(spark, ["a/b/c"], P.prefixes_of) == [["", "a", "a/b"]]
    assert apply(spark, ["a/b", "c\\d", "e/", "f"], P.last_segment) == ["b", "d", "e/", "f"]


def _ignored(path: str, is_dir: bool, patterns) -> bool:
    """The rule told step by step: any ancestor, then the path itself."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        rel, name = "/".join(parts[:n]), parts[n - 1]
        folder = is_dir if n == len(parts) else True
        if name.startswith("."):
            return True
        for p in patterns:
            if p.endswith(("/**", "/")):
                if folder and fnmatch.fnmatchcase(name, p.rstrip("/*")):
                    return True
            elif fnmatch.fnmatchcase(name, p):
                return True
            if fnmatch.fnmatchcase(rel, p):
                return True
    return False


SEGMENTS = st.sampled_from(["src", "build", "a.pyc", "x.egg-info", "dist", ".git", "b", "ab", "c1.tmp", "Thumbs.db", "venv"])
GLOBS = st.lists(st.sampled_from([*V.IGNORE_PATTERNS, "src/*.py", "a?", "[ab]/**", "src/b/**", "*b", "x/", "[!s]rc"]), max_size=6)


@settings(max_examples=400, deadline=None)
@given(st.lists(SEGMENTS, min_size=1, max_size=4), st.booleans(), GLOBS)
def test_ignore_regex_equals_the_rule(parts, is_dir, patterns):
    path = "/".join(parts)
    regex = re.compile(ignore_regex(patterns).replace(r"\z", r"\Z"))
    assert bool(regex.search(path + "/" if is_dir else path)) == _ignored(path, is_dir, patterns)


def test_ignore_in_spark(spark):
    names = ["src", "build", "a.pyc", "x.egg-info", ".git", "b.log", "m.py"]
    paths = ["/".join(p) for n in (1, 2, 3) for p in itertools.product(names, repeat=n)]
    got = apply(spark, paths, B.is_ignored)
    assert got == [_ignored(p, False, V.IGNORE_PATTERNS) for p in paths]


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://h/v1/", "https://h/v1"),
        ("https://h//v1//chat", "https://h/v1/chat"),
        ("https://h//other", "https://h//other"),
        ("", ""),
        ("http://h///", "http://h"),
    ],
)
def test_repair_base_url(spark, url, want):
    assert apply(spark, [url], N.repair_base_url) == [want]


def test_percentage(spark):
    df = spark.createDataFrame([(1, 3), (0, 0), (7, 5)], "c int, t int")
    assert [tuple(r) for r in df.select(N.percentage("c", "t"), N.capped_percentage("c", "t")).collect()] == [
        (33.3, 33.3), (0.0, 0.0), (140.0, 100.0)]


def test_module_and_group_names(spark):
    assert apply(spark, ["apiserver", "mqtt_tool", "", "voice", "myHandler", "tool", "data-hub"], E.module_display_name) == [
        "Api Server", "Mqtt  Tool", "其他", "Voice", "Myhandler", "Tool", "Data Hub"]
    assert apply(spark, ["apiserver", "root", "my_mod"], E.group_display_name) == ["API服务接口", "根目录接口", "My Mod接口"]


def test_normalise_endpoint(spark):
    given = ["get  /a", "MCP工具 switch(device1: int)", "single", "POST /x/{id} (old)", " GET /b "]
    assert apply(spark, given, E.normalise_endpoint) == ["GET /A", "MCP工具 SWITCH", "SINGLE", "POST /X/{ID} ", "GET /B "]


def test_title_of_mixed_scripts_and_replacement_characters(spark):
    texts = ["接口api", "用户auth_service", "ab1cd", "ÉCOLE été", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(S.title("t")).collect()] == [t.title() for t in texts]
    raw = ["a\ufffdb".encode() + b"\xff" + "c\ufffd\r\n".encode(), "ok\ufffd".encode(), b"\xc3(", b""]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "b binary")
    assert [r[0] for r in df.select(S.text_of("b")).collect()] == [b.decode("utf-8", "ignore").replace("\r\n", "\n") for b in raw]
