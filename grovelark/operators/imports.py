"""Import and inheritance edges taken from source text."""

from __future__ import annotations

import ast
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import paths as P
from ..functions import pystr as S
from ..sources.durable import cut
from .skew import split_join

_EDGE = "struct<target:string,dep_type:string,line:int,level:int,detail:string>"


def _edge(target: Column, dep_type: str, detail: Column | None = None) -> Column:
    empty = F.lit(None)
    return F.struct(
        target.alias("target"),
        F.lit(dep_type).alias("dep_type"),
        empty.cast("int").alias("line"),
        F.lit(0).alias("level"),
        (empty if detail is None else detail).cast("string").alias("detail"),
    )


def _found(text: Column, pattern: str, dep_type: str = "import", flags: str = "", detail: str | None = None) -> Column:
    fixed = None if detail is None else F.lit(detail)
    return F.transform(S.extract_all(text, pattern, 1, flags), lambda t: _edge(t, dep_type, fixed))


def python_edges(text: Column) -> Column:
    """Line-anchored form; targets are modules only."""
    return F.concat(_found(text, V.PY_IMPORT, flags="m"), _found(text, V.PY_FROM, flags="m"))


def javascript_edges(text: Column) -> Column:
    whole = S.extract_all(text, V.JS_FROM, 0)
    named = F.zip_with(whole, S.extract_all(text, V.JS_FROM, 1), lambda d, t: _edge(t, "import", d))
    return F.concat(named, _found(text, V.JS_BARE), _found(text, V.JS_REQUIRE))


def typescript_edges(text: Column) -> Column:
    return F.concat(javascript_edges(text), _found(text, V.TS_TYPE, detail="type import"))


def java_edges(text: Column) -> Column:
    lists = S.extract_all(text, V.JAVA_IMPLEMENTS, 1)
    names = F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, ","), S.strip)))
    return F.concat(
        _found(text, V.JAVA_IMPORT, flags="m"),
        _found(text, V.JAVA_EXTENDS, "extends"),
        F.transform(names, lambda t: _edge(t, "implements")),
    )


def go_edges(text: Column) -> Column:
    blocks = S.extract_all(text, V.GO_BLOCK, 1, "s")
    inner = F.flatten(F.transform(blocks, lambda b: S.extract_all(b, V.GO_QUOTED, 1)))
    return F.concat(_found(text, V.GO_SINGLE), F.transform(inner, lambda t: _edge(t, "import")))


Parser = Callable[[Column], Column]

#: extension → column expression giving an array of edges
PARSERS: dict[str, Parser] = {
    ".py": python_edges,
    ".js": javascript_edges,
    ".jsx": javascript_edges,
    ".ts": typescript_edges,
    ".tsx": typescript_edges,
    ".java": java_edges,
    ".go": go_edges,
}


def parse_edges(files: DataFrame, parsers: dict[str, Parser] = PARSERS) -> DataFrame:
    """Edges of all files in one pass, each file by the parser of its extension."""
    by_parser: dict[Parser, list[str]] = {}
    for ext, parser in parsers.items():
        by_parser.setdefault(parser, []).append(ext)
    found = F.lit(None).cast(f"array<{_EDGE}>")
    for parser, exts in by_parser.items():
        found = F.when(F.col("ext").isin(*exts), parser(F.col("content"))).otherwise(found)
    return files.where(F.col("ext").isin(*parsers)).select("repo", F.col("relative_path").alias("source"), F.inline(found))


def _syntax_edges(text: str) -> list[dict] | None:
    """Imported names of one Python text, or None when it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out = []
    for node in ast.walk(tree):
        if not isinstance(node, (ast.Import, ast.ImportFrom)):
            continue
        whole = isinstance(node, ast.Import)
        base = "" if whole else node.module or ""
        for alias in node.names:
            out.append({
                "target": ".".join(filter(None, (base, alias.name))),
                "dep_type": "import",
                "line": node.lineno,
                "level": 0 if whole else node.level,
                "detail": f"import {alias.name}" if whole else f"from {base} import {alias.name}",
            })
    return out


def _syntax_batch(texts: pd.Series) -> pd.Series:
    return texts.map(_syntax_edges)


def parse_edges_by_syntax(files: DataFrame) -> DataFrame:
    """As :func:`parse_edges`, with Python files read by their syntax tree.

    One edge per imported name with line and detail; a file that does not parse
    falls back to the pattern form. Only the edges come back from Python.
    """
    read = F.pandas_udf(_syntax_batch, f"array<{_EDGE}>")
    py = files.where(F.col("ext") == ".py").select("repo", F.col("relative_path").alias("source"), "content")
    found = py.withColumn("found", read("content"))
    from_py = found.select("repo", "source", F.inline(F.coalesce("found", python_edges(F.col("content")))))
    others = {k: v for k, v in PARSERS.items() if k != ".py"}
    return from_py.unionByName(parse_edges(files, others))


# ---------------------------------------------------------------- resolution

_SCRIPT_ENDINGS = ("", ".js", ".jsx", ".ts", ".tsx", ".vue", "/index.js", "/index.ts")


def _collapse(path: Column) -> Column:
    """Resolve ``.`` and ``..`` steps."""
    return F.array_join(
        F.reduce(
            F.split(path, "/"),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s.isin("", "."), acc)
            .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.array_append(acc, s)),
        ),
        "/",
    )


def _ascend(folder: Column, steps: Column) -> Column:
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - steps, F.lit(0))), "/")


def _under(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def _candidates(lang: Column, scope: Column, level: Column, target: Column, dep_type: Column) -> Column:
    """Possible file paths of a target, best first."""
    parts = F.split(target, r"\.")
    n = F.size(parts)
    base = F.when(level > 0, _ascend(scope, level - 1)).otherwise(F.lit(""))
    modules = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.transform(
                F.array(F.lit(".py"), F.lit("/__init__.py")),
                lambda end: F.concat(_under(base, F.array_join(F.slice(parts, F.lit(1), n - i), "/")), end),
            ),
        )
    )
    near = _collapse(F.concat_ws("/", scope, target))
    scripts = F.transform(F.array(*[F.lit(e) for e in _SCRIPT_ENDINGS]), lambda e: F.concat(near, e))
    none = F.array().cast("array<string>")
    return (
        F.when(lang == ".py", modules)
        .when(lang.isin(".js", ".jsx", ".ts", ".tsx", ".vue"), F.when(F.startswith(target, F.lit(".")), scripts).otherwise(none))
        .when((lang == ".java") & (dep_type == "import"), F.array(F.concat(F.replace(target, F.lit("."), F.lit("/")), F.lit(".java"))))
        .when(lang == ".java", F.array(F.concat(_under(scope, target), F.lit(".java"))))
        .when(lang == ".go", F.array(F.concat(target, F.lit(".go"))))
        .otherwise(none)
    )


def resolve_targets(edges: DataFrame, files: DataFrame, resolve: str = "paths") -> DataFrame:
    """Add ``resolved``: the file a target stands for, or null when it is external.

    ``resolve="none"`` only accepts a target that equals a file path literally.
    Each distinct (target, scope) is looked up once, so a module imported by a
    large share of all files costs one row here.
    """
    known = files.select("repo", F.col("relative_path").alias("resolved")).distinct()
    if resolve == "none":
        same = known.withColumn("target", F.col("resolved"))
        return edges.join(same, ["repo", "target"], "left")
    edges = cut(edges)  # used twice: the texts are parsed once
    source, target = F.col("source"), F.col("target")
    lang = P.extension_of(P.name_of(source))
    level = F.coalesce(F.col("level"), F.lit(0))
    local = (level > 0) | F.startswith(target, F.lit(".")) | (F.col("dep_type") != "import")
    keyed = edges.withColumns(
        {"_lang": lang, "_scope": F.when(local, P.parent_of(source)).otherwise(F.lit("")), "_level": level}
    )
    key = ["repo", "_lang", "_scope", "_level", "target", "dep_type"]
    tried = keyed.select(*key).distinct().select(
        *key,
        F.posexplode(_candidates(F.col("_lang"), F.col("_scope"), F.col("_level"), target, F.col("dep_type"))).alias("_rank", "resolved"),
    )
    best = cut(tried.join(known, ["repo", "resolved"]).groupBy(*key).agg(F.min_by("resolved", "_rank").alias("resolved")))
    return split_join(keyed, best, key, "left").drop("_lang", "_scope", "_level")
