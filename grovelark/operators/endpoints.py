"""API endpoints read from per-file notes and from project documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import paths as P
from ..functions import pystr as S


def api_block(text: Column | str) -> Column:
    """The endpoint notes inside a document, stripped; null when there are none.

    A block without an end mark runs to the end of the text.
    """
    t = S.col(text)
    closed, opened = S.matches(t, V.API_BLOCK, "si"), S.matches(t, V.API_BLOCK_OPEN, "si")
    return F.when(closed, S.strip(S.extract(t, V.API_BLOCK, 1, "si"))).when(
        opened, S.strip(S.extract(t, V.API_BLOCK_OPEN, 1, "si"))
    )


def has_api(block: Column | str) -> Column:
    """Ordered tests on an endpoint block: stated no, stated yes, then hints."""
    b = S.col(block)
    says_no = reduce(lambda x, y: x | y, [F.contains(b, F.lit(w)) for w in V.API_NO])
    says_yes = reduce(lambda x, y: x | y, [F.contains(b, F.lit(w)) for w in V.API_YES])
    hints = F.contains(b, F.lit(V.API_LIST_WORD)) | S.matches(b, V.API_BRACKET) | S.matches(b, V.API_LIST_ITEM)
    routes = S.matches(b, "|".join(V.API_ROUTES), "i")
    return F.when(b.isNull() | says_no, False).when(says_yes, True).otherwise(hints | routes)


def with_api_info(docs: DataFrame, text: str = "content") -> DataFrame:
    """Add ``has_api`` and ``api_info`` to documents."""
    found = docs.withColumn("_block", api_block(text))
    found = found.withColumn("has_api", has_api("_block"))
    return found.withColumn("api_info", F.when(F.col("has_api"), F.col("_block"))).drop("_block")


def module_of(source_file: Column | str) -> Column:
    p = P.normalise(source_file)
    return P.first_segment(p, P.stem_of(P.name_of(p)))


def _endpoint_array(info: Column, strict: bool) -> Column:
    pattern = S.rx(V.ENDPOINT_LINE if strict else V.ENDPOINT_LINE_HYPHEN)
    lines = F.transform(F.split(info, "\n"), lambda s, i: F.struct(i.alias("pos"), S.strip(s).alias("line")))
    hits = F.filter(lines, lambda s: s["line"].rlike(pattern))
    return F.transform(
        hits,
        lambda s: F.struct(
            s["pos"].alias("pos"),
            *[S.strip(F.regexp_extract(s["line"], pattern, g)).alias(n) for g, n in ((1, "method"), (2, "path"), (3, "desc"))],
        ),
    )


def endpoints(infos: DataFrame, strict: bool = True) -> DataFrame:
    """Endpoint rows of ``(repo, source_file, info_text)``, with line position.

    ``strict`` keeps the usual grammar, where a path ends at its first hyphen;
    ``strict=False`` lets hyphens be part of a path.
    """
    return infos.select(
        "repo", "source_file", module_of("source_file").alias("module"),
        F.inline(_endpoint_array(F.col("info_text"), strict)),
    )


def endpoint_key(method: Column | str = "method", path: Column | str = "path") -> Column:
    return F.concat_ws(" ", S.col(method), S.col(path))


def module_display_name(module: Column | str) -> Column:
    m = F.translate(S.col(module), "_-", "  ")
    lower = (m == F.lower(m)) & (m != F.upper(m))
    suffix = rf"^(.+?)({'|'.join(V.MODULE_SUFFIXES)})\z"
    split = F.when(lower & (F.length(m) > 5), F.regexp_replace(m, f"(?s){suffix}", "$1 $2")).otherwise(m)
    return F.when(F.coalesce(S.col(module), F.lit("")) == "", F.lit(V.OTHER_MODULE)).otherwise(S.title(split))


def group_display_name(group: Column | str) -> Column:
    g = S.col(group)
    names = F.create_map(*[F.lit(x) for kv in V.GROUP_NAMES.items() for x in kv])
    plain = F.concat(S.title(F.translate(g, "_-", "  ")), F.lit(V.GROUP_SUFFIX))
    return F.coalesce(F.element_at(names, g), plain)


def normalise_endpoint(api: Column | str) -> Column:
    """Upper-case ``METHOD PATH`` with the path cut at ``(``."""
    up = F.upper(S.col(api))
    two = r"(?s)^\s*(\S+)\s+(\S.*)$"
    path = F.substring_index(S.extract(up, two, 2), "(", 1)
    return F.when(S.matches(up, two), F.concat_ws(" ", S.extract(up, two, 1), path)).otherwise(up)


# ------------------------------------------------------- project documents


def _grouped(text: Column, pattern: str, groups: dict[str, int], flags: str) -> Column:
    """Array of structs: one per match, with the named groups and its number."""
    arrays = [S.extract_all(text, pattern, g, flags).alias(n) for n, g in groups.items()]
    return F.arrays_zip(*arrays)


def overview_endpoints(docs: DataFrame) -> DataFrame:
    """Endpoints listed by an overview document: ``(…key, pos, api)``.

    Numbered rows first, the first row of each number counts; a document
    without any is read as two-column rows, and failing that as list items.
    Input ``(repo, doc, content)``.
    """
    c = F.col("content")

    def shaped(matches: Column, number: Column | None = None) -> Column:
        return F.transform(
            matches,
            lambda r, i: F.struct(
                (r["num"] if number is None else F.lit(None).cast("string")).alias("num"), i.alias("pos"),
                S.strip(r["method"]).alias("method"), S.strip(r["path"]).alias("path"),
            ),
        )

    none = F.lit(None)
    numbered = F.filter(
        shaped(_grouped(c, V.OVERVIEW_ROW, {"num": 1, "method": 3, "path": 4}, "m")),
        lambda r: (r["method"] != "") & (r["path"] != ""),
    )
    rows = F.filter(
        shaped(_grouped(c, V.OVERVIEW_SIMPLE, {"method": 1, "path": 2}, "m"), none),
        lambda r: ~r["method"].isin(*V.OVERVIEW_SKIP_METHOD) & ~F.startswith(r["method"], F.lit("-"))
        & ~r["path"].isin(*V.OVERVIEW_SKIP_PATH) & ~F.startswith(r["path"], F.lit("-")),
    )
    items = F.filter(
        shaped(_grouped(c, V.OVERVIEW_LIST, {"method": 1, "path": 2}, ""), none),
        lambda r: ~F.lower(r["method"]).isin(*V.OVERVIEW_SKIP_WORDS),
    )
    by_form = docs.select("repo", "doc", numbered.alias("a"), rows.alias("b"), items.alias("c"))
    chosen = F.when(F.size("a") > 0, F.col("a")).when(F.size("b") > 0, F.col("b")).otherwise(F.col("c"))
    # rows without a number are all kept: their position stands in for it
    slot = F.coalesce(F.col("num"), F.concat(F.lit("@"), F.col("pos")))
    return (
        by_form.select("repo", "doc", F.inline(chosen))
        .groupBy("repo", "doc", slot.alias("_slot"))
        .agg(F.min("pos").alias("pos"), F.min_by(endpoint_key(), "pos").alias("api"))
        .drop("_slot")
    )


def _described_heading(lookahead: int | None) -> str:
    """A heading line with a function or auth field in one of the next ``lookahead`` lines, or before the next heading for None.

    The look-ahead walks whole lines and never gives one back, so a document
    is read in one linear pass.
    """
    line = r"[^\S\n]*(?:#{2,4})[^\S\n]+(\S.*)$"
    other = r"(?![^\S\n]*#{2,4}[^\S\n])" if lookahead is None else ""
    times = "*?" if lookahead is None else f"{{0,{lookahead - 1}}}?"
    below = rf"(?=(?:\n{other}[^\n]*+){times}\n{other}[^\n]*?(?:{V.USAGE_META}))"
    return f"^{line}{below}"


def usage_endpoints(docs: DataFrame, lookahead: int | None = V.USAGE_LOOKAHEAD) -> DataFrame:
    """Endpoints described by a usage document: ``(…key, origin, pos, api)``.

    A heading counts when a function or auth field follows within the next ``lookahead`` lines, whatever headings lie between,
    as the usual grammar has it; with None it may be any number of lines, up to the next heading. Table rows count unless a
    heading already names them.
    """
    c = F.col("content")

    def parsed(text: Column, i: Column) -> Column:
        method, path = F.lit(""), F.lit("")
        for pattern, flags in ((V.USAGE_PLAIN, ""), (V.USAGE_NUMBERED, "i"), (V.USAGE_BRACKET, "")):
            first = S.extract(text, pattern, 1, flags)
            method = F.when(first != "", S.strip(first)).otherwise(method)
            path = F.when(first != "", S.strip(S.extract(text, pattern, 2, flags))).otherwise(path)
        return F.struct(F.lit("heading").alias("origin"), i.alias("pos"), method.alias("method"), path.alias("path"))

    def trimmed(r: Column, i: Column) -> Column:
        return F.struct(
            F.lit("table").alias("origin"), i.alias("pos"), S.strip(r["method"]).alias("method"), S.strip(r["path"]).alias("path")
        )

    heads = F.transform(F.transform(S.extract_all(c, _described_heading(lookahead), 1, "m"), S.strip), parsed)
    table = F.filter(
        F.transform(_grouped(c, V.USAGE_TABLE, {"method": 1, "path": 2}, "m"), trimmed),
        lambda r: ~F.lower(r["method"]).isin(*V.USAGE_SKIP_METHOD) & ~F.startswith(r["method"], F.lit("-"))
        & ~F.lower(r["path"]).isin(*V.USAGE_SKIP_PATH) & ~F.startswith(r["path"], F.lit("-")),
    )
    found = F.filter(F.concat(heads, table), lambda r: (r["method"] != "") & (r["path"] != ""))
    rows = docs.select("repo", "doc", F.inline(found)).select("repo", "doc", "origin", "pos", endpoint_key().alias("api"))
    # the mentions of one endpoint in one document meet; a heading silences the table rows
    met = rows.groupBy("repo", "doc", F.upper("api").alias("_key")).agg(
        F.bool_or(F.col("origin") == "heading").alias("_named"), F.collect_list(F.struct("origin", "pos", "api")).alias("_all")
    )
    kept = F.filter("_all", lambda r: (r["origin"] == "heading") | ~F.col("_named"))
    return met.select("repo", "doc", F.inline(kept))


def _line_of(pattern: str) -> str:
    """Body of an anchored line pattern, for use inside a look-ahead."""
    return pattern.removeprefix("^").removesuffix("$").replace("(.+)", r"[^|\n]+").replace(r"([^\d#].*)", r"[^\d#|\n][^|\n]*")


def endpoints_by_module(docs: DataFrame) -> DataFrame:
    """Endpoints under each module heading: ``(…key, module, pos, api)``.

    The text is cut in front of every module heading, so a section carries its
    own heading and no running state is needed. A repeated heading replaces
    the earlier section; a section without endpoints leaves no trace.
    """
    edge = rf"(?dUm)^(?=[^\S\n]*(?:{_line_of(V.MODULE_NUMBERED)}|{_line_of(V.MODULE_PLAIN)})$)"

    def endpoint(line: Column) -> Column:
        return F.struct(
            S.strip(S.extract(line, V.MODULE_ROW, 1)).alias("method"), S.strip(S.extract(line, V.MODULE_ROW, 2)).alias("path")
        )

    def section(text: Column, i: Column) -> Column:
        first = S.strip(F.substring_index(text, "\n", 1))
        numbered, plain = S.extract(first, V.MODULE_NUMBERED, 1), S.extract(first, V.MODULE_PLAIN, 1)
        is_head = F.startswith(first, F.lit("###")) & ~F.contains(first, F.lit("|"))
        lines = F.filter(F.transform(F.split(text, "\n"), S.strip), lambda x: S.matches(x, V.MODULE_ROW))
        rows = F.filter(
            F.transform(lines, endpoint),
            lambda r: ~r["method"].isin(*V.MODULE_SKIP_METHOD) & ~F.startswith(r["method"], F.lit("-"))
            & ~r["path"].isin(*V.MODULE_SKIP_PATH) & ~F.startswith(r["path"], F.lit("-")),
        )
        return F.struct(
            i.alias("section"),
            F.when(is_head, S.strip(F.when(numbered != "", numbered).otherwise(plain))).alias("module"),
            F.array_distinct(F.transform(rows, lambda r: endpoint_key(r["method"], r["path"]))).alias("apis"),
        )

    sections = F.transform(F.split("content", edge), section)
    real = F.filter(sections, lambda x: (x["module"] != "") & (F.size(x["apis"]) > 0))
    newest = (
        docs.select("repo", "doc", F.inline(real))
        .groupBy("repo", "doc", "module").agg(F.max_by("apis", "section").alias("apis"))
    )
    return newest.select("repo", "doc", "module", F.posexplode("apis").alias("pos", "api"))


def heading_endpoints(docs: DataFrame) -> DataFrame:
    """Distinct endpoints named by verb headings and tool headings."""
    c = F.col("content")
    verbs = F.transform(
        _grouped(c, V.HEADING_VERB, {"method": 1, "path": 2}, "m"), lambda r: F.concat_ws(" ", r["method"], r["path"])
    )
    tools = F.transform(S.extract_all(c, V.HEADING_TOOL, 1, "mi"), lambda n: F.concat(F.lit("MCP "), n))
    return docs.select("repo", "doc", F.explode(F.array_distinct(F.concat(verbs, tools))).alias("api")).distinct()


def listed_count(apis: DataFrame) -> DataFrame:
    return apis.groupBy("repo", "doc").agg(F.count(F.lit(1)).alias("n"))
