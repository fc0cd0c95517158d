"""Documents assembled from rows, and sections cut out of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import paths as P
from ..functions import pystr as S
from ..sources.durable import cut
from . import endpoints as E
from .ranking import assemble, ordinal, parts_of

# ------------------------------------------------------------ headers


def file_document(generated_at: Column, summary: Column | str = "summary") -> Column:
    return F.format_string(
        "# 文件分析: %s\n\n**源文件**: `%s`\n**生成时间**: %s\n\n---\n\n%s",
        F.col("name"), F.col("relative_path"), generated_at, S.col(summary),
    )


def dir_document(generated_at: Column, summary: Column | str = "summary") -> Column:
    """Needs ``file_count`` and ``dir_count``; the root is shown by its name."""
    shown = F.when(F.col("relative_path") == "", F.col("name")).otherwise(F.col("relative_path"))
    return F.format_string(
        "# 目录分析: %s\n\n**目录路径**: `%s`\n**子文件数**: %d\n**子目录数**: %d\n**生成时间**: %s\n\n---\n\n%s",
        F.col("name"), shown, F.col("file_count"), F.col("dir_count"), generated_at, S.col(summary),
    )


def without_time(content: Column | str) -> Column:
    """A file's or directory's document without the time it was generated at."""
    return F.regexp_replace(S.col(content), r"(?m)^\*\*生成时间\*\*: .*\n", "")


def project_document(kind: Column | str, project: Column | str, content: Column | str, generator: str, generated_at: Column) -> Column:
    """Header by kind, content, and a footer naming the generator."""
    k, name = S.col(kind), S.col(project)
    header = (
        F.when(k == "reading_guide", F.concat(F.lit("# "), name, F.lit(" - 文档阅读顺序指南\n\n> 本指南帮助你按照合理的顺序阅读项目文档，快速理解项目结构和核心逻辑。\n\n---\n\n")))
        .when(k == "api_doc", F.concat(F.lit("# "), name, F.lit(" - API接口清单\n\n> 本文档列出项目的所有API接口及其功能描述。\n> 注意：本文档仅包含接口清单，不包含详细的请求/响应示例。\n\n---\n\n")))
        .otherwise(F.lit(""))
    )
    footer = F.concat(F.lit(f"\n\n---\n\n*本文档由 {generator} 自动生成*\n*生成时间: "), generated_at, F.lit("*\n"))
    return F.concat(header, S.col(content), footer)


# ------------------------------------------------------------ overview table


def overview_rows(apis: DataFrame) -> DataFrame:
    """Numbered table rows over (source file, line): ``(repo, ordinal, line)``.

    The parsed endpoints are written first, so that sorting them does not parse
    the texts again.
    """
    num = ordinal(cut(apis), ["repo"], ["source_file", "pos"])
    line = F.format_string(
        "| %d | %s | %s | %s | %s | " + V.AUTH_DEFAULT + " |",
        F.col("ordinal"), E.module_display_name("module"), F.col("method"), F.col("path"), F.col("desc"),
    )
    return num.select("repo", "ordinal", line.alias("line"))


def overview_frame(repos: DataFrame, apis: DataFrame) -> DataFrame:
    """Text around the rows per repo: head, total line, or the fixed empty text."""
    n = apis.groupBy("repo").agg(F.count(F.lit(1)).alias("total"))
    return repos.join(n, "repo", "left").fillna(0, ["total"]).select(
        "repo", "total",
        F.when(F.col("total") > 0, F.lit("\n".join(V.OVERVIEW_HEAD))).otherwise(F.lit(V.OVERVIEW_EMPTY)).alias("head"),
        F.when(F.col("total") > 0, F.format_string(V.OVERVIEW_TOTAL, "total")).alias("foot"),
    )


def numbered_list(apis: DataFrame, group: list[str], order: list[str], rows_per_part: int = 256) -> DataFrame:
    """``1. METHOD /path`` lines as ordered parts."""
    num = ordinal(cut(apis), group, order, "n").withColumn("line", F.format_string("%d. %s", "n", "api"))
    return parts_of(num, group, "line", "\n", rows_per_part, "n")


# ------------------------------------------------------------ details


def combined_details(details: DataFrame, rows_per_part: int = 256) -> DataFrame:
    """All per-file details of a repo: titled, in path order, as parts."""
    titled = details.withColumn("text", F.concat(F.lit("## 文件: "), "source_file", F.lit("\n\n"), "details"))
    return assemble(titled, ["repo"], ["source_file"], "text", V.DOC_SEPARATOR, rows_per_part)


def group_of(source_file: Column | str) -> Column:
    return P.first_segment(P.normalise(source_file), F.lit("root"))


def grouped_details(details: DataFrame, rows_per_part: int = 256) -> DataFrame:
    """Details by first directory: ``(repo, group, heading, part, text, n_rows)``.

    Groups are numbered in name order. Numbering runs over the distinct groups
    of a repo, never over its files.
    """
    rows = details.withColumn("group", group_of("source_file"))
    names = ordinal(rows.select("repo", "group").distinct(), ["repo"], ["group"], "n").select(
        "repo", "group", F.format_string("\n### 2.%d %s\n", F.col("n"), E.group_display_name("group")).alias("heading")
    )
    noted = rows.withColumn("text", F.concat(F.lit("\n> 来源: `"), "source_file", F.lit("`\n\n"), "details", F.lit("\n\n")))
    return assemble(noted, ["repo", "group"], ["source_file"], "text", "\n", rows_per_part).join(names, ["repo", "group"])


def endpoint_totals(apis: DataFrame) -> DataFrame:
    """Endpoints per repo; documents of every size are assembled from parts."""
    return apis.groupBy("repo").agg(F.count(F.lit(1)).alias("total"))


# ------------------------------------------------------------ sections


def _after(text: Column, marker: str) -> Column:
    """From the first marker to the end, or null."""
    at = F.instr(text, F.lit(marker))
    return F.when(at > 0, F.substring(text, at, F.length(text)))


def quick_start(common: Column | str, default: str = V.QUICK_START_DEFAULT) -> Column:
    t = S.col(common)
    start = F.instr(t, F.lit(V.QUICK_START))
    ends = [F.nullif(F.instr(t, F.lit(m)), F.lit(0)) for m in V.QUICK_START_ENDS]
    ends = [F.when(e > start, e) for e in ends]
    stop = F.coalesce(F.least(*ends), F.length(t) + 1)
    body = S.strip(F.substring(t, start, stop - start))
    return F.when((start > 0) & (body != ""), body).otherwise(F.lit(default))


def errors_and_examples(common: Column | str, default: str = V.ERRORS_DEFAULT) -> Column:
    t = S.col(common)
    tail = F.coalesce(_after(t, V.ERRORS), _after(t, V.EXAMPLES))
    return F.coalesce(F.concat(F.lit("\n\n"), S.strip(tail)), F.lit(default))


def merged_quick_start(common: Column | str) -> Column:
    """Quick start up to the error or example section; else the opening lines."""
    t = S.col(common)
    start = F.instr(t, F.lit(V.QUICK_START))
    errors, examples = F.instr(t, F.lit(V.ERRORS)), F.instr(t, F.lit(V.EXAMPLES))
    stop = F.when(errors > 0, errors).when(examples > 0, examples).otherwise(F.length(t) + 1)
    body = S.strip(F.when(stop > start, F.substring(t, start, stop - start)).otherwise(F.lit("")))
    opening = S.strip(F.regexp_replace(t, r"(?ms)^## [三四].*\z", ""))
    starts_there = t.rlike(r"\A## [三四]")
    fallback = F.when(starts_there, F.lit(V.QUICK_START_MERGED_DEFAULT)).otherwise(opening)
    return F.when((start > 0) & (body != ""), body).otherwise(fallback)


def module_section(text: Column | str) -> Column:
    """The per-module part of an endpoint document, or null."""
    t = S.col(text)
    return F.when(S.matches(t, V.MODULE_SECTION, "si"), S.extract(t, V.MODULE_SECTION, 1, "si"))


def assembled_api_document(project: Column | str, summary_table: Column | str, written: Column | str) -> Column:
    """Generated table first, then the module part of the written text, or all of it."""
    rest = module_section(written)
    head = F.concat(F.lit("# "), S.col(project), F.lit(" API接口文档\n\n"), S.col(summary_table))
    return F.when(rest.isNotNull(), F.concat(head, F.lit("\n"), rest)).otherwise(F.concat(head, F.lit("\n\n"), S.col(written)))


def module_sequence(modules: DataFrame) -> DataFrame:
    """Modules in the fixed order, unknown ones after by name: ``(repo, module, n)``."""
    order = F.create_map(*[x for i, m in enumerate(V.MODULE_ORDER) for x in (F.lit(m), F.lit(i))])
    ranked = modules.withColumn("_rank", F.coalesce(F.element_at(order, F.col("module")), F.lit(len(V.MODULE_ORDER))))
    return ordinal(ranked, ["repo"], ["_rank", "module"], "n").drop("_rank")


def merged_modules(module_docs: DataFrame) -> DataFrame:
    """Module documents under numbered headings: ``(repo, n, module, text)``."""
    text = F.concat(F.format_string("\n### 2.%d %s\n", "n", "module"), F.lit("\n"), "content")
    return module_sequence(module_docs).select("repo", "n", "module", text.alias("text"))


def module_counts(apis: DataFrame) -> DataFrame:
    """Overview lines of all modules: the fixed order first, others after them by name."""
    n = apis.groupBy("repo", "module").agg(F.count(F.lit(1)).alias("total"))
    return module_sequence(n).withColumn("line", F.format_string("- %s: %d 个", "module", "total"))


def filled(template: str, fields: dict[str, Column | str]) -> Column:
    """A template with ``{name}`` fields replaced by columns.

    The template is split around its fields first, so a value that itself
    contains ``{…}`` is never expanded again.
    """
    pieces: list[str | Column] = [template]
    for name, value in fields.items():
        mark, out = "{" + name + "}", []
        for piece in pieces:
            if not isinstance(piece, str):
                out.append(piece)
                continue
            texts = piece.split(mark)
            out.append(texts[0])
            for text in texts[1:]:
                out.extend([F.coalesce(S.col(value).cast("string"), F.lit("")), text])
        pieces = out
    parts = [F.lit(p) if isinstance(p, str) else p for p in pieces]
    return reduce(lambda a, b: F.concat(a, b), parts)
