"""Documents as tables and as trees of Markdown files."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import pystr as S
from .lister import list_corpus, with_contents


def write_documents(docs: DataFrame, path: str) -> None:
    """Append documents to a table laid out by repo."""
    docs.write.mode("append").partitionBy("repo").parquet(path)


def write_markdown(docs: DataFrame, folder: str, content: str = "content") -> None:
    """One file per ``(repo, doc_path)`` below ``folder``.

    Each file appears by a rename, so a repeated task leaves the same result.
    """

    def run(rows: Iterator[Row]) -> None:
        for r in rows:
            target = os.path.join(folder, r["repo"], r["doc_path"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{os.getpid()}.part"
            with open(part, "w", encoding="utf-8") as f:
                f.write(r[content] or "")
            os.replace(part, target)

    docs.select("repo", "doc_path", content).foreachPartition(run)


def read_markdown(roots: DataFrame, docs_root: str = "docs") -> DataFrame:
    """Documents of trees written by :func:`write_markdown`; ``roots(repo, root)``."""
    found = list_corpus(roots, (), (".md",), 1 << 40).where("node_type = 'file'")
    path = F.concat(F.lit(docs_root + "/"), "relative_path")
    return with_contents(found).select("repo", path.alias("doc_path"), S.text_of("content").alias("content"))
