"""A corpus from ``documents`` to token files: quality, near duplicates, contamination, mixture, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; every stage but the last returns the
columns of its ``docs``, further ones included. ``run`` writes each result as Parquet below ``spark.checkpoint.dir`` and reads
it again, so a lost executor costs a part of one stage. Rows that share a ``doc_id`` are rejected together; rows without
one count as sharing one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelark.llm.common import broadcast_if_light, cut, pick, table, text_or_empty
from grovelark.llm.decontaminate import contaminated, contamination
from grovelark.llm.jaccard_join import similarity_join, with_smallest
from grovelark.llm.mixing import mix, mixable
from grovelark.llm.quality_lm import classify
from grovelark.llm.token_planes import default_tokenizer, encode_documents

#: Near duplicates: five words a shingle, four fifths of all shingles in common.
WIDTH, PERCENT = 5, 80


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    gone = cut(rejected.select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs["doc_id"].cast("bigint").eqNullSafe(gone["_gone"]), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity the quality model rejects go."""
    judged = classify(pick(docs, "doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return _without(docs, judged.where("NOT keep"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like documents the one with the smallest ``doc_id`` stays, and one of rows equal in ``doc_id`` and text.

    Documents without a word are like nothing and stay.
    """
    member, _ = similarity_join(pick(docs, "doc_id", "text"), WIDTH, PERCENT)
    first = F.col("component_id").eqNullSafe(F.col("doc_id"))
    ids = cut(with_smallest(member).groupBy(F.col("doc_id").alias("_id")).agg(F.max(first).alias("stays"), F.count(F.lit(1)).alias("n")))
    gone, twice = (broadcast_if_light(cut(ids.where(c).select("_id"))) for c in ("NOT stays", "stays AND n > 1"))  # fewer than stay: texts seldom have to move
    same_id = lambda ids: docs["doc_id"].cast("bigint").eqNullSafe(ids["_id"])
    once = docs.join(gone, same_id(gone), "left_anti").join(twice, same_id(twice), "left_anti")
    return once.unionByName(docs.join(twice, same_id(twice), "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark passages go."""
    found = contamination(pick(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where(contaminated()))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target weights, each at most once."""
    drawn = mix(mixable(pick(docs, "doc_id", "text", "lang", "source")), max_epochs=1).where("taken > 0")
    drawn = cut(drawn.select(F.col("doc_id").alias("_drawn"), F.col("mark").alias("_mark")).distinct())
    mark = F.xxhash64(text_or_empty())
    return docs.join(drawn, docs["doc_id"].cast("bigint").eqNullSafe(drawn["_drawn"]) & (mark == drawn["_mark"]), "left_semi")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in plane files: ``(doc_id, start, n_tokens, ids_crc32)`` read back from them."""
    return encode_documents(docs, default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The language model's perplexities can't be said in SQL; tests/llm runs every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
