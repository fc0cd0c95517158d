"""Benchmark passages in documents, as a prefix-filtered set join, with DataFrame functions only.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lowered. A *window* is ``window`` consecutive words of a
benchmark item, or the whole of a shorter item. A document holds a window if its words occur there one after another; all
words inside any occurrence are hit.

The sets joined are windows and documents as sets of word shingles. For a document to hold a window it must hold all of
the window's shingles, so a prefix of one shingle is necessary and enough to find it: the rarest one, counted over all
documents. The occurrences of benchmark shingles in documents are found first, in one pass that sends positions and hashes
only; the prefix then picks among them, the offset in the window and the number of words bound where a window can lie, and
the words themselves decide.

Results for odd input: texts that are null or have no word hit nothing; items without a word have no window; a null
``item_id`` is left out of the list of items; repeated rows get a row each; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, lower_az, pick, table, text_or_empty

WINDOW, SHINGLE = 13, 5
SMALL_ROWS = 1_000_000
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(lower_az(text), _BETWEEN), "")


def _hash(words: str, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(words, at + j) for j in range(width)])


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, first, size, passage, words)`` of every distinct window of every item."""
    items = benchmark.select("item_id", words(text_or_empty()).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    rows = items.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("first"))
    part = F.slice("words", F.col("first") + 1, F.lit(window))
    return rows.select("item_id", part.alias("words")).select("item_id", "words", F.size("words").alias("size"), F.array_join("words", " ").alias("passage")).distinct()


def window_shingles(held: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Every shingle of every window: ``(item_id, passage, size, width, offset, h)``; a window shorter than a shingle is one."""
    by_width = F.when(F.col("size") >= shingle, F.transform(F.sequence(F.lit(0), F.greatest(F.col("size") - shingle, F.lit(0))), lambda i: F.struct(F.lit(shingle).alias("width"), i.alias("offset"), _hash("words", i, shingle).alias("h"))))
    for w in range(shingle - 1, 0, -1):
        by_width = by_width.when(F.col("size") == w, F.array(F.struct(F.lit(w).alias("width"), F.lit(0).alias("offset"), _hash("words", F.lit(0), w).alias("h"))))
    return held.select("item_id", "passage", "size", F.explode(by_width).alias("s")).select("item_id", "passage", "size", "s.*")


def _shingles(width: int) -> Column:
    """Position and hash of every shingle of ``words``; none where the words are fewer."""
    last = F.size("words") - width
    each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("pos"), _hash("words", i, width).alias("h")))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def occurrences(docs: DataFrame, shingles: DataFrame, widths: list[int]) -> DataFrame:
    """``(doc_id, mark, n_words, pos, h)`` of the benchmark's shingles in documents, and a row with null ``pos`` per document."""
    each = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("bigint").alias("h")))
    for w in widths:
        each = F.concat(each, _shingles(w))
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), words("text").alias("words"))
    rows = rows.select("doc_id", "mark", F.size("words").alias("n_words"), F.explode(each).alias("e")).select("doc_id", "mark", "n_words", "e.*")
    return rows.join(broadcast_if_small(shingles.withColumnRenamed("h", "known"), SMALL_ROWS), F.col("h") == F.col("known"), "left").where("pos IS NULL OR known IS NOT NULL").drop("known")


def verify(words: Column, found: Column) -> Column:
    """Those of ``found (first, size, passage, item_id)`` whose passage the words spell."""
    return F.filter(found, lambda f: F.array_join(F.slice(words, f["first"] + 1, f["size"]), " ") == f["passage"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_words, n_hit, items)`` per row of ``docs (doc_id, text)``; ``items`` are the item ids as sorted strings."""
    held = cut(window_shingles(windows(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"), window), shingle))
    widths = sorted(r["width"] for r in held.select("width").distinct().collect())  # at most one per shingle length
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    seen = cut(occurrences(texts, cut(held.select("h").distinct()), widths))
    counts = seen.where("pos IS NOT NULL").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rarest = held.join(counts, "h", "left").groupBy("item_id", "passage", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "h")).alias("p"))
    prefix = cut(rarest.where("p.n > 0").select("item_id", "passage", "size", "p.offset", F.col("p.h").alias("key")))
    first = F.col("pos") - F.col("offset")
    found = seen.where("pos IS NOT NULL").join(broadcast_if_small(prefix, SMALL_ROWS), F.col("h") == F.col("key"))
    found = found.where((first >= 0) & (first + F.col("size") <= F.col("n_words")))
    found = cut(found.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.collect_set(F.struct(first.alias("first"), "size", "passage", "item_id")).alias("found")))
    marked = texts.withColumn("mark", F.xxhash64("text"))
    with_text = marked.join(broadcast_if_small(found, SMALL_ROWS // 10), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    checked = with_text.select("d", "m", "found", words("text").alias("words")).select("d", "m", verify(F.col("words"), F.col("found")).alias("ok"))
    covered = F.array_distinct(F.flatten(F.transform("ok", lambda f: F.sequence(f["first"], f["first"] + f["size"] - 1))))
    items = F.array_sort(F.array_distinct(F.filter(F.transform("ok", lambda f: f["item_id"]), lambda x: x.isNotNull())))
    hits = checked.where(F.size("ok") > 0).select("d", "m", F.size(covered).cast("bigint").alias("n_hit"), items.alias("items")).dropDuplicates(["d", "m"])
    rows = seen.where("pos IS NULL").join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    return rows.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items.alias("items_sha256"), contaminated().alias("contaminated"))


def oracle(docs: str = "documents", benchmark: str = "benchmark") -> str:
    """The same in SQL: every word of every document joined with every window's first word, then compared in full."""
    split = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, {split} AS w FROM {docs}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {split} AS w FROM {benchmark}),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[i : i + {WINDOW} - 1], ' ') AS passage
        FROM b, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
places AS (SELECT doc_id, i, s AS size, array_to_string(w[i : i + s - 1], ' ') AS passage
       FROM w, (SELECT DISTINCT size AS s FROM win), unnest(range(1, len(w) - s + 2)) AS t(i)),
hit AS (SELECT doc_id, i, places.size AS size, item_id FROM places JOIN win USING (size, passage)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + size)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)"""
