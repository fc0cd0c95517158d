"""Document fingerprints: bottom-k sketches of word-shingle hashes, with DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's shingles. Sketches of parts merge into
that of the whole (``merged``, and ``merge`` as an aggregate); two of them estimate resemblance and containment, one
estimates the number of distinct shingles. Below ``k`` shingles every estimate is exact.

Words are runs of other characters than white space (20, 09 to 0D), A-Z lowered. A text of fewer words than a shingle is one
shingle; a null or empty text has none and resembles only its like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import ordinal
from .common import lower_az, pick, table, text_or_empty

K, WIDTH = 128, 5
PER_BUCKET = 1000
_SPACE = "[\\x20\\x09-\\x0D]+"
_SPAN = 2.0**64


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(lower_az(text), _SPACE), "")


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """Hashes of ``width`` words from each place on; of all words if they are fewer; none without words.

    ``words`` should be a column or a variable: it is named for every shingle.
    """
    last = F.size(words) - width
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))).otherwise(
        F.array().cast("array<bigint>")
    )


def bottom(hashes: str | Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: str | Column, k: int = K, width: int = WIDTH) -> Column:
    """The sketch of a text column."""
    return let(words(text), lambda w: bottom(shingle_hashes(w, width), k))


def merged(a: str | Column, b: str | Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return bottom(F.concat(a, b), k)


def merge(df: DataFrame, by: list[str], name: str = "sketch", k: int = K) -> DataFrame:
    """The sketch of every group of parts: each group's ``k`` smallest distinct hashes, thinned per stretch of rows before
    they meet, so that a group of any size sends at most ``k`` hashes from each stretch."""
    each = df.select(*by, F.pmod(F.hash(name), F.lit(64)).alias("_stretch"), F.explode_outer(name).alias("_h")).groupBy(*by, "_stretch", "_h").count()
    w = Window.partitionBy(*by, "_stretch").orderBy(F.col("_h").asc_nulls_last())
    near = each.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return near.groupBy(*by).agg(bottom(F.collect_set("_h"), k).alias(name))


def resemblance(a: str | Column, b: str | Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two sketches: the share of both among the ``k`` smallest of either."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))

    def share(either: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(a, b), either))
        return F.when(F.size(either) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(either), F.lit(1)))

    return let(bottom(F.concat(a, b), k), share)


def distinct_count(a: str | Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    below = F.element_at(a, F.lit(k)).cast("double") / _SPAN + 0.5
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / below)


def containment(a: str | Column, b: str | Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    j = resemblance(a, b, k)
    both = j * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def as_text(a: str | Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.hex(h)), " ")


GUEST = 1 << 60


def placed(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, mark, …)`` with ``bucket`` and ``order``: rows by ascending ``doc_id``, dealt out in buckets.

    The row after another one in its bucket is the next by ``doc_id``. The first place of a bucket also visits the bucket
    before (that of the table's first row the last one) as a guest, with ``order`` ``GUEST``, to be filtered out in the end.
    Rows equal in ``doc_id`` and ``mark`` share a place and follow one another. Places are numbered on keys alone.
    """
    keys = ordinal(docs.select("doc_id", "mark").distinct(), [], ["doc_id", "mark"], "place")
    n = keys.count()
    rows = docs.join(keys.withColumnsRenamed({"doc_id": "_d", "mark": "_m"}), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("mark").eqNullSafe(F.col("_m")))
    at = F.col("place") - 1
    bucket, last = F.floor(at / PER_BUCKET), (max(n, 1) - 1) // PER_BUCKET
    own = F.struct(bucket.alias("bucket"), at.alias("order"))
    guest = F.struct(F.when(at == 0, F.lit(last)).otherwise(bucket - 1).alias("bucket"), F.lit(GUEST).cast("bigint").alias("order"))
    visits = F.when(at % PER_BUCKET == 0, F.array(own, guest)).otherwise(F.array(own))
    return rows.withColumn("visit", F.explode(visits)).select(*docs.columns, "visit.*")


def edited(text: Column, following: Column) -> Column:
    """The last half (rounded down) of ``text`` replaced by as much of the beginning of ``following``, or all of it."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(following, F.lit(1), half))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    rows = placed(docs.withColumn("mark", F.xxhash64("text")))
    in_order = Window.partitionBy("bucket").orderBy("order")
    rows = rows.select("doc_id", "bucket", "order", "text", F.lead("text").over(in_order).alias("next_text"))
    rows = rows.withColumn("own", sketch("text")).withColumn("next_own", F.lead("own").over(in_order)).where(F.col("order") < GUEST)
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("other"), "own", "next_own")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("other").cast("binary"), 256).alias("edited_sha256"), "own", sketch("other").alias("edit"), "next_own")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("edit").alias("edited_fingerprint"),
        resemblance("own", "edit").alias("near_edited"), resemblance("own", "next_own").alias("near_next"),
        distinct_count("own").alias("n_shingles"), containment("own", "edit").alias("contained_in_edited"),
    )
