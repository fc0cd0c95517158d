"""Quality by the perplexity of a modified Kneser-Ney model of trusted text.

Trusted rows (labelled good and not toxic) train one character model per language, counted over all of them but a fifth,
which calibrates the thresholds. Scoring joins counts, not whole models: texts are dealt into blocks of one language and a
bounded size; a block's distinct grams of every order are joined with the sharded model table; each block then scores its
own texts with the rows that came back. No task holds a model, and what is joined grows with the text.

A document is kept if its bits per character lie between its language's quantiles among the calibration rows, widened by
``slack`` times their distance from the median. Too many bits is text unlike any trusted one, too few is repetition. Short
texts are first drawn towards the median as if ``prior_chars`` more characters cost what the median does.

A language with fewer than ``least`` calibration rows has too few for quantiles of its own: it takes those of all languages' rates
relative to their medians, with a spread of at least ``spread``,
and a floor no higher than the rate of any of its trusted rows. Its median is that of its calibration rows, or of all its texts if it
has none. A language without a model is scored by one of all trusted text.

Results for odd input: null and empty texts cost nothing, have no perplexity and are not kept; a null language is one of its
own; with no trusted text to train on, or none to calibrate, texts are kept; repeated rows get a row each; several labels of a document count if all trust it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, pick, table, text_or_empty
from .kneser_ney import Scorer, codes_of, count_grams, distinct, gram_hashes, hashed, smooth, stretches

ORDER, BLOCK_CHARS = 5, 32_000_000
LOW, HIGH, SLACK, PRIOR_CHARS, LEAST, SPREAD = 0.05, 0.95, 3.0, 100.0, 30, 0.05
#: The label of the model of all trusted text.
POOL = "\x00"
SMALL_ROWS = 4_000_000


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of rows that every label calls good and not toxic."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")).where("good").select("doc_id")


def _held() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """Model table ``(label, key, alpha, gamma)`` of the trusted rows that do not calibrate."""
    texts = docs.join(trusted, "doc_id", "left_semi").where(~_held()).where("text <> ''")
    return cut(hashed(smooth(count_grams(texts, order), order)))


def blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A ``block`` for every row: texts of one label, about ``block_chars`` characters, chosen by the row's own hash."""
    sums = cut(docs.groupBy("label").agg(F.ceil(F.sum(F.length("text")) / block_chars).cast("bigint").alias("n_blocks")))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.col("n_blocks"), F.lit(1)))
    return docs.join(broadcast_if_small(sums, 10_000), "label").select("doc_id", "label", "text", block.alias("block"))


def packed(dealt: DataFrame) -> DataFrame:
    """``(label, block, packet)``: the rows that a task has of a block as one compressed column batch.

    Texts compress about twice as well together as row by row, and they are the bulk of what moves.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (label, block), rows in b.groupby(["label", "block"], sort=False):
                batch = pa.record_batch({"doc_id": pa.array(rows["doc_id"].tolist(), pa.int64(), from_pandas=True), "text": pa.array(rows["text"].tolist(), pa.large_string())})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch)
                yield pd.DataFrame({"label": [label], "block": [block], "packet": [sink.getvalue().to_pybytes()]})

    return dealt.select("label", "block", "doc_id", F.col("text")).mapInPandas(pack, "label string, block bigint, packet binary")


def _opened(packets: pd.DataFrame) -> Iterator[tuple[list[int | None], list[str]]]:
    for p in packets["packet"]:
        t = pa.ipc.open_stream(p).read_all()
        yield t["doc_id"].to_pylist(), t["text"].to_pylist()


def score(docs: DataFrame, model: DataFrame, order: int = ORDER, block_chars: int = BLOCK_CHARS, pooled: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, label, n_chars, bits)`` per row of ``docs (doc_id, label, text)``; ``bits`` is null without a model.

    Labels in ``pooled`` are scored by the model labelled ``POOL``.
    """

    def grams(packets: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros(1, np.uint64)]
        for _, texts in _opened(packets):
            for _, _, places, whole in stretches(texts, order):
                h = gram_hashes(codes_of(whole), order)
                _, where = distinct(h[order], places)
                found += [pd.unique(h[k][where - d]) for k in range(1, order + 1) for d in ((0, 1) if k < order else (0,))]
            if len(found) > 200:
                found = [pd.unique(np.concatenate(found))]
        keys = pd.unique(np.concatenate(found))
        return pd.DataFrame({"label": packets["label"].iloc[0], "block": packets["block"].iloc[0], "key": keys.view(np.int64)})

    def bits(packets: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        scorer = Scorer.of(rows, [rows["label"].iloc[0]], order) if len(rows) else None
        out = []
        for ids, texts in _opened(packets):
            cost = scorer.log2_sums(texts)[:, 0] if scorer else None
            out.append(pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "label": packets["label"].iloc[0], "n_chars": [len(t) for t in texts], "bits": cost}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "label": [], "n_chars": [], "bits": []})

    dealt = packed(blocks(docs, block_chars))
    wanted = dealt.groupBy("label", "block").applyInPandas(grams, "label string, block bigint, key bigint")
    by = F.when(F.col("label").isin(*pooled), F.lit(POOL)).otherwise(F.col("label")) if pooled else F.col("label")
    rows = model.select(F.col("label").alias("by"), "key", F.col("alpha").cast("float").alias("alpha"), F.col("gamma").cast("float").alias("gamma"))
    found = wanted.withColumn("by", by).join(rows, ["by", "key"]).drop("by")
    return dealt.groupBy("label", "block").cogroup(found.groupBy("label", "block")).applyInPandas(bits, "doc_id bigint, label string, n_chars bigint, bits double")


def thresholds(scored: DataFrame, trusted: DataFrame, low: float = LOW, high: float = HIGH, slack: float = SLACK, prior_chars: float = PRIOR_CHARS, least: int = LEAST, spread: float = SPREAD) -> DataFrame:
    """``(label, middle, floor, ceiling)`` of every label, from the calibration rows."""
    scored = scored.where("n_chars > 0 AND bits IS NOT NULL")
    held = cut(scored.where(_held()).join(trusted, "doc_id", "left_semi"))
    median = F.percentile_approx(F.col("bits") / F.col("n_chars"), F.lit(0.5), F.lit(10_000)).alias("middle")
    middle = cut(held.groupBy("label").agg(median, F.count(F.lit(1)).alias("n")))
    rate = (F.col("bits") + prior_chars * F.col("middle")) / (F.col("n_chars") + prior_chars)
    held = held.join(broadcast_if_small(middle, 10_000), "label").withColumn("rate", rate)
    quantiles = lambda x: F.percentile_approx(x, F.array(F.lit(low), F.lit(high)), F.lit(10_000)).alias("q")
    m, q, d = F.col("middle"), F.col("q"), 1 + slack
    own = held.where(F.col("n") >= least).groupBy("label", "middle").agg(quantiles("rate"))
    own = own.select("label", "middle", (m - d * (m - q[0])).alias("floor"), (m + d * (q[1] - m)).alias("ceiling"))
    # medians of one or two rows say nothing of the spread
    pool = cut(held.where(F.col("n") > 2).agg(quantiles(F.col("rate") / m)))
    bare = cut(scored.select("label").distinct().join(broadcast_if_small(middle, 10_000), "label", "left_anti"))
    few = middle.where(F.col("n") < least).select("label", "middle")
    few = few.unionByName(scored.join(broadcast_if_small(bare, 10_000), "label", "left_semi").groupBy("label").agg(median))
    below, above = (F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(spread)) for x in (1 - q[0], q[1] - 1))
    few = few.crossJoin(F.broadcast(pool)).select("label", "middle", (m * (1 - d * below)).alias("floor"), (m * (1 + d * above)).alias("ceiling"))
    # rows that a small model has been trained on look likely to it, but aren't repetition
    seen = scored.join(trusted, "doc_id", "left_semi").join(broadcast_if_small(cut(few), 10_000), "label")
    seen = seen.withColumn("rate", rate).groupBy("label").agg(F.min("rate").alias("least_seen"))
    few = few.join(seen, "label", "left").select("label", "middle", F.least("floor", "least_seen").alias("floor"), "ceiling")
    return own.unionByName(few)


def _without_model(docs: DataFrame, model: DataFrame) -> list[str]:
    """The labels of texts that have no model, if there is a model at all."""
    have = cut(model.select("label").distinct())
    if have.isEmpty():
        return []
    return [r["label"] for r in docs.where("text <> ''").select("label").distinct().join(have, "label", "left_anti").collect()]  # a row per language


def classify(docs: DataFrame, labels: DataFrame, prior_chars: float = PRIOR_CHARS, block_chars: int = BLOCK_CHARS, **options) -> DataFrame:
    """``(doc_id, label, n_chars, perplexity, rate, floor, ceiling, keep)`` per row; ``docs`` has doc_id, text and lang."""
    rows = docs.select("doc_id", text_or_empty().alias("text"), text_or_empty("lang").alias("label"))
    trusted = broadcast_if_small(cut(trusted_ids(labels)), SMALL_ROWS)
    model = train(rows, trusted)
    pooled = _without_model(rows, model)
    if pooled:
        model = model.unionByName(train(rows.withColumn("label", F.lit(POOL)), trusted))
    scored = cut(score(rows, model, block_chars=block_chars, pooled=pooled))
    bounds = broadcast_if_small(cut(thresholds(scored, trusted, prior_chars=prior_chars, **options)), 10_000)
    out = scored.join(bounds, "label", "left")
    rate = (F.col("bits") + prior_chars * F.col("middle")) / (F.col("n_chars") + prior_chars)
    out = out.withColumn("rate", rate).withColumn("perplexity", F.when(F.col("n_chars") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("n_chars"))))
    keep = (F.col("n_chars") > 0) & F.coalesce(F.col("rate").between(F.col("floor"), F.col("ceiling")), F.lit(True))
    return out.select("doc_id", "label", "n_chars", "perplexity", "rate", "floor", "ceiling", keep.alias("keep"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
