"""Language of a text by interpolated Kneser-Ney models over characters.

One model per language, all in one sorted array of gram hashes; a text gets the language with the lowest cross-entropy per
character. Rejection is calibrated: on labelled rows kept from training, the temperature that makes the softmax of
cross-entropies most likely gives ``score``, and each language's bound on the cross-entropy of its own texts gives
``accepted``.

The models are fitted on a bounded sample of labelled rows: ``train_chars`` characters in all, in equal shares per
language, rows chosen by hash (:func:`sampled`). Everything else covers every row and every text whole.

Results for odd input: null texts and texts without a letter get ``und``, score 0, not accepted; a null ``doc_id`` is never
trained on; with no labelled row every text is ``und``; ties go to the language first in order; a repeated row gets its own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pick, table, worker_cache
from .kneser_ney import Scorer, codes_of, collected, count_grams, smooth, spans

ORDER, TRAIN_CHARS, CALIBRATE_CHARS, MAX_LANGUAGES = 5, 3_000_000, 800_000, 1000
#: Characters that a worker normalises and scores at a time, however large the batches of rows are.
SPAN_CHARS = 1_000_000
UNKNOWN = "und"
RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean"


def _letters() -> np.ndarray:
    held = worker_cache("letters")
    if "table" not in held:
        held["table"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return held["table"]


def normal(text: str) -> str:
    """Lower case, every run of other characters than letters one space."""
    low = text.lower()
    codes, letters = codes_of(low), _letters()
    is_letter = letters[codes]
    if not is_letter.any():
        return ""
    keep = is_letter | np.concatenate([[True], is_letter[:-1]])
    return np.where(is_letter, codes, np.uint32(32))[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def normal_pieces(text: str, chars: int = SPAN_CHARS) -> str:
    """As :func:`normal`; a long text is taken piece by piece, so that its code points are never all held at once."""
    if len(text) <= chars:
        return normal(text)
    out, last = [], ""
    for at in range(0, len(text), chars):
        piece = normal(text[at : at + chars]) or " "  # nothing but other characters is one space
        if piece[0] == " " and last == " ":
            piece = piece[1:]
        out.append(piece)
        last = piece[-1:] or last
    whole = "".join(out)
    return whole if whole.strip(" ") else ""


def _normal_rows(docs: DataFrame) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_numpy()
            for lo, hi in spans(sizes.tolist(), SPAN_CHARS):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([normal_pieces(t) for t in part.column("text").to_pylist()], pa.string())], ["label", "text"])

    return docs.select("lang", "text").mapInArrow(go, "label string, text string")


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


class Model:
    """Languages, their scorer, the temperature and each language's bound."""

    def __init__(self, labels: list[str], scorer: Scorer | None, temperature: float, bounds: np.ndarray):
        self.labels, self.scorer, self.temperature, self.bounds = labels, scorer, temperature, bounds

    def rates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character by language, and the characters, of normalised texts."""
        n = np.array([len(t) for t in texts])
        return self.scorer.log2_sums(texts) / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str]) -> pd.DataFrame:
        texts = [normal_pieces(t) if t else "" for t in texts]
        real = np.array([bool(t) for t in texts]) & bool(self.labels)
        out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "cross_entropy": np.nan, "accepted": False})
        if real.any():
            rates, n = self.rates([t for t, ok in zip(texts, real, strict=True) if ok])
            best = rates.argmin(1)
            own = rates[np.arange(len(best)), best]
            at = np.flatnonzero(real)
            out.loc[at, "lang_pred"] = [self.labels[i] for i in best]
            out.loc[at, "score"] = _softmax(rates, n, self.temperature)[np.arange(len(best)), best]
            out.loc[at, "cross_entropy"] = own
            out.loc[at, "accepted"] = own <= self.bounds[best]
        return out


def _softmax(rates: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    x = -(rates - rates.min(1, keepdims=True)) * np.sqrt(n)[:, None] * temperature
    e = np.exp(np.maximum(x, -700))
    return e / e.sum(1, keepdims=True)


def _bounds(relative: np.ndarray, truth: np.ndarray, medians: np.ndarray, quantile: float, weight: float = 40.0) -> np.ndarray:
    """Each language's bound: its own quantile of relative rates drawn towards that of all, the more the fewer rows it has."""
    pooled = np.quantile(relative, quantile)
    out = np.zeros(len(medians))
    for j in range(len(medians)):
        own = relative[truth == j]
        share = len(own) / (len(own) + weight)
        out[j] = medians[j] * 1.1 * (share * np.quantile(own, quantile) + (1 - share) * pooled if len(own) else pooled)
    return out


def sampled(labelled: DataFrame, train_chars: int, calibrate_chars: int) -> DataFrame:
    """``(lang, calibrate, text)``: of every language rows in hash order until its equal share of characters is reached.

    The first row of a language in that order trains; of the others a fifth calibrates. A text counts, and is given, up to the
    share at most, so that the sample has its bound whatever the lengths of the texts; this is what the models are fitted on,
    never a text that is predicted. Running sums are over a draw of about four times the share, not over all rows of a
    language. Of more than ``MAX_LANGUAGES`` languages those with most rows are learnt.
    """
    order = F.xxhash64(F.lit(7), "doc_id", "text")
    keys = cut(labelled.select("lang", order.alias("at"), F.length("text").cast("bigint").alias("chars")))
    sums = keys.groupBy("lang").agg(F.min("at").alias("first"), F.sum("chars").alias("all"), F.count(F.lit(1)).alias("rows"))
    sums = cut(sums.orderBy(F.desc("rows"), "lang").limit(MAX_LANGUAGES))  # a row per language
    n = max(1, sums.count())
    share = F.when(F.col("calibrate"), F.lit(max(1, calibrate_chars // n))).otherwise(F.lit(max(1, train_chars // n)))
    keys = keys.join(F.broadcast(sums), "lang").withColumn("calibrate", (F.col("at") != F.col("first")) & (F.pmod(F.xxhash64(F.lit(8), "at"), F.lit(5)) == 0))
    luck = F.pmod(F.xxhash64(F.lit(9), "at"), F.lit(1 << 30)) / float(1 << 30)
    expected = F.col("all") * F.when(F.col("calibrate"), 0.2).otherwise(0.8)
    drawn = keys.where((F.col("at") == F.col("first")) | (luck * expected < 4.0 * share))
    earlier = Window.partitionBy("lang", "calibrate").orderBy(F.col("at") != F.col("first"), "at").rowsBetween(Window.unboundedPreceding, -1)
    taken = drawn.withColumn("so_far", F.coalesce(F.sum(F.least("chars", share)).over(earlier), F.lit(0))).where(F.col("so_far") < share)
    taken = cut(taken.select(F.col("lang").alias("l"), "at", "calibrate").distinct())
    rows = labelled.withColumn("_at", order).join(taken, (F.col("_at") == F.col("at")) & (F.col("lang") == F.col("l")))
    return rows.select("lang", "calibrate", F.substring("text", F.lit(1), share.cast("int")).alias("text")).distinct()


def fit(labelled: DataFrame, order: int = ORDER, train_chars: int = TRAIN_CHARS, calibrate_chars: int = CALIBRATE_CHARS, quantile: float = 0.995) -> Model:
    """From ``(doc_id, lang, text)`` with no nulls. A fifth of the rows is kept for calibration."""
    sample = cut(sampled(labelled, train_chars, calibrate_chars))
    labels, scorer = collected(smooth(count_grams(_normal_rows(sample.where(~F.col("calibrate"))).where("text <> ''"), order), order, modified=False), order) if sample.where(~F.col("calibrate")).limit(1).count() else ([], None)
    if not labels:
        return Model([], None, 1.0, np.zeros(0))
    model = Model(labels, scorer, 1.0, np.full(len(labels), np.inf))
    held = sample.where("calibrate").select("lang", "text").toArrow().to_pandas()
    texts = [normal(t) for t in held["text"]]
    ok = np.array([bool(t) and la in labels for t, la in zip(texts, held["lang"], strict=True)], bool)
    if ok.any():
        truth = np.array([labels.index(la) for la, o in zip(held["lang"], ok, strict=True) if o])
        rates, n = model.rates([t for t, o in zip(texts, ok, strict=True) if o])
        grid = np.geomspace(0.02, 20, 40)
        loss = [-np.log(np.maximum(_softmax(rates, n, g)[np.arange(len(truth)), truth], 1e-12)).mean() for g in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        # rates relative to their language's median, pooled: one rule for languages of many and of few rows
        medians = np.array([np.median(rates[truth == j, j]) if (truth == j).any() else np.nan for j in range(len(labels))])
        known = np.where(np.isnan(medians), np.nanmedian(medians), medians)
        own = rates[np.arange(len(truth)), truth] / known[truth]
        model.bounds = _bounds(own, truth, known, quantile)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``RESULT`` rows; only texts enter a prediction."""
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.scorer and (model.scorer.keys, model.scorer.alpha, model.scorer.gamma, model.scorer.order), model.temperature, model.bounds))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, arrays, temperature, bounds = shared.value
        own = Model(labels, arrays and Scorer(*arrays), temperature, bounds)
        for b in batches:
            sizes = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_numpy()
            for lo, hi in spans(sizes.tolist(), SPAN_CHARS):
                part = b.slice(lo, hi - lo)
                got = own.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *(pa.array(got[c]) for c in got.columns)], ["doc_id", "held_out", *got.columns])

    rows = docs.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(go, RESULT).withColumn("cross_entropy", F.when(~F.isnan("cross_entropy"), F.col("cross_entropy")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    labelled = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(remainder() != 0)
    return predict(docs, fit(labelled))
