"""Interpolated Kneser-Ney models over characters, counted and smoothed as Spark tables.

A gram is a string of 1 to ``order`` characters. The model is one table ``(label, gram, alpha, gamma)``: ``alpha`` is the
discounted probability of the gram's last character after the others, ``gamma`` the weight that the gram, as a context,
leaves to its shorter context. A probability is the recursion

    p_k = alpha(last k characters) + gamma(the k - 1 before the last) · p_{k-1},   p_0 = 2^-16,

with ``alpha`` 0 and ``gamma`` 1 where the table has no such gram. The highest order uses counts, lower ones the number of
distinct characters before the gram. ``modified`` takes the three discounts for counts of one, two and more from the counts
of counts; without it there is a single discount.

Grams travel as 64-bit hashes that Python computes for whole arrays of characters at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_dir

PAD = "\x02"
FLOOR = 2.0**-16
_MULTIPLY, _SPREAD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(_SPREAD)
    return x ^ (x >> np.uint64(32))


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the k characters that end at each place, for k = 0 … ``order``; places before k - 1 hold no gram."""
    one = _mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLY))
    out, power, held = [np.zeros(len(codes), np.uint64)], 1, np.zeros(len(codes), np.uint64)
    for k in range(1, order + 1):
        held = held.copy()
        held[k - 1 :] += one[: len(one) - k + 1] * np.uint64(power)
        power = power * _MULTIPLY & _MASK
        out.append(_mixed(held + np.uint64(k * _SPREAD & _MASK)))
    return out


def label_hash(label: str) -> int:
    return int.from_bytes(hashlib.md5(label.encode("utf-8", "surrogatepass")).digest()[:8], "little")


def hash_grams(grams: Sequence[str]) -> np.ndarray:
    """The hash of each gram, as ``gram_hashes`` gives it."""
    out = np.zeros(len(grams), np.uint64)
    sizes = np.array([len(g) for g in grams])
    for k in np.unique(sizes):
        if k:
            at = np.flatnonzero(sizes == k)
            codes = codes_of("".join(grams[i] for i in at))
            out[at] = gram_hashes(codes, int(k))[k][k - 1 :: k]
    return out


def spans(sizes: Sequence[int], chars: int) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about ``chars`` characters, so that memory does not follow the batch."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > chars:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def pieces(text: str, order: int, chars: int) -> Iterator[tuple[str, int]]:
    """A long text in stretches, each with how many characters of context stand before its own."""
    for a in range(0, max(len(text), 1), chars):
        before = min(a, order - 1)
        yield text[a - before : a + chars], before


def stretches(texts: Sequence[str], order: int, chars: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
    """Texts one after another with ``order - 1`` pads before each: which text each piece is of, where its characters begin
    among ``places``, the place of every character to count, and the string that the places are of."""
    own = [(i, piece, before) for i, t in enumerate(texts) for piece, before in pieces(t, order, chars)]
    pad = PAD * (order - 1)
    for lo, hi in spans([len(x[1]) for x in own], chars):
        part = own[lo:hi]
        whole = pad + pad.join(x[1] for x in part)
        sizes, skip = np.array([len(x[1]) for x in part]), np.array([x[2] for x in part])
        begin = np.cumsum(sizes) - sizes + (np.arange(len(part)) + 1) * (order - 1) + skip
        sizes = sizes - skip
        real = sizes > 0
        begin, sizes = begin[real], sizes[real]
        if len(sizes):
            first = np.cumsum(sizes) - sizes
            yield np.array([x[0] for x in part])[real], first, np.arange(sizes.sum()) + np.repeat(begin - first, sizes), whole


def distinct(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the distinct gram at each place, and one place of each distinct gram."""
    number, values = pd.factorize(hashes[places])
    where = np.zeros(len(values), np.int64)
    where[number] = places
    return number, where


def count_grams(texts: DataFrame, order: int, most: int = 1_500_000) -> DataFrame:
    """``(label, gram, c)`` of the highest order from ``(label, text)``.

    A task adds up its own counts first; it holds ``most`` of them at a time and passes them on when half of that are distinct.
    """

    def part(texts: list[str], label: str) -> Iterator[pd.DataFrame]:
        for _, _, places, whole in stretches(texts, order):
            hashes = gram_hashes(codes_of(whole), order)[order]
            number, where = distinct(hashes, places)
            yield pd.DataFrame({"label": label, "hash": hashes[where], "gram": [whole[p - order + 1 : p + 1] for p in where.tolist()], "c": np.bincount(number)})

    def summed(held: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(held).groupby(["label", "hash"], sort=False).agg(gram=("gram", "first"), c=("c", "sum")).reset_index()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for b in batches:
            for label, group in b.groupby("label", sort=False):
                for p in part(group["text"].tolist(), label):
                    held.append(p)
                    rows += len(p)
                    if rows > most:
                        held = [summed(held)]
                        rows = len(held[0])
                    if rows > most // 2 and len(held) == 1:
                        yield held.pop()[["label", "gram", "c"]]
                        rows = 0
        if held:
            yield summed(held)[["label", "gram", "c"]]

    return texts.select("label", "text").mapInPandas(count, "label string, gram string, c bigint").groupBy("label", "gram").agg(F.sum("c").alias("c"))


def _levels(counts: DataFrame, order: int) -> DataFrame:
    """``(label, gram, c, k)``: the grams of every length ``k`` in one written table, a folder per length, each made from the one before."""
    spark, schema = counts.sparkSession, "label string, gram string, c bigint"
    folder = fresh_dir(spark, "levels")
    level = counts.select("label", "gram", "c")
    for k in range(order, 0, -1):
        level.write.parquet(f"{folder}/k={k}")
        level = spark.read.schema(schema).parquet(f"{folder}/k={k}")
        level = level.groupBy("label", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    return spark.read.schema(f"{schema}, k int").parquet(folder)


def smooth(counts: DataFrame, order: int, modified: bool = True) -> DataFrame:
    """The model table of ``count_grams``: ``(label, gram, alpha, gamma)``.

    All lengths go through one plan: with a branch for each, the driver's memory was that of planning them again and again.
    """
    levels = _levels(counts, order)
    per = [F.sum((F.col("c") == i).cast("double")).alias(f"t{i}") for i in (1, 2, 3, 4)]
    t = [F.col(f"t{i}") for i in (1, 2, 3, 4)]
    y = F.try_divide(t[0], t[0] + 2 * t[1])
    if modified:
        ds = [F.coalesce(F.try_divide(F.lit(float(i)) * t[i - 1] - (i + 1) * y * t[i], t[i - 1]), F.lit(0.5 * i)) for i in (1, 2, 3)]
        ds = [F.greatest(F.lit(0.05), F.least(F.lit(0.95 * i), d)) for i, d in zip((1, 2, 3), ds, strict=True)]
    else:
        ds = [F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.coalesce(y, F.lit(0.5))))] * 3
    discounts = cut(levels.groupBy("label", "k").agg(*per).select("label", "k", *[d.alias(f"d{i}") for i, d in enumerate(ds, 1)]))
    context = F.expr("substring(gram, 1, k - 1)")
    own = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    seen = levels.join(F.broadcast(discounts), ["label", "k"]).withColumn("context", context).withColumn("off", own)  # a row per label and length
    totals = seen.groupBy("label", "context").agg(F.sum("c").cast("double").alias("total"), F.sum("off").alias("mass"))  # contexts of other lengths are other contexts
    ends = seen.join(totals, ["label", "context"]).select("label", "gram", ((F.col("c") - F.col("off")) / F.col("total")).alias("alpha"), F.lit(None).cast("double").alias("gamma"))
    table = ends.unionByName(totals.select("label", F.col("context").alias("gram"), F.lit(None).cast("double").alias("alpha"), (F.col("mass") / F.col("total")).alias("gamma")))
    return table.groupBy("label", "gram").agg(F.max("alpha").alias("alpha"), F.max("gamma").alias("gamma"))


def hashed(model: DataFrame) -> DataFrame:
    """The model with ``key``, the hash of its grams, in their place."""

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "key": hash_grams(b["gram"].tolist()).view(np.int64), "alpha": b["alpha"], "gamma": b["gamma"]})

    return model.select("label", "gram", "alpha", "gamma").mapInPandas(key, "label string, key bigint, alpha double, gamma double")


class Scorer:
    """Scores texts with models held as one sorted array of gram hashes and a column per label."""

    def __init__(self, keys: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, order: int):
        self.keys, self.alpha, self.gamma, self.order = keys, alpha, gamma, order
        # hashes are spread evenly: the leading bits of one say where it stands, but for a few places
        bits = max(1, min(24, len(keys).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    @classmethod
    def of(cls, rows: pd.DataFrame, labels: list[str], order: int) -> Scorer:
        """From ``hashed`` rows of the given labels."""
        keys, at = np.unique(rows["key"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        alpha, gamma = np.zeros((len(keys), len(labels)), np.float32), np.ones((len(keys), len(labels)), np.float32)
        col = rows["label"].map({x: i for i, x in enumerate(labels)}).to_numpy()
        for m, name in ((alpha, "alpha"), (gamma, "gamma")):
            ok = rows[name].notna().to_numpy()
            m[at[ok], col[ok]] = rows[name].to_numpy()[ok]
        return cls(keys, alpha, gamma, order)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = len(self.keys) - 1
        at = np.minimum(self.first[h >> self.shift], last)
        here = self.keys[at]
        late = np.flatnonzero((here < h) & (at < last))
        while len(late):
            at[late] += 1
            here[late] = self.keys[at[late]]
            late = late[(here[late] < h[late]) & (at[late] < last)]
        return at, here == h

    def log2_sums(self, texts: Sequence[str]) -> np.ndarray:
        """Sum over each text's characters of -log2 p, per label; every distinct gram of a stretch is scored once."""
        out = np.zeros((len(texts), self.alpha.shape[1]))
        for row, first, places, whole in stretches(texts, self.order):
            hashes = gram_hashes(codes_of(whole), self.order)
            number, where = distinct(hashes[self.order], places)
            p = np.full((len(where), out.shape[1]), FLOOR, np.float32)
            for k in range(1, self.order + 1):
                at, ok = self._find(hashes[k - 1][where - 1] if k > 1 else np.zeros(len(where), np.uint64))
                p *= np.where(ok[:, None], self.gamma[at], 1)
                at, ok = self._find(hashes[k][where])
                p += np.where(ok[:, None], self.alpha[at], 0)
            cost = -np.log2(p)
            for j in range(out.shape[1]):
                np.add.at(out[:, j], row, np.add.reduceat(cost[number, j].astype(np.float64), first))
        return out


def collected(model: DataFrame, order: int) -> tuple[list[str], Scorer]:
    """A scorer on the driver; only for models whose training text has a fixed bound."""
    rows = hashed(model).toArrow().to_pandas()
    labels = sorted(rows["label"].unique())
    return labels, Scorer.of(rows, labels, order)
