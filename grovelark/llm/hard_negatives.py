"""Hard negatives by exact inner-product search over anchor clusters with shared, bounded lists.

Vectors are rows of whole numbers, the score of two rows is their inner product. Anchors are grouped by direction. For a
block of anchors of one cluster with centroid ``c`` and half-angle ``t`` (the widest angle between ``c`` and a member), a
candidate ``i`` scores at most ``|i| · cos(max(0, angle(i, c) - t)) · |anchor|`` with any member. Candidates are sorted by
that bound once per block; all members walk the list together, in growing strides, and a member stops when the bound that
comes next can't reach what it still needs. The result is exact; the bound and the clusters only decide how far a walk goes.

Two walks: the first finds each anchor's ``positives`` best rows of its own label, the second, for each positive, the best
rows of other labels whose score lies in a window set by the positive's score.

Work is dealt out in cells of one candidate shard (by hash of ``vec_id``) and one round of anchor blocks (``ROUND_ANCHORS``
anchors at most on average). Both sides of a cell have a bounded size, whatever the table's: a stated query set against all
rows, in blocks. Each cell returns at most k rows per window, so large groups of equal vectors never become pairs.

Results for odd input: rows without a ``vec_id``, label or vector, or with a null or non-finite component, take no part; of rows
that share a ``vec_id`` the smallest (by label, then vector) stands for all; vectors of different lengths are filled up with
zeros; components beyond a long become the nearest long and scores beyond one the nearest one; equal scores are ordered by
``vec_id``; an empty table, or one without anchors, gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SCALE = 256
#: Fitting the clusters: the sample's size, rounds of improvement, anchors per cluster, clusters at most.
SAMPLE, FIT_ROUNDS, PER_CLUSTER, MAX_CLUSTERS = 4096, 8, 128, 512
#: Members of a block, anchors of a round, rows of a shard.
BLOCK, ROUND_ANCHORS, SHARD_ROWS = 256, 32_768, 32_768
STRIDE, MAX_STRIDE = 256, 8192
SLACK = 1e-6  # on angles, above the error of arccos

_NONE, _ALL = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "anchor_id bigint, slot int, vec_id bigint, score bigint"


def quantised(vectors: Column, scale: int = SCALE) -> Column:
    """floor(scale · x) of every component."""
    return F.transform(vectors, lambda x: F.floor(x.cast("double") * scale))


def usable(rows: DataFrame) -> DataFrame:
    """``(vec_id, label, q)``: one row per ``vec_id`` of those that take part, ``q`` all of one length."""
    own = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    one = own.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r"))
    return one.select("vec_id", "r.label", quantised(F.col("r.embedding")).alias("q"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column; all lists have one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m.astype(np.float64), m.astype(np.float64)))


class Products:
    """Exact inner products: in float64 where every sum stays below 2^53, else in whole numbers of any size."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        top = float(np.abs(left.astype(np.float64)).max(initial=0)) * float(np.abs(right.astype(np.float64)).max(initial=0)) * max(1, left.shape[1])
        self.exact = top < 2.0**53
        kind = np.float64 if self.exact else object
        self.left, self.right = left.astype(kind), right.astype(kind)

    def of(self, rows: np.ndarray, cols: slice) -> np.ndarray:
        got = self.left[rows] @ self.right[cols].T
        return got.astype(np.int64) if self.exact else np.clip(got, _NONE + 1, _ALL).astype(np.int64)


def angles(m: np.ndarray, size: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angle of each row with a unit vector (or a zero one); 0 where there is none, which only widens bounds."""
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = np.where(size > 0, (m @ centre) / size, 1.0)
    return np.arccos(np.clip(cosine, -1, 1)) if centre.any() else np.zeros(len(m))


def walk(
    members: np.ndarray, member_ids: np.ndarray, member_labels: np.ndarray, low: np.ndarray, high: np.ndarray, centre: np.ndarray,
    rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The ``k`` best rows for every member and window: (member, window, vec_id, score), and how many products were taken.

    A window ``[low, high]`` is one column; an empty one has ``low > high``. ``same``: rows of the member's label but not its
    own ``vec_id``; otherwise rows of other labels. The list is sorted by its bound for this block, once; the walk is
    certified: it leaves a member only when nothing further down can enter any of its windows.
    """
    size, length = norms(rows), norms(members)
    spread = float(angles(members, length, centre).max(initial=0)) + SLACK
    bound = size * np.cos(np.maximum(0, angles(rows, size, centre) - spread))
    order = np.argsort(-bound, kind="stable")
    bound, ids, labels = bound[order], ids[order], labels[order]
    products = Products(members, rows[order])
    n, windows = low.shape
    owner, column, found, score = (np.zeros(0, np.int64) for _ in range(4))
    need, top, taken = low.copy(), high.max(1), 0
    need[low > high] = _ALL
    rival = np.full(low.shape, _ALL)  # who holds the k-th place: an equal score enters with a smaller id only
    at, stride = 0, STRIDE
    while at < len(order):
        # a bound of b times the member's length, rounded up past any error of the arithmetic
        reach = bound[at] * length
        least = need.min(1)
        going = np.flatnonzero((least < _ALL) & (reach + np.abs(reach) * 1e-9 + 1 >= least.astype(np.float64)))
        if not len(going):
            break
        stretch = slice(at, min(at + stride, len(order)))
        got = products.of(going, stretch)
        taken += got.size
        fits = (labels[None, stretch] == member_labels[going, None]) == same
        fits &= (got >= least[going, None]) & (got <= top[going, None])
        if same:
            fits &= ids[None, stretch] != member_ids[going, None]
        i, j = np.nonzero(fits)
        value, who, which = got[i, j], going[i], j + at
        parts = []
        for w in range(windows):
            keep = np.flatnonzero(((value > need[who, w]) | (value == need[who, w]) & (ids[which] < rival[who, w])) & (value <= high[who, w]))
            parts.append((who[keep], np.full(len(keep), w), ids[which[keep]], value[keep]))
        if any(len(p[0]) for p in parts):
            owner, column, found, score = (np.concatenate([a, *(p[c] for p in parts)]) for c, a in enumerate((owner, column, found, score)))
            best = np.lexsort((found, -score, column, owner))
            owner, column, found, score = owner[best], column[best], found[best], score[best]
            run = owner * windows + column
            first = np.searchsorted(run, run)
            place = np.arange(len(run)) - first
            last = place == k - 1
            need[owner[last], column[last]], rival[owner[last], column[last]] = score[last], found[last]
            kept = place < k
            owner, column, found, score = owner[kept], column[kept], found[kept], score[kept]
        at, stride = stretch.stop, min(2 * stride, MAX_STRIDE)
    return owner, column, found, score, taken


def fit_centres(sample: np.ndarray, n_clusters: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means from rows spread over the sample."""
    unit = sample / np.maximum(norms(sample), 1e-300)[:, None]
    centres = unit[np.linspace(0, len(unit) - 1, n_clusters).astype(int)]
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        size = norms(sums)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres


def clustered(anchors: DataFrame, n_anchors: int) -> tuple[DataFrame, np.ndarray]:
    """``anchors`` with ``cluster`` and ``block``, and the centroids.

    Centroids are fitted on ``SAMPLE`` anchors at most; every anchor joins the nearest. A cluster of many anchors, say copies
    of one vector, is dealt out by hash over as many blocks as it needs.
    """
    sample = matrix(anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("q").toArrow().column("q")).astype(np.float64)
    centres = fit_centres(sample, max(1, min(MAX_CLUSTERS, len(sample), round(n_anchors / PER_CLUSTER))))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (matrix(b.column("q")) @ centres.T).argmax(1) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], [*b.schema.names, "cluster"])

    plain = anchors.select("vec_id", "label", "q")
    named = cut(plain.mapInArrow(nearest, f"vec_id bigint, label bigint, q {plain.schema['q'].dataType.simpleString()}, cluster int"))
    many = named.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    block = F.col("cluster") * (1 << 32) + F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.col("blocks"))
    return named.join(F.broadcast(many), "cluster").select("vec_id", "label", "q", "cluster", block.alias("block")), centres  # MAX_CLUSTERS rows


def search(anchors: DataFrame, centres: np.ndarray, rows: DataFrame, shards: int, rounds: int, same: bool, k: int) -> DataFrame:
    """``FOUND`` rows: the ``k`` best of ``rows`` for every anchor and window.

    ``anchors (vec_id, label, q, cluster, block, low, high)`` with the windows as arrays; ``rows (vec_id, label, q)``.
    """

    def cell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        got: list[tuple] = []
        if left.num_rows and right.num_rows:
            members, m_ids, m_labels = matrix(left["q"]), left["vec_id"].to_numpy(), left["label"].to_numpy()
            low, high = matrix(left["low"]), matrix(left["high"])
            around, ids, labels = matrix(right["q"]), right["vec_id"].to_numpy(), right["label"].to_numpy()
            blocks, clusters = left["block"].to_numpy(), left["cluster"].to_numpy()
            for b in np.unique(blocks):
                own = np.flatnonzero(blocks == b)
                who, w, found, score, _ = walk(members[own], m_ids[own], m_labels[own], low[own], high[own], centres[clusters[own[0]]], around, ids, labels, same, k)
                got.append((m_ids[own][who], w, found, score))
        cols = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 4
        return pa.table({"anchor_id": cols[0], "slot": cols[1].astype(np.int32), "vec_id": cols[2], "score": cols[3]})

    dealt = anchors.withColumn("round", F.pmod(F.xxhash64("block"), F.lit(rounds)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(shards)).cast("int")).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    cells = shards * rounds  # said outright: a cell is little to read and much to multiply
    dealt, spread = dealt.repartition(cells, "shard", "round"), spread.repartition(cells, "shard", "round")
    found = dealt.groupBy("shard", "round").cogroup(spread.groupBy("shard", "round")).applyInArrow(cell, FOUND)
    place = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95) -> DataFrame:
    """Hard negatives ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows (vec_id, label, q)`` as ``usable`` gives them; ``is_anchor`` chooses the anchors. A negative's score is between
    ``low_percent`` and ``high_percent`` of the positive's, both included.
    """
    spark = rows.sparkSession
    rows = cut(rows)
    widest = F.max(F.array_max(F.transform("q", lambda x: F.abs(x.cast("double")))))
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(is_anchor.cast("bigint")).alias("a"), F.max(F.size("q")).alias("d"), widest.alias("top")).first()
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not known["a"]:
        return spark.createDataFrame([], result)
    kind = next(k for k, most in (("smallint", 2**15), ("int", 2**31), ("bigint", float("inf"))) if (known["top"] or 0) < most)  # vectors move once per round
    rows = rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("bigint"), F.lit(max(1, known["d"])) - F.size("q"))).cast(f"array<{kind}>"))
    per_shard = max(1024, min(SHARD_ROWS, known["n"] // (3 * spark.sparkContext.defaultParallelism)))
    shards, rounds = -(-known["n"] // per_shard), -(-known["a"] // ROUND_ANCHORS)
    anchors, centres = clustered(rows.where(is_anchor), known["a"])
    anchors = cut(anchors)
    every = F.array(F.lit(_NONE + 1)), F.array(F.lit(_ALL))
    best = search(anchors.withColumn("low", every[0]).withColumn("high", every[1]), centres, rows, shards, rounds, True, positives)
    best = cut(best.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # low <= negative <= high in whole numbers; products of a score and a percentage may pass a long, decimals do not
    score = F.col("positive_score").cast("decimal(24,0)")
    low = F.ceil(score * low_percent / 100).cast("bigint")
    high = F.floor(score * high_percent / 100).cast("bigint")
    limits = best.select("anchor_id", F.struct(F.col("slot"), low.alias("low"), high.alias("high")).alias("w"))
    limits = limits.groupBy("anchor_id").agg(F.array_sort(F.collect_list("w")).alias("w"))  # at most ``positives`` each
    none = F.struct(F.lit(0).alias("slot"), F.lit(1).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("high"))
    w = F.concat("w", F.array_repeat(none, F.lit(positives) - F.size("w")))
    seeking = anchors.join(limits.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    seeking = seeking.withColumn("low", F.transform(w, lambda x: x["low"])).withColumn("high", F.transform(w, lambda x: x["high"])).drop("w")
    worst = search(seeking, centres, rows, shards, rounds, False, negatives)
    worst = worst.select("anchor_id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(worst, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows with a ``vec_id`` divisible by 50; every seventh label is moved on by one first."""
    rows = usable(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def oracle() -> str:
    return """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
               FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
          FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score
          FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
           AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
    SELECT anchor_id, positive_id, k::INTEGER AS rank, negative_id, positive_score, negative_score
    FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS k FROM n)
    WHERE k <= 3"""
