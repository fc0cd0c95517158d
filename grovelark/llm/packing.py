"""Packing token sequences into windows by non-negative least squares over a histogram of lengths.

1. Texts become token ids, written once. A document's full windows are sequences of their own; what is left of it, its tail,
   is an *item* of a length class: its length in units of ``window / 128``, rounded up.
2. The histogram of classes (129 numbers, however many documents) is fitted on the driver: shallow combinations of up to three
   classes that fill a window exactly are enumerated, and repeat counts solved so that the combinations use the histogram up:
   least squares over tokens, no count below zero. Counts are rounded to what the histogram has; a greedy pass over the rest
   of the histogram adds deeper combinations.
3. Items take their places by rank within their class: which combination, which repeat of it, which slot. Ranks are counts per
   task added up, so a class with a third of all documents is no group of its own.
4. What still is left forms a stream, cut where needed: it fills the rounding gaps of the windows first, then whole windows. The
   last tokens, fewer than a window, become sequences of powers of two. So no sequence needs padding.

Results for odd input: a null text is an empty one (its end id only); a null ``doc_id`` is kept; repeated rows are packed each;
an empty table gives no piece; long texts are cut into as many windows as they fill.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pick, table, worker_cache
from .token_planes import END_ID, WordMemo, _spans, default_tokenizer

WINDOW, UNITS = 2048, 128
#: A greedy combination may leave this share of a window open for the stream to fill.
OPEN_SHARE = 1 / 32
#: Windows whose gaps are added up together.
STRETCH = 1 << 10

IDS = "task bigint, place bigint, doc_id bigint, n bigint, class int, rank bigint, before bigint, chunks bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
CHUNKS = -1  # the class under which full windows are counted


# ---------------------------------------------------------------- the plan, from the histogram alone


def combinations(classes: list[int], total: int) -> list[dict[int, int]]:
    """Shallow ways to fill ``total`` units: m times a, m times a and n times b, or one each of a, b and c."""
    have, out = set(classes), []
    for a in classes:
        if total % a == 0:
            out.append({a: total // a})
        for m in range(1, total // a + 1):
            rest = total - m * a
            out += [{a: m, b: rest // b} for b in classes if b > a and rest and rest % b == 0]
        out += [{a: 1, b: 1, total - a - b: 1} for b in classes if a < b < total - a - b and total - a - b in have]
    return out


def least_squares(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """x >= 0 that makes ``a x`` nearest to ``b``, by the active-set method; no more entries than rows are above zero."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    small = 1e-9 * max(1.0, float(np.abs(b).max(initial=0))) * max(1.0, float(np.abs(a).max(initial=0)))
    for _ in range(most or 6 * len(b)):
        pull = a.T @ (b - a @ x)
        pull[active] = 0
        best = int(pull.argmax()) if n else 0
        if not n or pull[best] <= small:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            y = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (y > 0).all():
                x[:] = 0
                x[at] = y
                break
            bad = y <= 0  # as far towards y as x stays above zero
            step = (x[at][bad] / np.maximum(x[at][bad] - y[bad], 1e-300)).min()
            x[at] += step * (y - x[at])
            gone = at[bad & (x[at] <= 1e-12 * max(1.0, x.max()))]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    return x


def solved(counts: dict[int, int], total: int) -> list[tuple[dict[int, int], int]]:
    """Combinations and how often each is used; together they use no class more often than it occurs."""
    classes = sorted(k for k, n in counts.items() if 0 < k <= total and n > 0)
    ways = combinations(classes, total)
    left = {k: counts[k] for k in classes}
    plan: list[tuple[dict[int, int], int]] = []

    def take(way: dict[int, int], most: float) -> None:
        n = int(min(most, *(left[k] // m for k, m in way.items())))
        if n > 0:
            plan.append((way, n))
            for k, m in way.items():
                left[k] -= n * m

    if ways:
        row = {k: i for i, k in enumerate(classes)}
        a = np.zeros((len(classes), len(ways)))
        for j, way in enumerate(ways):
            for k, m in way.items():
                a[row[k], j] = m
        weight = np.array(classes, float)  # a class counts by its tokens: short rests are easy to place
        x = least_squares(a * weight[:, None], np.array([counts[k] for k in classes]) * weight)
        for j in np.argsort(-x, kind="stable"):
            if x[j] > 0:
                take(ways[j], round(x[j]))
    for k in reversed(classes):  # the rest, longest first; every turn uses a class up or gives it to the stream
        while left[k]:
            way, room = {k: 1}, total - k
            for j in reversed(classes):
                more = min(room // j, left[j] - way.get(j, 0))
                if more > 0:
                    way[j] = way.get(j, 0) + more
                    room -= more * j
            if room > total * OPEN_SHARE:
                break
            take(way, float("inf"))
    return plan


def limited(plan: list[tuple[dict[int, int], int]], most: int) -> list[tuple[dict[int, int], int]]:
    """At most ``most`` windows: there must be tokens to fill every gap."""
    out = []
    for way, n in plan:
        n = min(n, most)
        most -= n
        if n:
            out.append((way, n))
    return out


def runs(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(class, first rank, behind the last rank, first window, items per window, first slot)`` of each class of each combination."""
    used, window, out = {}, 0, []
    for way, n in plan:
        slot = 0
        for k, m in sorted(way.items()):
            at = used.get(k, 0)
            out.append((k, at, at + n * m, window, m, slot))
            used[k], slot = at + n * m, slot + m
        window += n
    return out


def powers(n: int) -> list[int]:
    """Powers of two that add up to ``n``, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


# ---------------------------------------------------------------- tokens and ranks


def id_type(tokenizer: WordMemo) -> str:
    return "<u2" if tokenizer.whole.get_vocab_size() <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer: str, window: int, unit: int, end_id: int | None) -> DataFrame:
    """``IDS``: every text's ids in the tokenizer's narrowest type, and its place in its task.

    ``rank`` and ``before`` count the items of the same class, and their tokens, that stand before it in its task; ``chunks`` the full windows.
    """

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = worker_cache("token_planes")
        memo = held.get(tokenizer) or held.setdefault(tokenizer, WordMemo(tokenizer))
        kind, task, seen = id_type(memo), TaskContext.get().partitionId(), 0
        ranks, before = np.zeros(window // unit + 2, np.int64), np.zeros(window // unit + 2, np.int64)
        chunks = 0
        for b in batches:
            texts = b["text"].fillna("").tolist()
            for lo, hi in _spans(texts, 1_000_000):
                n, flat = memo.encode(texts[lo:hi], end_id)
                raw, ends = flat.astype(kind).tobytes(), np.cumsum(n) * int(kind[-1])
                tail, full = n % window, n // window
                group = pd.Series(-(-tail // unit))
                rows = pd.DataFrame({
                    "task": task, "place": (task << 33) + seen + np.arange(len(n)), "doc_id": b["doc_id"].iloc[lo:hi].to_numpy(), "n": n, "class": group.astype("int32"),
                    "rank": ranks[group] + group.groupby(group).cumcount(), "before": before[group] + pd.Series(tail).groupby(group).cumsum() - tail,
                    "chunks": chunks + np.cumsum(full) - full, "ids": [raw[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)],
                })
                np.add.at(ranks, group, 1)
                np.add.at(before, group, tail)
                chunks, seen = chunks + int(full.sum()), seen + len(n)
                yield rows

    return pick(docs, "doc_id", "text").mapInPandas(go, IDS)


def _totals(ids: DataFrame, window: int) -> DataFrame:
    """``(task, class, n, tokens, rank0, before0)``: what each task has of each class, and what the tasks before it have."""
    tail = F.col("n") % window
    items = ids.groupBy("task", "class").agg(F.count(F.lit(1)).alias("n"), F.sum(tail).alias("tokens"))
    full = ids.groupBy("task").agg(F.lit(CHUNKS).alias("class"), F.sum(F.floor(F.col("n") / window)).alias("n"), F.lit(0).cast("bigint").alias("tokens"))
    earlier = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    sums = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for c, name in (("n", "rank0"), ("tokens", "before0"))]
    return cut(items.unionByName(full).select("*", *sums))


# ---------------------------------------------------------------- places


def _stream_gaps(slots: DataFrame, window: int) -> DataFrame:
    """``(window, at, gap, from)``: where each window's gap begins, its size, and the tokens of gaps before it."""
    gaps = slots.groupBy("window").agg(F.sum("length").alias("at")).withColumn("gap", F.lit(window) - F.col("at")).where("gap > 0")
    gaps = gaps.withColumn("stretch", F.floor(F.col("window") / STRETCH))
    per = cut(gaps.groupBy("stretch").agg(F.sum("gap").alias("all")))
    earlier = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    per = per.select("stretch", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("first"))
    own = Window.partitionBy("stretch").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    return gaps.join(per, "stretch").select("window", "at", "gap", (F.col("first") + F.coalesce(F.sum("gap").over(own), F.lit(0))).alias("from"))


def _overlaps(stream: DataFrame, gaps: DataFrame, size: int) -> DataFrame:
    """Pieces of the stream that lie in gaps: both are cut up by stretches of ``size`` tokens, so no join key is hot."""
    ends = F.col("from") + F.col("gap")
    over = lambda a, e: F.explode(F.sequence(F.floor(a / size), F.floor((e - 1) / size)))
    left = stream.withColumn("cell", over(F.col("pos"), F.col("pos") + F.col("length")))
    right = gaps.withColumn("end", ends).withColumn("cell", over(F.col("from"), ends))
    lo, hi = F.greatest("pos", "from"), F.least(F.col("pos") + F.col("length"), F.col("end"))
    both = left.join(right, "cell").where((lo < hi) & (F.floor(lo / size) == F.col("cell")))
    return both.select("place", (F.col("start") + lo - F.col("pos")).alias("start"), (hi - lo).alias("length"), F.col("window").alias("sequence"), (F.col("at") + lo - F.col("from")).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int | None = END_ID) -> DataFrame:
    """``PIECES``: every id of every document in exactly one piece of one sequence; ``ids`` are the piece's ids as unsigned
    32-bit little-endian numbers. Sequences hold ``window`` ids, the last few a power of two fewer."""
    spark = docs.sparkSession
    unit = max(1, window // UNITS)
    total = window // unit
    ids = cut(encoded(docs, tokenizer, window, unit, end_id))
    per = _totals(ids, window)
    known = {r["class"]: (int(r["n"]), int(r["tokens"])) for r in per.groupBy("class").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()}  # a row per class
    chunks = known.pop(CHUNKS, (0, 0))[0]
    plan = limited(solved({k: n for k, (n, _) in known.items()}, total), sum(t for _, t in known.values()) // window)
    windows = sum(n for _, n in plan)
    places = runs(plan)
    used = {k: max((r[2] for r in places if r[0] == k), default=0) for k in known}

    items = ids.select("task", "place", "class", "n", F.col("rank").alias("r"), "before").join(per.select("task", "class", "rank0", "before0"), ["task", "class"])
    items = items.select(
        "place", "class", (F.col("n") - F.col("n") % window).alias("start"), (F.col("n") % window).alias("length"), (F.col("r") + F.col("rank0")).alias("rank"), (F.col("before") + F.col("before0")).alias("upto")
    ).where("length > 0")
    items = cut(items)
    limits = spark.createDataFrame(sorted(used.items()), "class int, used bigint")
    marked = items.join(F.broadcast(limits), "class")  # a row per class

    run = spark.createDataFrame([(k, a, z, w, m, s) for k, a, z, w, m, s in places], "class int, low bigint, behind bigint, first bigint, each int, slot int")
    nth = F.col("rank") - F.col("low")
    slots = marked.where("rank < used").join(F.broadcast(run), "class").where("rank >= low AND rank < behind")  # a row per combination and class
    slots = cut(slots.select("place", "start", "length", F.expr("first + (rank - low) div each").alias("window"), (F.col("slot") + nth % F.col("each")).alias("slot")))
    earlier = Window.partitionBy("window").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most a window's items
    placed = slots.select("place", "start", "length", F.col("window").alias("sequence"), F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))

    inside = {r["class"]: int(r["t"]) for r in marked.where("rank < used").groupBy("class").agg(F.sum("length").alias("t")).collect()}  # a row per class
    gap = windows * window - sum(inside.values())
    base, rows = 0, []
    for k in sorted(known):
        rows.append((k, base - inside.get(k, 0)))
        base += known[k][1] - inside.get(k, 0)
    shift = spark.createDataFrame(rows, "class int, shift bigint")
    stream = cut(marked.where("rank >= used").join(F.broadcast(shift), "class").select("place", "start", "length", (F.col("upto") + F.col("shift")).alias("pos")))
    filled = _overlaps(stream.where(F.col("pos") < gap).withColumn("length", F.least("length", F.lit(gap) - F.col("pos"))), _stream_gaps(slots, window), window)

    rest = base - gap  # tokens of the stream behind the gaps
    whole = rest // window
    lo, hi = F.greatest(F.col("pos"), F.lit(gap)) - gap, F.col("pos") + F.col("length") - gap
    behind = stream.select("place", F.col("start") - F.col("pos") + gap, lo.alias("lo"), hi.alias("hi")).toDF("place", "shift", "lo", "hi").where("lo < hi")
    cells = behind.where(F.col("lo") < whole * window).withColumn("k", F.explode(F.sequence(F.floor(F.col("lo") / window), F.least(F.floor((F.col("hi") - 1) / window), F.lit(whole - 1)))))
    ends = [(whole + i, whole * window + sum(powers(rest % window)[:i]), size) for i, size in enumerate(powers(rest % window))]
    last = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(a).cast("bigint").alias("a"), F.lit(a + s).cast("bigint").alias("e")) for k, a, s in ends]) if ends else None
    spots = cells.select("place", "shift", "lo", "hi", F.col("k").cast("bigint").alias("k"), (F.col("k") * window).cast("bigint").alias("a"), ((F.col("k") + 1) * window).cast("bigint").alias("e"))
    if ends:
        tails = behind.where(F.col("hi") > whole * window).withColumn("c", F.explode(last)).select("place", "shift", "lo", "hi", "c.k", "c.a", "c.e")
        spots = spots.unionByName(tails)
    spots = spots.withColumn("x", F.greatest("lo", "a")).withColumn("y", F.least("hi", "e")).where("x < y")
    streamed = spots.select("place", (F.col("x") + F.col("shift")).alias("start"), (F.col("y") - F.col("x")).alias("length"), (F.col("k") + windows).alias("sequence"), (F.col("x") - F.col("a")).alias("offset"))

    piece = F.struct("start", "length", (F.col("sequence") + chunks).alias("sequence"), "offset")
    pieces = placed.unionByName(filled).unionByName(streamed).select("place", piece.alias("p")).groupBy("place").agg(F.collect_list("p").alias("pieces"))  # less than a window's tokens
    full = per.where(F.col("class") == CHUNKS).select(F.col("task").alias("t"), F.col("rank0").alias("chunks0"))
    rows = ids.join(pieces, "place", "left").join(full, F.col("task") == F.col("t"))
    return rows.select("doc_id", "n", (F.col("chunks") + F.col("chunks0")).alias("first"), "ids", "pieces").mapInPandas(_cutter(tokenizer, window), PIECES)


def _cutter(tokenizer: str, window: int):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = None
        for b in batches:
            out: list[tuple] = []
            size = 0
            for doc, n, first, raw, pieces in zip(b["doc_id"], b["n"], b["first"], b["ids"], b["pieces"], strict=True):
                if kind is None and n:
                    kind = f"<u{len(raw) // n}"
                own = np.frombuffer(raw, kind).astype("<u4") if n else np.zeros(0, "<u4")
                parts = [(k * window, window, first + k, 0) for k in range(n // window)]
                parts += [(p["start"], p["length"], p["sequence"], p["offset"]) for p in (pieces if pieces is not None else ())]
                doc = None if pd.isna(doc) else int(doc)
                for s, length, sequence, offset in parts:
                    out.append((doc, s, length, n, sequence, offset, own[s : s + length].tobytes()))
                size += 4 * n
                if size > 8_000_000:
                    yield _frame(out)
                    out, size = [], 0
            if out:
                yield _frame(out)

    return go


def _frame(rows: list[tuple]) -> pd.DataFrame:
    got = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
    return got.assign(doc_id=got["doc_id"].astype("Int64"))


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """``(sequence_id, n, ids)``: the ids of each sequence in order, padded with ``pad`` to a window unless ``n`` is a power of two."""
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(held.alias("held"), F.sum("length").alias("n"))  # a window's ids
    joined = F.aggregate("held", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    filler = F.unhex(F.repeat(F.lit(pad.to_bytes(4, "little").hex()), (F.lit(window) - F.col("n")).cast("int")))
    even = F.bit_count(F.col("n")) == 1
    return rows.select("sequence_id", "n", F.when(even, joined).otherwise(F.concat(joined, filler)).alias("ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 2048."""
    pieces = pack(table(spark, sf_dir, "documents"), default_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
