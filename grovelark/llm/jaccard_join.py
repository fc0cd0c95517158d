"""Documents whose shingle sets are alike, by partition of the universe and pigeonhole.

A document's set is that of the hashes of its word shingles. Two sets link if ``100 · |A ∩ B| >= percent · |A ∪ B|``, that is, if
they differ in at most ``q · (|A| + |B|)`` shingles with ``q = (100 - percent) / (100 + percent)``.

1. **Index.** Sizes are cut into bands; a band whose largest size is U allows H = ``floor(2 q U)`` differences. Its universe is
   dealt by hash into segments, each either *exact* (its subset must be equal) or with its *one-deletion neighbourhood* (the
   subset and every subset with one shingle less: within two differences). If exact ones count once, others twice, and
   they come to H + 1 + s, two sets of the band that link agree in segments that count s + 1 at least. So each set may leave out
   its s exact segments of fewest shingles (ties by key): the order is the same for both, so of s + 1 common ones the last stays
   in either index. Nothing is lost, and segments that are empty or nearly so, which chance fills alike, name no key. How many
   segments have neighbourhoods and how many are left out is a matter of cost: rows of the index against expected chance hits, by the
   number of documents in the band. A set also has keys in the band above if a set there can link with it.
2. **Classes.** Equal sets are one class, so copies cost nothing from here on.
3. **Shared keys.** Keys travel as sorted runs of 32 bits within a range of keys, with the number of the row. Keys that a run
   has twice go straight on and count once in it, so a hot key is as many entries as there are runs.
4. **Stars.** All pairs of a key's classes would be quadratic in a group of near copies. Instead each key names a hub, the class
   that shares the most keys (the text that the others were copied from), and every class meets its hubs only.
5. **Parts.** A hub's group is dealt out over parts that fit a task, each with the hub. Every row of the index has a *sketch*, which says
   of each of some 3 places per shingle whether an odd number of shingles falls on it. Sketches differ in no more places than
   their sets, so only members that have another one within reach by sketch fetch their whole sets. A part returns links that join
   what its links join, fewer than it has members; so the links span the components, but are not all links, and nothing
   here counts links per document.
6. **Across parts, exactly.** Of two members of a group that parts have not joined yet, one at least is outside the group's commonest
   component. Up to some thousands of these meet all others, part by part, as in step 5. Where they are more, a link between two
   under one hub can be missing only if one of them doesn't link with the hub: then their differences from the hub must overlap in a known
   number of shingles, and a prefix join on these, those that the hub lacks first, finds all such pairs; first on sets of the shingles'
   leading bytes, as many as keep chance rare (these too differ in no more places than the whole sets), then on whole ones.
7. **Components** of the links by alternating stars.

Results for odd input: texts that are null or have no word have no set, link with nothing and are their own component; fewer
words than a shingle are one shingle; repeated rows get a row each; rows without ``doc_id`` count for a component that has
others, else it has none; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_light, cut, pick, table

WIDTH, PERCENT = 3, 90
#: Tokens and members of a group, or of a part of one, that a task compares, about; a longer set is one of its own.
GROUP_TOKENS, GROUP_MEMBERS = 250_000, 1_000
#: Blocks as large that may meet all parts of a group.
MOST_BLOCKS = 8
#: Keys of a run, and of a range of keys, about.
RUN_KEYS, RANGE_KEYS = 1_000_000, 2_000_000
#: A band's largest size is its smallest by ``(100 / percent) ** BAND_STEPS``.
BAND_STEPS = 2
CHARS_PER_WORD, CHANCE = 6.0, 0.2
#: Places of a sketch per shingle, at least; the next power of two is taken.
PLACES = 2
#: Texts, and characters of them, that a task has in hand at once; a longer text is alone.
SPAN_ROWS, SPAN_CHARS = 500, 1_000_000
WHOLE = 8
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]  # bytes: ASCII rules only
    flat = [w for ws in split for w in ws]
    if not flat:
        return [np.zeros(0, np.uint64) for _ in texts]
    held = np.empty(len(flat), object)
    held[:] = flat
    number, values = pd.factorize(held)
    word = np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), np.uint64, len(values))[number]
    shingle = word.copy()
    for j in range(1, width):
        shingle = _mixed(shingle * _A + np.uint64(j))
        shingle[: max(len(word) - j, 0)] += word[j:]
    shingle = _mixed(shingle)
    out, at = [], 0
    for ws in split:
        n = len(ws)
        if n >= width:
            out.append(np.unique(shingle[at : at + n - width + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws) + b"\0short")], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def spans(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and total + n > chars:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)


def _sizes(mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of a segment and the share of segments of each, if its mean is ``mean``."""
    if mean > 500:
        return np.array([mean]), np.ones(1)
    k = np.arange(int(mean + 8 * math.sqrt(mean) + 12))
    return k, np.exp(k * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))]))


class Bands:
    """Bands of sizes, and for each the number of segments, how many of them have neighbourhoods and how many are left out."""

    def __init__(self, percent: int, counts: dict[int, int]):
        self.percent, self.lows = percent, [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, math.ceil(self.lows[-1] * (100 / percent) ** BAND_STEPS)))
        self.counts = counts
        self.plans = {b: self._plan(b, n) for b, n in counts.items()}

    def plan(self, band: int) -> tuple[int, int, int]:
        """Segments, those with neighbourhoods, and exact ones left out."""
        if band not in self.plans:
            self.plans[band] = self._plan(band, self.counts.get(band, 0))
        return self.plans[band]

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def allowed(self, band: int) -> int:
        return 2 * (self.lows[band + 1] - 1) * (100 - self.percent) // (100 + self.percent)

    def _plan(self, band: int, n: int) -> tuple[int, int, int]:
        need, top, best = self.allowed(band) + 1, self.lows[band + 1] - 1, None
        for near in range(min(need, 64) // 2 + 1):
            for left_out in sorted({need * f // 8 for f in range(13)}):
                m = max(need + left_out - near, near, 1)
                exact, size = m - near, 0.75 * top / m
                if left_out and left_out >= exact:
                    continue
                k, share = _sizes(size)
                kept = np.diff(np.minimum(np.cumsum(share[::-1]), (exact - left_out) / exact), prepend=0.0)[::-1] if exact else 0 * share
                rows = exact - left_out + near * (size + 1)
                chance = n * (exact * (kept * CHANCE**k).sum() + near * (size + 1) * (share * CHANCE ** np.maximum(k - 1, 0)).sum())
                if best is None or rows + chance < best[0]:
                    best = (rows + chance, m, near, left_out)
        return best[1:]

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """The index keys of a set; none where only an equal set could link with it."""
        n, out = len(tokens), []
        if not n:
            return np.zeros(0, np.int64)
        own = self.band(n)
        for band in (own, own + 1):
            if band > own and 100 * n < self.percent * self.lows[band]:
                continue
            if not self.allowed(band):
                continue
            m, near, left_out = self.plan(band)
            mixed = _mixed(tokens + np.uint64((band + 1) * int(_A) & _MASK))
            segment = (mixed % np.uint64(m)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            weight, segment = _mixed(mixed[order] + _C), segment[order]
            sums = np.zeros(m, np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            sums[segment[starts]] = np.add.reduceat(weight, starts)
            place = np.arange(m, dtype=np.uint64) * _A + np.uint64((2 * band + 1) * int(_B) & _MASK)
            whole = _mixed(sums + place)
            fewest = np.lexsort((whole[near:], np.bincount(segment, minlength=m)[near:]))
            out += [whole[:near], whole[near:][fewest[left_out:]]]
            if near:
                part = segment < near
                out.append(_mixed(sums[segment[part]] - weight[part] + place[segment[part]]))
        return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def _set_id(tokens: np.ndarray) -> bytes | None:
    return hashlib.md5(tokens.tobytes()).digest() if len(tokens) else None


def sketch(tokens: np.ndarray) -> bytes:
    """A bit per place: whether an odd number of tokens falls on it."""
    places = 1 << max(6, (PLACES * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketches as if they had been made with ``size`` bytes, a power of two."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, size), axis=1)


def _reach(n: np.ndarray, sketches: list[bytes], percent: int) -> Callable[[int], np.ndarray]:
    """Whether each of the sets with sizes ``n`` and ``sketches`` is within reach of one of them."""
    sizes = np.array([len(s) for s in sketches])
    rows = {size: np.flatnonzero(sizes == size) for size in np.unique(sizes)}
    bits = {(size, size): np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(len(at), size) for size, at in rows.items()}

    def reach(i: int) -> np.ndarray:
        out = np.zeros(len(n), bool)
        own = np.frombuffer(sketches[i], np.uint8)[None, :]
        for size, at in rows.items():
            fit = 100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i])
            if fit.any():
                least = min(size, sizes[i])
                if (size, least) not in bits:
                    bits[size, least] = folded(bits[size, size], least)
                d = np.bitwise_count(bits[size, least][fit] ^ folded(own, least)).sum(axis=1, dtype=np.int64)
                out[at[fit]] = (100 + percent) * d <= (100 - percent) * (n[at[fit]] + n[i])
        return out

    return reach


def near_members(n: np.ndarray, sketches: list[bytes], hub: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of places in ``n`` (sizes) and ``sketches`` within reach: those with ``hub`` as ``(hub, i)``, and those not both within reach of it."""
    reach = _reach(n, sketches, percent)
    linked = reach(hub)
    out = [(hub, int(i)) for i in np.flatnonzero(linked) if i != hub]
    for i in np.flatnonzero(~linked):
        out += [(int(i), int(j)) for j in np.flatnonzero(reach(i)) if linked[j] and j != hub or not linked[j] and j > i]
    return out


def in_company(n: np.ndarray, sketches: list[bytes], label: np.ndarray, hub: int, percent: int) -> np.ndarray:
    """Whether each member of a group has another one of a different ``label`` within reach."""
    reach = _reach(n, sketches, percent)
    names, number, count = np.unique(label, return_inverse=True, return_counts=True)
    near = np.zeros(len(n), bool)
    if len(names) == len(n):  # those within reach of the hub need no look at each other: they are in company
        near = reach(hub)
        near[hub] = near.sum() > 1
        others = np.flatnonzero(~near)
    else:
        others = np.flatnonzero(number != count.argmax())
    for i in others:
        met = reach(i) & (label != label[i])
        if met.any():
            near |= met
            near[i] = True
    return near


def spanning(sets: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between ``sets`` that join all that links join, where sets of one ``label`` are joined already: fewer than there are sets.

    The first set is held against all. From then on a set of the most common label needs no look: whoever has another one takes it.
    """
    n = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(n) - n
    if len(sets) < 2:
        return []
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    label, out, mark = np.unique(label, return_inverse=True)[1], [], np.zeros(len(token), bool)
    main = int(np.flatnonzero(label == np.bincount(label).argmax())[0]) if len(np.unique(label)) < len(sets) else 0
    for i in range(len(sets)):
        if i and label[i] == label[main]:
            continue
        own = token[starts[i] : starts[i] + n[i]]
        mark[own] = True
        common = np.add.reduceat(mark[token], starts, dtype=np.int64)
        mark[own] = False
        met = np.flatnonzero((100 * common >= percent * (n + n[i] - common)) & (label != label[i]))
        names, first = np.unique(label[met], return_index=True)
        out += [(i, int(j)) for j in met[first]]
        label[np.isin(label, names)] = label[i]
    return out


def indexed(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, mark, sid, n, keys, sketch)`` per row of ``docs (doc_id, text)``: a hash of its text, the id and size of its set, its
    index keys and, if it has any, its sketch."""
    lows = Bands(percent, {}).lows
    guess = F.greatest(F.lit(1), (F.length("text") / CHARS_PER_WORD).cast("int"))
    step = BAND_STEPS * math.log(100 / percent)
    rough = docs.groupBy(F.floor(F.log(guess.cast("double")) / step).alias("s")).agg(F.count(F.lit(1)).alias("n")).where("s IS NOT NULL").collect()  # a row per band
    counts: dict[int, int] = {}
    for r in rough:
        b = int(np.searchsorted(lows, math.exp(r["s"] * step) + 1, side="right")) - 1
        counts[b] = counts.get(b, 0) + r["n"]
    bands = Bands(percent, counts)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SPAN_ROWS):  # a batch's texts are many megabytes: only some are Python's at a time
                b = whole.slice(at, SPAN_ROWS)
                texts = b.column("text").to_pylist()
                for lo, hi in spans(texts, SPAN_CHARS):
                    sets = shingle_sets(texts[lo:hi], width)
                    keys = [bands.keys(s) for s in sets]
                    ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                    sketches = [sketch(s) if len(k) else None for s, k in zip(sets, keys, strict=True)]
                    own = b.slice(lo, hi - lo)
                    columns = [own.column("doc_id"), own.column("mark"), pa.array([_set_id(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32())]
                    columns += [pa.ListArray.from_arrays(ends, np.concatenate(keys)), pa.array(sketches, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "sid", "n", "keys", "sketch"])

    return docs.select("doc_id", _mark().alias("mark"), "text").mapInArrow(go, "doc_id bigint, mark bigint, sid binary, n int, keys array<bigint>, sketch binary")


def _mark() -> Column:
    return F.xxhash64("text")


def narrowed(tokens: np.ndarray, size: int) -> bytes:
    """The distinct leading ``size`` bytes of sorted tokens, in order."""
    if size < WHOLE:
        tokens = np.unique(tokens >> np.uint64(64 - 8 * size))
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def widened(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def told(docs: DataFrame, width: int) -> DataFrame:
    """``(hub, salt, size, salts, sid, n, tokens)``: the set of every row of ``docs (text, asks)``, sorted, as tokens of ``size``
    bytes, for each group that asks for it; ``n`` is the size of the whole set. A task tells a set once, however many rows have it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, SPAN_ROWS):
                texts, asks = (batch.column(c).slice(at, SPAN_ROWS).to_pylist() for c in ("text", "asks"))
                for lo, hi in spans(texts, SPAN_CHARS):
                    rows = []
                    for tokens, ask in zip(shingle_sets(texts[lo:hi], width), asks[lo:hi], strict=True):
                        sid = _set_id(tokens)
                        if sid not in said:
                            said.add(sid)
                            raw = {size: narrowed(tokens, size) for size in {a["size"] for a in ask}}
                            rows += [a | {"sid": sid, "n": len(tokens), "tokens": raw[a["size"]]} for a in ask]
                    for i in range(0, len(rows), 500):
                        yield pa.RecordBatch.from_pylist(rows[i : i + 500], schema)

    schema = pa.schema([("hub", pa.binary()), ("salt", pa.int32()), ("size", pa.int32()), ("salts", pa.int64()), ("sid", pa.binary()), ("n", pa.int32()), ("tokens", pa.binary())])
    return docs.select("text", "asks").mapInArrow(go, "hub binary, salt int, size int, salts long, sid binary, n int, tokens binary")


def compare(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, whole: bool, rest: bool = True) -> DataFrame:
    """``(a, b, n, linked, head, half, d)`` for ``pairs (a, b)``: b's size, whether they link and, of the ``d`` differences between
    the sets, the prefix that ``missing_pairs`` needs: what only b has first, then what only a has, each by hash. Its first ``half`` are
    enough to meet what doesn't link with a either.

    Without ``whole`` the sets are of leading bytes and ``linked`` is false only if they can't link. Without ``rest`` there are no
    prefixes.

    ``classes (sid, doc_id, mark, n)`` names a text of each set. Sets move once per pair, to the group of their ``a``; groups
    of more than ``GROUP_TOKENS`` are dealt out over several, to each of which a's set goes.
    """

    def go(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a, size = key[0], int(group["size"].iloc[0])
        sets = {sid: (int(n), raw) for sid, n, raw in zip(group["sid"], group["n"], group["tokens"], strict=True)}
        nx, raw = sets.pop(a)
        x, members = widened(raw, size), []
        for b, (ny, raw) in sets.items():
            y = widened(raw, size)
            new, old = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
            d = len(new) + len(old)
            linked = (100 + percent) * d <= (100 - percent) * (nx + ny)
            most = max(1, ((100 + percent) * d + (100 - percent) * (nx - ny)) // (2 * (100 + percent)) + 1)
            least = most if linked else max(1, d - ny * (100 - percent) // percent)
            both = np.concatenate([new, old])
            head = both[: max(d - least + 1, 0)].view(np.int64) if rest else None
            members.append((a, b, ny, linked, head, max(d - max(most, least) + 1, 0), d))
        out = pd.DataFrame(members, columns=["a", "b", "n", "linked", "head", "half", "d"])
        return out.astype({"n": "Int32", "half": "Int32", "d": "Int32"})

    sized = classes.select("sid", F.col("n").alias("size_of"))
    load = pairs.join(sized.withColumnRenamed("sid", "b"), "b").groupBy("a").agg(F.greatest(F.lit(1), F.ceil(F.sum("size_of") / GROUP_TOKENS)).alias("salts"))
    # 64 times as many values as a set has tokens, so that a difference is taken for none in a sixtieth of all cases at most
    size = F.lit(WHOLE) if whole else F.when(F.col("size_of") <= 1 << 10, 2).when(F.col("size_of") <= 1 << 18, 3).otherwise(4)
    load = cut(load.join(sized.withColumnRenamed("sid", "a"), "a").select("a", "salts", size.alias("size")))
    member = pairs.join(load, "a").select(F.col("b").alias("sid"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "size", "salts")
    hub = load.select(F.col("a").alias("sid"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"), "size", "salts")
    return _sets(member.unionByName(hub), docs, classes, width).groupBy("hub", "salt").applyInPandas(go, "a binary, b binary, n int, linked boolean, head array<bigint>, half int, d int")


def _sets(asked: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``told`` for ``asked (sid, hub, salt, size, salts)``."""
    asks = asked.groupBy("sid").agg(F.collect_list(F.struct("hub", "salt", "size", "salts")).alias("asks"))  # a set's keys and salts at most
    wanted = cut(asks.join(classes, "sid").select(F.col("doc_id").alias("w"), F.col("mark").alias("m"), "asks"))
    here = docs.withColumn("m", _mark())
    few = here.join(broadcast_if_light(cut(wanted.select("m").distinct())), "m", "left_semi")  # only these texts may have to move
    texts = few.join(wanted.withColumnRenamed("m", "m2"), (F.col("m") == F.col("m2")) & F.col("doc_id").eqNullSafe(F.col("w")))
    return told(texts, width)


def _run(at: np.ndarray, keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes]]:
    """``(range, own, packet)`` of a run of keys: what it has twice as packets of their own (``own`` > 0), else by range."""
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    slot = keys >> np.uint64(32 - bits)
    first = np.concatenate([[True], slot[1:] != slot[:-1]])
    again = ~first | ~np.concatenate([first[1:], [True]])
    if again.any():
        yield -1, int(at[again][0]) + 1, zstandard.compress(slot[again].tobytes() + at[again].tobytes(), 1)
    slot, at = slot[first], at[first]
    where = (slot >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        base = at[lo:hi].min()
        gaps = np.diff(slot[lo:hi], prepend=slot[lo] & ~np.uint64(0xFFFFFFFF))
        parts = [planes(gaps.astype("<u4")), planes((at[lo:hi] - base).astype("<u8"))]
        yield int(where[lo]), 0, int(base).to_bytes(8, "little") + zstandard.compress(b"".join(parts), 1)


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers by place: leading zeros stand together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def shared_keys(index: DataFrame, bits: int) -> DataFrame:
    """``(key, at)`` of the keys that several rows of ``index (at, keys)`` have; some more than once.

    A key here is its leading ``bits`` + 32 bits; ``2 ** bits`` ranges of them are met apart.
    """

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        held = 0
        for b in batches:
            for a, k in zip(b["at"], b["keys"], strict=True):
                if held and held + len(k) > RUN_KEYS:
                    yield pd.DataFrame(_run(np.concatenate(at), np.concatenate(keys), bits), columns=["range", "own", "packet"])
                    at, keys, held = [], [], 0
                at.append(np.full(len(k), a, np.int64))
                keys.append(np.asarray(k, np.int64).view(np.uint64))
                held += len(k)
        if held:
            yield pd.DataFrame(_run(np.concatenate(at), np.concatenate(keys), bits), columns=["range", "own", "packet"])

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if key[1]:
            raw = zstandard.decompress(group["packet"].iloc[0])
            return pd.DataFrame({"key": np.frombuffer(raw[: len(raw) // 2], np.int64), "at": np.frombuffer(raw[len(raw) // 2 :], np.int64)})
        slots, ats = [], []
        for p in group["packet"]:
            raw = zstandard.decompress(p[8:])
            n = len(raw) // 12
            gaps = np.frombuffer(raw[: 4 * n], np.uint8).reshape(4, n).T.copy().view("<u4").ravel()
            slots.append(np.cumsum(gaps.astype(np.int64)))
            ats.append(np.frombuffer(raw[4 * n :], np.uint8).reshape(8, n).T.copy().view("<i8").ravel() + int.from_bytes(p[:8], "little"))
        slot, at = np.concatenate(slots), np.concatenate(ats)
        order = np.argsort(slot, kind="stable")
        slot, at = slot[order], at[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]])
        again = ~first | ~np.concatenate([first[1:], [True]])
        return pd.DataFrame({"key": slot[again] + (int(key[0]) << 32), "at": at[again]})

    packets = index.select("at", "keys").mapInPandas(runs, "range bigint, own bigint, packet binary")
    return packets.groupBy("range", "own").applyInPandas(meet, "key bigint, at bigint")


def stars(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(hub, sid)`` pairs to compare, and the classes ``(sid, doc_id, mark, at, n)`` with one document each.

    ``index`` is written and has a number ``at`` for each row.
    """
    classes = index.where("sid IS NOT NULL").groupBy("sid").agg(F.min(F.struct("doc_id", "mark", "at")).alias("one"), F.first("n").alias("n"))
    classes = cut(classes.select("sid", "one.doc_id", "one.mark", "one.at", "n"))
    keyed = index.where(F.size("keys") > 0).join(broadcast_if_light(cut(classes.select("at"))), "at", "left_semi")
    total = index.agg(F.sum(F.size("keys"))).first()[0] or 0
    bits = max(4, min(30, math.ceil(math.log2(total / RANGE_KEYS + 1))))
    shared = cut(shared_keys(keyed, bits))
    fame = cut(shared.groupBy("at").agg(F.count(F.lit(1)).alias("fame")))
    hubs = cut(shared.join(fame, "at").groupBy("key").agg(F.max(F.struct("fame", "at"))["at"].alias("hub")))
    pairs = cut(shared.join(hubs, "key").where("at <> hub").select("hub", "at").distinct())
    names = classes.select("at", "sid")
    named = pairs.join(names, "at").select("hub", "sid").join(names.select(F.col("at").alias("hub"), F.col("sid").alias("h")), "hub")
    return cut(named.select(F.col("h").alias("hub"), "sid")), classes


def missing_pairs(met: DataFrame, percent: int, labels: DataFrame | None = None) -> DataFrame:
    """Pairs ``(a, b)`` of classes under one hub, not both linked with it, whose differences from the hub can overlap enough; with
    ``labels (sid, label)`` of all of them, those of different labels.

    Let dX be the differences of X from the hub H, X not linked with it, Y under the same one. ``|X ^ Y| <= q (|X| + |Y|)``
    needs more than ``(|dY| + q (|H| - |Y|)) / 2`` differences in common, and at least ``|dX| - (100 - percent) / percent · |X|``.
    So the first ``|d| - that + 1`` differences of both, in one order for all, must meet. Differences that the hub lacks come first in
    the order: they are the rare ones. Of two that both don't link with H only shorter prefixes meet, for which the first bound
    holds on either side. Where two meet first, what follows in either must be enough for ``(|dX| + |dY| - q (|X| + |Y|)) / 2`` in
    common. So what the hub has and many lack, which is last in the order, seldom makes a pair of them.
    All this holds for sets of leading bytes too, if the sizes are those of the whole sets.
    """
    dealt = met.where("head IS NOT NULL")
    some = cut(dealt.where("NOT linked").select("a").distinct())
    heads = dealt.join(some, "a", "left_semi").select("a", "b", "n", "linked", "half", "d", F.posexplode("head").alias("pos", "token"))
    left = (F.col("d") - F.col("pos")).cast("bigint")
    heads = heads.select("a", "b", F.col("n").cast("bigint").alias("n"), "linked", "token", (F.col("pos") < F.col("half")).alias("half"), F.col("d").cast("bigint").alias("d"), left.alias("left"))
    heads = cut(heads.withColumn("label", F.col("b")) if labels is None else heads.join(labels.withColumnRenamed("sid", "b"), "b"))
    x, y = heads.where("NOT linked").drop("linked"), heads.where("half").drop("half").withColumnsRenamed({"b": "b2", "n": "n2", "linked": "linked2", "d": "d2", "left": "left2", "label": "label2"})
    pairs = x.join(y, ["a", "token"]).where("label <> label2").where(F.col("linked2") | (F.col("half") & (F.col("b") < F.col("b2"))))
    pairs = pairs.where(2 * (100 + percent) * F.least("left", "left2") >= (100 + percent) * (F.col("d") + F.col("d2")) - (100 - percent) * (F.col("n") + F.col("n2")))
    pairs = pairs.where(100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    return pairs.select(F.least("b", "b2").alias("a"), F.greatest("b", "b2").alias("b")).distinct()


def _sketches(sids: DataFrame, index: DataFrame, classes: DataFrame) -> DataFrame:
    """``(sid, n, sketch)`` of the classes in ``sids (sid)``."""
    wanted = cut(sids.distinct().join(classes.select("sid", "at"), "sid"))
    rows = index.select("at", "n", "sketch").join(broadcast_if_light(cut(wanted.select("at"))), "at", "left_semi")  # only these sketches move
    return rows.join(wanted, "at").select("sid", "n", "sketch")


def within_reach(pairs: DataFrame, index: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs (a, b)`` whose sketches are within reach."""
    sketches = cut(_sketches(pairs.select(F.explode(F.array("a", "b")).alias("sid")), index, classes))
    both = pairs.join(sketches.withColumnsRenamed({"sid": "a"}), "a").join(sketches.withColumnsRenamed({"sid": "b", "n": "n2", "sketch": "sketch2"}), "b")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("sketch").to_pylist(), batch.column("sketch2").to_pylist()
            n = np.stack([batch.column("n").to_numpy(), batch.column("n2").to_numpy()], axis=1).astype(np.int64)
            found = [bool(near_members(n[i], [x[i], y[i]], 0, percent)) for i in range(len(n))]
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return both.select("a", "b", "n", "n2", "sketch", "sketch2").mapInArrow(go, "a binary, b binary")


def dealt(pairs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(hub, salt, sid)`` of the groups of ``pairs (a, b)``, each dealt out over as many parts as fit a task, with its hub in every
    one; and ``(hub, salts)``, the number of parts."""
    sized = classes.select(F.col("sid").alias("b"), F.col("n").alias("size_of"))
    parts = F.greatest(F.lit(1), F.ceil(F.sum("size_of") / GROUP_TOKENS), F.ceil(F.count(F.lit(1)) / GROUP_MEMBERS))
    load = cut(pairs.join(sized, "b").groupBy(F.col("a").alias("hub")).agg(parts.alias("salts")))
    salt = F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")
    hubs = load.select("hub", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt"), F.col("hub").alias("sid"))
    return cut(pairs.withColumnRenamed("a", "hub").join(load, "hub").select("hub", salt, F.col("b").alias("sid")).unionByName(hubs)), load


def group_links(member: DataFrame, index: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` that join whatever links join within each ``(hub, salt)`` of ``member (hub, salt, sid, label)``, where members
    of one label are joined already. Only texts move that have another one of a different label within reach by sketch."""

    def near(key: tuple, group: pa.Table) -> pa.Table:
        sids, hub = group.column("sid").to_pylist(), key[0].as_py()
        label = np.unique(np.array(group.column("label").to_pylist(), object), return_inverse=True)[1]
        found = in_company(group.column("n").to_numpy().astype(np.int64), group.column("sketch").to_pylist(), label, sids.index(hub) if hub in sids else 0, percent)
        return group.select(["hub", "salt", "sid", "label"]).filter(pa.array(found, pa.bool_()))

    def go(key: tuple, group: pa.Table, named: pa.Table) -> pa.Table:
        held = dict(zip(*(group.column(c).to_pylist() for c in ("sid", "tokens")), strict=True))
        names = dict(zip(*(named.column(c).to_pylist() for c in ("sid", "label")), strict=True))
        sids = sorted(held, key=lambda sid: (sid != key[0].as_py(), sid))
        label = np.unique(np.array([names[s] for s in sids], object), return_inverse=True)[1]
        found = spanning([np.frombuffer(held[s], "<u8") for s in sids], label, percent)
        return pa.table({"a": pa.array([sids[i] for i, _ in found], pa.binary()), "b": pa.array([sids[j] for _, j in found], pa.binary())})

    close = member.join(_sketches(member.select("sid"), index, classes), "sid").select("hub", "salt", "sid", "label", "n", "sketch")
    close = cut(close.groupBy("hub", "salt").applyInArrow(near, "hub binary, salt int, sid binary, label binary"))
    sets = _sets(close.select("sid", "hub", "salt", F.lit(WHOLE).alias("size"), F.lit(1).cast("bigint").alias("salts")), docs, classes, width).select("hub", "salt", "sid", "tokens")
    return cut(sets.groupBy("hub", "salt").cogroup(close.groupBy("hub", "salt")).applyInArrow(go, "a binary, b binary").distinct())


def links_across(member: DataFrame, load: DataFrame, roots: DataFrame, index: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between classes of different components ``roots (node, root)`` that are in one group, but may be in different parts.

    Either of such two is not of its group's commonest component. Up to ``MOST_BLOCKS`` blocks of those that are not meet all others part
    by part; more of them by prefixes of their differences from the hub. Links with the hub are in ``roots`` already.
    """
    labels = classes.select("sid", "n").join(roots, F.col("sid") == F.col("node"), "left").select("sid", "n", F.coalesce("root", "sid").alias("label"))
    is_hub = F.col("hub") == F.col("sid")
    held = member.where(~is_hub | (F.col("salt") == 0)).join(load.where("salts > 1"), "hub").join(labels, "sid")
    held = cut(held.select("hub", "salts", "salt", "sid", "label", "n"))
    tops = held.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("hub").agg(F.max(F.struct("c", "label"))["label"].alias("main"))
    held = cut(held.join(tops, "hub").withColumn("other", F.col("label") != F.col("main")).drop("main"))
    blocks = F.greatest(F.ceil(F.sum("n") / GROUP_TOKENS), F.ceil(F.count(F.lit(1)) / GROUP_MEMBERS))
    left = cut(held.where("other").groupBy("hub").agg(blocks.alias("blocks")))
    here = held.join(left.where(F.col("blocks") <= MOST_BLOCKS), "hub")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    parts = here.withColumn("block", every("blocks"))
    others = here.where("other").withColumn("block", F.pmod(F.xxhash64("sid", F.lit(1)), "blocks").cast("int")).withColumn("salt", every("salts"))
    place = (F.col("block") * F.col("salts") + F.col("salt")).cast("int").alias("salt")
    both = parts.select("hub", place, "sid", "label").unionByName(others.select("hub", place, "sid", "label")).distinct()
    links = group_links(cut(both), index, docs, classes, width, percent)
    pairs = held.where(~is_hub).join(left.where(F.col("blocks") > MOST_BLOCKS), "hub", "left_semi").select(F.col("hub").alias("a"), F.col("sid").alias("b"))
    pairs, labels, asked = cut(pairs), labels.select("sid", "label"), []
    for whole in (False, True):  # leading bytes first; whole sets under hubs with some that only seem to link with them
        if pairs.isEmpty():
            break
        met = cut(compare(pairs, docs, classes, width, percent, whole))
        asked.append(cut(within_reach(cut(missing_pairs(met, percent, labels)), index, classes, percent)))
        named = met.where("linked").select("a", "b").join(labels.withColumnsRenamed({"sid": "a", "label": "of"}), "a").join(labels.withColumnRenamed("sid", "b"), "b")
        pairs = cut(named.select("a", "b").join(named.where("of <> label").select("a").distinct(), "a", "left_semi"))
    for more in asked:
        links = links.unionByName(compare(more, docs, classes, width, percent, whole=True, rest=False).where("linked").select("a", "b"))
    return links


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges (a, b)``: the smallest node that links lead to."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        print_of = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if before == print_of:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = print_of
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def similarity_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Membership ``(doc_id, sid, n, component)`` of every row, and links ``(a, b)`` between set ids that span the components.

    Not every link: two sets that both link with their hub are not compared.
    """
    index = cut(indexed(docs, width, percent).withColumn("at", F.monotonically_increasing_id()))  # a written number
    pairs, classes = stars(index)
    pairs = pairs.select(F.col("hub").alias("a"), F.col("sid").alias("b"))
    member, load = dealt(pairs, classes)
    links = group_links(member.withColumn("label", F.col("sid")), index, docs, classes, width, percent)
    roots = components(links)
    if not load.where("salts > 1").isEmpty():
        more = cut(links_across(member, load, roots, index, docs, classes, width, percent))
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    member = index.select("doc_id", "sid", "n").join(roots, index["sid"] == roots["node"], "left")
    return member.select("doc_id", "sid", "n", F.coalesce("root", "sid").alias("component")), links


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    member, _ = similarity_join(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return with_smallest(member).select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")


def with_smallest(member: DataFrame) -> DataFrame:
    """Membership with ``component_id``, the smallest ``doc_id`` of the component."""
    least = cut(member.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least")))
    return member.join(least, "component", "left").withColumn("component_id", F.coalesce("least", _own())).drop("least")


def _own() -> Column:
    return F.when(F.col("component").isNull(), F.col("doc_id"))
