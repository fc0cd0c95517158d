"""Fill-in-middle: each text cut into prefix, middle and suffix, and put in another order between marks.

Cuts are drawn per document from a keyed hash and count code points. Where a cut falls in the UTF-8 bytes is found by
arithmetic on whole words: the bytes of many texts are viewed as unsigned 64-bit words; bytes that end a code point (the
next byte does not continue one) are marked in every word at once; ``bitwise_count`` and a running sum number them; a cut
after the k-th code point is a binary search for its word and a select within the word. No text is decoded.

Results for odd input: a null text is an empty one and stays plain; a null ``doc_id`` is hashed as an empty string; repeated
rows get a row each, and equal ones the same cuts; an empty table gives none; texts of any length are cut whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, text_or_empty

MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
RESULT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
#: Bytes of text that a worker cuts at a time; a longer text is cut alone.
SPAN_BYTES = 4 << 20

_LOW = np.uint64(0x0101010101010101)  # the lowest bit of every byte
_HIGH = np.uint64(0x8080808080808080)


class UnitIndex:
    """Rank and select over the code points of a run of valid UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)  # zeros behind the text: its last byte ends a code point
        padded[: len(data)] = data
        words = padded.view("<u8")
        continues = (words >> np.uint64(7)) & ~(words >> np.uint64(6)) & _LOW
        begins = ~continues & _LOW
        self.ends = (begins[:-1] >> np.uint64(8)) | (begins[1:] << np.uint64(56))
        self.upto = np.cumsum(np.bitwise_count(self.ends).astype(np.int64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that end before each byte offset."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte * np.uint64(8))) - np.uint64(1)
        return self._before(word) + np.bitwise_count(self.ends[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte offset behind the k-th code point, 0 for none."""
        word = np.searchsorted(self.upto, k)
        nth = np.maximum(k - self._before(word), 1).astype(np.uint64)
        running = self.ends[word] * _LOW  # byte i: marks in bytes 0 … i
        reached = ((running | _HIGH) - nth * _LOW) & _HIGH
        return np.where(k > 0, 8 * word + 9 - np.bitwise_count(reached), 0)

    def _before(self, word: np.ndarray) -> np.ndarray:
        return np.where(word > 0, self.upto[np.maximum(word, 1) - 1], 0)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each begins (one offset more than strings)."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def byte_spans(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of strings of at most ``most`` bytes; a longer string is one of its own."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def cut_points(data: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per string: its code points, those before the first and the second cut, and the byte offsets of both cuts."""
    index = UnitIndex(data)
    before = index.rank(at)
    n = np.diff(before)
    one, two = h1 % (n + 1), h2 % (n + 1)
    first, second = np.minimum(one, two), np.maximum(one, two)
    return n, first, second, index.select(before[:-1] + first), index.select(before[:-1] + second)


def arranged(text: bytes, form: str, a: int, b: int) -> bytes:
    """The text cut behind its bytes ``a`` and ``b``, in the order of ``form``."""
    p, s, m = (x.encode() for x in MARKS)
    if form == PSM:
        return p + text[:a] + s + text[b:] + m + text[a:b]
    if form == SPM:
        return s + text[b:] + p + text[:a] + m + text[a:b]
    return text


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form. No mark can begin inside another, so the marks found are the ones put in."""
    part = F.split(output, "|".join(MARKS), -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``RESULT`` rows of ``docs (doc_id, text)``; ``percent`` of the texts are rearranged, ``spm_percent`` of these suffix first.

    A text that is empty or contains a mark stays plain.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    group = [F.conv(F.substring("key", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains("text", F.lit(m))
    stays = (F.col("text") == "") | marked | (group[2] % 100 >= percent)
    form = F.when(stays, PLAIN).when(group[3] % 100 < spm_percent, SPM).otherwise(PSM)
    rows = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"), key.alias("key"))
    rows = rows.select("doc_id", "text", form.alias("form"), group[0].alias("h1"), group[1].alias("h2"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = string_bytes(b.column("text"))
            for lo, hi in byte_spans(at, SPAN_BYTES):
                part = b.slice(lo, hi - lo)
                own, begin = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                n, first, second, a, z = cut_points(own, begin, part.column("h1").to_numpy(), part.column("h2").to_numpy())
                forms, raw = part.column("form").to_pylist(), own.tobytes()
                limits = zip(begin[:-1].tolist(), begin[1:].tolist(), a.tolist(), z.tolist(), forms, strict=True)
                out = [arranged(raw[s:e], f, x - s, y - s) for s, e, x, y, f in limits]
                plain = np.array([f == PLAIN for f in forms])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), part.column("form"), pa.array(first, mask=plain), pa.array(second - first, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rows.mapInArrow(go, RESULT)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged, as digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    again = restored(F.col("output"), F.col("form"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(again).alias("restored_sha256"))


def oracle() -> str:
    return """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    k AS (SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
                 ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
    f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
    p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                            WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
           sha256(pre || mid || suf) AS restored_sha256
    FROM p"""
