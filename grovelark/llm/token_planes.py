"""Token ids in a binary format of bit or byte planes.

A file (one per range of ``doc_id``) is

    magic ``GLBP0001`` | planes of chunk 0 | planes of chunk 1 | … | index | length of the index (u64) | ``GLBP0001``

A chunk holds ``chunk_ids`` ids (the last one of a file fewer). Its ids, as unsigned 32-bit little-endian numbers, are
transposed: plane ``p`` has bit ``p`` (or byte ``p``) of every id, so that the high planes are runs of zeros. Each plane
is compressed with zstandard on its own; a plane of zeros only takes no bytes. The index, compressed too, has the plane
width, the number of ids, the offset and length of every plane of every chunk, and for every document its id, whether
that id is null, and its number of ids. A reader can fetch any chunk alone.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, pick, table, worker_cache

MAGIC = b"GLBP0001"
CHUNK_IDS = 1 << 16
END_ID = 1
#: Words that a worker remembers; more take memory, fewer are learnt again more often.
MEMO_WORDS = 500_000
_OWN_WORDS, _SPACE = re.compile(r"(?:\S|[\x1c-\x1f])+"), re.compile(r"[^\S\x1c-\x1f]")

DOC_ROWS = "file string, position bigint, doc_id bigint, n_tokens bigint, before bigint, ids_crc32 bigint"


def pack_chunk(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The compressed planes of one chunk: 4 byte planes or 32 bit planes."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        flat = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(flat[:, p], bitorder="little") for p in range(32)]
    else:
        planes = [np.ascontiguousarray(raw[:, p]) for p in range(4)]
    press = zstandard.ZstdCompressor(level=1)
    return [press.compress(p.tobytes()) if p.any() else b"" for p in planes]


def unpack_chunk(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a chunk from its compressed planes."""
    bits = len(planes) == 32
    width = (n + 7) // 8 if bits else n
    expand = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(expand.decompress(p, max_output_size=width), np.uint8) if p else np.zeros(width, np.uint8) for p in planes]
    if bits:
        flat = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], axis=1)
        raw = np.packbits(flat, axis=1, bitorder="little")
    else:
        raw = np.stack(rows, axis=1)
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file; memory is bounded by one chunk and the table of documents."""

    def __init__(self, sink: io.RawIOBase, chunk_ids: int = CHUNK_IDS, bits: bool = False):
        self.sink, self.chunk_ids, self.bits = sink, chunk_ids, bits
        self.at, self.planes, self.waiting, self.n_waiting, self.n_ids = len(MAGIC), [], [], 0, 0
        self.doc_ids, self.nulls, self.counts = [], [], []
        sink.write(MAGIC)

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents in order: their ids, how many token ids each has, and these one after another."""
        self.nulls += [d is None for d in doc_ids]
        self.doc_ids += [0 if d is None else int(d) for d in doc_ids]
        self.counts.append(np.asarray(counts, np.int64))
        self.n_ids += len(ids)
        while self.n_waiting + len(ids) >= self.chunk_ids:
            take = self.chunk_ids - self.n_waiting
            self._chunk(np.concatenate([*self.waiting, ids[:take]]))
            self.waiting, self.n_waiting, ids = [], 0, ids[take:]
        if len(ids):
            self.waiting.append(ids)
            self.n_waiting += len(ids)

    def _chunk(self, ids: np.ndarray) -> None:
        for p in pack_chunk(ids, self.bits):
            self.planes.append((self.at, len(p)))
            self.at += len(p)
            self.sink.write(p)

    def close(self) -> None:
        if self.n_waiting:
            self._chunk(np.concatenate(self.waiting))
        head = json.dumps({"chunk_ids": self.chunk_ids, "planes": 32 if self.bits else 4, "n_ids": self.n_ids, "n_chunks": len(self.planes) // (32 if self.bits else 4), "n_docs": len(self.doc_ids)}).encode()
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        body = struct.pack("<I", len(head)) + head + np.array(self.planes, "<i8").tobytes() + np.array(self.doc_ids, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes() + counts.astype("<i8").tobytes()
        body = zstandard.ZstdCompressor(level=3).compress(body)
        self.sink.write(body + struct.pack("<Q", len(body)) + MAGIC)


class PlaneReader:
    """Reads a file held in memory, chunk by chunk."""

    def __init__(self, content: bytes):
        if content[: len(MAGIC)] != MAGIC or content[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token plane file, or one cut short")
        (size,) = struct.unpack("<Q", content[-len(MAGIC) - 8 : -len(MAGIC)])
        body = zstandard.ZstdDecompressor().decompress(content[-len(MAGIC) - 8 - size : -len(MAGIC) - 8])
        (n,) = struct.unpack("<I", body[:4])
        self.content, self.head, at = content, json.loads(body[4 : 4 + n]), 4 + n
        chunks, docs = self.head["n_chunks"], self.head["n_docs"]
        self.planes = np.frombuffer(body, "<i8", chunks * self.head["planes"] * 2, at).reshape(chunks, self.head["planes"], 2)
        at += self.planes.nbytes
        self.doc_ids = np.frombuffer(body, "<i8", docs, at)
        self.nulls = np.frombuffer(body, np.uint8, docs, at + 8 * docs).astype(bool)
        self.counts = np.frombuffer(body, "<i8", docs, at + 9 * docs)

    def chunk(self, k: int) -> np.ndarray:
        n = min(self.head["chunk_ids"], self.head["n_ids"] - k * self.head["chunk_ids"])
        return unpack_chunk([self.content[a : a + size] for a, size in self.planes[k]], n)

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, ids before it in this file, ids, crc32 of its ids as little-endian unsigned 32-bit numbers)."""
        k, left, before = 0, np.zeros(0, "<u4"), 0
        for doc, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.counts.tolist(), strict=True):
            crc, need = 0, n
            while need:
                if not len(left):
                    left, k = self.chunk(k), k + 1
                part, left = left[:need], left[need:]
                crc = zlib.crc32(part.tobytes(), crc)
                need -= len(part)
            yield None if null else doc, before, n, crc
            before += n


class WordMemo:
    """Token ids of texts by way of their distinct words.

    The tokenizer drops white space and none of its rules looks across it, so a text's ids are those of its white-space
    separated words one after another. Words of Latin letters and marks are lowered, cut into runs of letters and of marks
    and given to the tokenizer's merges together, where ``</w>`` tokens show the ends; all others go through the whole
    tokenizer one by one. (The separators 1C to 1F are white space to Python, not to the tokenizer.) The tests hold both
    against the tokenizer on whole texts.
    """

    def __init__(self, path: str, words: int = MEMO_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.merges = Tokenizer.from_file(path)
        self.merges.encode_special_tokens = True
        spec = json.loads(self.whole.to_str())
        self.by_words = spec["model"].get("end_of_word_suffix") == "</w>" and spec["normalizer"] is not None
        if self.by_words:
            from tokenizers import normalizers

            self.merges.normalizer = normalizers.Sequence([])
            self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
            marks = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which starts contractions
            to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.bytes = str.maketrans({c: to_bytes.pre_tokenize_str(c)[0][0] for c in sorted(set((letters + marks).lower()))})
            self.odd, self.marks = re.compile(f"[^{letters}{re.escape(marks)}\\x20\\x09-\\x0D]"), re.compile(f"[{re.escape(marks)}]+")
            vocabulary = self.whole.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.limit = {}, words
        self.starts, self.sizes, self.ids, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _split(self, text: str) -> list[str]:
        """The keys of a text in order: letters, marks, or ``\\0`` and a word that only the whole tokenizer can take."""
        out, at, m = [], 0, self.odd.search(text)
        while m:
            s, e = m.start(), _OWN_WORDS.match(text, m.start())
            while e and s > at and not _SPACE.match(text, s - 1):
                s -= 1
            out += self.marks.sub(r" \g<0> ", text[at:s].lower()).split()
            at = e.end() if e else m.end()  # white space that is not plain, or a word of its own
            if e:
                out.append("\0" + text[s:at])
            m = self.odd.search(text, at)
        return out + self.marks.sub(r" \g<0> ", text[at:].lower()).split()

    def _learn(self, new: list[str]) -> None:
        plain, odd = [w for w in new if w[0] != "\0"], [w for w in new if w[0] == "\0"]
        flat, size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if plain:
            flat = np.array(self.merges.encode_batch_fast([" ".join(plain).translate(self.bytes)], add_special_tokens=False)[0].ids, np.uint32)
            size = np.diff(np.concatenate([[0], np.flatnonzero(self.ends[flat]) + 1]))
            if len(size) != len(plain):
                raise ValueError("the tokenizer's word ends don't fit its words")
        if odd:
            lists = [e.ids for e in self.whole.encode_batch_fast([w[1:] for w in odd], add_special_tokens=False)]
            flat = np.concatenate([flat, np.array([i for x in lists for i in x], np.uint32)])
            size = np.concatenate([size, np.array([len(x) for x in lists], np.int64)])
        base, n = len(self.words), len(new)
        self.words.update(zip(plain + odd, range(base, base + n), strict=True))
        self.starts, self.sizes = _room(self.starts, base + n), _room(self.sizes, base + n)
        self.ids = _room(self.ids, self.n + len(flat))
        self.starts[base : base + n] = self.n + np.cumsum(size) - size
        self.sizes[base : base + n] = size
        self.ids[self.n : self.n + len(flat)] = flat
        self.n += len(flat)

    def encode(self, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids of all texts one after another."""
        if not self.by_words:
            lists = [e.ids + ([] if end_id is None else [end_id]) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([len(x) for x in lists], np.int64), np.array([i for x in lists for i in x], np.uint32)
        if len(self.words) > self.limit:  # a bound of memory: what is dropped is learnt again; common words come first and stay
            keep = self.limit // 2
            self.n = int(self.starts[keep])
            self.words = dict(islice(self.words.items(), keep))
        split = [self._split(t) for t in texts]
        flat = [w for ws in split for w in ws]
        at = np.fromiter(map(self.words.get, flat, repeat(-1)), np.int64, len(flat))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            self._learn(list(dict.fromkeys(flat[i] for i in unknown)))
            at[unknown] = [self.words[flat[i]] for i in unknown]
        sizes, starts = self.sizes[at], self.starts[at]
        n_words = np.array([len(ws) for ws in split], np.int64)
        ends_at = np.cumsum(n_words)
        if end_id is not None:  # an end id stands as one more word after each text
            sizes, starts = np.insert(sizes, ends_at, 1), np.insert(starts, ends_at, -1)
            ends_at = ends_at + np.arange(1, len(texts) + 1)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        where = _ranges(starts, sizes)
        if end_id is None:
            return np.diff(np.concatenate([[0], sums[ends_at]])), self.ids[where]
        last = sums[ends_at] - 1
        where[last] = 0
        out = self.ids[where]
        out[last] = end_id
        return np.diff(np.concatenate([[0], sums[ends_at]])), out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each range, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def _open_sink(folder: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    return store, path


def write_planes(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = END_ID, chunk_ids: int = CHUNK_IDS, bits: bool = False) -> DataFrame:
    """Encode every text and write its ids, in ascending ``doc_id`` order, as plane files below ``folder``.

    ``tokenizer`` is the path of a tokenizer file. A null text is an empty one; ``end_id`` (if any) ends each document.
    Documents are dealt out by ranges of ``doc_id``, one file each, named by the range; a null ``doc_id`` comes first,
    equal ones stand in the order of their texts. A task that is run again writes its file anew under another name and
    then renames it, so a lost executor leaves no half file. Returns ``(file, n_docs, n_ids)``.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = worker_cache("token_planes")
        memo = held.get(tokenizer) or held.setdefault(tokenizer, WordMemo(tokenizer))
        store, path = _open_sink(folder)
        name = f"planes-{TaskContext.get().partitionId():06d}.glbp"
        trial, writer = f"{path}/_{name}-{uuid.uuid4().hex}", None
        store.create_dir(path, recursive=True)
        with store.open_output_stream(trial) as sink:
            writer = PlaneWriter(sink, chunk_ids, bits)
            for b in batches:
                texts, ids = b["text"].fillna("").tolist(), [None if pd.isna(d) else int(d) for d in b["doc_id"]]
                for lo, hi in _spans(texts, 500_000):
                    writer.add(ids[lo:hi], *memo.encode(texts[lo:hi], end_id))
            writer.close()
        if not writer.doc_ids:
            store.delete_file(trial)
            return
        store.move(trial, f"{path}/{name}")
        yield pd.DataFrame({"file": [name], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids]})

    rows = pick(docs, "doc_id", "text")
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInPandas(write, "file string, n_docs bigint, n_ids bigint")


def _spans(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about ``chars`` characters; a longer text is one of its own."""
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > chars:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def read_planes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the plane files below ``folder``: ``(file, position, doc_id, n_tokens, before, ids_crc32)``,
    where ``before`` counts the ids before it in its file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                got = list(PlaneReader(content).documents())
                yield pd.DataFrame({
                    "file": path.rsplit("/", 1)[-1], "position": range(len(got)), "doc_id": pd.array([g[0] for g in got], "Int64"),
                    "n_tokens": [g[2] for g in got], "before": [g[1] for g in got], "ids_crc32": [g[3] for g in got],
                })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "planes-*.glbp").load(folder)
    return files.select("path", "content").mapInPandas(read, DOC_ROWS)


def encode_documents(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the plane files and read them back: ``(doc_id, start, n_tokens, ids_crc32)``.

    An empty table gives no file and no row.
    """
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "planes")
    written = write_planes(docs, folder, tokenizer, **options).toPandas()  # one row per file
    starts = spark.createDataFrame(_starts(written), "file string, first bigint")
    if not len(written):
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    rows = read_planes(spark, folder).join(F.broadcast(starts), "file")
    return rows.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _starts(written: pd.DataFrame) -> pd.DataFrame:
    files = written.sort_values("file")
    return pd.DataFrame({"file": files["file"].astype(str), "first": (files["n_ids"].cumsum() - files["n_ids"]).astype("int64")})


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token ids in plane files, read back."""
    return encode_documents(table(spark, sf_dir, "documents"), default_tokenizer())
