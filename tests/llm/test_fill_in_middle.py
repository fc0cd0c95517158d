"""Fill-in-middle against cuts made on decoded texts, and on odd input."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grovelark.llm import fill_in_middle as fim

ALPHABET = "ab \x00<>PSM\té\xdfñ你好\U0001f600́￿"


def plain_version(doc_id, text, seed=1, percent=90, spm_percent=20):
    """(n, form, prefix, middle, output) by slices of the string."""
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def random_texts(n, longest=60):
    luck = random.Random(5)
    return ["".join(luck.choice(ALPHABET) for _ in range(luck.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_index_over_bytes(kind):
    texts = ["", *random_texts(500), "", "\U0001f600" * 9, "é" * 4000, "x" * 8, ""]
    column = pa.array(["dropped", *texts, "dropped"], kind).slice(1, len(texts))
    data, at = fim.string_bytes(column)
    assert data.tobytes().decode() == "".join(texts)
    index = fim.UnitIndex(data)
    before = index.rank(at)
    assert np.diff(before).tolist() == [len(t) for t in texts]
    whole = "".join(texts)
    ends = np.cumsum([0] + [len(c.encode()) for c in whole])
    assert index.select(np.arange(len(whole) + 1)).tolist() == ends.tolist()


def test_no_text_at_all():
    data, at = fim.string_bytes(pa.array([], pa.string()))
    assert len(data) == 0 and at.tolist() == [0]
    assert fim.UnitIndex(data).rank(np.array([0])).tolist() == [0]


def test_spans_cover_every_string():
    at = np.array([0, 3, 3, 50, 51, 52, 52])
    assert list(fim.byte_spans(at, 4)) == [(0, 2), (2, 3), (3, 6)]
    assert list(fim.byte_spans(np.array([0]), 4)) == []


def test_whole_operator_against_slices(spark):
    luck = random.Random(8)
    texts = [*random_texts(300), "a<P>b", "<S>", "x<M>", None, "", "<", "<P", ">", "é" * 30_000, "\U0001f600 long " * 40_000]
    rows = [(luck.choice([None, *range(40)]), t) for t in texts] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("n", "form", "key", "h1", "output")})
    made = fim.fill_in_middle(docs).withColumn("again", fim.restored(F.col("output"), F.col("form")))
    got = sorted(map(tuple, made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "again").collect()), key=repr)
    want = sorted(((d, *plain_version(d, t), t or "") for d, t in rows), key=repr)
    assert got == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_parameters_and_empty_table(spark):
    rows = [(i, f"text number {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in fim.fill_in_middle(docs, seed=9, percent=50, spm_percent=100).collect()}
    assert got == {d: plain_version(d, t, 9, 50, 100) for d, t in rows}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
