"""The pipeline's stages against plain versions on the smallest tables, and on odd input."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_llm_operators import plain_components
from tokenizers import Tokenizer

import corpus_pipeline
from grovelark.llm.token_planes import default_tokenizer


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    """The documents before each stage and what the last one returns, as pandas."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet").withColumn("extra", F.lit("x")), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs.toPandas().sort_values("doc_id")))
        folder = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, small).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return out + [("end", docs.toPandas().sort_values("doc_id"))]


def test_stages_keep_columns_and_take_rows_away(steps):
    assert [n for n, _ in steps] == ["quality", "near_duplicates", "decontaminate", "mixture", "tokens", "end"]
    assert all(set(d.columns) == set(steps[0][1].columns) for _, d in steps[:5])
    sizes = [len(d) for _, d in steps]
    assert sizes == sorted(sizes, reverse=True) and sizes[2] < sizes[1] and sizes[4] == sizes[5] < sizes[3]


def test_one_of_each_group_stays(steps):
    before, after = steps[1][1], steps[2][1]
    _, component = plain_components(before.text, list(before.doc_id), corpus_pipeline.WIDTH, corpus_pipeline.PERCENT)
    assert sorted(set(component)) == sorted(after.doc_id)


def test_contaminated_documents_go(steps, small):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
    windows = set()
    for t in pd.read_parquet(f"{small}/benchmark.parquet").text:
        w = words(t)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    before, after = steps[2][1], steps[3][1]
    stay = []
    for d, t in zip(before.doc_id, before.text, strict=True):
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            stay.append(d)
    assert stay == list(after.doc_id)


def test_mixture_spends_its_budget(steps):
    before, after = steps[3][1], steps[4][1]
    n = lambda d: d.text.str.split().str.len().sum()
    assert 0.8 * n(before) < n(after) <= 0.9 * n(before) + 1


def test_tokens_are_those_of_the_last_documents(steps):
    docs, out = steps[4][1], steps[5][1]
    ids = [e.ids + [1] for e in Tokenizer.from_file(default_tokenizer()).encode_batch(list(docs.text), add_special_tokens=False)]
    n = np.array([len(i) for i in ids])
    assert list(out.doc_id) == list(docs.doc_id) and (out.start == n.cumsum() - n).all()
    assert list(out.ids_crc32) == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]


def test_stages_on_odd_and_empty_tables(spark, small):
    rows = [(1, None, "en", "src1"), (2, "", None, None), (None, "no id", "en", "src1"), (3, "a b c d e f", "en", "src1"), (3, "a b c d e f", "en", "src1"), (4, "a b c d e f", "en", "src2"), (5, "w " * 100_000, "de", "src3")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns({c: F.lit(0) for c in ("n_chars", "label", "keep", "mark", "component", "_gone2")})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, small)
        assert name == "tokens" or got.columns == odd.columns
        assert got.count() <= len(rows)
        assert stage(spark, odd.limit(0), small).count() == 0
    near = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, odd, small)
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "2", "3", "5", "None"]


def test_rows_that_stay_are_not_shuffled(spark, small):
    """Only rows that share a doc_id are dealt out again after the join; the others keep their place."""
    rows = [(i, f"text number {i} of its own kind {i * i}") for i in range(30)] + [(3, "text number 3 of its own kind 9"), (4, "another text with that id"), (30, "text number 5 of its own kind 25")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, small)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted([*range(30), 4])
    lines = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    top = next(i for i, line in enumerate(lines) if "Union" in line)
    depth = lines[top + 1].index(":-")
    end = next(i for i in range(top + 1, len(lines)) if lines[i][depth:].startswith("+-"))
    assert any("LeftAnti" in line for line in lines[top:end]) and not any("Aggregate" in line for line in lines[top:end])
