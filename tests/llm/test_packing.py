"""Packing: every id in exactly one piece, sequences without gaps or padding, and the plan on its own."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grovelark.llm import packing, registry
from grovelark.llm.token_planes import default_tokenizer


def whole_ids(texts):
    whole = Tokenizer.from_file(default_tokenizer())
    whole.encode_special_tokens = True
    return [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]


def assert_packed(pieces: pd.DataFrame, lengths: list[int], window: int):
    """Every sequence is gapless from 0 and full, but for the last ones, whose sizes are falling powers of two."""
    assert pieces["length"].sum() == sum(lengths) and (pieces["length"] > 0).all()
    sizes = {}
    for s, rows in pieces.sort_values("offset").groupby("sequence_id"):
        ends = rows["offset"] + rows["length"]
        assert rows["offset"].tolist() == [0, *ends.tolist()[:-1]]
        sizes[s] = int(ends.iloc[-1])
    assert sorted(sizes) == list(range(len(sizes)))
    order = [sizes[s] for s in sorted(sizes)]
    full = sum(lengths) // window
    assert order == [window] * full + packing.powers(sum(lengths) % window)


def assert_documents(pieces: pd.DataFrame, docs: list[tuple], ids: list[np.ndarray]):
    """The pieces of each document, in order, are its ids."""
    want = {}
    for (d, _), x in zip(docs, ids, strict=True):
        want.setdefault(d, []).append(x.tobytes())
    for d, raw in want.items():
        rows = pieces[pieces["doc_id"].isna() if d is None else pieces["doc_id"] == d]
        assert len(set(raw)) == 1 or d is not None  # equal ids may have several texts, told apart below
        assert rows["length"].sum() * 4 == sum(map(len, raw))
        if len(raw) == 1:
            rows = rows.sort_values("start")
            assert (rows["start"] == rows["length"].cumsum() - rows["length"]).all()
            assert b"".join(rows["ids"]) == raw[0] and (rows["doc_tokens"] * 4 == len(raw[0])).all()


def random_docs(n, longest, seed=1):
    luck = random.Random(seed)
    words = ["alpha", "Beta", "gamma!", "你好", "\U0001f600", "x-y", "'s", "naïve"]
    return [(i, " ".join(luck.choices(words, k=luck.randrange(longest)))) for i in range(n)]


@pytest.mark.parametrize(("window", "n", "longest"), [(64, 400, 60), (2048, 60, 3000), (100, 150, 200), (300, 40, 5), (2, 20, 4)])
def test_every_id_once_without_padding(spark, window, n, longest):
    docs = random_docs(n, longest)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = packing.pack(df, default_tokenizer(), window).toPandas()
    ids = whole_ids([t for _, t in docs])
    assert_packed(got, list(map(len, ids)), window)
    assert_documents(got, docs, ids)


def test_odd_rows(spark):
    docs = [(None, "no id"), (1, None), (2, ""), (3, "lorem ipsum dolor " * 20_000), (4, "twice the same"), (4, "twice the same"), (4, "and other"), (5, "a")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("n", "task", "place", "class", "rank", "ids")})
    got = packing.pack(df, default_tokenizer(), 128).toPandas()
    ids = whole_ids([t for _, t in docs])
    assert_packed(got, list(map(len, ids)), 128)
    assert_documents(got, docs, ids)
    assert sorted(got[got["doc_id"] == 2]["ids"]) == [np.array([1], "<u4").tobytes()]
    assert packing.pack(df.limit(0), default_tokenizer()).count() == 0


def test_most_documents_of_one_length(spark):
    docs = [(i, "word " * (40 if i % 3 else i % 50)) for i in range(600)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), default_tokenizer(), 256).toPandas()
    ids = whole_ids([t for _, t in docs])
    assert_packed(got, list(map(len, ids)), 256)
    assert_documents(got, docs, ids)
    assert len(got) < 1.5 * len(docs)  # most stay whole


def test_assembled_sequences(spark):
    docs = random_docs(40, 90, 3)
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), default_tokenizer(), 64).cache()
    got = {r.sequence_id: (r.n, bytes(r.ids)) for r in packing.sequences(pieces, 64, 7).collect()}
    assert sum(n for n, _ in got.values()) == sum(map(len, whole_ids([t for _, t in docs])))
    assert all(len(raw) == 4 * n for n, raw in got.values())  # full, or a power of two
    for s, rows in pieces.toPandas().sort_values("offset").groupby("sequence_id"):
        assert b"".join(rows["ids"]) == got[s][1]
    short = spark.createDataFrame([(1, 0, 3, 3, 0, 0, b"\1\0\0\0" * 3)], packing.PIECES)
    assert packing.sequences(short, 4, 258).first().ids == b"\1\0\0\0" * 3 + b"\2\1\0\0"


def test_query_on_the_whole_table(spark, small):
    got = registry.QUERIES["op12_packing"](spark, small).toPandas()
    docs = pd.read_parquet(f"{small}/documents.parquet")
    ids = dict(zip(docs["doc_id"], whole_ids(docs["text"]), strict=True))
    assert_packed(got, [len(x) for x in ids.values()], 2048)
    for r in got.itertuples():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    covered = got.groupby("doc_id")["length"].sum()
    assert covered.to_dict() == {d: len(x) for d, x in ids.items()}


def test_least_squares_finds_the_best_nonnegative_fit():
    luck = np.random.default_rng(4)
    for _ in range(20):
        a, b = luck.random((8, 15)), luck.random(8) * 10
        x = packing.least_squares(a, b)
        pull = a.T @ (b - a @ x)  # optimal: no column pulls further, and those in use don't pull at all
        assert (x >= 0).all() and pull.max() < 1e-6 and np.abs(pull[x > 0]).max(initial=0) < 1e-6


def used_by(plan):
    used = {}
    for way, n in plan:
        size = sum(k * m for k, m in way.items())
        assert n > 0 and 128 * (1 - packing.OPEN_SHARE) <= size <= 128
        for k, m in way.items():
            used[k] = used.get(k, 0) + n * m
    return used


def test_plan_takes_no_more_than_there_is():
    luck = random.Random(6)
    for _ in range(10):
        counts = {k: luck.choice([0, 1, 7, 300, 100_000]) for k in range(130)}
        assert all(n <= counts[k] for k, n in used_by(packing.solved(counts, 128)).items())
    assert packing.solved({}, 128) == [] and packing.solved({0: 5, 129: 3}, 128) == []


def test_plan_leaves_little_where_short_tails_are_common():
    for n in (10_000, 50_000_000):
        counts = {k: n // k for k in range(1, 129)}
        used = used_by(packing.solved(counts, 128))
        assert sum(k * n for k, n in used.items()) > 0.98 * sum(k * n for k, n in counts.items())


def test_combinations_fill_exactly_and_stay_shallow():
    ways = packing.combinations(list(range(1, 25)), 24)
    assert all(sum(k * m for k, m in w.items()) == 24 and len(w) <= 3 for w in ways)
    keys = [tuple(sorted(w.items())) for w in ways]
    assert len(set(keys)) == len(keys) and ((24, 1),) in keys and ((1, 24),) in keys and ((3, 1), (9, 1), (12, 1)) in keys


def test_runs_deal_out_ranks_without_overlap():
    plan = [({3: 2, 5: 1}, 4), ({3: 1}, 2)]
    assert packing.runs(plan) == [(3, 0, 8, 0, 2, 0), (5, 0, 4, 0, 1, 2), (3, 8, 10, 4, 1, 0)]
    assert packing.limited(plan, 5) == [plan[0], ({3: 1}, 1)] and packing.limited(plan, 0) == []
