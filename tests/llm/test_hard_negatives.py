"""Hard negatives against brute force over all rows, certified walks, and odd input."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovelark.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, positives=5, negatives=3):
    """Every score of every anchor with every row, in whole numbers of any size."""
    best = {}
    for i, e, la in sorted((r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[2], r[1])):
        best.setdefault(i, ((la + 1) % 10 if i % 7 == 0 else la, [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in e]))
    score = lambda a, b: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for a, (la, q) in best.items():
        if a % 50:
            continue
        ranked = sorted((-score(q, v), i, lb == la) for i, (lb, v) in best.items() if i != a)
        for s, i, _ in [r for r in ranked if r[2]][:positives]:
            fits = [(n, j) for n, j, same in ranked if not same and 50 * -s <= 100 * -n <= 95 * -s][:negatives]
            out += [(a, i, k, j, -s, -n) for k, (n, j) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows):
    own = hn.usable(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("q", "block", "shard", "score", "low", "slot")}))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hn.mine(own.withColumn("label", moved), F.col("vec_id") % 50 == 0).collect()))


@pytest.fixture()
def fine(monkeypatch):
    """Small blocks, strides and clusters, so that a small table has many."""
    for name, value in (("BLOCK", 4), ("PER_CLUSTER", 3), ("STRIDE", 8), ("MAX_STRIDE", 32), ("ROUND_ANCHORS", 6)):
        monkeypatch.setattr(hn, name, value)


def test_same_as_brute_force(spark, fine):
    luck = np.random.default_rng(1)
    directions = luck.normal(size=(6, 12))
    rows = [(i, (directions[luck.integers(6)] + luck.normal(size=12) * luck.choice([0.05, 0.4])).tolist(), int(luck.integers(10))) for i in range(1200)]
    want = brute(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want


def test_copies_ties_and_odd_rows(spark, fine):
    luck = np.random.default_rng(2)
    same = [0.5, 0.25, -0.125]
    rows = [(i, same, i % 3) for i in range(400)]  # every second row is one vector
    rows += [(i, (luck.integers(-3, 4, 3) / 4).tolist(), int(luck.integers(3))) for i in range(400, 800)]
    rows += [(800, [], 1), (850, [1.0], 1), (851, [1.0, 2.0, 3.0, 4.0], 1), (900, [0.0, 0.0, 0.0], 2), (1000, [-1.0, 0.0, 0.0], 0)]
    rows += [(1050, None, 1), (1100, [1.0, None], 1), (1150, [float("nan")], 1), (1151, [float("inf")], 0), (None, [1.0], 1), (1200, [1.0], None)]
    rows += [rows[0], rows[500], (50, [9.0, 9.0, 9.0], 9), (50, [0.0], 0)]
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_doubles(spark):
    rows = [(i, [float(2**40 + i), float(3 - i)], i % 2) for i in range(0, 120)] + [(150, [1e300, 1.0], 0), (151, [1e300, -1e300], 1)]
    assert mined(spark, rows) == brute(rows)


def test_no_rows_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []
    assert mined(spark, [(50, [1.0], 1)]) == []


def test_walk_is_exact_and_ends_early():
    """Members around one direction leave the list once the bound is below what they have."""
    luck = np.random.default_rng(3)
    centre = np.zeros(16)
    centre[0] = 1.0
    members = np.rint(1000 * (centre + luck.normal(size=(20, 16)) * 0.02)).astype(np.int64)
    rows = np.rint(1000 * luck.normal(size=(20_000, 16)) / 4).astype(np.int64)
    rows[:50] = members[luck.integers(20, size=50)] + luck.integers(-20, 20, (50, 16))
    labels, ids = luck.integers(2, size=len(rows)), luck.permutation(len(rows))
    low, high = np.full((20, 1), hn._NONE + 1), np.full((20, 1), hn._ALL)
    who, _, found, score, taken = hn.walk(members, -np.arange(1, 21), np.zeros(20, np.int64), low, high, centre, rows, ids, labels, True, 5)
    scores = members @ rows.T
    for m in range(20):
        own = np.flatnonzero(labels == 0)
        want = own[np.lexsort((ids[own], -scores[m, own]))[:5]]
        assert found[who == m].tolist() == ids[want].tolist() and score[who == m].tolist() == scores[m, want].tolist()
    assert taken < 0.5 * scores.size


def test_clusters_and_blocks_cover_all_anchors(spark, fine):
    rows = spark.createDataFrame([(i * 50, i % 3, [1, i % 2, 0]) for i in range(60)], "vec_id bigint, label bigint, q array<smallint>")
    got, centres = hn.clustered(rows, 60)
    pdf = got.toPandas()
    assert sorted(pdf.vec_id) == [50 * i for i in range(60)] and centres.shape[1] == 3
    assert pdf.groupby("block").cluster.nunique().max() == 1
