"""The plan of the language models does not grow with the length of their grams."""

from __future__ import annotations

import pytest

from grovelark.llm import kneser_ney


@pytest.mark.parametrize("modified", [True, False])
def test_all_lengths_go_through_one_plan(spark, modified):
    texts = spark.createDataFrame([("x", "abracadabra"), ("y", "aaaa"), ("y", "b")], "label string, text string")
    plans, models = [], []
    for order in (2, 5):
        model = kneser_ney.smooth(kneser_ney.count_grams(texts, order), order, modified)
        plans.append(model._jdf.queryExecution().sparkPlan().toString())
        models.append(model.collect())
    for node in ("Join", "Scan", "Aggregate"):
        assert plans[0].count(node) == plans[1].count(node) > 0
    assert {len(r["gram"]) for r in models[0]} == {0, 1, 2} and {len(r["gram"]) for r in models[1]} == {0, 1, 2, 3, 4, 5}
    for rows in models:  # what a label's single characters leave to none is their weight
        for label, n in (("x", 5), ("y", 2)):
            one = [r for r in rows if r["label"] == label and len(r["gram"]) == 1 and r["alpha"] is not None]
            rest = next(r["gamma"] for r in rows if r["label"] == label and r["gram"] == "")
            assert len(one) == n and abs(sum(r["alpha"] for r in one) + rest - 1) < 1e-9
