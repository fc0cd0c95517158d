"""The sample that language models are fitted on, and texts taken piece by piece."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from grovelark.llm import language_id as li


def test_pieces_are_normalised_as_one():
    text = "Ab, cd!! efé 你好  1234 " * 40 + "end"
    want = li.normal(text)
    for n in (1, 2, 3, 7, 50, 10_000):
        assert li.normal_pieces(text, n) == want
    assert li.normal_pieces("12 34 " * 20, 5) == "" and li.normal_pieces("", 3) == ""


def test_every_language_is_sampled_and_the_sample_is_bounded(spark):
    rows = [(i, "en", "many short words " * 3) for i in range(600)] + [(1000, "rare", "x" * 50_000), (1001, "two", "a b"), (1002, "two", "c d")]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    got = li.sampled(df, 3000, 900).toPandas()
    train, held = got[~got["calibrate"]], got[got["calibrate"]]
    assert set(train["lang"]) == {"en", "rare", "two"}
    assert train.groupby("lang")["text"].apply(lambda t: t.str.len().sum()).max() <= 2 * 1000
    assert held["text"].str.len().sum() <= 2 * 900
    assert li.sampled(df.limit(0), 3000, 900).count() == 0
    again = li.sampled(df.repartition(7).withColumn("extra", F.lit(1)), 3000, 900).toPandas()
    assert sorted(map(tuple, again.to_numpy())) == sorted(map(tuple, got.to_numpy()))


def test_bounds_of_languages_with_few_rows_lean_on_all():
    relative, truth = np.concatenate([np.linspace(0.9, 1.1, 400), [1.0]]), np.array([0] * 400 + [1])
    many, few, none = li._bounds(relative, truth, np.array([2.0, 3.0, 4.0]), 0.995)
    assert abs(many - 2 * 1.1 * 1.099) < 0.02 and 3 * 1.1 * 1.0 < few < 3 * 1.1 * 1.1 and abs(none - 4 * 1.1 * 1.099) < 0.01
