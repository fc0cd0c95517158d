"""Groups of near copies that are dealt out over several tasks, and helpers that scoring and encoding share."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovelark.llm import jaccard_join as J
from grovelark.llm import kneser_ney, token_planes


def near_copies():
    luck, base = random.Random(3), [f"w{i}" for i in range(400)]
    texts = [base]
    for _ in range(90):
        t = list(base)
        for p in luck.sample(range(len(t)), luck.randint(4, 14)):
            t[p] = f"x{luck.random()}"
        texts.append(t)
        if luck.random() < 0.3:  # a near copy of a near copy, beyond the first text's reach
            texts.append([*t[:-1], f"y{luck.random()}"])
    return [" ".join(t) for t in texts]


def test_groups_that_are_dealt_out_lose_no_link_and_meet_in_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "GROUP_TOKENS", 2000)
    texts = near_copies()
    sets, root = J.shingle_sets(texts, 3), list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                common = len(np.intersect1d(a, sets[j]))
                if 100 * common >= 90 * (len(a) + len(sets[j]) - common):
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[r] == r for r in root):
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in J.with_smallest(J.similarity_join(docs, 3, 90)[0]).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) > 10
    index = J.cut(J.indexed(docs, 3, 90).withColumn("at", F.monotonically_increasing_id()))
    _, classes = J.stars(index)
    first = index.where("doc_id = 0").select(F.col("sid").alias("a"))
    pairs = J.cut(classes.select(F.col("sid").alias("b")).crossJoin(first).where("a <> b").select("a", "b"))
    met = J.cut(J.compare(pairs, docs, classes, 3, 90, True))
    heads = met.select("a", "b", "linked", F.explode("head").alias("token"))
    y = heads.withColumnsRenamed({"b": "b2", "linked": "linked2"})
    met_before = heads.where("NOT linked").join(y, ["a", "token"]).where("b <> b2 AND (linked2 OR b < b2)").select(F.least("b", "b2"), F.greatest("b", "b2")).distinct().count()
    n = J.missing_pairs(met, 90).count()
    assert 0 < n < met_before / 10, (n, met_before)


def by_brute_force(texts, width, percent):
    sets, root = J.shingle_sets(texts, width), list(range(len(texts)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * (c := len(np.intersect1d(a, b))) >= percent * (len(a) + len(b) - c)]
    for _ in texts:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return root, len(links)


@pytest.mark.parametrize(("members", "blocks"), [(1000, 8), (12, 8), (12, 0)])
def test_a_group_returns_fewer_links_than_members(spark, monkeypatch, members, blocks):
    """In one part, in parts whose rest meets by blocks, and by prefixes: components are exact, rows no more than a few per member."""
    monkeypatch.setattr(J, "GROUP_MEMBERS", members)
    monkeypatch.setattr(J, "MOST_BLOCKS", blocks)
    luck, base, texts = random.Random(4), [f"w{i}" for i in range(100)], []
    for k in range(90):  # one to three words differ; the text they were copied from is not there
        t = list(base)
        for p in luck.sample(range(100), luck.randint(1, 3)):
            t[p] = f"x{luck.random()}"
        texts.append(" ".join(t + [f"y{k // 45}_{i}" for i in range(12)]))
    root, n_links = by_brute_force(texts, 5, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    member, links = J.similarity_join(docs, 5, 80)
    assert {r["doc_id"]: r["component_id"] for r in J.with_smallest(member).collect()} == dict(enumerate(root))
    index = J.cut(J.indexed(docs, 5, 80).withColumn("at", F.monotonically_increasing_id()))
    pairs, classes = J.stars(index)
    groups, _ = J.dealt(pairs.select(F.col("hub").alias("a"), F.col("sid").alias("b")), classes)
    n = J.group_links(groups.withColumn("label", F.col("sid")), index, docs, classes, 5, 80).count()
    assert 1 < len(set(root)) < 60 and n_links > 300
    assert n <= groups.count() and (members < 1000 or links.count() < n_links)


def test_spanning_links_join_what_links_join():
    luck = np.random.default_rng(6)
    for n in (2, 5, 40):
        base = np.unique(luck.integers(0, 1 << 64, 60, dtype=np.uint64))
        sets = [np.unique(np.concatenate([base[luck.random(len(base)) > 0.06], luck.integers(0, 1 << 64, 2, dtype=np.uint64)])) for _ in range(n)]
        linked = np.array([[100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)) for b in sets] for a in sets])
        for label in (np.arange(n), np.arange(n) // 3, np.arange(n) % 2):
            found = J.spanning(sets, label.copy(), 85)
            assert all(linked[i, j] and label[i] != label[j] for i, j in found) and len(found) < n
            joined = []
            for pairs in (found, np.argwhere(linked)):
                own = label.copy()
                for i, j in list(pairs):
                    own[own == own[j]] = own[i]
                joined.append([{int(j) for j in np.flatnonzero(own == x)} for x in own])
            assert joined[0] == joined[1]


def test_words_learnt_first_are_remembered():
    memo = token_planes.WordMemo(token_planes.default_tokenizer(), words=40)
    first, _ = [" ".join(f"c{i}" for i in range(10))], memo.encode([" ".join(f"c{i}" for i in range(10))], 1)
    early = list(memo.words)[:20]
    want = memo.encode(first, 1)[1].tolist()
    for k in range(20):
        memo.encode([" ".join(f"r{k}q{i}" for i in range(30))], 1)
    memo.encode(["end"], 1)
    assert list(memo.words)[: len(early)] == early and memo.encode(first, 1)[1].tolist() == want


def test_grams_are_found_at_any_number_of_keys():
    luck = np.random.default_rng(5)
    for n in (1, 2, 100, 5000):
        keys = np.unique(luck.integers(0, 1 << 64, n, dtype=np.uint64))
        keys = np.unique(np.concatenate([keys, keys[:1] + np.arange(20, dtype=np.uint64)]))  # a place with many
        s = kneser_ney.Scorer(keys, np.zeros((len(keys), 1)), np.zeros((len(keys), 1)), 5)
        asked = np.concatenate([keys, keys + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
        at, ok = s._find(asked)
        assert (ok == np.isin(asked, keys)).all() and (keys[at[ok]] == asked[ok]).all()


def test_sketches_rule_out_no_link_and_most_others():
    luck = np.random.default_rng(8)
    sets = [np.unique(luck.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 30, 300, 2000)]
    for base in list(sets):
        for share in (0.02, 0.05, 0.2, 0.3, 0.5):
            kept = base[luck.random(len(base)) > share]
            sets.append(np.unique(np.concatenate([kept, luck.integers(0, 1 << 64, len(base) - len(kept), dtype=np.uint64)])))
    n = np.array([len(s) for s in sets], np.int64)
    sketches = [J.sketch(s) for s in sets]
    for percent in (90, 80, 30):
        d = np.array([[len(np.setxor1d(x, y)) for y in sets] for x in sets])
        linked = (100 + percent) * d <= (100 - percent) * (n[:, None] + n[None, :])
        for hub in range(len(sets)):
            found = {frozenset(p) for p in J.near_members(n, sketches, hub, percent)}
            assert all(frozenset((hub, i)) in found for i in np.flatnonzero(linked[hub]) if i != hub)
            met = {i for p in found if hub in p for i in p}
            assert all(frozenset((i, j)) in found for i, j in np.argwhere(np.triu(linked, 1)) if not {i, j} <= met | {hub})
            if percent == 90:
                assert sum(d[i, j] > 0.4 * (n[i] + n[j]) / 2 for i, j in map(tuple, found) if min(n[i], n[j]) > 20) == 0


def test_small_groups_move_no_text(spark, monkeypatch):
    """Groups that fit one task meet by sketch; only texts within reach by sketch are read again."""
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    asked, plain = [], J.compare

    def counted(pairs, *rest, **named):
        asked.append(pairs.count())
        return plain(pairs, *rest, **named)

    monkeypatch.setattr(J, "compare", counted)
    J.similarity_join(docs, 3, 90)
    sets = J.shingle_sets(texts, 3)
    d = [(len(np.setxor1d(x, y)), len(x) + len(y)) for i, x in enumerate(sets) for y in sets[:i]]
    assert sum(asked) <= sum(190 * k <= 12 * n for k, n in d), asked
