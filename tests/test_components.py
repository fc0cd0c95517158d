"""Cycles of any length against brute force, and how many rounds they take."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from grovelark.operators import components as C
from grovelark.operators import skew

EDGE = "repo string, source string, target string"


def reachable(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    got = {}
    for start in out:
        seen, todo = set(), [start]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        got[start] = seen
    return out, got


def brute(edges):
    """(component, size, node) of nodes on a cycle, and the first shortest cycle through each component's smallest node."""
    out, reach = reachable(edges)
    members, cycles = set(), {}
    for n, far in reach.items():
        if n in far:
            own = sorted(m for m in far if n in reach.get(m, ()))
            members.add((own[0], len(own), n))
    for c in {m[0] for m in members}:
        paths = [[c]]
        while c not in cycles:
            paths = sorted(p + [y] for p in paths for y in out.get(p[-1], ()) if y == c or y not in p)
            cycles.update({c: p for p in reversed(paths) if p[-1] == c})
    return members, cycles


def test_random_graphs(spark):
    luck, edges, want, cycles = random.Random(7), [], set(), {}
    for g in range(5):
        n = luck.choice([4, 9, 25])
        nodes = [f"x{i}" for i in range(n)]
        own = {(luck.choice(nodes), luck.choice(nodes)) for _ in range(int(n * luck.choice([0.9, 1.2, 1.5])))}
        edges += [(f"g{g}", *e) for e in own]
        m, c = brute(own)
        want |= {(f"g{g}", *x) for x in m}
        cycles |= {(f"g{g}", k): v for k, v in c.items()}
    df = spark.createDataFrame(edges + edges[:5] + [("g0", None, "x1"), ("g0", "x1", None)], EDGE)
    members = C.cyclic_components(df)
    assert {tuple(r) for r in members.select("repo", "component", "size", "node").collect()} == want and want
    assert {(r["repo"], r["component"]): r["cycle"] for r in C.component_cycles(df, members).collect()} == cycles


@pytest.fixture(scope="module")
def ring(spark):
    """A ring of 1000 in order of its names, into which a hub on another cycle leads everywhere."""
    n = 1000
    ids = spark.range(n)
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    edges = ids.select(name(F.col("id")).alias("source"), name((F.col("id") + 1) % n).alias("target"))
    hub = ids.select(F.lit("hub").alias("source"), F.when(F.col("id") > 0, name(F.col("id"))).otherwise(F.lit("spoke")).alias("target"))
    back = spark.createDataFrame([("spoke", "hub")], "source string, target string")
    return edges.unionByName(hub).unionByName(back).select(F.lit("r").alias("repo"), "source", "target")


def test_marks_go_round_a_long_ring_in_few_rounds(ring):
    marks, rounds = C.reaching_marks(ring)
    assert rounds < 15
    assert marks.where("node <> 'hub' AND node <> 'spoke'").select("mark").distinct().count() == 1


def test_chains_of_a_long_ring(spark, ring):
    inside = ring.where("source LIKE 'n%'").select("repo", F.lit("n0").alias("component"), "source", "target")
    chain, rounds = C.chains(inside)
    assert rounds <= 11
    assert chain.agg(F.count_distinct("node"), F.min("first"), F.max("first"), F.max("back")).first() == (999, "n1", "n1", 998)


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGE)
    assert C.cyclic_components(none).count() == 0 and C.cycle_nodes(none).count() == 0
    line = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c")], EDGE)
    assert C.cyclic_components(line).count() == 0


# ---------------------------------------------------------------- joins with hot keys


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows has one key."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string")))
    left = spark.range(0, 60_000, numPartitions=8).select(F.when(F.col("id") % 1000 != 1, key).alias("k"), F.col("id").alias("v"))
    right = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.col("id").alias("w"))
    return left, right.unionByName(spark.createDataFrame([("hot", -1)], "k string, w bigint"))


def test_the_sketch_names_the_hot_key(spark, skewed):
    left, _ = skewed
    mark = F.xxhash64("k")
    hot = skew.hot_keys(left, mark, 8)
    want = spark.createDataFrame([("hot",)], "k string").select(mark).first()[0]
    assert [h[0] for h in hot] == [want] and hot[0][1] >= 19_000
    assert skew.hot_keys(left.limit(0), mark, 8) == []


@pytest.mark.parametrize(("how", "small"), [("inner", 32 << 20), ("left", 0), ("left_anti", 32 << 20)])
def test_same_rows_as_a_plain_join(skewed, how, small):
    left, right = skewed
    plain, split = left.join(right, "k", how), skew.split_join(left, right, ["k"], how, small_bytes=small)
    cols = plain.columns
    assert split.columns == cols
    total = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(20,0)"))).first()
    assert total(plain) == total(split)


def test_no_task_gets_much_more_than_the_others(spark, skewed):
    left, right = skewed
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = sorted(r[0] for r in skew.split_join(left, right, ["k"], "left").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).select("count(1)").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(counts) == 60_000 and counts[-1] <= 2 * counts[len(counts) // 2]


def test_a_right_side_that_would_repeat_is_refused(skewed):
    with pytest.raises(ValueError, match="asked for twice"):
        skew.split_join(*skewed, ["k"], "full")
    assert rows(skewed[0].limit(0)) == []


def test_rounds_send_no_table_that_grows_to_the_driver(spark, monkeypatch):
    """Joins are by shuffle, whatever the planner would broadcast, but for bounded tables: hot keys and light ones."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    cut = C.cut
    monkeypatch.setattr(C, "cut", seen)
    monkeypatch.setattr(C, "LIGHT_BYTES", -1)
    monkeypatch.setattr(C, "split_join", lambda left, right, keys, how="inner": left.join(right, keys, how))
    edges = [("r", f"n{i}", f"n{(i + 1) % 5}") for i in range(5)] + [("r", "hub", "n3"), ("r", "hub", "n1")]
    assert C.cycle_nodes(spark.createDataFrame(edges, EDGE)).count() == 6
    assert len(plans) > 20 and not any("Broadcast" in p for p in plans)


def test_numbers_follow_the_order_of_names(spark):
    df = spark.createDataFrame([("r", "b", "a"), ("r", "c", "b"), ("q", "z", "z"), (None, "x", "y"), ("r", None, "y")], EDGE)
    names, links = C.numbered(df)
    assert [(r["repo"], r["node"]) for r in names.orderBy("id").collect()] == [("q", "z"), ("r", "a"), ("r", "b"), ("r", "c")]
    assert links.count() == 3 and names.select("label").distinct().count() == 4
