"""Cycles of any length: strongly connected components, and one shortest cycle of each, in few rounds.

Nodes are numbered in the order of their names first, so that rounds move numbers only; names join at the end.
Marks travel along edges and over themselves: a node that knows a mark also takes what the marked node knows, so the stretch
of the graph that a node has heard from about doubles every round. Marks are the nodes' numbers with their bits mixed, so that no
order of names can make rounds one step long. Paths without branches are contracted to one weighted edge by pointer doubling
before a shortest cycle is looked for. Only rows of one node or edge travel, by shuffle: nothing that grows with the graph is
broadcast. The driver sees whether a table is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import cut
from .skew import split_join, written_bytes

#: A table that is broadcast to meet keys that may be hot is of so many bytes at most, as written.
LIGHT_BYTES = 256 << 10


def _shuffled(df: DataFrame) -> DataFrame:
    """Joined by shuffle, however small the planner takes it for: rounds would send it to the driver again and again."""
    return df.hint("merge")


def _sent(df: DataFrame) -> DataFrame:
    """A written table whose keys may be hot on the other side: sent to the nodes while it is small."""
    return F.broadcast(df) if written_bytes(df) <= LIGHT_BYTES else _shuffled(df)


def _at(df: DataFrame) -> list[str]:
    """What nodes are named within."""
    return [c for c in ("repo", "component") if c in df.columns]


def _mixed(number: str) -> Column:
    """Another number for each number, in no order: shifts and exclusive ors, which lose nothing."""
    x = F.col(number) + 1
    for _ in range(3):
        x = x.bitwiseXOR(F.shiftleft(x, 13))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
        x = x.bitwiseXOR(F.shiftleft(x, 17))
    return x


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, label, repo, node)`` of every node, ids in order of ``(repo, node)``, and distinct ``(source, target)`` as ids."""
    links = cut(edges.select("repo", "source", "target").where("repo IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL").distinct())
    nodes = links.select("repo", F.explode(F.array("source", "target")).alias("node")).distinct()
    names = cut(nodes.orderBy("repo", "node").select(F.monotonically_increasing_id().alias("id"), "repo", "node"))
    names = names.withColumn("label", _mixed("id"))
    known = names.select("id", "repo", "node")
    by = links.join(_shuffled(known.withColumnsRenamed({"node": "source", "id": "s"})), ["repo", "source"])
    by = by.join(_shuffled(known.withColumnsRenamed({"node": "target", "id": "t"})), ["repo", "target"])
    return names, cut(by.select(F.col("s").alias("source"), F.col("t").alias("target")))


def reaching_marks(links: DataFrame) -> tuple[DataFrame, int]:
    """``(repo, node, mark)``, the node with the greatest label of a node and all that lead to it, and the rounds it took."""
    names, own = numbered(links)
    marks, rounds = _marks(_labelled(own))
    named = marks.join(_shuffled(names.select(F.col("label").alias("node"), "repo", F.col("node").alias("name"))), "node")
    named = named.join(_shuffled(names.select(F.col("label").alias("mark"), F.col("node").alias("top"))), "mark")
    return named.select("repo", F.col("name").alias("node"), F.col("top").alias("mark")), rounds


def _labelled(links: DataFrame) -> DataFrame:
    return cut(links.select(_mixed("source").alias("source"), _mixed("target").alias("target")))


def _marks(links: DataFrame) -> tuple[DataFrame, int]:
    """``(node, mark)`` for ``links (source, target)`` between labels, and the rounds.

    Besides marks, a node keeps a *hop*, at first the way in that leads to the fewest other nodes; hops double every round.
    """
    ends = links.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    ways_out = links.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    hops = links.join(_shuffled(ways_out), "source").groupBy(F.col("target").alias("node")).agg(F.min_by("source", F.struct("n", "source")).alias("hop"))
    marks, rounds = cut(ends.join(_shuffled(hops), "node", "left").select("node", "hop", F.col("node").alias("mark"))), 0
    while True:
        rounds += 1
        own = marks.select("node", "hop", "mark", F.col("mark").alias("was"))
        sent = links.join(_shuffled(marks.select(F.col("node").alias("source"), "mark")), "source").select(F.col("target").alias("node"), "mark")
        heard = own.unionByName(sent, allowMissingColumns=True).groupBy("node")
        now = cut(heard.agg(F.max("hop").alias("hop"), F.max("mark").alias("mark"), F.max("was").alias("was")))
        # what the marked node has itself heard of; one row for each mark in use
        known = now.select(F.col("mark").alias("via")).distinct()
        further = cut(known.join(_shuffled(now.select(F.col("node").alias("via"), F.col("mark").alias("far"))), "via").where("far > via").select(F.col("via").alias("mark"), "far"))
        ahead = now.select(F.col("node").alias("hop"), F.col("mark").alias("_mark"), F.col("hop").alias("_hop"))
        # few marks may have many nodes each: those few are sent to the nodes
        told = now.join(_sent(further), "mark", "left").join(_shuffled(ahead), "hop", "left")
        marks = cut(told.select("node", F.col("_hop").alias("hop"), F.greatest("mark", "far", "_mark").alias("mark"), "was"))
        if marks.where("mark <> was").isEmpty():
            return marks.select("node", "mark"), rounds


def trimmed(links: DataFrame, rounds: int = 2) -> DataFrame:
    """Without edges that cannot lie on a cycle, as far as ``rounds`` looks see; exact for any number."""
    at = _at(links)
    for _ in range(rounds):
        sources = _shuffled(links.select(*at, F.col("source").alias("target")).distinct())
        targets = _shuffled(links.select(*at, F.col("target").alias("source")).distinct())
        links = links.join(sources, [*at, "target"], "left_semi").join(targets, [*at, "source"], "left_semi")
        links = cut(links.select(*at, "source", "target"))
    return links


def _members(links: DataFrame) -> DataFrame:
    """``(root, node)``, as labels, of every node on a cycle of ``links (source, target)``, which are ids.

    A round marks every node with the greatest label that leads to it; the nodes that also lead to it, over nodes of its
    mark, are its component. These and all marked nodes then leave the graph.
    """
    links = _labelled(links)
    loops = links.where("source = target").select(F.col("source").alias("root"), F.col("source").alias("node"))
    core, found = trimmed(links.where("source <> target")), []
    while not core.isEmpty():
        forth, _ = _marks(core)
        a = forth.select(F.col("node").alias("source"), F.col("mark").alias("_from"))
        b = forth.select(F.col("node").alias("target"), "mark")
        inside = core.join(_shuffled(a), "source").join(_shuffled(b), "target").where("mark = _from")
        inside = cut(inside.select(F.col("target").alias("source"), F.col("source").alias("target")))  # turned round
        back, _ = _marks(inside)
        members = cut(forth.join(_shuffled(back), ["node", "mark"], "left_semi").select(F.col("mark").alias("root"), "node"))
        found.append(members)
        done = _shuffled(cut(forth.where("node = mark").select("node").unionByName(members.select("node")).distinct()))
        core = core.join(done.withColumnRenamed("node", "source"), "source", "left_anti").join(done.withColumnRenamed("node", "target"), "target", "left_anti")
        core = trimmed(core)
    if not found:
        return loops
    joined = reduce(DataFrame.unionByName, found)
    several = cut(joined.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root"))
    large = cut(split_join(joined, _shuffled(several), ["root"], "left_semi"))
    return cut(large.unionByName(loops.join(_shuffled(large), "node", "left_anti").select("root", "node")))


def _with_components(members: DataFrame, names: DataFrame) -> DataFrame:
    """``(repo, component, size, first, node, name)`` of ``(root, node)``: ids of the component's smallest node and of the node, and their names."""
    placed = cut(members.withColumnRenamed("node", "label").join(_shuffled(names), "label").select("root", "id", "repo", "node"))
    smallest = placed.groupBy("root").agg(F.min(F.struct("id", "node")).alias("least"), F.count(F.lit(1)).alias("size"))
    smallest = cut(smallest.select("root", F.col("least.id").alias("first"), F.col("least.node").alias("component"), "size"))
    out = split_join(placed, _shuffled(smallest), ["root"])
    return out.select("repo", "component", "size", "first", F.col("id").alias("node"), F.col("node").alias("name"))


def cyclic_components(edges: DataFrame) -> DataFrame:
    """Every node that lies on a cycle of any length: ``(repo, component, size, node)``; ``component`` is its smallest node."""
    names, links = numbered(edges)
    found = _with_components(_members(links), names)
    return found.select("repo", "component", "size", F.col("name").alias("node"))


# ---------------------------------------------------------------- one cycle of each


def chains(inside: DataFrame) -> tuple[DataFrame, int]:
    """Nodes with one way in and one way out, but for components' smallest: ``(…, first, back, node)`` with the chain they are of.

    ``back`` is their distance from the chain's first node; pointers double every round. Also the rounds it took.
    """
    own, plain = _at(inside), inside.where("source <> target")
    out = plain.groupBy(*own, F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    into = plain.groupBy(*own, F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("m"), F.min("source").alias("before"))
    inner = cut(out.join(_shuffled(into), [*own, "node"]).where("n = 1 AND m = 1 AND node <> component").select(*own, "node", "before"))
    before = inner.select(*own, F.col("node").alias("before"), F.lit(True).alias("_inner"))
    at = inner.join(_shuffled(before), [*own, "before"], "left")
    at = cut(at.select(*own, "node", F.when(F.col("_inner"), F.col("before")).otherwise(F.col("node")).alias("first"), F.when(F.col("_inner"), 1).otherwise(0).cast("bigint").alias("back"), F.coalesce("_inner", F.lit(False)).alias("open")))
    rounds, ready = 0, None
    while not at.where("open").isEmpty():
        rounds += 1
        far = at.select(*own, F.col("node").alias("first"), F.col("first").alias("_first"), F.col("back").alias("_back"), F.col("open").alias("_open"))
        at = cut(at.join(_shuffled(far), [*own, "first"]).select(*own, "node", F.col("_first").alias("first"), (F.col("back") + F.col("_back")).alias("back"), (F.col("open") & F.col("_open")).alias("open")))
    return at.select(*own, "first", "back", "node"), rounds


def cycle_nodes(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One shortest cycle through the smallest node of every component: ``(repo, component, length, position, node)``.

    The smallest node stands at position 0 and at position ``length``; of several shortest cycles the first in order of their
    nodes. Branch-free stretches count as one edge, so rounds follow the branchings on a cycle and not its length.
    """
    names, links = numbered(edges)
    if members is None:
        own = cut(_with_components(_members(links), names).select(F.col("first").alias("component"), "node"))
    else:
        known = names.select("id", "repo", "node")
        own = members.select("repo", "component", "node").join(_shuffled(known), ["repo", "node"]).select("repo", "component", F.col("id").alias("n"))
        own = own.join(_shuffled(known.withColumnsRenamed({"node": "component", "id": "c"})), ["repo", "component"])
        own = cut(own.select(F.col("c").alias("component"), F.col("n").alias("node")))
    found = cut(_shortest(links, own))
    known = names.select(F.col("id").alias("node"), "repo", F.col("node").alias("name"))
    least = own.where("node = component").join(_shuffled(known), "node").select("component", F.col("name").alias("_component"))
    placed = cut(found.join(_shuffled(known), "node").select("repo", "component", "length", "position", F.col("name").alias("node")))
    out = split_join(placed, _shuffled(least), ["component"])
    return out.select("repo", F.col("_component").alias("component"), "length", "position", "node")


def _shortest(links: DataFrame, own: DataFrame) -> DataFrame:
    """``(component, length, position, node)`` of :func:`cycle_nodes` for ``own (component, node)``, all as ids."""
    inside = links.join(_shuffled(own.withColumnRenamed("node", "source")), "source").join(_shuffled(own.withColumnRenamed("node", "target")), ["component", "target"])
    inside = cut(inside.where("source <> target OR source = component").select("component", "source", "target"))
    inner, _ = chains(inside)
    inner = cut(inner)
    whole = inner.groupBy("component", "first").agg(F.count(F.lit(1)).alias("n"), F.max_by("node", "back").alias("last"))
    into = inside.join(_shuffled(whole.withColumnRenamed("first", "target")), ["component", "target"]).select("component", F.col("target").alias("first"), F.col("source").alias("entry"), "n", "last")
    long = into.join(_shuffled(inside.withColumnRenamed("source", "last")), ["component", "last"]).select("component", F.col("entry").alias("source"), F.col("first").alias("step"), (F.col("n") + 1).alias("w"), F.col("target").alias("end"))
    names = inner.select("component", "node")
    direct = inside.join(_shuffled(names.withColumnRenamed("node", "source")), ["component", "source"], "left_anti").join(_shuffled(names.withColumnRenamed("node", "target")), ["component", "target"], "left_anti")
    direct = direct.select("component", "source", F.col("target").alias("step"), F.lit(1).cast("bigint").alias("w"), F.col("target").alias("end"))
    ways = cut(direct.unionByName(long))
    step = "array<struct<step: bigint, at: bigint, w: bigint, end: bigint>>"
    front = own.where("node = component").select("component", "node", F.struct(F.lit(0).cast("bigint").alias("d"), F.array().cast(step).alias("path")).alias("r"))
    best, closed = cut(front), None
    front = best
    while not front.isEmpty():
        tried = front.withColumnRenamed("node", "source").join(_shuffled(ways), ["component", "source"])
        more = F.array_append("r.path", F.struct("step", F.col("r.d").alias("at"), "w", "end"))
        tried = cut(tried.groupBy("component", F.col("end").alias("node")).agg(F.min(F.struct((F.col("r.d") + F.col("w")).alias("d"), more.alias("path"))).alias("r")))
        home = tried.where("node = component").select("component", "r")
        closed = cut(home if closed is None else closed.unionByName(home).groupBy("component").agg(F.min("r").alias("r")))
        known = best.select("component", "node", F.col("r").alias("_known"))
        goal = cut(closed.select("component", F.col("r.d").alias("_goal")))
        better = tried.where("node <> component").join(_shuffled(known), ["component", "node"], "left").join(_sent(goal), "component", "left")
        better = better.where("(_known IS NULL OR r < _known) AND (_goal IS NULL OR r.d < _goal)")
        front = cut(better.select("component", "node", "r"))
        best = cut(best.unionByName(front).groupBy("component", "node").agg(F.min("r").alias("r")))
    if closed is None:
        return own.select("component", F.lit(0).cast("bigint").alias("length"), F.lit(0).cast("bigint").alias("position"), "node").limit(0)
    steps = closed.select("component", F.col("r.d").alias("length"), F.explode("r.path").alias("s")).select("component", "length", "s.*")
    start = closed.select("component", F.col("r.d").alias("length"), F.lit(0).cast("bigint").alias("position"), F.col("component").alias("node"))
    ends = steps.select("component", "length", (F.col("at") + F.col("w")).alias("position"), F.col("end").alias("node"))
    long_steps = cut(steps.where("w > 1").withColumnRenamed("step", "first"))
    between = inner.join(_sent(long_steps), ["component", "first"])
    between = between.select("component", "length", (F.col("at") + 1 + F.col("back")).alias("position"), "node")
    return start.unionByName(ends).unionByName(between)


def component_cycles(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """As :func:`cycle_nodes`, a cycle as one array ``(repo, component, cycle)``; for cycles that fit a row."""
    nodes = cycle_nodes(edges, members)
    listed = nodes.groupBy("repo", "component").agg(F.array_sort(F.collect_list(F.struct("position", "node"))).alias("c"))
    return listed.select("repo", "component", F.transform("c", lambda x: x["node"]).alias("cycle"))
