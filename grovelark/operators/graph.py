"""Aggregates, exports and bounded cycle search over dependency edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources.durable import cut
from .components import component_cycles, cycle_nodes, cyclic_components, trimmed  # noqa: F401  (cycles of any length)
from .ranking import ordinal
from .skew import split_join


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Sources and targets; files without edges are not part of the graph."""
    ends = F.explode(F.array("source", "target")).alias("node")
    return edges.select("repo", ends).distinct()


def dependencies_of(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("source") == node)


def dependents_of(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("target") == node)


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo", F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo", F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))


def top_module(target: Column | str) -> Column:
    t = F.col(target) if isinstance(target, str) else target
    return F.substring_index(F.substring_index(t, ".", 1), "/", 1)


def import_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo", top_module("target").alias("module")).agg(F.count(F.lit(1)).alias("n"))


def top_imports(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` most imported modules per repo; the rank limit is applied before the shuffle."""
    best = Window.partitionBy("repo").orderBy(F.desc("n"), "module")
    return import_histogram(edges).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def graph_totals(resolved: DataFrame) -> DataFrame:
    """Nodes, edges and external modules per repo; external = resolves to no file."""
    resolved = cut(resolved)
    nodes = graph_nodes(resolved).groupBy("repo").agg(F.count(F.lit(1)).alias("n_nodes"))
    outside = F.when(F.col("resolved").isNull(), top_module("target"))
    counts = resolved.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_distinct(outside).alias("n_external")
    )
    return nodes.join(counts, "repo")


def numbered_nodes(edges: DataFrame) -> DataFrame:
    """Short ids ``N0…`` in node order with display names."""
    node = F.col("node")
    shown = P.last_segment(node)
    return ordinal(graph_nodes(edges), ["repo"], ["node"]).select(
        "repo", "node", F.concat(F.lit("N"), F.col("ordinal") - 1).alias("node_id"), shown.alias("label")
    )


def numbered_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by the ids of their ends; a module that a large share of all files imports is no task of its own."""
    ids, edges = cut(nodes.select("repo", "node", "node_id")), cut(edges.select("repo", "source", "target"))
    a = ids.select("repo", F.col("node").alias("source"), F.col("node_id").alias("source_id"))
    b = ids.select("repo", F.col("node").alias("target"), F.col("node_id").alias("target_id"))
    return split_join(edges, b, ["repo", "target"]).join(a, ["repo", "source"]).select(
        "repo", "source_id", "target_id",
        F.format_string("    %s --> %s", "source_id", "target_id").alias("line"),
    )


def node_json(edges: DataFrame) -> DataFrame:
    """The other half of the export: one JSON object per node of the graph."""
    return graph_nodes(edges).select("repo", F.to_json(F.struct("node")).alias("json"))


def edge_json(edges: DataFrame) -> DataFrame:
    """One JSON object per edge, for a line-per-edge export."""
    fields = F.struct("source", "target", F.col("dep_type").alias("type"), "line", "detail")
    return edges.select("repo", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


# ---------------------------------------------------------------- cycles


def _rotated(*names: str) -> Column:
    """Cycle as an array that starts and ends with its smallest node."""
    nodes = F.array(*names)
    at = F.array_position(nodes, F.array_min(nodes)).cast("int")
    turned = F.concat(F.slice(nodes, at, len(names)), F.slice(nodes, F.lit(1), at - 1))
    return F.array_append(turned, F.element_at(turned, 1)).alias("cycle")


def _triangles(links: DataFrame) -> DataFrame:
    """Cycles of length 3 through a degree order.

    Each node only pairs its neighbours of higher (degree, name), at most
    √(2·edges) of them, so a hub never meets all its neighbours pairwise.
    """
    degrees = (
        links.select("repo", F.explode(F.array("source", "target")).alias("node"))
        .groupBy("repo", "node").agg(F.count(F.lit(1)).alias("d"))
    )
    a = degrees.select("repo", F.col("node").alias("source"), F.struct("d", "node").alias("_s"))
    b = degrees.select("repo", F.col("node").alias("target"), F.struct("d", "node").alias("_t"))
    up = F.col("_s") < F.col("_t")
    sides = (
        links.join(a, ["repo", "source"]).join(b, ["repo", "target"])
        .select("repo", F.least("_s", "_t").alias("lo"), F.greatest("_s", "_t").alias("hi"), up.alias("fwd"))
        .groupBy("repo", "lo", "hi")
        .agg(F.bool_or("fwd").alias("fwd"), F.bool_or(~F.col("fwd")).alias("bwd"))
    )
    sides = cut(sides)  # read three times
    x = sides.select("repo", F.col("lo").alias("u"), F.col("hi").alias("v"), F.col("fwd").alias("uv"), F.col("bwd").alias("vu"))
    y = sides.select("repo", F.col("lo").alias("u"), F.col("hi").alias("w"), F.col("fwd").alias("uw"), F.col("bwd").alias("wu"))
    z = sides.select("repo", F.col("lo").alias("v"), F.col("hi").alias("w"), F.col("fwd").alias("vw"), F.col("bwd").alias("wv"))
    found = x.join(y, ["repo", "u"]).where(F.col("v") < F.col("w")).join(z, ["repo", "v", "w"])
    one = F.when(F.expr("uv and vw and wu"), _rotated("u.node", "v.node", "w.node"))
    two = F.when(F.expr("uw and wv and vu"), _rotated("u.node", "w.node", "v.node"))
    return found.select("repo", F.explode(F.array_compact(F.array(one, two))).alias("cycle"))


def cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """All simple cycles of at most ``max_length`` nodes: ``(repo, length, cycle)``.

    A cycle starts and ends with its smallest node. Lengths above 3 grow paths
    step by step from that node over larger nodes only; their number is the
    number of such paths, so raise the bound with care on dense graphs.
    """
    links = cut(edges.select("repo", "source", "target").distinct())
    loops = links.where("source = target").select("repo", F.array("source", "target").alias("cycle"))
    core = trimmed(links.where("source <> target"))
    back = core.select("repo", F.col("target").alias("source"), F.col("source").alias("target"))
    pairs = core.where("source < target").join(back, ["repo", "source", "target"], "left_semi")
    found = [loops, pairs.select("repo", F.array("source", "target", "source").alias("cycle"))]
    if max_length >= 3:
        found.append(_triangles(core))
    if max_length > 3:
        found.extend(_longer(core, max_length))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("repo", (F.size("cycle") - 1).alias("length"), "cycle").where(F.col("length") <= max_length)


def _longer(core: DataFrame, max_length: int) -> list[DataFrame]:
    step = core.select("repo", F.col("source").alias("last"), F.col("target").alias("next"))
    close = core.select("repo", F.col("source").alias("last"), F.col("target").alias("start"))
    paths = core.where("source < target").select(
        "repo", F.col("source").alias("start"), F.col("target").alias("last"), F.array("source", "target").alias("path")
    )
    out = []
    for length in range(3, max_length + 1):
        paths = cut(
            paths.join(step, ["repo", "last"])
            .where((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next")))
            .select("repo", "start", F.col("next").alias("last"), F.array_append("path", F.col("next")).alias("path"))
        )
        if length > 3:
            closed = paths.join(close, ["repo", "last", "start"], "left_semi")
            out.append(closed.select("repo", F.array_append("path", F.col("start")).alias("cycle")))
    return out


def format_cycle(cycle: Column | str = "cycle") -> Column:
    return F.array_join(cycle, " -> ")
