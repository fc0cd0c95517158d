"""Mixing sources to target weights: budgets down a tree, then a prefix of seeded epochs per leaf.

The tree has one level per column (here domain, language, source). A node's budget goes to its children in proportion to
their weights, but no child gets more than its capacity: the tokens of its documents, ``max_epochs`` times. What a child
can't take goes to its siblings first, in proportion again, and only what all of them together can't take is missing from
their parent, whose siblings then get it. That is one pass down the tree: a child of capacity c and weight w gets
``min(c, level · w)``, with the level that spends the parent's budget; sorted by c / w, running sums give it (the highest level at which a child
stays within its capacity).

A leaf's documents come in a fixed pseudo-random order per epoch. Whole epochs are taken while the budget lasts, then the
documents of the next epoch's order while their running sum of tokens stays within the budget. Running sums are taken in two steps,
over slices of the order and inside the slice where the budget ends, so no task holds a leaf.

Results for odd input: a null level is the value ``""``; null and empty texts have no tokens and stay as long as their place in the
order is reached; rows equal in every key are ordered by text and taken one by one; weights that are missing are 1, weights of 0
get nothing unless nothing else can spend the budget; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pick, table, text_or_empty

LEVELS = ("domain", "lang", "source")
#: Relative weights of the tree's nodes by path; 1 where none is given.
WEIGHTS = {("web",): 3, ("curated",): 2, ("web", "en"): 4, ("curated", "en"): 2}
SHARE, SEED, PER_SLICE = 0.9, "mix", 1000


def domain(source: str | Column) -> Column:
    """Sources with an even number are the web's, the others are curated."""
    return F.when(F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("bigint") % 2, F.lit(0)) == 0, "web").otherwise("curated")


def n_tokens(text: str | Column) -> Column:
    """White-space separated words."""
    return F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")).cast("bigint")


def _weight(levels: Sequence[str], weights: Mapping[tuple[str, ...], int]) -> Column:
    """The weight of a node of ``levels``, from the mapping's paths of that length."""
    out = F.lit(None).cast("bigint")
    for path, w in weights.items():
        if len(path) == len(levels):
            hit = F.lit(True)
            for c, v in zip(levels, path, strict=True):
                hit = hit & (F.col(c) == v)
            out = F.when(hit, F.lit(w).cast("bigint")).otherwise(out)
    return F.coalesce(out, F.lit(1).cast("bigint"))


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], int], total: float | Column) -> DataFrame:
    """``(levels…, capacity, budget)`` per leaf, from ``(levels…, capacity)``; ``total`` is the budget of the root.

    Siblings are few: the tree is a table of its nodes, and each window holds the children of one node.
    """
    now = leaves.select(F.lit(0).alias("root"), total.cast("bigint").alias("budget") if isinstance(total, Column) else F.lit(total).cast("bigint").alias("budget")).distinct()
    for depth in range(1, len(levels) + 1):
        own, up = list(levels[:depth]), ["root", *levels[: depth - 1]]
        nodes = leaves.groupBy(*own).agg(F.sum("capacity").alias("capacity")).withColumn("root", F.lit(0)).withColumn("w", _weight(own, weights))
        nodes = nodes.join(now.select(*up, "budget"), up)
        ratio = F.when(F.col("w") > 0, F.col("capacity") / F.col("w"))
        w = Window.partitionBy(*up).orderBy(F.col("ratio").asc_nulls_last(), *own)
        before, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
        left = F.greatest(F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)), F.lit(0))
        ranked = nodes.withColumn("ratio", ratio).withColumn("left", left).withColumn("rest", F.sum("w").over(rest))
        level = F.max(F.when((F.col("w") > 0) & (F.col("w") * F.col("left").cast("double") / F.col("rest") <= F.col("capacity")), F.col("left").cast("double") / F.col("rest"))).over(Window.partitionBy(*up))
        share = F.when(F.col("w") == 0, F.least("capacity", "left")).otherwise(
            F.when(F.col("level").isNull(), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.floor(F.col("level") * F.col("w"))))
        )
        now = ranked.withColumn("level", level).select("root", *own, "capacity", share.cast("bigint").alias("budget"))
    return now.drop("root")


def _spot(seed: str, epoch: Column) -> Column:
    """A document's place in the order of an epoch: the first 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("bigint")


def mix(docs: DataFrame, levels: Sequence[str] = LEVELS, weights: Mapping[tuple[str, ...], int] = WEIGHTS, share: float = SHARE, max_epochs: int = 1, seed: str = SEED, per_slice: int = PER_SLICE) -> DataFrame:
    """``(doc_id, mark, levels…, n_tokens, budget, taken)`` for every row of ``docs (doc_id, mark, levels…, n_tokens)``.

    ``taken`` is how often the document is drawn. The root's budget is ``share`` of all tokens.
    """
    rows = docs.select("doc_id", "mark", *[F.coalesce(c, F.lit("")).alias(c) for c in levels], "n_tokens")
    leaves = cut(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    total = leaves.agg(F.sum("tokens").alias("t")).select(F.floor(F.coalesce("t", F.lit(0)) * F.lit(share)).alias("t")).first()["t"]
    plan = budgets(leaves.select(*levels, (F.col("tokens") * max_epochs).alias("capacity")), levels, weights, total).drop("capacity")
    plan = plan.join(leaves, list(levels)).withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(max_epochs)))
    plan = cut(plan.withColumn("over", F.col("budget") - F.col("epochs") * F.col("tokens")).withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("n") / per_slice))))
    spot = rows.join(plan, list(levels)).withColumn("spot", _spot(seed, F.col("epochs")))
    spot = cut(spot.withColumn("slice", F.floor(F.col("spot").cast("double") / 2.0**60 * F.col("slices"))).drop("tokens", "n", "slices"))
    sums = spot.groupBy(*levels, "slice", "over").agg(F.sum("n_tokens").alias("tokens"))
    to = Window.partitionBy(*levels).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("until", F.sum("tokens").over(to)).select(*levels, "slice", (F.col("until") - F.col("tokens")).alias("before"), "until", (F.col("until") <= F.col("over")).alias("whole"))
    marked = spot.join(cut(ends), [*levels, "slice"])
    whole = marked.where("whole OR before > over").withColumn("more", F.col("whole"))
    inside = Window.partitionBy(*levels, "slice").orderBy("spot", F.col("doc_id").asc_nulls_first(), "mark").rowsBetween(Window.unboundedPreceding, 0)
    at_end = marked.where("NOT whole AND before <= over").withColumn("more", F.col("before") + F.sum("n_tokens").over(inside) <= F.col("over"))
    return whole.unionByName(at_end).select("doc_id", "mark", *levels, "n_tokens", "budget", F.least(F.lit(max_epochs).cast("bigint"), F.col("epochs") + F.col("more").cast("bigint")).alias("taken"))


def mixable(docs: DataFrame) -> DataFrame:
    """A documents table as ``mix`` takes it."""
    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("mark"), domain(F.coalesce("source", F.lit(""))).alias("domain"), "lang", "source", n_tokens(text_or_empty()).alias("n_tokens"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs at most, so that small leaves can be drawn twice before their siblings get the rest."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    return mix(mixable(docs), max_epochs=2).select("doc_id", *LEVELS, "n_tokens", "budget", "taken")


def oracle(max_epochs: int = 2, share: float = SHARE, docs: str = "documents") -> str:
    """The same in SQL, with windows over whole leaves."""
    names = {1: "domain", 2: "domain, lang", 3: "domain, lang, source"}

    def weight(depth: int) -> str:
        cases = [f"WHEN {' AND '.join(f'{c} = {v!r}' for c, v in zip(LEVELS, path))} THEN {w}" for path, w in WEIGHTS.items() if len(path) == depth]
        return f"CASE {' '.join(cases)} ELSE 1 END" if cases else "1"

    steps, up = [], "root"
    for depth, own in names.items():
        by, order = (f"PARTITION BY {up}", f"ORDER BY capacity / w, {own}")
        steps.append(f"""
n{depth} AS (SELECT *, greatest(budget - coalesce(sum(capacity) OVER ({by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS rem,
             sum(w) OVER ({by} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM (SELECT 0 AS root, {own}, sum(capacity) AS capacity, {weight(depth)} AS w FROM leaves GROUP BY ALL) JOIN b{depth - 1} USING ({up})),
b{depth} AS (SELECT root, {own}, CAST(CASE WHEN lv IS NULL THEN capacity ELSE least(capacity, floor(lv * w)) END AS BIGINT) AS budget
      FROM (SELECT *, max(CASE WHEN w * CAST(rem AS DOUBLE) / rest <= capacity THEN CAST(rem AS DOUBLE) / rest END) OVER ({by}) AS lv FROM n{depth}))""")
        up = f"root, {own}"
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT) % 2, 0) = 0 THEN 'web' ELSE 'curated' END AS domain,
             coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
             CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM {docs}),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {max_epochs} AS capacity FROM d GROUP BY ALL),
b0 AS (SELECT 0 AS root, CAST(floor(sum(tokens) * CAST({share} AS DOUBLE)) AS BIGINT) AS budget FROM leaves),{",".join(steps)},
p AS (SELECT domain, lang, source, budget, CASE WHEN tokens > 0 THEN CAST(floor(budget / tokens) AS BIGINT) ELSE {max_epochs} END AS epochs, tokens
      FROM b3 JOIN leaves USING (domain, lang, source)),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
             ORDER BY left(md5('{SEED}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 15), doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS until
      FROM d JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, budget, least({max_epochs}, epochs + CASE WHEN until <= budget - epochs * tokens THEN 1 ELSE 0 END) AS taken FROM s"""
