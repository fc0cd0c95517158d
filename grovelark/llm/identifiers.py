"""Personal data: fixed patterns, and contexts learnt from what they find.

Seeds are the matches of the fixed patterns, each a whole *instance*. Every other word that looks like an identifier (it
holds a digit or an ``@``) and touches no match is an instance too. An instance stands in a *pattern*: the two words before
it and the word after it, digits made 0; its own form is no part of that. Patterns and instances form a two-sided graph over
the whole corpus. A pattern is accepted for a kind by a precision bound on what is known of its instances: those of other
kinds speak against it, unknown ones only if they outnumber the known ones by far. Form is a weak feature: an instance formed
like seeds of other kinds counts as a few instances against it. An instance that is accepted in enough of its patterns is
known from then on, and rounds go on until none is added. Spans, besides the seeds: instances accepted in the pattern that
they stand in, and every mention of a known instance, complete seeds that no fixed pattern matches at that place included.

Results for odd input: null and empty texts have no span; a repeated row gets its own row; an empty table gives none;
texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, islice, takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, pick, table

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS, ACCEPT = 3, 0.8
#: The least known share of a pattern's instances; the share of an instance's patterns that must be accepted for it to be known
#: elsewhere; how many instances a form of another kind counts for.
MIN_SHARE, SPREAD, FORM = 0.2, 0.5, 4.0
SMALL_ROWS = 1_000_000

_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _SIGN = re.compile(r"[0-9]"), re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN, _IN_RUN = re.compile(r"[A-Za-z0-9@._%+-]+"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@._%+-")

MENTION = "struct<pattern:string,instance:string,kind:string,s:bigint,e:bigint>"
FOUND = f"doc_id bigint, base array<struct<s:bigint,k:int,e:bigint>>, mentions array<{MENTION}>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@`` and ``_DOMAIN``, in time proportional to the text.

    The characters before an ``@`` can only be the run that ends there, and such a run holds no ``@``.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > free and _BEFORE_AT.match(text, s - 1):
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; offsets are code points."""
    out = [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _words_with_sign(text: str) -> Iterator[tuple[int, int]]:
    """Runs of ``_RUN`` that hold a digit or an ``@``, in time proportional to the text."""
    free, m = 0, _SIGN.search(text)
    while m:
        s = m.start()
        while s > free and text[s - 1] in _IN_RUN:
            s -= 1
        free = _RUN.match(text, m.start()).end()
        yield s, free
        m = _SIGN.search(text, free)


def _mention(text: str, s: int, e: int, kind: str | None) -> tuple | None:
    while s < e and text[e - 1] in "._%+-":
        e -= 1
    while s < e and text[s] in "._%-":
        s += 1
    if s >= e:
        return None
    before = [w.lower() for w in _WORD.findall(text[max(0, s - 80) : s])][-2:]
    after = [w.lower() for w in _WORD.findall(text[e : e + 40])][:1]
    return re.sub(r"[0-9]+", "0", " ".join([*before, "_", *after])), text[s:e].lower(), kind, s, e


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """The fixed matches with their kind, and identifier-like words that touch none; each with its pattern."""
    out, at, reach = [_mention(text, s, e, KINDS[k]) for s, k, e in base], 0, list(accumulate((e for _, _, e in base), max))
    for s, e in _words_with_sign(text):
        while at < len(base) and reach[at] <= s:  # fixed matches that end before the word
            at += 1
        if not any(s < x[2] for x in takewhile(lambda x: x[0] < e, islice(base, at, None))):
            out.append(_mention(text, s, e, None))
    return [m for m in out if m]


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, mentions)`` of every row of ``docs``; its texts go no further than this step."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base, more = [], []
            for t in b["text"]:
                spans = base_spans(t) if t else []
                base.append([{"s": s, "k": k, "e": e} for s, k, e in spans])
                more.append([dict(zip(("pattern", "instance", "kind", "s", "e"), x, strict=True)) for x in mentions(t, spans)] if t else [])
            yield pd.DataFrame({"doc_id": b["doc_id"], "base": base, "mentions": more})

    return pick(docs, "doc_id", "text").mapInPandas(scan, FOUND)


def learn(edges: DataFrame, min_seeds: int = MIN_SEEDS, accept: float = ACCEPT, min_share: float = MIN_SHARE, spread: float = SPREAD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds ``(instance, kind, confidence)``, the instances learnt besides, and pairs ``(pattern, instance, kind)`` of instances
    accepted in a pattern.

    ``edges`` is ``(pattern, instance, kind)``, one row per distinct pair, ``kind`` null where no fixed pattern knows it.
    A pattern's score for a kind is known of the kind / (known of any + 1), counted if at least ``min_seeds`` and a share of
    ``min_share`` of all its distinct instances are known to be of the kind.
    """
    seeds = cut(edges.where("kind IS NOT NULL").groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("confidence", F.lit(1.0)))
    form = F.regexp_replace(F.regexp_replace("instance", "[a-z]+", "a"), "[0-9]+", "0")
    kinds = seeds.groupBy(form.alias("form"), F.col("kind").alias("own")).agg(F.count(F.lit(1)).alias("m"))
    forms = cut(kinds.groupBy("form").agg(F.sum("m").alias("all_m"), F.map_from_entries(F.collect_list(F.struct("own", "m"))).alias("of")))
    total = cut(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    fresh = edges.where("kind IS NULL").drop("kind").join(seeds.select("instance"), "instance", "left_anti").withColumn("form", form)
    fresh = cut(fresh.join(forms, "form", "left").select("pattern", "instance", "all_m", "of"))
    places = cut(fresh.groupBy("instance").agg(F.count(F.lit(1)).alias("f")))
    known = seeds
    while True:
        per = edges.drop("kind").join(known, "instance").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("k"), F.sum("confidence").alias("mass"))
        per = cut(per)
        every = per.groupBy("pattern").agg(F.sum("mass").alias("every"))
        scored = per.where(F.col("k") >= min_seeds).join(every, "pattern").where(F.col("mass") >= accept * (F.col("every") + 1))
        scored = cut(scored.join(total, "pattern").where(F.col("k") >= min_share * F.col("n")).select("pattern", "kind", "mass", "every"))
        other = F.coalesce(1 - F.coalesce(F.try_element_at("of", F.col("kind")), F.lit(0)) / F.col("all_m"), F.lit(0.0))
        pairs = fresh.join(broadcast_if_small(scored, SMALL_ROWS), "pattern").withColumn("score", F.col("mass") / (F.col("every") + 1 + FORM * other))
        pairs = cut(pairs.where(F.col("score") >= accept).select("pattern", "instance", "kind", "score"))
        found = pairs.groupBy("instance", "kind").agg(F.count(F.lit(1)).alias("a"), F.max("score").alias("score")).join(places, "instance").where(F.col("a") >= spread * F.col("f"))
        found = found.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("best")).select("instance", F.col("best.kind").alias("kind"), F.col("best.score").alias("confidence"))
        more = cut(found.join(known.select("instance"), "instance", "left_anti"))
        if more.isEmpty():
            return seeds, known.join(seeds.select("instance"), "instance", "left_anti"), pairs.groupBy("pattern", "instance").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))
        known = cut(known.unionByName(more))


def bootstrap(edges: DataFrame, **options) -> DataFrame:
    """Instances that the patterns show to be identifiers: ``(instance, kind, confidence)``."""
    return learn(edges, **options)[1]


def identifiers(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, base, spans)`` per row: arrays of ``(s, k, e)`` with ``k`` the place in ``KINDS``."""
    found = cut(find(docs).withColumn("row", F.monotonically_increasing_id()))  # row: fixed by the written table
    rows = found.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    edges = cut(rows.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    seeds, learnt, pairs = learn(edges, **options)
    place = F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))])
    instances = seeds.unionByName(learnt).select("instance", F.col("kind").alias("own"))
    unmatched = rows.where("kind IS NULL").drop("kind").join(instances, "instance", "left").join(pairs, ["pattern", "instance"], "left")
    new = unmatched.withColumn("kind", F.coalesce("own", "kind")).where("kind IS NOT NULL")
    new = new.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("s", place[F.col("kind")].alias("k"), "e"))).alias("new"))
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")
    return found.select("row", "doc_id", "base").join(new, "row", "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("new", none))).alias("spans")
    )


def count_of(spans: str | Column, kind: int) -> Column:
    """How many of the spans are of one kind."""
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("bigint")


def spans_text(spans: str | Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op8_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers(table(spark, sf_dir, "documents"))
    counts = [count_of("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(spans_text("base", KINDS).cast("binary"), 256).alias("base_sha256"), spans_text("spans", KINDS).alias("spans"))
