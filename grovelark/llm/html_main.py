"""Main text of web pages: template subtrees found by counting them per host, and the article that is left.

Each page is read once into pieces of text and the element subtrees around them. A subtree's hash covers its tag, class, id and
everything below it. Spark counts, per host, on how many pages a hash occurs; subtrees on at least ``least`` pages, or on all of
two or more, are template and are deleted. Those on less than ``share`` of the host's pages or on fewer than ``least`` stay if
they are together most of a page's text: then it is a copy of another page. Then, as page structure: what is never article text (scripts, styles,
forms, navigation, headers, footers, sidebars, and elements with a class, id or role that is the name of an advert, notice, menu or
reader comments, unless they hold the article or most of the text) goes, and if the page marks its main content (``article``, ``main``), only that stays. Prose (paragraphs, headings, list
items, quotes, inline markup) is deleted with a container that recurs, never for recurring itself: copies of an article are articles.

Text is what a browser shows: character references decoded, white space in a block one space, blocks joined by one space.

Results for odd input: null or empty html has empty text; markup that is cut off or wrongly nested is closed as browsers do for the
common cases; an article within another or named as a comment is reader comment, unless it holds most of the text; a null url is a host of its own; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SHARE, LEAST, SALTS = 0.3, 5, 32

# values without quotes may hold some, and a quote that nothing closes stands for itself, as in browsers
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"'=]|=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?|"[^"]*"|'[^']*'|["'])*+)>""", re.DOTALL)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_PROSE = _INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt figcaption".split())
_DROP = frozenset("head script style noscript template iframe object svg math canvas audio video form button select textarea input nav header footer aside menu dialog title".split())
_MAIN = frozenset(("article", "main"))
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios consent cookie cookies discussion disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices overlay popup promo related replies respond share sharing sidebar signup skip social "
    "sponsor sponsored subscribe toolbar widget".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: An open element on the left is closed when one on the right opens.
_CLOSES = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")), "option": frozenset(("option", "optgroup")),
}
_SCOPE = frozenset("article main section div table td th ul ol dl blockquote body html aside nav header footer form figure".split())

PARSED = "page_id bigint, url string, host string, has_main boolean, pieces array<struct<text:string,main:boolean,above:array<bigint>>>, subtrees array<bigint>"


class _Node:
    __slots__ = ("tag", "drop", "soft", "main", "parts", "pieces", "solid")

    def __init__(self, tag: str, drop: bool, soft: bool, main: bool, solid: bool, sign: str):
        self.tag, self.drop, self.soft, self.main, self.solid, self.parts, self.pieces = tag, drop, soft, main, solid, [sign], []


def _hash(parts: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _named(attributes: str) -> tuple[bool, bool, str]:
    """Whether the role, and whether a whole class name or id, says that an element isn't article text; and what of them goes into
    the hash."""
    drop, soft, sign = False, False, []
    for m in _NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden":
            continue
        sign.append(f"{name}={value}")
        if name == "role":
            drop |= value in _ROLES
        else:
            soft |= not _WORDS.isdisjoint(value.split())
    return drop, soft, " ".join(sign)


def _chosen(has_main: bool, pieces: list[tuple]) -> tuple[bool, list[tuple[str, bool, list[int]]]]:
    """Whether the marked main content decides, and the pieces left once elements go that are dropped by class or id alone.

    Such an element stays if it holds most of the page's text, or the only marked article, with most of the text. An article that
    stays so loses what is named so within it, unless that is most of the text.
    """
    size = lambda rows: sum(len(p[0].strip()) for p in rows)
    total, main = size(pieces), [p for p in pieces if p[1]]
    plain = [p for p in pieces if not p[3]]
    if has_main:
        return True, [p[:3] for p in (plain if any(p[1] for p in plain) or not main else main)]
    if 2 * size(main) > total:
        return True, [p[:3] for p in ([p for p in main if not p[4]] or main)]
    held: dict[int, int] = {}
    for p in pieces:
        held[p[3]] = held.get(p[3], 0) + len(p[0].strip())
    left, within = [p for p in pieces if not p[3] or 2 * held[p[3]] > total], [p for p in pieces if p[5]]
    return False, [(p[0], False, p[2]) for p in left if not p[5] or 2 * size(within) > total]


def parse(page: str) -> tuple[bool, list[tuple[str, bool, list[int]]], list[int]]:
    """Whether main content is marked; pieces of text (a leading line feed where a block begins) with whether they are main and
    the hashes of the subtrees around them that may be deleted; the distinct hashes of all such subtrees."""
    root = _Node("", False, False, False, True, "")
    stack, pieces, subtrees, has_main = [root], [], set(), False
    depth_drop = depth_main = depth_soft = depth_inner = outer = 0  # inner: within main content; outer: which of the elements dropped by class
    fresh, in_article = True, False  # a block begins with the next text; the outermost of the elements dropped by class is an article

    def close() -> None:
        nonlocal depth_drop, depth_main, depth_soft, depth_inner
        node = stack.pop()
        depth_soft -= node.soft
        depth_inner -= node.soft and depth_main > 0
        depth_drop -= node.drop
        depth_main -= node.main
        above = stack[-1]
        key = _hash(node.parts)
        above.parts.append(str(key))
        if not node.solid:
            subtrees.add(key)
            for i in node.pieces:
                pieces[i][2].append(key)
        above.pieces += node.pieces

    def text(raw: str) -> None:
        nonlocal fresh
        if not raw:
            return
        value = html.unescape(raw) if "&" in raw else raw
        node = stack[-1]
        if value.strip():
            node.parts.append(" ".join(value.split()))
        if depth_drop == 0:
            node.pieces.append(len(pieces))
            pieces.append(("\n" + value if fresh else value, depth_main > 0, [], outer if depth_soft else 0, depth_inner > 0, in_article and depth_soft > 1))
            fresh = fresh and depth_soft > 0

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in _INLINE:
            fresh = True
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        close()
                    break
                if tag in _INLINE and stack[k].tag in _SCOPE:
                    break
            continue
        if tag in _VOID:
            continue
        k = len(stack) - 1
        while k > 0:
            own = stack[k].tag
            if tag in _CLOSES.get(own, ()):
                while len(stack) > k:
                    close()
                break
            if own in _SCOPE and own not in _CLOSES:
                break
            k -= 1
        drop, soft, sign = _named(m[3]) if m[3] else (False, False, "")
        drop |= tag in _DROP
        drop &= tag not in ("body", "html")
        # an article within an article, or one that its class names a comment or the like, isn't the page's
        soft = (soft or tag == "article" and any(e.tag == "article" for e in stack)) and tag not in ("body", "html", "main")
        main = tag in _MAIN and not drop and not soft and depth_drop == 0
        has_main |= main and not depth_soft
        if soft and not depth_soft:
            outer, in_article = outer + 1, tag == "article"
        depth_soft += soft
        depth_inner += soft and depth_main > 0
        depth_drop += drop
        depth_main += main
        solid = main or tag in ("body", "html") or tag in _PROSE
        stack.append(_Node(tag, drop, soft, main, solid, f"{tag} {sign}"))
        if tag in _RAW and not m[0].endswith("/>"):
            end = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(page, at)
            stack[-1].parts.append(page[at : end.start() if end else n])
            at = end.start() if end else n
    while len(stack) > 1:
        close()
    return *_chosen(has_main, pieces), list(subtrees)


def parsed(pages: DataFrame) -> DataFrame:
    """``PARSED`` rows of ``pages (page_id, url, html)``. Where main content is marked, other pieces go no further than here."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page_id, url, page in zip(b["page_id"], b["url"], b["html"], strict=True):
                has_main, pieces, subtrees = parse(page) if page else (False, [], [])
                host = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url) if url else None
                kept = [{"text": t, "main": m, "above": a} for t, m, a in pieces if m or not has_main]
                out.append((page_id, url, host[1].lower() if host else "", has_main, kept, subtrees))
            yield pd.DataFrame(out, columns=["page_id", "url", "host", "has_main", "pieces", "subtrees"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInPandas(go, PARSED)


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``(host, subtree, wide)`` on at least ``least`` of the host's pages, however many it has, or on all of two or more.

    ``wide``: on at least ``share`` of the host's pages, too. The others may be parts of copied articles.
    """
    n = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    counts = pages.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wide = (F.col("n") >= least) & (F.col("n") >= share * F.col("n_pages"))
    return counts.join(n, "host").where((F.col("n") >= least) | (F.col("n") == F.col("n_pages"))).select("host", "subtree", wide.alias("wide"))


def main_text(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``(page_id, url, text, n_removed)`` per row of ``pages (page_id, url, html)``."""
    around = F.array_distinct(F.flatten(F.transform("pieces", lambda p: p["above"])))
    rows = cut(parsed(pages).withColumn("row", F.monotonically_increasing_id()).withColumn("boxed", F.size(around) > 0))  # row: fixed by the written table
    known = cut(templates(rows, share, least))
    # only subtrees around text that is still there can matter; a hot host's templates are copied to several salts
    above = rows.where("boxed").select("row", "host", F.explode(around).alias("subtree")).withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    gone = above.join(known, ["host", "subtree", "salt"]).groupBy("row").agg(*[F.collect_set(F.when(F.col("wide") == w, F.col("subtree"))).alias(c) for c, w in (("gone", True), ("rare", False))])
    none = F.array().cast("array<bigint>")
    # pages whose text lies in no subtree that may go stay where they are
    free = rows.where("NOT boxed").select("page_id", "url", "pieces", none.alias("gone"), none.alias("rare"))
    out = rows.where("boxed").select("row", "page_id", "url", "pieces").join(gone, "row", "left").select("page_id", "url", "pieces", "gone", "rare").unionByName(free)
    without = lambda pieces, name: F.filter(pieces, lambda p: ~F.arrays_overlap(p["above"], F.coalesce(name, none)))
    size = lambda pieces: F.aggregate(pieces, F.lit(0), lambda n, p: n + F.length(F.trim(p["text"])))
    # rarer templates go unless they are most of what is left: then the page is a copy
    out = out.withColumn("pieces", without("pieces", "gone")).withColumn("left", without("pieces", "rare"))
    part = 2 * size("left") >= size("pieces")
    kept = F.when(part, F.col("left")).otherwise(F.col("pieces"))
    removed = F.size(F.coalesce("gone", none)) + F.when(part, F.size(F.coalesce("rare", none))).otherwise(0)
    text = F.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda p: p["text"]), ""), "(?U)[\\s\\x1C-\\x1F]+", " "))
    return out.select("page_id", "url", text.alias("text"), removed.alias("n_removed"))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_removed")
