"""Small scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pystr import col


def repair_base_url(url: Column | str) -> Column:
    """Drop trailing slashes; mend a doubled slash before ``v1``, ``messages``, ``chat``."""
    cut = F.regexp_replace(col(url), r"/+\z", "")
    rest = F.replace(F.replace(cut, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    mended = cut
    for tail in ("v1", "messages", "chat"):
        mended = F.replace(mended, F.lit("//" + tail), F.lit("/" + tail))
    return F.when(F.contains(rest, F.lit("//")), mended).otherwise(cut)


def percentage(done: Column | str, total: Column | str) -> Column:
    """Share in percent with one decimal, 0 when there is nothing to do."""
    return F.when(col(total) > 0, F.bround(col(done) / col(total) * 100, 1)).otherwise(F.lit(0.0))


def capped_percentage(done: Column | str, total: Column | str) -> Column:
    return F.least(F.lit(100.0), percentage(done, total))
