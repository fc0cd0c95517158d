"""Column expressions with the string rules of Python's ``str`` and ``re``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the characters str.strip() removes
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rx(pattern: str, flags: str = "") -> str:
    """Unicode classes, ``\\n`` as the only line end, plus ``m``/``s``/``i``."""
    return f"(?dU{flags}){pattern}"


def strip(c: Column | str) -> Column:
    """``str.strip``; a character trim, which only looks at the ends."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def extract(c: Column | str, pattern: str, group: int, flags: str = "") -> Column:
    return F.regexp_extract(col(c), rx(pattern, flags), group)


def extract_all(c: Column | str, pattern: str, group: int, flags: str = "") -> Column:
    return F.regexp_extract_all(col(c), F.lit(rx(pattern, flags)), F.lit(group))


def matches(c: Column | str, pattern: str, flags: str = "") -> Column:
    return col(c).rlike(rx(pattern, flags))


def count_literal(c: Column | str, text: str) -> Column:
    """Non-overlapping occurrences of a fixed text."""
    return ((F.length(col(c)) - F.length(F.replace(col(c), F.lit(text), F.lit("")))) / len(text)).cast("long")


def line_count(c: Column | str) -> Column:
    """``len(text.splitlines())``."""
    c = col(c)
    breaks = F.regexp_count(c, F.lit(_BREAK))
    open_end = (F.length(c) > 0) & ~c.rlike(rf"(?:{_BREAK})\z")
    return (breaks + open_end.cast("int")).cast("long")


def title(c: Column | str) -> Column:
    """``str.title``: capitalise after every character that has no case."""
    runs = F.regexp_extract_all(col(c), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), "")


_ASIDE = "\U0010fffd\U0010fffc\U0010fffd"


def text_of(content: Column | str) -> Column:
    """Decode bytes as UTF-8, drop bad bytes, normalise newlines."""
    raw = col(content)
    # genuine replacement characters step aside for a private-use one that the text does not have
    held = F.replace(raw.cast("string"), F.lit("�"), F.lit(_ASIDE))
    mended = F.replace(F.replace(F.make_valid_utf8(held), F.lit("�"), F.lit("")), F.lit(_ASIDE), F.lit("�"))
    decoded = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(mended)
    return F.regexp_replace(decoded, "\r\n?", "\n")
