"""Shell-style ignore patterns compiled to one regular expression.

A single ``rlike`` decides a path together with all its ancestor directories,
so the predicate stays inside generated code and needs no array expansion.
"""

from __future__ import annotations

import re
from collections.abc import Iterable


def glob_regex(pattern: str, any_char: str) -> str:
    """Regex body of a glob; ``any_char`` is what ``*`` and ``?`` may cover."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(any_char + "*")
        elif c == "?":
            out.append(any_char)
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body.replace("^", "\\^")) + "]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def ignore_regex(patterns: Iterable[str]) -> str:
    """Regex for paths that are ignored or lie below an ignored directory.

    Directories are tested with a trailing ``/``.
    """
    names, dirs, paths = [r"\.[^/]*"], [], []
    for p in patterns:
        if p.endswith(("/", "/**")):
            dirs.append(glob_regex(p.rstrip("/*"), "[^/]"))
        else:
            names.append(glob_regex(p, "[^/]"))
        if p.endswith("/**"):
            paths.append(glob_regex(p[:-2], ".") + ".+")
        elif not p.endswith("/"):
            paths.append(glob_regex(p, "."))
    rules = [f"(?:^|/)(?:{'|'.join(names)})(?:/|\\z)"]
    if dirs:
        rules.append(f"(?:^|/)(?:{'|'.join(dirs)})/")
    if paths:
        rules.append(f"^(?:{'|'.join(paths)})(?:/|\\z)")
    return "(?s)" + "|".join(rules)
