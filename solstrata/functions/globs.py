"""Glob patterns as anchored regular expressions, translated on the driver."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """`*` and `?` stay within a path part, `**` crosses parts, a trailing `/**` also matches the folder itself."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out.append("(?:/.*)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif pattern[i] == "*":
            out.append("[^/]*")
            i += 1
        elif pattern[i] == "?":
            out.append("[^/]")
            i += 1
        elif pattern[i] == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = pattern[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[:1] in "!^" else inner) + "]")
            i = end + 1
        else:
            out.append(re.escape(pattern[i]))
            i += 1
    return "^" + "".join(out) + "$"


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a path, or its last part, matches any of the globs."""
    if not patterns:
        return F.lit(False)
    whole = path.rlike("|".join(glob_regex(p) for p in patterns))
    bare = [p for p in patterns if "/" not in p]
    base = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(whole | (base.rlike("|".join(glob_regex(p) for p in bare)) if bare else F.lit(False)), F.lit(False))
