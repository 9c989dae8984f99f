"""Text patterns and comparisons as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob(col: Column, pattern: str) -> Column:
    """Anchored, without regard to case; ``*`` is any run of characters. Null does not match."""
    like = re.sub(r"([%_\\])", r"\\\1", pattern).replace("*", "%")
    return F.coalesce(col.ilike(like), F.lit(False))


def loose_glob(col: Column, pattern: str) -> Column:
    """Found anywhere, without regard to case; ``*`` is any run and the rest is a regular expression."""
    return F.coalesce(col.rlike("(?i)" + pattern.replace("*", ".*")), F.lit(False))


def path_glob(col: Column, pattern: str) -> Column:
    """Without ``*`` a part of the path; else ``**`` crosses folders and ``*`` does not."""
    if "*" not in pattern:
        return F.coalesce(col.contains(pattern), F.lit(False))
    text = "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", pattern))
    return F.coalesce(col.rlike(text), F.lit(False))


def file_pattern(pattern: str) -> str:
    """An ignore-file pattern as an anchored regular expression; a closing slash means all below a folder."""
    if pattern.endswith("/"):
        pattern += "**"
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part)
    return f"^{out}$"


def same(a: Column, b: Column) -> Column:
    """Two-valued equality: null equals null."""
    return a.eqNullSafe(b)


def number_compare(a: Column, op: str, b: float) -> Column:
    """Order by number: null counts as 0, text that is no number compares false."""
    x = F.coalesce(a.try_cast("double") if hasattr(a, "try_cast") else a.cast("double"), F.when(a.isNull(), F.lit(0.0)))
    return F.coalesce({"<": x < b, "<=": x <= b, ">": x > b, ">=": x >= b}[op], F.lit(False))


def contains(col: Column, part: str) -> Column:
    return F.coalesce(F.lower(col).contains(part.lower()), F.lit(False))


def starts_with(col: Column, part: str) -> Column:
    return F.coalesce(F.lower(col).startswith(part.lower()), F.lit(False))


def ends_with(col: Column, part: str) -> Column:
    return F.coalesce(F.lower(col).endswith(part.lower()), F.lit(False))


def regex(col: Column, pattern: str) -> Column:
    """Found anywhere; a pattern that is not valid matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return F.coalesce(col.rlike(pattern), F.lit(False))


def ranges_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Closed line ranges share a line; nulls do not."""
    return F.coalesce((a0 <= b1) & (a1 >= b0), F.lit(False))
