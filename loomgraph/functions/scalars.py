"""Scalar functions as Column expressions: tokens, versions, overlap, ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_tokens(col: Column) -> Column:
    """Words of an identifier: cut at case changes, ``_``, ``-`` and ``.``; lower case."""
    x = F.regexp_replace(col, "([a-z0-9])([A-Z])", "$1 $2")
    x = F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(x, "[_.\\-]", " ")), "\\s+"), lambda t: t != "")


def search_tokens(col: Column) -> Column:
    """Lower-case runs of letters and digits of two or more characters."""
    x = F.regexp_replace(col, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: F.length(t) > 1)


def code_tokens(col: Column) -> Column:
    """Words, and each symbol on its own."""
    return F.filter(F.split(F.regexp_replace(F.lower(col), "([^a-z0-9\\s])", " $1 "), "\\s+"), lambda t: t != "")


def normalise_code(col: Column) -> Column:
    """Code without comments, its strings as STR and its numbers as NUM."""
    x = F.regexp_replace(col, "//[^\\n]*|/\\*(?s:.*?)\\*/", " ")
    x = F.regexp_replace(x, "\"[^\"]*\"|'[^']*'", "STR")
    return F.regexp_replace(x, "\\b[0-9]+(?:\\.[0-9]+)?\\b", "NUM")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens; fewer tokens have none."""
    # The tokens are bound to a variable, so that they are made once and not for every run.
    runs = lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(tokens), runs), 0)


def version(col: Column) -> Column:
    """(major, minor, patch); what is missing is 0."""
    part = lambda k: F.coalesce(F.regexp_extract(col, r"(\d+)(?:\.(\d+))?(?:\.(\d+))?", k).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


def token_estimate(col: Column) -> Column:
    return F.ceil(F.length(col) / 4)


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared lines of two closed ranges over the lines of either."""
    shared = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1)
    return shared / ((a1 - a0 + 1) + (b1 - b0 + 1) - shared)


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def saturate(col: Column) -> Column:
    return col / (col + 1)


def route(col: Column) -> Column:
    """A URL's path: no scheme, host, query or closing slash; parameters as ``:p``."""
    x = F.regexp_replace(col, "^[a-zA-Z]+://[^/]*", "")
    x = F.regexp_replace(x, "[?#].*$", "")
    x = F.regexp_replace(x, "\\{[^}]*\\}|:[A-Za-z_]+|<[^>]*>", ":p")
    return F.when(F.length(x) > 1, F.regexp_replace(x, "/$", "")).otherwise(x)


def ladder(col: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step that the value reaches; steps fall."""
    out = F.lit(otherwise)
    for least, name in reversed(steps):
        out = F.when(col >= least, F.lit(name)).otherwise(out)
    return out


def snippet(col: Column, term: str, around: int = 40) -> Column:
    """The first place of a term, marked, with some text around it; null where it is not found."""
    at = F.locate(term.lower(), F.lower(col))
    first = F.greatest(F.lit(1), at - around)
    last = at + len(term) + around
    before, hit, after = F.substr(col, first, at - first), F.substr(col, at, F.lit(len(term))), F.substr(col, at + len(term), F.lit(around))
    return F.when(at > 0, F.concat(F.when(first > 1, F.lit("...")).otherwise(F.lit("")), before, F.lit("<<"), hit, F.lit(">>"), after, F.when(last <= F.length(col), F.lit("...")).otherwise(F.lit(""))))


def iou_span(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared lines of two closed ranges over the lines from the first to the last of both; 0 if they share none. Equals ``iou`` where they meet."""
    shared = F.least(a1, b1) - F.greatest(a0, b0) + 1
    return F.when(shared > 0, shared / (F.greatest(a1, b1) - F.least(a0, b0) + 1)).otherwise(F.lit(0.0))


#: The public rational approximation of erfc (absolute error below 1.5e-7).
ERFC_P, ERFC = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """The complementary error function, approximately."""
    t = 1 / (1 + ERFC_P * F.abs(x))
    y = F.lit(0.0)
    for a in reversed(ERFC):
        y = (y + a) * t
    y = y * F.exp(-x * x)
    return F.when(x < 0, 2 - y).otherwise(y)


def chi2_survival(x: Column) -> Column:
    """The chance that chi squared of one degree of freedom exceeds x; 1 for x <= 0."""
    return F.when(x <= 0, 1.0).otherwise(erfc(F.sqrt(x / 2)))


def effect_size(only_first: Column, only_second: Column, cases: Column) -> Column:
    rate = F.when(cases > 0, F.abs(only_first - only_second) / cases).otherwise(0.0)
    return F.when(rate > 0.2, "large").when(rate > 0.1, "medium").when(rate > 0.05, "small").otherwise("negligible")


def signature_params(signature: Column) -> Column:
    """The trimmed parts, without empty ones, of what stands between the first ``(`` and the next ``)``."""
    return F.filter(F.transform(F.split(F.regexp_extract(signature, r"\(([^)]*)\)", 1), ","), lambda p: F.trim(p)), lambda p: p != "")


def content_fingerprint(mode: Column, path: Column, content: Column) -> Column:
    """SHA-256 of mode, path and content with a zero byte between each; null counts as empty."""
    parts = [F.coalesce(c, F.lit("")) for c in (mode, path, content)]
    return F.sha2(F.concat(parts[0], F.lit("\x00"), parts[1], F.lit("\x00"), parts[2]), 256)


#: Points of a change's risk by its level and by counts at or above a step, highest first.
LEVEL_POINTS = {"medium": 5, "high": 15, "critical": 30}
IMPACT_POINTS, PROCESS_POINTS = [(20, 25), (10, 18), (5, 12), (1, 5)], [(3, 20), (2, 13), (1, 7)]
FILE_POINTS, SYMBOL_POINTS = [(10, 15), (5, 10), (2, 5), (1, 2)], [(20, 10), (10, 7), (5, 4), (1, 1)]


def _ladder(n: Column, steps: list[tuple[int, int]]) -> Column:
    out = F.lit(0)
    for least, points in sorted(steps):
        out = F.when(n >= least, points).otherwise(out)
    return out


def change_risk(level: Column, symbols: Column, impacted: Column, processes: Column, files: Column) -> Column:
    """0 to 100: points for the risk level (if any symbol changed), what is impacted, processes, changed files and changed symbols."""
    own = F.lit(0)
    for name, points in LEVEL_POINTS.items():
        own = F.when(level == name, points).otherwise(own)
    own = F.when(symbols > 0, own).otherwise(0)
    return F.least(F.lit(100), own + _ladder(impacted, IMPACT_POINTS) + _ladder(processes, PROCESS_POINTS) + _ladder(files, FILE_POINTS) + _ladder(symbols, SYMBOL_POINTS)).cast("int")


def evidence_confidence(direct: Column, heuristic: Column, inferred: Column) -> Column:
    """Confidence from how many signals of each kind there are, to three places: the strongest kind sets the base, mixed kinds add a little."""
    base = F.when(direct > 0, 0.9 + F.least(direct, F.lit(5)) * 0.02).when(heuristic > 0, 0.7 + F.least(heuristic, F.lit(10)) * 0.019).when(inferred > 0, 0.5 + F.least(inferred, F.lit(10)) * 0.019)
    more = F.when((direct > 0) & (heuristic > 0), 0.03).otherwise(0.0) + F.when((heuristic > 0) & (inferred > 0), 0.02).otherwise(0.0)
    return F.coalesce(F.round(F.least(F.lit(1.0), base + more), 3), F.lit(0.0))
