"""Dotted names (FQNs): validation, parts, ancestors, suffixes, patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = r"\.\*$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def path_to_fqn(path: Column | str) -> Column:
    """``a/b/__init__.py`` -> ``a.b``; both slash kinds separate; null stays null."""
    dotted = F.regexp_replace(F.regexp_replace(col(path), r"\.py$", ""), r"[/\\]", ".")
    return F.regexp_replace(dotted, r"\.__init__$", "")


def is_fqn(x: Column | str) -> Column:
    """True for non-empty dotted names without empty segments; null is false."""
    c = col(x)
    return F.coalesce(F.length(c) > 0, F.lit(False)) & ~F.coalesce(c.rlike(r"^\.|\.$|\.\."), F.lit(False))


def safe_fqn(x: Column | str) -> Column:
    """The name where it is valid, else null."""
    return F.when(is_fqn(x), col(x))


def checked_fqn(x: Column | str) -> Column:
    """The name where it is valid, else the query fails."""
    c = col(x)
    return F.when(is_fqn(c), c).otherwise(F.raise_error(F.concat(F.lit("not a dotted name: "), F.coalesce(c, F.lit("null")))))


def parts(x: Column | str) -> Column:
    return F.split(col(x), r"\.")


def depth(x: Column | str) -> Column:
    return F.size(parts(x))


def last_part(x: Column | str) -> Column:
    return F.substring_index(col(x), ".", -1)


def parent(x: Column | str) -> Column:
    """Name without its last segment; null for one segment."""
    c = col(x)
    return F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"\.[^.]*$", ""))


def child(x: Column | str, name: Column | str) -> Column:
    return F.concat(col(x), F.lit("."), col(name))


def ancestors(x: Column | str, proper: bool = False) -> Column:
    """All dotted prefixes, shortest first; with the name itself unless ``proper``.

    Turns "t is o or lies under o" into an equality on o, so that a prefix join
    plans as a hash join and not as a nested loop.
    """
    p = parts(x)
    n = F.size(p) - (1 if proper else 0)
    seq = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(seq, lambda i: F.array_join(F.slice(p, F.lit(1), i), "."))


def suffixes(x: Column | str) -> Column:
    """All dotted suffixes, longest first."""
    p = parts(x)
    n = F.size(p)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(p, i, n), "."))


def is_wildcard(pattern: Column | str) -> Column:
    return col(pattern).rlike(WILDCARD)


def base(pattern: Column | str) -> Column:
    """Pattern without one trailing ``.*``."""
    return F.regexp_replace(col(pattern), WILDCARD, "")


def strip_dots_stars(pattern: Column | str) -> Column:
    """Pattern without any trailing run of dots and stars."""
    return F.regexp_replace(col(pattern), r"[.*]+$", "")


def match_status(fqn: Column | str, pattern: Column | str) -> Column:
    """EXACT for equality, WILDCARD below ``X.*``, else null. ``X.*`` does not match ``X``."""
    f, p = col(fqn), col(pattern)
    return F.when(f == p, "EXACT").when(is_wildcard(p) & f.startswith(F.concat(base(p), F.lit("."))), "WILDCARD")


def subject_covers(pattern: Column | str, fqn: Column | str) -> Column:
    """Pattern match in which ``X.*`` also covers ``X``."""
    f, p = col(fqn), col(pattern)
    return match_status(f, p).isNotNull() | (is_wildcard(p) & (f == base(p)))


def at_or_under(fqn: Column | str, top: Column | str) -> Column:
    f, t = col(fqn), col(top)
    return (f == t) | f.startswith(F.concat(t, F.lit(".")))


def specificity(pattern: Column | str) -> Column:
    """Segments of the pattern without ``.*``; one more when it is exact."""
    return (depth(base(pattern)) + F.when(is_wildcard(pattern), 0.0).otherwise(1.0)).cast("double")


def matching_patterns(fqn: Column | str) -> Column:
    """Every pattern that matches a name: itself, and ``A.*`` for each proper ancestor A.

    Turns pattern matching into an equality of strings, so rules and names meet in a hash join.
    """
    return F.concat(F.array(col(fqn)), F.transform(ancestors(fqn, proper=True), lambda a: F.concat(a, F.lit(".*"))))


def covering_patterns(fqn: Column | str) -> Column:
    """Patterns whose subject covers a name: the matching ones and ``X.*`` for the name X itself."""
    return F.concat(matching_patterns(fqn), F.array(F.concat(col(fqn), F.lit(".*"))))
