"""URL paths: canonical form, parameters, prefix joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archspan.functions.names import col


def canonical_path(path: Column | str) -> Column:
    """Path with every parameter as ``{}``: anchors, escapes and trailing slashes go, regex groups (to two levels), ``<...>`` and ``{...}`` fold."""
    c = F.regexp_replace(F.trim(col(path)), r"^\^|\$$", "")
    for _ in range(3):  # innermost groups first
        c = F.regexp_replace(c, r"\((?:\?P<\w+>|\?:)?[^()]*\)[?*+]?", "{}")
    c = F.regexp_replace(c, r"<[^<>]*>|\{[^{}]*\}", "{}")
    c = F.regexp_replace(F.regexp_replace(c, r"\\(.)", "$1"), "/+", "/")
    return F.concat(F.lit("/"), F.regexp_replace(c, r"^/|/$", ""))


def same_route(a: Column | str, b: Column | str) -> Column:
    """Two paths name one route if their canonical forms are equal."""
    return canonical_path(a) == canonical_path(b)


def join_prefix(prefix: Column | str, path: Column | str) -> Column:
    """Mounted path: one slash between prefix and path."""
    return F.concat(F.regexp_replace(col(prefix), "/+$", ""), F.lit("/"), F.regexp_replace(col(path), "^/+", ""))


def path_parameters(path: Column | str) -> Column:
    """Names of ``{name}``, ``{name:type}``, ``<name>`` and ``<type:name>`` parameters, in order, each once."""
    braces = F.regexp_extract_all(col(path), F.lit(r"\{(\w+)(?::[^}]*)?\}"), 1)
    angles = F.regexp_extract_all(col(path), F.lit(r"<(?:\w+:)?(\w+)>"), 1)
    return F.array_distinct(F.concat(braces, angles))
