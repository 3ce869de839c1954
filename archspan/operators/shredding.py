"""Deeply nested semi-structured records (problem 6).

Reports are shredded into columns: per leaf path a sequence of values with
repetition level (the list level at which a value starts anew) and definition
level (how many levels above it exist). Leaves are found in the records. Flat tables
are rebuilt from the level sequences by windows; every row keeps the positions of
its ancestors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archspan.runtime import Scratch

#: Lists that a report may write in any way: under any spelling of the key, at any outer
#: level, a lone object as a list of one, or as JSON text. Any other list is a level named by its path.
LISTS = ("falsepositiveedges", "cases", "violations", "pathhops", "scopesnapshots", "outgoing")
#: Key around the whole report that some reports have.
WRAPPER = "report"
_FP, _CASE = ("falsepositiveedges",), ("cases",)
_VIOLATION = (*_CASE, "violations")
_SNAPSHOT = (*_VIOLATION, "scopesnapshots")
#: Flat tables: the levels above a row, the names of its positions, and its columns with their key paths.
#: Keys are compared without case and punctuation.
TABLES: dict[str, tuple[tuple[str, ...], list[str], dict[str, str]]] = {
    "meta": ((), [], {"arm": "meta.arm", "generated_at": "meta.generatedat", "git_commit": "meta.gitcommit", "search_version": "meta.versions.search", "resolver_model": "meta.versions.resolver.model"}),
    "ingestion": ((), [], {k: f"ingestion.{v}" for k, v in {"exact": "exact", "partial": "partial", "miss": "miss", "total": "total", "false_positives": "falsepositives", "presence_exact": "classsplit.presence.exact", "presence_miss": "classsplit.presence.miss", "scope_exact": "classsplit.scope.exact", "scope_miss": "classsplit.scope.miss", "scope_unknown": "classsplit.scope.bylabel.unknown"}.items()}),
    "report": ((), [], {"repo_id": "repoid", "arm": "arm", "run_index": "runindex", "pin_commit": "pincommit", "detected_exact": "detection.exact", "detected_total": "detection.total", "parse_seconds": "cost.parseseconds"}),
    "case_cost": (("cost.percasedetectseconds",), ["item_no"], {"seconds": ""}),
    "fp_edge": (_FP, ["item_no"], {"adr_id": "adrid", "subject": "subject", "predicate": "predicate", "object": "object"}),
    "case": (_CASE, ["case_no"], {"case_id": "caseid", "exact": "exact", "miss": "miss", "overlap": "diagnostics.overlap"}),
    "violation": (
        _VIOLATION,
        ["case_no", "violation_no"],
        {"changed_fqn": "changedfqn", "matched_fqn": "matchedfqn", "change_type": "changetype", "match_status": "matchstatus", "evidence": "evidence", "fan_in": "fanin", "code_fingerprint": "codefingerprint"}
        | {f: f"constraint.{f.replace('_', '')}" for f in ("adr_id", "subject", "predicate", "object")}
        | {"file_path": "location.filepath", "line_start": "location.span.linestart", "line_end": "location.span.lineend"},
    ),
    "hop": ((*_VIOLATION, "pathhops"), ["case_no", "violation_no", "item_no"], {"kind": "kind", "target": "target", "file_path": "filepath"}),
    "snapshot": (_SNAPSHOT, ["case_no", "violation_no", "snapshot_no"], {"fqn": "fqn", "scope": "scope"}),
    "outgoing": ((*_SNAPSHOT, "outgoing"), ["case_no", "violation_no", "snapshot_no", "item_no"], {"kind": "kind", "target": "target"}),
}
_PLAIN = re.compile(r"[^a-z0-9]+")


def _key(name: str) -> str:
    return _PLAIN.sub("", name.lower())


def _items(value: object) -> list:
    """A list however it is written: null, a list, a lone object, or either as JSON text."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return []
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else []


@dataclass
class _Element:
    """An element of a list, or the report: its leaves by key path and the elements of its lists by level name."""

    leaves: dict[str, str] = field(default_factory=dict)
    lists: dict[str, list[_Element]] = field(default_factory=dict)


def _element(value: object, outermost: bool = False) -> _Element:
    """Reads objects level by level: of two values for one key path, or two lists of one name, the outer and first holds."""
    if isinstance(value, str) and not outermost:
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return _Element({"": value})
    out = _Element()
    if isinstance(value, list):
        out.lists["item"] = [_element(v) for v in value]
    elif not isinstance(value, dict):
        if value is not None:
            out.leaves[""] = json.dumps(value)
        return out
    level = [((), value)] if isinstance(value, dict) else []
    while level:
        below = []
        for prefix, current in level:
            for name, v in current.items():
                key = _key(name)
                path = prefix if outermost and not prefix and key == WRAPPER and isinstance(v, dict) else (*prefix, key)
                if v is None:
                    continue
                if key in LISTS or isinstance(v, list):
                    level_name = key if key in LISTS else ".".join(path)
                    if level_name not in out.lists:
                        out.lists[level_name] = [_element(x) for x in _items(v)]
                elif isinstance(v, dict):
                    below.append((path, v))
                else:
                    out.leaves.setdefault(".".join(path), v if isinstance(v, str) else json.dumps(v))
        level = below
    return out


def _schema(element: _Element, levels: tuple[str, ...], found: dict[tuple[str, ...], dict[str, None]]) -> None:
    """All levels of a report with the leaves that any of their elements has; each level has the leaf ``.``, the element itself."""
    found.setdefault(levels, {".": None}).update(dict.fromkeys(element.leaves))
    for name, items in element.lists.items():
        found.setdefault((*levels, name), {".": None})
        for item in items:
            _schema(item, (*levels, name), found)


def _column(element: _Element, levels: tuple[str, ...], leaf: str, rep: int, at: int) -> Iterator[tuple[int, int, str | None]]:
    """(repetition level, definition level, value) of one leaf in document order."""
    if at == len(levels):
        value = element.leaves.get(leaf)
        yield rep, at + (value is not None), value
        return
    items = element.lists.get(levels[at])
    if not items:
        yield rep, at, None
        return
    for i, item in enumerate(items):
        yield from _column(item, levels, leaf, rep if i == 0 else at + 1, at + 1)


#: Output rows are sent on from this number.
FLUSH_ROWS = 100_000
COLUMN = "report_id bigint, levels string, leaf string, depth int, seq bigint, rep int, def int, value string"


def shred(reports: DataFrame, leaves: list[tuple[tuple[str, ...], str]] | None = None) -> DataFrame:
    """(report_id, levels, leaf, depth, seq, rep, def, value): the level sequences of the chosen (levels, leaf), or of all that a report has.

    ``levels`` are the lists above the leaf, joined by ``/``, ``depth`` their number.
    Repeated reports count once. A report that is null, not valid JSON or nested
    deeper than Python reads gives no rows; a missing or empty list gives one entry
    that is defined only above it.
    """

    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()]

    def packed(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[c.split()[0] for c in COLUMN.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in types]
            for report_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    report = _element(json.loads(payload), outermost=True)
                except (TypeError, ValueError, RecursionError):
                    continue
                chosen = leaves
                if chosen is None:
                    found: dict[tuple[str, ...], dict[str, None]] = {}
                    _schema(report, (), found)
                    chosen = [(levels, leaf) for levels, names in found.items() for leaf in names]
                for levels, leaf in chosen:
                    name, depth = "/".join(levels), len(levels)
                    for seq, (rep, defined, value) in enumerate(_column(report, levels, leaf, 0, 0)):
                        for to, x in zip(out, (report_id, name, leaf, depth, seq, rep, defined, value), strict=True):
                            to.append(x)
                if len(out[0]) >= FLUSH_ROWS:
                    yield packed(out)
                    out = [[] for _ in types]
            yield packed(out)

    return reports.select("report_id", "payload").distinct().mapInArrow(read, COLUMN)


def positions(columns: DataFrame, most: int) -> DataFrame:
    """Level sequences of at most ``most`` levels with the position ``i1`` .. ``iN`` of each value within each enclosing list.

    A value starts a new element of level k where its repetition level is at most k;
    counting the starts within the element above gives the position. Entries of lists
    that are not there are left out.
    """
    within = ["report_id", "levels", "leaf"]
    for k in range(1, most + 1):
        starts = F.when(F.col("rep") <= k, 1).otherwise(0)
        columns = columns.withColumn(f"i{k}", (F.sum(starts).over(W.partitionBy(*within).orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)) - 1).cast("int"))
        within = [*within, f"i{k}"]
    return columns.where(F.col("def") >= F.col("depth"))


def _rebuilt(columns: DataFrame, table: str) -> DataFrame:
    levels, links, names = TABLES[table]
    mine = columns.where((F.col("levels") == "/".join(levels)) & F.col("leaf").isin(*names.values(), "."))
    placed = positions(mine, len(levels))
    keys = ["report_id", *[F.col(f"i{k + 1}").alias(link) for k, link in enumerate(links)]]
    return placed.groupBy(*keys).agg(*[F.max(F.when(F.col("leaf") == leaf, F.col("value"))).alias(name) for name, leaf in names.items()])


def flat_table(reports: DataFrame, table: str) -> DataFrame:
    """One of TABLES: report_id, the positions of all enclosing elements, and the values as text."""
    levels, _, names = TABLES[table]
    return _rebuilt(shred(reports, [(levels, leaf) for leaf in (".", *names.values())]), table)


def flat_tables(reports: DataFrame, scratch: Scratch) -> dict[str, DataFrame]:
    """All of TABLES, and ``other``: (report_id, levels, leaf, seq, value) of every value that none of them holds. Reports are parsed once."""
    columns = scratch.cut(shred(reports))
    out = {table: _rebuilt(columns, table) for table in TABLES}
    held = F.lit(False)
    for levels, _, names in TABLES.values():
        held = held | ((F.col("levels") == "/".join(levels)) & F.col("leaf").isin(*names.values()))
    out["other"] = columns.where(F.col("value").isNotNull() & ~held).select("report_id", "levels", "leaf", "seq", "value")
    return out


def leaf_counts(reports: DataFrame) -> DataFrame:
    """(levels, leaf, n_values, n_reports): every leaf that the reports hold, in the tables or not."""
    values = shred(reports).where(F.col("value").isNotNull())
    return values.groupBy("levels", "leaf").agg(F.count(F.lit(1)).alias("n_values"), F.count_distinct("report_id").alias("n_reports"))


def innermost(reports: DataFrame) -> DataFrame:
    """(report_id, case_no, violation_no, item, snapshot_no, item_no, target): all hops, outgoing edges and false-positive edges."""
    shown = {"hop": "target", "outgoing": "target", "fp_edge": "object"}
    chosen = [(TABLES[item][0], TABLES[item][2][column]) for item, column in shown.items()]
    placed = positions(shred(reports, chosen), 4)
    item = F.element_at(F.create_map(*[F.lit(x) for name in shown for x in ("/".join(TABLES[name][0]), name)]), F.col("levels"))
    at = {link: F.lit(-1) for link in ("case_no", "violation_no", "snapshot_no", "item_no")}
    for name in shown:
        for k, link in enumerate(TABLES[name][1]):
            at[link] = F.when(F.col("item") == name, F.col(f"i{k + 1}")).otherwise(at[link])
    named = placed.withColumn("item", item)
    return named.select("report_id", at["case_no"].alias("case_no"), at["violation_no"].alias("violation_no"), "item", at["snapshot_no"].alias("snapshot_no"), at["item_no"].alias("item_no"), F.coalesce("value", F.lit("")).alias("target"))
