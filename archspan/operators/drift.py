"""Schemas that drift between files (problem 5).

Each record is read into tagged cells (path, type bit, value). Schemas are fused in
parallel with all alternative types per path kept; a path with several types
becomes typed branches plus one canonical text; files are compared with the file
before them in their stream, and names that a field bore in turn become one name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspan.runtime import Scratch

#: Bit of each alternative in a fused type set.
TYPE_BITS = {"string": 1, "number": 2, "boolean": 4, "array": 8}
RECORD = ["family", "stream_id", "file_no", "record_key"]
CELLS = "array<struct<path:string,bit:int,value:string>>"
#: Renamed names up to this number are sent to every task as one map per family; beyond it they are joined.
BROADCAST_NAMES = 50_000


def _bit(value: object) -> int:
    if isinstance(value, bool):
        return TYPE_BITS["boolean"]
    if isinstance(value, (int, float)):
        return TYPE_BITS["number"]
    return TYPE_BITS["array"] if isinstance(value, list) else TYPE_BITS["string"]


def _canonical(value: object) -> str:
    """One text per JSON value: sorted keys, no blanks, whole floats as integers."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        value = int(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _walk(node: dict) -> Iterator[tuple[str, object]]:
    stack = [("", node)]
    while stack:
        prefix, current = stack.pop()
        for key, value in current.items():
            if isinstance(value, dict):
                stack.append((f"{prefix}{key}.", value))
            elif value is not None:
                yield f"{prefix}{key}", value


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, bits, values, ends = [], [], [], [0]
        for payload in batch.column("payload").to_pylist():
            try:
                record = json.loads(payload)
            except (TypeError, ValueError, RecursionError):
                record = None
            if isinstance(record, dict):
                for path, value in _walk(record):
                    paths.append(path), bits.append(_bit(value)), values.append(_canonical(value))
            ends.append(len(paths))
        flat = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(bits, pa.int32()), pa.array(values, pa.string())], names=["path", "bit", "value"])
        cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in RECORD], cells], names=[*RECORD, "cells"])


def tagged_records(records: DataFrame, distinct: bool = False) -> DataFrame:
    """(family, stream_id, file_no, record_key, cells): the non-null leaves of every record line as (path, type bit, value).

    With ``distinct`` repeated lines count once. Payloads that are null, not JSON or no
    object have no cells. Lists are leaves; empty objects are none.
    """
    plain = records.select(*RECORD, "payload")
    return (plain.distinct() if distinct else plain).mapInArrow(_read, f"family string, stream_id bigint, file_no int, record_key string, cells {CELLS}")


def _each(tagged: DataFrame, *columns: str) -> DataFrame:
    return tagged.select(*columns, F.explode("cells").alias("c")).select(*columns, "c.*")


def type_names(mask: Column) -> Column:
    """The types of a bit mask in order, as text."""
    return F.array_join(F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(b)) > 0, F.lit(n)) for n, b in sorted(TYPE_BITS.items())])), ",")


def fused_schema(tagged: DataFrame, *by: str) -> DataFrame:
    """Per group and path the fused set of types (a bit mask) and the number of leaves."""
    return _each(tagged, *by).groupBy(*by, "path").agg(F.bit_or("bit").alias("types"), F.count(F.lit(1)).alias("n_leaves"))


AT = ["stream_id", "file_no"]


def schema_changes(tagged: DataFrame, scratch: Scratch) -> DataFrame:
    """(stream_id, file_no, field_name, change_kind, new_name, old_types, new_types) of each file against file_no - 1 of its stream.

    ``tagged`` holds all records, written. A file exists if it has a row. A removed
    field is ``renamed`` to an added one if every record key of both files has the same
    set of values (or none) under the two names and one has a value; all such pairs
    come out. Sets of values, as a key may occur with several payloads in a file. Rows
    without stream or file number have no place and are left out; files without
    predecessor give no rows.
    """
    known = tagged.dropna(subset=AT)
    files = known.select(*AT).distinct()
    pairs = files.join(files.select("stream_id", (F.col("file_no") + 1).alias("file_no")), AT)
    fields = scratch.cut(fused_schema(known, *AT).drop("n_leaves"))
    now = fields.select(*AT, "path", F.col("types").alias("now"))
    old = fields.select("stream_id", (F.col("file_no") + 1).alias("file_no"), "path", F.col("types").alias("old"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("old"), "type_changed")
    both = now.join(old, [*AT, "path"], "full").withColumn("change_kind", kind).where(F.col("change_kind").isNotNull())
    changed = scratch.cut(both.join(pairs, AT, "left_semi"))
    renames = scratch.cut(_renames(known, changed))
    bore = renames.select(*AT, F.explode(F.array(F.struct(F.lit("removed").alias("change_kind"), F.col("path")), F.struct(F.lit("added").alias("change_kind"), F.col("new_name").alias("path")))).alias("r")).select(*AT, "r.*").distinct()
    rest = changed.join(bore, [*AT, "change_kind", "path"], "left_anti").withColumn("new_name", F.lit(""))
    came = changed.where("change_kind = 'added'").select(*AT, F.col("path").alias("new_name"), F.col("now"))
    named = renames.join(changed.where("change_kind = 'removed'").select(*AT, "path", "old"), [*AT, "path"]).join(came, [*AT, "new_name"]).withColumn("change_kind", F.lit("renamed"))
    return rest.unionByName(named).select(*AT, F.col("path").alias("field_name"), "change_kind", "new_name", type_names(F.coalesce("old", F.lit(0))).alias("old_types"), type_names(F.coalesce("now", F.lit(0))).alias("new_types"))


def _renames(known: DataFrame, changed: DataFrame) -> DataFrame:
    """(stream_id, file_no, path, new_name) of removed and added fields that hold the same sets of values.

    Only pairs of files with both kinds of change are read again. The values of a key
    under a name become a digest of 128 bits; per record key the digests of the
    changed names meet once, and pairs of names are counted from them.
    """
    moved = changed.where("change_kind IN ('added', 'removed')").select(*AT, "path", F.col("change_kind").alias("side"))
    mixed = moved.groupBy(*AT).agg(F.count_distinct("side").alias("n")).where("n = 2").select(*AT)
    sides = known.select("stream_id", F.explode(F.array(F.struct(F.col("file_no"), F.lit("added").alias("side")), F.struct((F.col("file_no") + 1).alias("file_no"), F.lit("removed").alias("side")))).alias("s"), "record_key", "cells")
    sides = sides.where(F.col("record_key").isNotNull()).select("stream_id", "s.*", "record_key", "cells").join(mixed, AT, "left_semi")
    cells = _each(sides, *AT, "side", "record_key").drop("bit").join(moved, [*AT, "side", "path"], "left_semi")
    values = cells.groupBy(*AT, "side", "record_key", "path", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit("again"), F.col("value")).alias("h2")).agg(F.lit(1).alias("one"))
    digests = values.groupBy(*AT, "side", "record_key", "path").agg(F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor("h1").alias("a"), F.bit_xor("h2").alias("b")).alias("digest"))
    there = sides.select(*AT, "side", "record_key").distinct().withColumn("cell", F.lit(None).cast("struct<path:string,digest:struct<n:bigint,a:bigint,b:bigint>>"))
    all_ = there.unionByName(digests.select(*AT, "side", "record_key", F.struct("path", "digest").alias("cell")))
    keyed = all_.groupBy(*AT, "record_key").agg(*[F.max(F.col("side") == s).alias(f"in_{s}") for s in ("removed", "added")], *[F.collect_list(F.when(F.col("side") == s, F.col("cell"))).alias(s) for s in ("removed", "added")]).where("in_removed AND in_added")
    none = F.lit(None).cast("string")
    same = F.flatten(F.transform("removed", lambda o: F.transform(F.filter("added", lambda w: w["digest"] == o["digest"]), lambda w: F.struct(o["path"].alias("path"), w["path"].alias("new_name")))))
    seen = F.concat(same, F.transform("removed", lambda o: F.struct(o["path"].alias("path"), none.alias("new_name"))), F.transform("added", lambda w: F.struct(none.alias("path"), w["path"].alias("new_name"))))
    counts = keyed.select(*AT, F.explode(seen).alias("p")).groupBy(*AT, "p").agg(F.count(F.lit(1)).alias("n")).select(*AT, "p.*", "n")
    n_old = counts.where("new_name IS NULL").select(*AT, "path", F.col("n").alias("n_old"))
    n_new = counts.where("path IS NULL").select(*AT, "new_name", F.col("n").alias("n_new"))
    met = counts.where("path IS NOT NULL AND new_name IS NOT NULL").join(n_old, [*AT, "path"]).join(n_new, [*AT, "new_name"])
    return met.where((F.col("n") == F.col("n_old")) & (F.col("n") == F.col("n_new"))).select(*AT, "path", "new_name")


def field_names(tagged: DataFrame, changes: DataFrame, scratch: Scratch) -> DataFrame:
    """(family, path, field): one name for all that a field was called in the streams of its family.

    Renames link names; of linked names the one that most files have holds (ties: the
    least). Names that stand side by side in a file are different fields, so the
    links of such a group are not followed. Only names that change are listed.
    """
    streams = tagged.select("family", "stream_id").dropna().distinct()
    fields = fused_schema(tagged.dropna(subset=AT), "family", *AT).drop("types", "n_leaves")
    per = fields.groupBy("family", "path").agg(F.count(F.lit(1)).alias("n_files"))
    pairs = changes.where("change_kind = 'renamed'").join(streams, "stream_id").select("family", F.col("field_name").alias("a"), F.col("new_name").alias("b")).distinct()
    links = scratch.cut(pairs.unionByName(pairs.select("family", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    group, moved = scratch.cut_counting(links.select("family", F.col("a").alias("path"), F.col("a").alias("group")).distinct(), F.lit(True))
    while moved:  # each round carries the least name one link further
        near = links.join(group.select("family", F.col("path").alias("b"), F.col("group").alias("g")), ["family", "b"]).groupBy("family", F.col("a").alias("path")).agg(F.min("g").alias("g"))
        step = group.join(near, ["family", "path"]).select("family", "path", F.least("group", "g").alias("group"), (F.col("g") < F.col("group")).alias("changed"))
        step, moved = scratch.cut_counting(step, F.col("changed"))
        group = step.drop("changed")
    beside = fields.join(group, ["family", "path"]).groupBy("family", "group", *AT).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("family", "group").distinct()
    whole = group.join(beside, ["family", "group"], "left_anti").join(per, ["family", "path"])
    best = whole.groupBy("family", "group").agg(F.min(F.struct((-F.col("n_files")).alias("n"), F.col("path")))["path"].alias("field"))
    return whole.join(best, ["family", "group"]).where("path <> field").select("family", "path", "field")


def _named(tagged: DataFrame, names: DataFrame, scratch: Scratch, limit: int) -> DataFrame:
    """Cells under their consistent names."""
    names, n = scratch.cut_counting(names, F.lit(True))
    if n <= limit:
        maps = names.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("path", "field"))).alias("names"))
        joined = tagged.join(F.broadcast(maps), "family", "left")
        name = lambda c: F.coalesce(F.element_at("names", c["path"]), c["path"])
        return joined.withColumn("cells", F.transform("cells", lambda c: F.struct(name(c).alias("path"), c["bit"].alias("bit"), c["value"].alias("value")))).drop("names")
    lines = scratch.cut(tagged.withColumn("line", F.monotonically_increasing_id()))
    cells = _each(lines, "line", "family").join(names, ["family", "path"], "left").select("line", F.struct(F.coalesce("field", "path").alias("path"), "bit", "value").alias("c"))
    return lines.drop("cells").join(cells.groupBy("line").agg(F.collect_list("c").alias("cells")), "line", "left").drop("line").withColumn("cells", F.coalesce("cells", F.array().cast(CELLS)))


def _branch(bit: int | None, value) -> Column:
    """Map from path to value of the cells of one type; of two cells with one path (a dotted key beside a nested one) the lesser value holds."""
    cells = F.col("cells") if bit is None else F.filter("cells", lambda c: c["bit"] == bit)
    entries = F.array_sort(F.transform(cells, lambda c: F.struct((c["path"] if bit else F.concat(c["path"], F.lit("#"), type_names(c["bit"]))).alias("key"), value(c["value"]).alias("value"))))
    return F.map_from_entries(F.filter(entries, lambda e, i: (i == 0) | (F.get(entries, i - 1)["key"] != e["key"])))


def union_table(tagged: DataFrame, changes: DataFrame, scratch: Scratch, broadcast_names: int = BROADCAST_NAMES) -> DataFrame:
    """One row per distinct record with the same columns for every family and file.

    ``strings``, ``numbers``, ``booleans`` and ``arrays`` are the typed branches by
    field, ``canonical`` holds every value as JSON text under ``field#type``, so a field whose type differs
    between files stays readable in one place. A renamed field stands under one name
    (`field_names`). Records without cells have empty maps.
    """
    named = _named(tagged, field_names(tagged, changes, scratch), scratch, broadcast_names)
    return named.select(
        *RECORD,
        _branch(TYPE_BITS["string"], lambda v: F.get_json_object(v, "$")).alias("strings"),
        _branch(TYPE_BITS["number"], lambda v: v.cast("double")).alias("numbers"),
        _branch(TYPE_BITS["boolean"], lambda v: v == "true").alias("booleans"),
        _branch(TYPE_BITS["array"], lambda v: F.from_json(v, "array<string>")).alias("arrays"),
        _branch(None, lambda v: v).alias("canonical"),
    )


def conflicts(tagged: DataFrame) -> DataFrame:
    """(family, path, types, n_files): paths that hold more than one type, with the types in order and the files that have them."""
    fused = fused_schema(tagged, "family", *AT)
    per = fused.groupBy("family", "path").agg(F.bit_or("types").alias("mask"), F.count(F.lit(1)).alias("n_files"))
    return per.where(F.bit_count("mask") > 1).select("family", "path", type_names(F.col("mask")).alias("types"), "n_files")
