"""What a reviewer sees beside the findings: snapshots of scopes, changes of a commit, classes of fires, covered names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archspan.functions import names
from archspan.operators.model import DEPENDENCY

#: Characters of a search result above which it is withheld.
RESULT_CEILING = 16_000


def scope_snapshots(findings: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(constraint_id, changed_fqn, matched_fqn, snapshot_no, scope, fqn, item_no, kind, target): what a requires finding saw.

    Snapshot 0 (``changed``) is the changed name, 1 (``enclosing_module``) its module where that is
    another name, each with its outgoing dependency edges in order; a scope without such
    edges has one row with item_no -1 and null kind and target. Prohibits and object-scope findings have none.
    """
    asked = findings.where(F.col("predicate").isin("requires_dependency", "requires_implementation")).select("constraint_id", "repo_id", "changed_fqn", "matched_fqn").distinct()
    scoped = asked.join(modules.select("repo_id", F.col("fqn").alias("changed_fqn"), "module"), ["repo_id", "changed_fqn"], "left")
    own = F.struct(F.lit(0).alias("snapshot_no"), F.lit("changed").alias("scope"), F.col("changed_fqn").alias("fqn"))
    outer = F.when(F.col("module") != F.col("changed_fqn"), F.struct(F.lit(1).alias("snapshot_no"), F.lit("enclosing_module").alias("scope"), F.col("module").alias("fqn")))
    snaps = scoped.select("constraint_id", "repo_id", "changed_fqn", "matched_fqn", F.explode(F.array_compact(F.array(own, outer))).alias("_s")).select("constraint_id", "repo_id", "changed_fqn", "matched_fqn", "_s.*")
    out = edges.where(F.col("kind").isin(*DEPENDENCY)).withColumn("item_no", F.row_number().over(W.partitionBy("repo_id", "source").orderBy("ord")) - 1)
    met = snaps.join(out.select("repo_id", F.col("source").alias("fqn"), "item_no", "kind", "target"), ["repo_id", "fqn"], "left")
    return met.fillna(-1, ["item_no"]).select("constraint_id", "changed_fqn", "matched_fqn", "snapshot_no", "scope", "fqn", "item_no", "kind", "target")


def hop_files(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(constraint_id, changed_fqn, matched_fqn, object_fqn, hop_no, target, file_path): the hops of each finding's path in order, with the file of the name they lead to."""
    hops = findings.where(F.size("hops") > 0).select("constraint_id", "repo_id", "changed_fqn", "matched_fqn", F.col("ord3").alias("object_fqn"), F.posexplode("hops").alias("hop_no", "target"))
    files = nodes.select("repo_id", F.col("fqn").alias("target"), "file_path")
    return hops.join(files, ["repo_id", "target"], "left").select("constraint_id", "changed_fqn", "matched_fqn", "object_fqn", "hop_no", "target", "file_path")


def _rows(snapshots: DataFrame) -> DataFrame:
    """The row that holds per line, sha and FQN: the one with the highest row_no."""
    keep = [F.col(c) for c in ("from_sha", "kind", "file_path", "code_hash")]
    last = snapshots.dropna(subset=["line_id", "to_sha", "fqn"]).groupBy("line_id", "to_sha", "fqn").agg(F.max_by(F.struct(*keep), "row_no").alias("_r"))
    return last.select("line_id", "to_sha", "fqn", "_r.*")


def changed_names(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(line_id, to_sha, fqn, change_type, file_path, enclosing_class, enclosing_module) of the definitions that a commit changed.

    ``changes`` holds (line_id, to_sha, fqn, change_kind); added names stand in the new
    snapshot, deleted ones in the old. Only ``.py`` files outside folders that start with a dot
    count. Modules come out only as a fallback, for a file of which no definition changed.
    """
    rows = _rows(snapshots)
    before = rows.select("line_id", F.col("to_sha").alias("from_sha"), "fqn", "kind", "file_path")
    links = rows.groupBy("line_id", "to_sha").agg(F.min("from_sha").alias("from_sha"))
    here = changes.where("change_kind <> 'removed'").join(rows.select("line_id", "to_sha", "fqn", "kind", "file_path"), ["line_id", "to_sha", "fqn"])
    gone = changes.where("change_kind = 'removed'").join(links, ["line_id", "to_sha"]).join(before, ["line_id", "from_sha", "fqn"]).drop("from_sha")
    path = F.regexp_replace(F.regexp_replace(F.trim("file_path"), r"[\\/]+", "/"), r"^\./", "")
    named = here.unionByName(gone).withColumn("file_path", path).where(F.col("file_path").endswith(".py") & ~F.col("file_path").rlike(r"(^|/)\."))
    inner = F.coalesce(F.col("kind"), F.lit("")).isin("function", "method", "class")
    files = named.groupBy("line_id", "to_sha", "file_path").agg(F.max(inner.cast("int")).alias("_inner"))
    kept = named.join(files, ["line_id", "to_sha", "file_path"]).where(inner | (F.col("_inner") == 0))
    change_type = F.element_at(F.create_map(*[F.lit(x) for p in (("added", "added"), ("removed", "deleted"), ("changed", "modified")) for x in p]), F.col("change_kind"))
    return kept.select("line_id", "to_sha", "fqn", change_type.alias("change_type"), "file_path", F.when(F.col("kind") == "method", names.parent("fqn")).alias("enclosing_class"), names.path_to_fqn("file_path").alias("enclosing_module"))


def renamed_files(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(line_id, to_sha, old_path, new_path): files whose names all went while a new file came with the same code.

    The code of a file is the bag of the hashes of its definitions, as a count and two
    digests; modules are left out, as their text may hold the old name. A file that has no hash, or
    several candidates, is no rename.
    """
    rows = _rows(snapshots)
    inner = rows.where(F.col("kind").isin("function", "method", "class"))
    digest = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.lower("code_hash")).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit("b"), F.lower("code_hash")).cast("decimal(38,0)")).alias("b"))
    files = inner.groupBy("line_id", "to_sha", "file_path").agg(digest.alias("code"), F.count(F.when(F.length("code_hash") > 0, 1)).alias("hashed")).where("hashed = code.n")
    links = rows.where(F.col("from_sha").isNotNull()).groupBy("line_id", "to_sha").agg(F.min("from_sha").alias("from_sha"))
    old = files.select("line_id", F.col("to_sha").alias("from_sha"), F.col("file_path").alias("old_path"), "code").join(links, ["line_id", "from_sha"])
    gone = old.join(rows.select("line_id", "to_sha", F.col("file_path").alias("old_path")).distinct(), ["line_id", "to_sha", "old_path"], "left_anti")
    came = files.join(links, ["line_id", "to_sha"]).join(rows.select("line_id", F.col("to_sha").alias("from_sha"), "file_path").distinct(), ["line_id", "from_sha", "file_path"], "left_anti")
    moved = changes.select("line_id", "to_sha").distinct()
    met = gone.select("line_id", "to_sha", "old_path", "code").join(came.select("line_id", "to_sha", F.col("file_path").alias("new_path"), "code"), ["line_id", "to_sha", "code"]).join(moved, ["line_id", "to_sha"], "left_semi")
    alone = met.groupBy("line_id", "to_sha", "code").agg(F.min("old_path").alias("old_path"), F.min("new_path").alias("new_path"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return alone.select("line_id", "to_sha", "old_path", "new_path")


def fire_classes(fires: DataFrame, baseline: DataFrame) -> DataFrame:
    """``fires`` with ``fire_class``: structural (its key fires in the baseline too), else merge_mechanism (a requires rule with a wildcard subject), else arm_candidate.

    A key is repo_id, adr_id, predicate, subject, object and matched_fqn, compared null-safe.
    """
    key = ["repo_id", "adr_id", "predicate", "subject", "object", "matched_fqn"]
    plain = lambda df: df.withColumn("_key", F.to_json(F.struct(*key)))
    known = plain(baseline).select("_key").distinct().withColumn("_known", F.lit(True))
    kind = F.when(F.col("_known"), "structural").when(F.col("predicate").startswith("requires") & names.is_wildcard("subject"), "merge_mechanism").otherwise("arm_candidate")
    return plain(fires).join(known, "_key", "left").withColumn("fire_class", kind).drop("_key", "_known")


def result_names(payload: Column) -> Column:
    """Distinct FQNs of a search result in order: of a JSON array of hits or of an object with ``entries``; none for anything else or above RESULT_CEILING characters."""
    hits = "array<struct<fqn:string>>"
    listed = F.when(F.ltrim(payload).startswith("["), F.from_json(payload, hits)).otherwise(F.from_json(payload, f"entries {hits}")["entries"])
    found = F.array_distinct(F.array_compact(F.transform(listed, lambda e: e["fqn"])))
    return F.when(F.length(payload) <= RESULT_CEILING, F.coalesce(found, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def covered(rules: DataFrame, results: DataFrame) -> DataFrame:
    """(constraint_id, side): sides of a rule that a name of its own results grounds: equal bases, or one base above the other.

    ``rules`` holds (constraint_id, subject, object), ``results`` (constraint_id, fqn).
    """
    sides = rules.select("constraint_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), names.strip_dots_stars(s).alias("base")) for s in ("subject", "object")])).alias("_s")).select("constraint_id", "_s.*")
    seen = results.select("constraint_id", names.strip_dots_stars("fqn").alias("fqn")).distinct()
    up = sides.select("constraint_id", "side", F.explode(names.ancestors("base")).alias("fqn")).join(seen, ["constraint_id", "fqn"], "left_semi").select("constraint_id", "side")
    down = sides.join(seen.select("constraint_id", F.explode(names.ancestors("fqn")).alias("base")).distinct(), ["constraint_id", "base"], "left_semi").select("constraint_id", "side")
    return up.unionByName(down).distinct()


def provenance_classes(rules: DataFrame, results: DataFrame, roots: DataFrame) -> DataFrame:
    """(constraint_id, subject_grounded, object_grounded, provenance_class): B/C if a result grounds a side, else A if the object is external, else other."""
    sides = covered(rules, results).groupBy("constraint_id").agg(*[F.max((F.col("side") == s)).alias(f"{s}_grounded") for s in ("subject", "object")])
    inner = roots.select("repo_id", F.col("root").alias("_root"), F.lit(True).alias("_in"))
    joined = rules.withColumn("_root", F.substring_index(names.strip_dots_stars("object"), ".", 1)).join(inner, ["repo_id", "_root"], "left").join(sides, "constraint_id", "left").fillna(False, ["subject_grounded", "object_grounded"])
    kind = F.when(F.col("subject_grounded") | F.col("object_grounded"), "B/C").when(F.col("_in").isNull(), "A").otherwise("other")
    return joined.select("constraint_id", "subject_grounded", "object_grounded", kind.alias("provenance_class"))


def bound_field(kwarg: Column | str) -> Column:
    """The column that a ``relation__field__lookup`` argument binds: its last part that is no lookup, the first part at least."""
    lookup = "^(?i:" + "|".join(LOOKUPS) + ")$"
    parts = F.split(names.col(kwarg), "__")
    flags = F.transform(F.reverse(parts), lambda p: p.rlike(lookup))
    first = F.array_position(flags, False)
    return F.when(first == 0, F.get(parts, F.lit(0))).otherwise(F.element_at(F.reverse(parts), first.cast("int")))


#: Suffixes that name an operator and never a column.
LOOKUPS = (
    "exact", "iexact", "contains", "icontains", "in", "gt", "gte", "lt", "lte", "startswith", "istartswith", "endswith", "iendswith", "range", "date", "year", "iso_year", "month", "day",
    "week", "week_day", "iso_week_day", "quarter", "time", "hour", "minute", "second", "isnull", "regex", "iregex", "search", "similar", "trigram_similar",
)


def parsed_rules(lines: DataFrame) -> DataFrame:
    """``lines`` (with ``payload``) and subject, predicate, object, scope, ``dropped`` and ``audited`` of each rule a model wrote.

    ``dropped`` is the reason why a line is no rule: not_an_object, missing_subject_or_object,
    unknown_predicate or self_loop, in this order, or none_scope for the verdict that the rule governs
    nothing; that one is ``audited``, as a wrong verdict would lose the rule unseen. Any other missing or unknown
    scope is ``runtime``.
    """
    known = ["prohibits_dependency", "prohibits_implementation", "requires_dependency", "requires_implementation", "requires_object_scope"]
    at = {k: F.get_json_object("payload", f"$.{k}") for k in ("subject", "predicate", "object", "scope")}
    whole = F.expr("try_parse_json(payload)")
    empty = lambda k: F.coalesce(F.length(at[k]), F.lit(0)) == 0
    dropped = (
        F.when(whole.isNull() | ~F.ltrim("payload").startswith("{"), "not_an_object")
        .when(empty("subject") | empty("object"), "missing_subject_or_object")
        .when(~F.coalesce(at["predicate"], F.lit("")).isin(*known), "unknown_predicate")
        .when(at["scope"] == "none", "none_scope")
        .when(at["subject"] == at["object"], "self_loop")
    )
    scope = F.when(at["scope"] == "tooling", "tooling").otherwise("runtime")
    return lines.select("*", *[at[k].alias(k) for k in ("subject", "predicate", "object")], scope.alias("scope"), dropped.alias("dropped"), F.coalesce(dropped == "none_scope", F.lit(False)).alias("audited"))


def package_name(spec: Column | str) -> Column:
    """Package of a dependency line: its leading name in lower case, ``-`` and ``.`` as ``_``; null without one."""
    name = F.regexp_extract(F.trim(names.col(spec)), r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)", 1)
    return F.when(F.length(name) > 0, F.translate(F.lower(name), "-.", "__"))
