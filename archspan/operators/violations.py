"""Rule evaluation, conflict resolution, identity and suppression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archspan.functions import names
from archspan.operators import model, reach, search
from archspan.runtime import Scratch

RULE = ["constraint_id", "repo_id", "adr", "subject", "predicate", "object", "specificity"]
COLUMNS = [*RULE, "changed_fqn", "matched_fqn", "status", "evidence", "change_type", "hops", "phase", "ord1", "ord2", "ord3"]
#: The wording of evidence.
LABELS = {"prohibits_dependency": "has dependency path to", "prohibits_implementation": "implements", "requires_dependency": "has no dependency on any module matching", "requires_implementation": "does not implement any module matching"}


def _label(predicate: str) -> Column:
    out = F.lit(None).cast("string")
    for p, text in LABELS.items():
        out = F.when(F.col(predicate) == p, F.lit(text)).otherwise(out)
    return out


def _higher(a: Column, b: Column) -> Column:
    """The stronger of two statuses; EXACT outranks WILDCARD."""
    return F.when((a == "EXACT") | (b == "EXACT"), "EXACT").otherwise("WILDCARD")


@dataclass
class Graph:
    """The inputs of a check, written or cached by the caller."""

    nodes: DataFrame
    edges: DataFrame
    rules: DataFrame
    changed: DataFrame

    def __post_init__(self) -> None:
        self.dev = model.dev_tools(self.nodes)
        self.modules = model.enclosing_modules(self.nodes)


def groups(g: Graph, matches: DataFrame) -> DataFrame:
    """(constraint_id, g, repo_id, family): matched dependency and implementation rules; rules of a repository and family with one object pattern share a group, named by its least rule."""
    dependency = g.rules.join(matches.select("constraint_id").distinct(), "constraint_id", "left_semi").withColumn("family", reach.family_of("predicate")).where("family <> ''")
    least = dependency.groupBy("repo_id", "family", "object").agg(F.min("constraint_id").alias("g"))
    return dependency.join(least, ["repo_id", "family", "object"]).select("constraint_id", "g", "repo_id", "family")


def group_objects(g: Graph, matches: DataFrame, grouped: DataFrame) -> DataFrame:
    """(g, repo_id, family, object_fqn, object_status, is_dev): the nodes that the object pattern of a group matches."""
    objs = matches.where(F.col("side") == "object").select(F.col("constraint_id").alias("g"), "repo_id", F.col("fqn").alias("object_fqn"), F.col("status").alias("object_status"))
    tools = g.dev.select("repo_id", F.col("fqn").alias("object_fqn"), F.lit(True).alias("is_dev"))
    return objs.join(grouped.select("g", "family").distinct(), "g").join(tools, ["repo_id", "object_fqn"], "left").fillna(False, ["is_dev"])


def prohibited(g: Graph, matches: DataFrame, subjects: DataFrame, objs: DataFrame, paths: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Violations of prohibits rules: the first unexcused path per subject and object.

    ``subjects`` holds (constraint_id, g, repo_id, family, start, subject_status) and
    ``paths`` (g, start, target, len, path), and ``edges`` at least those of the paths. Paths meet the objects above their target
    first and then the rules of their start, so no subject meets an object it has no path to.
    """
    reached = paths.select("g", "start", "target", "len", "path", F.explode(names.ancestors("target")).alias("object_fqn"))
    met = reached.join(objs.where(~F.col("is_dev")).select("g", "object_fqn", "object_status"), ["g", "object_fqn"]).join(subjects, ["g", "start"])
    hits = scratch.cut(met.join(g.rules.select(*[c for c in RULE if c != "repo_id"]), "constraint_id"))
    hits = hits.join(_excused(hits, g, matches, edges, scratch), ["constraint_id", "start", "object_fqn", "target"], "left_anti")
    rest = ["target", "len", "path", "g", "repo_id", "family", "subject_status", "object_status", *[c for c in RULE if c not in ("constraint_id", "repo_id")]]
    chosen = hits.groupBy("constraint_id", "start", "object_fqn").agg(F.min_by(F.struct(*rest), F.struct("len", "path", "target")).alias("_h")).select("constraint_id", "start", "object_fqn", "_h.*")
    walked = _with_hops(scratch.cut(chosen), edges).join(g.modules.select("repo_id", F.col("fqn").alias("start"), "module"), ["repo_id", "start"], "left")
    report = F.coalesce("module", "start")
    decisive = F.filter("hops", lambda h: h["kind"] != "CONTAINS")
    owner = F.when(F.get("hops", F.lit(0))["kind"] == "CONTAINS", F.coalesce(F.get(decisive, F.lit(0))["source"], report)).otherwise(report)
    route = F.array_join(F.transform("hops", lambda h: F.concat(h["kind"], F.lit(" "), h["target"])), " -> ")
    out = walked.withColumn("matched_fqn", owner)
    return out.select(
        *RULE,
        F.col("start").alias("changed_fqn"),
        "matched_fqn",
        _higher(F.col("subject_status"), F.col("object_status")).alias("status"),
        F.concat_ws(" ", "matched_fqn", _label("predicate"), "object_fqn", F.lit("via"), route).alias("evidence"),
        F.lit("structural").alias("change_type"),
        F.transform("hops", lambda h: h["target"]).alias("hops"),
        F.lit(0).alias("phase"),
        F.format_string("%020d", "constraint_id").alias("ord1"),
        F.col("start").alias("ord2"),
        F.col("object_fqn").alias("ord3"),
    )


def _with_hops(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``hops``: the edges (source, kind, target) of each path, in order."""
    steps = hits.select("constraint_id", "repo_id", "start", "object_fqn", F.posexplode(F.transform("path", lambda o: F.when(o < 0, o + reach.SEED).otherwise(o))).alias("at", "ord"))
    named = steps.join(edges.select("repo_id", "ord", "source", "kind", F.col("target").alias("hop_target")), ["repo_id", "ord"])
    hops = named.groupBy("constraint_id", "start", "object_fqn").agg(F.sort_array(F.collect_list(F.struct("at", "source", "kind", F.col("hop_target").alias("target")))).alias("hops"))
    return hits.join(hops, ["constraint_id", "start", "object_fqn"])


def _excused(hits: DataFrame, g: Graph, matches: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Paths of two or more edges whose every later source is itself required to depend on the object."""
    active = g.rules.join(matches.select("constraint_id").distinct(), "constraint_id", "left_semi")
    needs = active.where(F.col("predicate").isin("requires_dependency", "requires_implementation")).select("repo_id", reach.family_of("predicate").alias("family"), F.col("subject").alias("src_pattern"), F.col("object").alias("obj_pattern")).distinct()
    long = hits.where("len > 1")
    objects = long.select("repo_id", "family", "object_fqn").distinct().select("*", F.explode(names.matching_patterns("object_fqn")).alias("obj_pattern"))
    allowed = scratch.cut(objects.join(needs, ["repo_id", "family", "obj_pattern"]).select("repo_id", "family", "object_fqn", "src_pattern").distinct())
    relevant = long.join(allowed, ["repo_id", "family", "object_fqn"], "left_semi")
    steps = relevant.select("constraint_id", "repo_id", "family", "start", "object_fqn", "target", "len", F.posexplode(F.slice("path", F.lit(2), F.size("path"))).alias("at", "ord"))
    via = steps.join(edges.select("repo_id", "ord", "source"), ["repo_id", "ord"])
    asked = via.select("repo_id", "family", "object_fqn", "source").distinct()
    keyed = asked.select("*", F.explode(names.matching_patterns("source")).alias("src_pattern"))
    covered = keyed.join(allowed, ["repo_id", "family", "object_fqn", "src_pattern"], "left_semi").select("repo_id", "family", "object_fqn", "source").distinct()
    ok = via.join(covered, ["repo_id", "family", "object_fqn", "source"], "left_semi").groupBy("constraint_id", "start", "object_fqn", "target", "len").agg(F.count(F.lit(1)).alias("_c"))
    return ok.where(F.col("_c") == F.col("len") - 1).select("constraint_id", "start", "object_fqn", "target")


def _requires_subjects(g: Graph, matches: DataFrame) -> DataFrame:
    """(rule, changed_fqn, change_type, start, subject_status): the scopes a requires rule is checked from."""
    needs = g.rules.join(matches.select("constraint_id").distinct(), "constraint_id", "left_semi").where(F.col("predicate").isin("requires_dependency", "requires_implementation"))
    changed = g.changed.select("repo_id", F.col("fqn").alias("changed_fqn"), "change_type")
    keyed = changed.select("*", F.explode(names.ancestors("changed_fqn")).alias("top"))
    wild = needs.where(names.is_wildcard("subject")).withColumn("top", names.base("subject")).join(keyed, ["repo_id", "top"]).select(*RULE, "changed_fqn", "change_type", F.col("changed_fqn").alias("start"), F.lit("WILDCARD").alias("subject_status"))
    exact = needs.where(~names.is_wildcard("subject")).withColumn("top", F.col("subject")).join(keyed, ["repo_id", "top"]).select(*RULE, "changed_fqn", "change_type", F.col("subject").alias("start"), F.lit("EXACT").alias("subject_status"))
    return wild.unionByName(exact)


def required(asked: DataFrame, objs: DataFrame, arrived: DataFrame) -> DataFrame:
    """Violations of requires rules: changed names from which no object of the rule can be reached.

    ``asked`` holds the scopes (`_requires_subjects`) with their group, ``arrived`` the
    (g, start) that reach one of the group's objects; no path is needed. Rules whose
    objects are development tools alone are not judged.
    """
    best = objs.groupBy("g").agg(F.max((F.col("object_status") == "EXACT").cast("int")).alias("_exact"), F.min(F.col("is_dev").cast("int")).alias("_tools")).where("_tools = 0")
    open_ = asked.join(arrived, ["g", "start"], "left_anti").join(best, "g")
    status = F.when((F.col("_exact") == 1) | (F.col("subject_status") == "EXACT"), "EXACT").otherwise("WILDCARD")
    return open_.select(
        *RULE,
        "changed_fqn",
        F.col("start").alias("matched_fqn"),
        status.alias("status"),
        F.concat_ws(" ", "start", _label("predicate"), "object").alias("evidence"),
        "change_type",
        F.lit(None).cast("array<string>").alias("hops"),
        F.lit(1).alias("phase"),
        F.col("changed_fqn").alias("ord1"),
        F.format_string("%020d", "constraint_id").alias("ord2"),
        F.col("start").alias("ord3"),
    )


def unscoped(g: Graph, matches: DataFrame) -> DataFrame:
    """Violations of requires_object_scope: handlers with an object parameter that no scoping guard covers (a guard without ``covers`` covers all)."""
    rules_ = g.rules.where(F.col("predicate") == "requires_object_scope").select(*RULE)
    subs = matches.where(F.col("side") == "subject").select("constraint_id", "repo_id", "fqn", "status").join(rules_, ["constraint_id", "repo_id"])
    handlers = g.nodes.where(F.size("object_parameters") > 0).select("repo_id", "fqn", "object_parameters", "guards")
    scoping = F.filter(F.coalesce("guards", F.array()), lambda x: F.coalesce(x["scopes_object"], F.lit(False)))
    safe = F.forall("object_parameters", lambda p: F.exists(scoping, lambda x: (F.coalesce(F.size(x["covers"]), F.lit(0)) <= 0) | F.coalesce(F.array_contains(x["covers"], p), F.lit(False))))
    bad = subs.join(handlers.where(~safe), ["repo_id", "fqn"])
    evidence = F.concat(F.col("fqn"), F.lit(" loads "), F.array_join("object_parameters", ", "), F.lit(" without an object-scope guard for "), F.col("object"), F.lit(": "), F.col("predicate"))
    return bad.select(*RULE, F.col("fqn").alias("changed_fqn"), F.col("fqn").alias("matched_fqn"), "status", evidence.alias("evidence"), F.lit("structural").alias("change_type"), F.lit(None).cast("array<string>").alias("hops"), F.lit(2).alias("phase"), F.format_string("%020d", "constraint_id").alias("ord1"), F.col("fqn").alias("ord2"), F.lit("").alias("ord3"))


def deduplicated(raw: DataFrame) -> DataFrame:
    """The first row per rule and matched name, in checking order."""
    order = W.partitionBy("constraint_id", "matched_fqn").orderBy("phase", "ord1", "ord2", "ord3")
    return raw.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def without_covered_children(rows: DataFrame) -> DataFrame:
    """Drops a finding whose matched name lies under another's of the same rule."""
    tops = rows.select("constraint_id", F.col("matched_fqn").alias("top")).distinct()
    below = rows.select("constraint_id", "matched_fqn", F.explode(names.ancestors("matched_fqn", proper=True)).alias("top")).join(tops, ["constraint_id", "top"], "left_semi").select("constraint_id", "matched_fqn").distinct()
    return rows.join(below, ["constraint_id", "matched_fqn"], "left_anti")


def outweighed(rows: DataFrame, active: DataFrame) -> DataFrame:
    """Drops findings that a stronger opposite rule on the same object overrules.

    A prohibits finding falls to a matched presence-requires rule of higher
    specificity whose subject covers it; a presence-requires finding to a matched
    prohibits rule of higher specificity, or of the same and a later ADR. Pairwise
    conflicts between two findings are a part of this, as every finding's rule is matched.
    """
    presence = F.col("predicate").isin("requires_dependency", "requires_implementation")
    stance = F.when(F.col("predicate").startswith("prohibits_"), "prohibits").when(presence, "requires")
    side = active.withColumn("stance", stance).where(F.col("stance").isNotNull()).select("repo_id", "object", F.col("subject").alias("pattern"), F.col("stance").alias("r_stance"), F.col("specificity").alias("r_spec"), F.col("adr").alias("r_adr"))
    keyed = rows.withColumn("stance", stance).where(F.col("stance").isNotNull()).select("repo_id", "object", "constraint_id", "matched_fqn", "stance", "specificity", "adr", F.explode(names.covering_patterns("matched_fqn")).alias("pattern"))
    met = keyed.join(side, ["repo_id", "object", "pattern"]).where(F.col("stance") != F.col("r_stance"))
    lost = met.where((F.col("r_spec") > F.col("specificity")) | ((F.col("stance") == "requires") & (F.col("r_spec") == F.col("specificity")) & (F.col("r_adr") > F.col("adr")))).select("constraint_id", "matched_fqn").distinct()
    return rows.join(lost, ["constraint_id", "matched_fqn"], "left_anti")


def code_fingerprint(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds location, ``fingerprint`` (SHA-256 over the code hashes the finding rests on) and the identity.

    The fingerprint is null where the changed or matched name has no code; such a
    finding can't be dismissed.
    """
    code = nodes.select("repo_id", "fqn", "file_path", "line_start", "line_end", F.when(F.length("code_hash") > 0, F.col("code_hash")).alias("code_hash"))

    def node(prefix: str) -> DataFrame:
        return code.select("repo_id", F.col("fqn").alias(f"{prefix}_fqn"), *[F.col(c).alias(f"{prefix}_{c}") for c in ("file_path", "line_start", "line_end", "code_hash")])

    hops = rows.where(F.size("hops") > 0).select("constraint_id", "changed_fqn", "matched_fqn", "ord3", "repo_id", F.posexplode("hops").alias("at", "fqn")).join(code.where(F.col("code_hash").isNotNull()).select("repo_id", "fqn", "code_hash"), ["repo_id", "fqn"]).groupBy("constraint_id", "changed_fqn", "matched_fqn", "ord3").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "code_hash"))), lambda s: s["code_hash"]).alias("hop_hashes"))
    placed = rows.join(node("changed"), ["repo_id", "changed_fqn"], "left").join(node("matched"), ["repo_id", "matched_fqn"], "left").join(hops, ["constraint_id", "changed_fqn", "matched_fqn", "ord3"], "left")
    anchored = F.col("changed_code_hash").isNotNull() & F.col("matched_code_hash").isNotNull()
    digest = F.sha2(F.array_join(F.concat(F.array("changed_code_hash", "matched_code_hash"), F.coalesce("hop_hashes", F.array().cast("array<string>"))), "|"), 256)
    structural = (F.col("change_type") == "structural") & F.col("matched_file_path").isNotNull()
    located = placed.withColumn("fingerprint", F.when(anchored, digest))
    for c in ("file_path", "line_start", "line_end"):
        located = located.withColumn(c, F.when(structural, F.col(f"matched_{c}")).otherwise(F.col(f"changed_{c}")))
    located = located.withColumn("identity", identity_hash("subject", "predicate", "object", "adr", F.coalesce("fingerprint", F.lit("none"))))
    return located.withColumn("short_id", F.substring("identity", 1, 5)).drop(*[f"{p}_{c}" for p in ("changed", "matched") for c in ("file_path", "line_start", "line_end", "code_hash")], "hop_hashes")


def identity_hash(*parts: Column | str) -> Column:
    """SHA-256 of the identity fields joined by ``|``; nulls count as empty."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(names.col(p), F.lit("")) for p in parts]), "|"), 256)


def governed(rows: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds the governed module (changed name for prohibits, else matched name), its file and its fan-in."""
    fqn = F.when(F.col("predicate").startswith("prohibits_"), F.col("changed_fqn")).otherwise(F.col("matched_fqn"))
    fan = model.importer_counts(edges).withColumnRenamed("fqn", "governed_fqn")
    files = nodes.select("repo_id", F.col("fqn").alias("governed_fqn"), F.col("file_path").alias("governed_file_path"))
    return rows.withColumn("governed_fqn", fqn).join(fan, ["repo_id", "governed_fqn"], "left").join(files, ["repo_id", "governed_fqn"], "left").fillna(0, ["fan_in"])


def dismissals(violations: DataFrame) -> DataFrame:
    """One dismissal per finding with a fingerprint; findings without one are refused (left out)."""
    return violations.where(F.col("fingerprint").isNotNull()).select("repo_id", "short_id", F.col("identity").alias("identity_hash"), "subject", "predicate", "object", F.col("adr").alias("adr_id"), F.col("fingerprint").alias("code_fingerprint"), "matched_fqn", "governed_fqn")


def merged_dismissals(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored dismissals with the new ones merged in by repository and identity: a new one replaces the stored one."""
    fresh = new.dropDuplicates(["repo_id", "identity_hash"])
    return stored.join(fresh.select("repo_id", "identity_hash"), ["repo_id", "identity_hash"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def not_dismissed(violations: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Findings whose identity no fingerprinted dismissal of the repository bears."""
    known = dismissed.where(F.col("code_fingerprint").isNotNull()).select("repo_id", F.col("identity_hash").alias("identity")).distinct()
    return violations.join(known, ["repo_id", "identity"], "left_anti")


def orphan_rules(rules_: DataFrame, matches: DataFrame) -> DataFrame:
    """Rules to enforce (self-loops included) that no pair of nodes matches."""
    return rules_.where(F.col("scope") != "tooling").join(matches.select("constraint_id").distinct(), "constraint_id", "left_anti")


def check(g: Graph, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings before resolution, findings after it, rule matches).

    Each step of the resolution is written, as the next reads it several times.
    """
    raw, matches = unresolved(g, scratch)
    active = model.enforced(g.rules).join(matches.select("constraint_id").distinct(), "constraint_id", "left_semi")
    rows = scratch.cut(without_covered_children(scratch.cut(deduplicated(raw))))
    return raw, scratch.cut(outweighed(rows, active)), matches


def unresolved(g: Graph, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(findings before resolution, rule matches).

    Per group of rules a reverse search from the objects tells what reaches them, which
    settles the requires rules; the forward search for the paths of prohibits rules
    then stays on the nodes of the reverse search (`search.found_and_edges`).
    """
    live = model.enforced(g.rules)
    g = Graph(g.nodes, g.edges, live, g.changed)
    g.dev, matches = scratch.cut_all(g.dev, reach.rule_matches(live, g.nodes, scratch))
    grouped = scratch.cut(groups(g, matches))
    of_group = grouped.select("constraint_id", "g", "family")
    barred = live.where(F.col("predicate").startswith("prohibits_")).select("constraint_id")
    subjects = matches.where(F.col("side") == "subject").select("constraint_id", "repo_id", F.col("fqn").alias("start"), F.col("status").alias("subject_status")).join(barred, "constraint_id", "left_semi").join(of_group, "constraint_id")
    objs, asked, subjects = scratch.cut_all(group_objects(g, matches, grouped), _requires_subjects(g, matches).join(of_group, "constraint_id"), subjects)
    starts = asked.select("g", "repo_id", "family", "start", F.lit(False).alias("walk")).unionByName(subjects.select("g", "repo_id", "family", "start", F.lit(True).alias("walk")))
    g.modules = scratch.cut(model.enclosing_modules(g.nodes, starts.select("repo_id", F.col("start").alias("fqn"))))
    found = scratch.cut(search.found_and_edges(objs, starts, g.edges, g.dev, g.modules))
    arrived, paths = found.where("g IS NOT NULL AND target IS NULL").select("g", "start"), found.where("target IS NOT NULL").drop("edge")
    used = scratch.cut(found.where("edge IS NOT NULL").select("edge.*").distinct())
    raw = scratch.cut(prohibited(g, matches, subjects, objs, paths, used, scratch).unionByName(required(asked, objs, arrived)).unionByName(unscoped(g, matches)))
    return raw, matches
