"""Queries of the graph model and the rule check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspan.functions import names
from archspan.operators import model, reach, violations
from archspan.plans import graph_sql
from archspan.runtime import Scratch, load


#: What a check reads of a node.
NODE = ("node_id", "repo_id", "fqn", "kind", "file_path", "line_start", "line_end", "role", "code_hash", "object_parameters", "guards", "loaded_at", "deleted_at")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.current_nodes(load(spark, sf_dir, "fqn_nodes"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.typed_edges(load(spark, sf_dir, "dep_edges"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.rules(load(spark, sf_dir, "constraint_edges"))


def graph(spark: SparkSession, sf_dir: str, scratch: Scratch, days: int | None = 60) -> violations.Graph:
    """The written inputs of a check; requires rules are judged at the names loaded in the last ``days``, or at all."""
    nodes, changed = model.nodes_and_changes(load(spark, sf_dir, "fqn_nodes").select(*NODE), scratch, days)
    edges, rules = scratch.cut_all(_edges(spark, sf_dir), _rules(spark, sf_dir))
    return violations.Graph(nodes, edges, rules, changed)


def g_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("repo_id", "fqn", "kind", "file_path", "role", "code_hash", "node_id")


def g_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def g_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select("constraint_id", "repo_id", "adr", "subject", "predicate", "object", "scope", "specificity")


def g_rule_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.rule_states(_rules(spark, sf_dir))


def g_rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach.rule_matches(model.enforced(_rules(spark, sf_dir)), _nodes(spark, sf_dir))


def g_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.enclosing_modules(_nodes(spark, sf_dir))


def g_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.importer_counts(_edges(spark, sf_dir))


def g_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.children(_edges(spark, sf_dir), _nodes(spark, sf_dir))


def g_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.changed_nodes(load(spark, sf_dir, "fqn_nodes"))


def g_dev_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.dev_tools(_nodes(spark, sf_dir))


def g_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the shortest typed path from every subject of a prohibits rule to every name it reaches."""
    scratch = Scratch(spark, "paths")
    g = graph(spark, sf_dir, scratch)
    live = model.enforced(g.rules)
    matches = reach.rule_matches(live, g.nodes)
    starts = matches.where("side = 'subject'").join(live.where(F.col("predicate").startswith("prohibits_")).select("constraint_id", reach.family_of("predicate").alias("family")), "constraint_id").select("repo_id", "family", F.col("fqn").alias("start"))
    return reach.first_paths(starts, reach.steps(g.edges, g.dev), ["repo_id", "family"], g.modules, scratch).select("repo_id", "family", "start", "target", "len")


def check_raw(spark: SparkSession, sf_dir: str, days: int | None = 60) -> DataFrame:
    scratch = Scratch(spark, "check")
    raw, _ = violations.unresolved(graph(spark, sf_dir, scratch, days), scratch)
    return raw.select("constraint_id", "changed_fqn", "matched_fqn", "status", "evidence", "change_type")


def check_found(spark: SparkSession, sf_dir: str, days: int | None = 60) -> DataFrame:
    scratch = Scratch(spark, "check")
    _, kept, _ = violations.check(graph(spark, sf_dir, scratch, days), scratch)
    return kept.select("constraint_id", "repo_id", "adr", "predicate", "changed_fqn", "matched_fqn", "status", "evidence", "change_type")


def checked(spark: SparkSession, sf_dir: str, scratch: Scratch, days: int | None = 60) -> tuple[violations.Graph, DataFrame, DataFrame]:
    """(inputs, findings with their provenance, rule matches) of a check."""
    g = graph(spark, sf_dir, scratch, days)
    _, kept, matches = violations.check(g, scratch)
    return g, violations.governed(violations.code_fingerprint(kept, g.nodes), g.edges, g.nodes), matches


def check_provenance(spark: SparkSession, sf_dir: str, days: int | None = 60) -> DataFrame:
    """Findings with location, fingerprint, identity, governed file and fan-in."""
    full = checked(spark, sf_dir, Scratch(spark, "check"), days)[1]
    return full.select("constraint_id", "matched_fqn", "file_path", "line_start", "line_end", "fingerprint", "identity", "short_id", "governed_fqn", "governed_file_path", "fan_in")


def check_all_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check with requires rules judged at every current node, whenever it was loaded."""
    return check_raw(spark, sf_dir, None)


def check_all_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_found(spark, sf_dir, None)


def check_all_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_provenance(spark, sf_dir, None)


def check_orphan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _rules(spark, sf_dir)
    matches = reach.rule_matches(model.enforced(rules), _nodes(spark, sf_dir))
    return violations.orphan_rules(rules, matches).select("constraint_id", "repo_id", "subject", "object")


def check_object_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers with object parameters that the subjects of requires_object_scope rules match, and whether each is scoped."""
    live = model.enforced(_rules(spark, sf_dir))
    nodes = _nodes(spark, sf_dir)
    g = violations.Graph(nodes, _edges(spark, sf_dir), live, model.changed_nodes(load(spark, sf_dir, "fqn_nodes")))
    return violations.unscoped(g, reach.rule_matches(live, nodes)).select("constraint_id", "changed_fqn", "status", "evidence")


def fn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name functions over every node."""
    return load(spark, sf_dir, "fqn_nodes").select(
        "node_id",
        names.path_to_fqn("file_path").alias("path_fqn"),
        names.safe_fqn("fqn").alias("safe"),
        names.parent("fqn").alias("parent"),
        names.last_part("fqn").alias("name"),
        names.depth("fqn").alias("depth"),
        F.array_join(names.suffixes("fqn"), "|").alias("suffixes"),
    )


def fn_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern functions over every rule: base, character-set strip, specificity, and how subject and object relate."""
    c = load(spark, sf_dir, "constraint_edges")
    return c.select(
        "constraint_id",
        names.base(F.trim("subject")).alias("base"),
        names.strip_dots_stars(F.trim("object")).alias("stripped"),
        names.specificity(F.trim("subject")).alias("specificity"),
        names.match_status(F.trim("object"), F.trim("subject")).alias("object_in_subject"),
        names.subject_covers(F.trim("subject"), F.trim("object")).alias("covers"),
        names.at_or_under(F.trim("object"), names.base(F.trim("subject"))).alias("under"),
    )


def name_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes at or under every dotted prefix."""
    return _nodes(spark, sf_dir).select("repo_id", F.explode(names.ancestors("fqn")).alias("prefix")).groupBy("repo_id", "prefix").agg(F.count(F.lit(1)).alias("n_nodes"))


def rule_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity hash and short id of every rule without code."""
    h = violations.identity_hash("subject", "predicate", "object", "adr", F.lit("none"))
    return _rules(spark, sf_dir).select("constraint_id", h.alias("identity"), F.substring(h, 1, 5).alias("short_id"))


QUERIES = {f.__name__: f for f in (g_nodes, g_edges, g_rules, g_rule_states, g_rule_matches, g_modules, g_fan_in, g_children, g_changed, g_dev_tools, g_paths, check_raw, check_found, check_provenance, check_all_raw, check_all_found, check_all_provenance, check_orphan_rules, check_object_scope, fn_names, fn_patterns, name_ancestors, rule_identity)}

_TOOLS = ", ".join(f"'{t}'" for t in model.DEV_TOOLS)
_B = graph_sql.BASE.replace("{tools}", _TOOLS)
_FINAL = _B + graph_sql.FINAL
_IDENTIFIED = r""",
code AS (SELECT repo_id, fqn, file_path, line_start, line_end, nullif(code_hash, '') AS code_hash FROM n),
hh AS (SELECT k.constraint_id, k.matched_fqn, list(c.code_hash ORDER BY u.i) AS hashes FROM kept k, unnest(range(1, len(k.hops) + 1)) AS u(i) JOIN code c ON c.repo_id = k.repo_id AND c.fqn = k.hops[u.i] AND c.code_hash IS NOT NULL GROUP BY 1, 2),
fp AS (SELECT k.*, CASE WHEN k.change_type = 'structural' AND b.file_path IS NOT NULL THEN b.file_path ELSE a.file_path END AS file_path,
    CASE WHEN k.change_type = 'structural' AND b.file_path IS NOT NULL THEN b.line_start ELSE a.line_start END AS line_start,
    CASE WHEN k.change_type = 'structural' AND b.file_path IS NOT NULL THEN b.line_end ELSE a.line_end END AS line_end,
    CASE WHEN a.code_hash IS NOT NULL AND b.code_hash IS NOT NULL THEN sha256(array_to_string([a.code_hash, b.code_hash] || coalesce(hh.hashes, []), '|')) END AS fingerprint,
    CASE WHEN k.predicate LIKE 'prohibits_%' THEN k.changed_fqn ELSE k.matched_fqn END AS governed_fqn
  FROM kept k LEFT JOIN code a ON a.repo_id = k.repo_id AND a.fqn = k.changed_fqn LEFT JOIN code b ON b.repo_id = k.repo_id AND b.fqn = k.matched_fqn LEFT JOIN hh ON hh.constraint_id = k.constraint_id AND hh.matched_fqn = k.matched_fqn),
fan AS (SELECT repo_id, array_to_string(p[1:i], '.') AS fqn, count(DISTINCT source) AS fan_in FROM (SELECT *, string_split(target, '.') AS p FROM e WHERE kind = 'IMPORTS'), unnest(range(1, len(p) + 1)) AS u(i) GROUP BY 1, 2),
idn AS (SELECT *, sha256(concat_ws('|', subject, predicate, object, adr, coalesce(fingerprint, 'none'))) AS identity FROM fp)"""
_PROVENANCE = _IDENTIFIED + """
SELECT i.constraint_id, i.matched_fqn, i.file_path, i.line_start, i.line_end, i.fingerprint, i.identity, substr(i.identity, 1, 5) AS short_id, i.governed_fqn, c.file_path AS governed_file_path, coalesce(fan.fan_in, 0) AS fan_in
FROM idn i LEFT JOIN code c ON c.repo_id = i.repo_id AND c.fqn = i.governed_fqn LEFT JOIN fan ON fan.repo_id = i.repo_id AND fan.fqn = i.governed_fqn"""


def _every_node(sql: str) -> str:
    """The same SQL without the window of the changed names."""
    return sql.replace(" WHERE n.loaded_at >= l.e - INTERVAL 60 DAYS)", ")", 1)


SQL = {
    "g_nodes": _B + " SELECT repo_id, fqn, kind, file_path, role, code_hash, node_id FROM n",
    "g_edges": _B + " SELECT repo_id, source, target, kind, ord FROM e",
    "g_rules": _B + " SELECT constraint_id, repo_id, adr, subject, predicate, object, scope, CAST(specificity AS DOUBLE) AS specificity FROM r",
    "g_rule_states": _B + " SELECT constraint_id, CASE WHEN scope = 'tooling' THEN 'tooling' WHEN subject = object THEN 'self_loop' ELSE 'enforced' END AS state FROM r",
    "g_rule_matches": _B + " SELECT constraint_id, repo_id, side, fqn, status FROM m",
    "g_modules": _B + " SELECT repo_id, fqn, module FROM mods",
    "g_fan_in": _B + " SELECT repo_id, array_to_string(p[1:i], '.') AS fqn, count(DISTINCT source) AS fan_in FROM (SELECT *, string_split(target, '.') AS p FROM e WHERE kind = 'IMPORTS'), unnest(range(1, len(p) + 1)) AS u(i) GROUP BY 1, 2",
    "g_children": _B + """ SELECT repo_id, fqn, child, kind, CAST(row_number() OVER (PARTITION BY repo_id, fqn ORDER BY ord) AS INT) AS child_no, count(*) OVER (PARTITION BY repo_id, fqn) > 150 AS truncated
FROM (SELECT e.repo_id, e.source AS fqn, e.target AS child, n.kind, min(e.ord) AS ord FROM e JOIN n ON n.repo_id = e.repo_id AND n.fqn = e.target WHERE e.kind = 'CONTAINS' GROUP BY 1, 2, 3, 4)
QUALIFY row_number() OVER (PARTITION BY repo_id, fqn ORDER BY ord) <= 150""",
    "g_changed": _B + " SELECT repo_id, fqn, change_type FROM changed",
    "g_dev_tools": _B + " SELECT repo_id, fqn FROM dev",
    "g_paths": _B + graph_sql.CHECK.rstrip().rstrip(",") + """ SELECT p.repo_id, p.family, p.start, p.target, CAST(p.p.l AS INT) AS len FROM paths p
SEMI JOIN (SELECT DISTINCT m.repo_id, regexp_extract(a.predicate, '_(dependency|implementation)$', 1) AS family, m.fqn AS start FROM m JOIN active a USING (constraint_id) WHERE m.side = 'subject' AND a.predicate LIKE 'prohibits_%') s USING (repo_id, family, start)""",
    "check_raw": _B + graph_sql.RAW + " SELECT constraint_id, changed_fqn, matched_fqn, status, evidence, change_type FROM raw",
    "check_found": _FINAL + " SELECT constraint_id, repo_id, adr, predicate, changed_fqn, matched_fqn, status, evidence, change_type FROM kept",
    "check_provenance": _FINAL + _PROVENANCE,
    "check_all_raw": _every_node(_B + graph_sql.RAW + " SELECT constraint_id, changed_fqn, matched_fqn, status, evidence, change_type FROM raw"),
    "check_all_found": _every_node(_FINAL + " SELECT constraint_id, repo_id, adr, predicate, changed_fqn, matched_fqn, status, evidence, change_type FROM kept"),
    "check_all_provenance": _every_node(_FINAL + _PROVENANCE),
    "check_orphan_rules": _B + " SELECT constraint_id, repo_id, subject, object FROM r WHERE scope <> 'tooling' AND constraint_id NOT IN (SELECT constraint_id FROM m)",
    "check_object_scope": _B + graph_sql.RAW + " SELECT constraint_id, changed_fqn, status, evidence FROM raw WHERE phase = 2",
    "fn_names": r"""SELECT node_id, regexp_replace(regexp_replace(regexp_replace(file_path, '\.py$', ''), '[/\\]', '.', 'g'), '\.__init__$', '') AS path_fqn,
CASE WHEN length(fqn) > 0 AND NOT regexp_matches(fqn, '^\.|\.$|\.\.') THEN fqn END AS safe, CASE WHEN contains(fqn, '.') THEN regexp_replace(fqn, '\.[^.]*$', '') END AS parent,
string_split(fqn, '.')[-1] AS name, CAST(len(string_split(fqn, '.')) AS INT) AS depth,
array_to_string(list_transform(range(1, len(string_split(fqn, '.')) + 1), lambda i: array_to_string(string_split(fqn, '.')[i:], '.')), '|') AS suffixes FROM fqn_nodes""",
    "fn_patterns": r"""SELECT constraint_id, regexp_replace(s, '\.\*$', '') AS base, regexp_replace(o, '[.*]+$', '') AS stripped,
len(string_split(regexp_replace(s, '\.\*$', ''), '.')) + CASE WHEN s LIKE '%.*' THEN 0.0 ELSE 1.0 END AS specificity,
CASE WHEN o = s THEN 'EXACT' WHEN s LIKE '%.*' AND starts_with(o, regexp_replace(s, '\*$', '')) THEN 'WILDCARD' END AS object_in_subject,
o = s OR (s LIKE '%.*' AND (starts_with(o, regexp_replace(s, '\*$', '')) OR o = regexp_replace(s, '\.\*$', ''))) AS covers,
o = regexp_replace(s, '\.\*$', '') OR starts_with(o, regexp_replace(s, '\.\*$', '') || '.') AS under
FROM (SELECT constraint_id, trim(subject) AS s, trim(object) AS o FROM constraint_edges)""",
    "name_ancestors": _B + " SELECT repo_id, top AS prefix, count(*) AS n_nodes FROM anc GROUP BY 1, 2",
    "rule_identity": _B + " SELECT constraint_id, sha256(concat_ws('|', subject, predicate, object, adr, 'none')) AS identity, substr(sha256(concat_ws('|', subject, predicate, object, adr, 'none')), 1, 5) AS short_id FROM r",
}
