"""Queries of the general data problems (1, 2, 3, 5, 6, 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspan.operators import copydiff, drift, hierarchy, orphans, shredding, snapshots
from archspan.runtime import Scratch, load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_references(load(spark, sf_dir, "constraint_edges"), load(spark, sf_dir, "fqn_nodes"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of rules and of dependency edges per table, field, month and reason."""
    edges = orphans.edge_orphans(load(spark, sf_dir, "dep_edges"), load(spark, sf_dir, "fqn_nodes"))
    return orphans.orphan_report({"constraint_edges": p1_found(spark, sf_dir), "dep_edges": edges})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copydiff.found(load(spark, sf_dir, "gold_adrs"), load(spark, sf_dir, "constraint_edges"), load(spark, sf_dir, "seed_checks"))


def p2_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copydiff.rule_differences(load(spark, sf_dir, "gold_adrs"), load(spark, sf_dir, "constraint_edges"))


def _tree(spark: SparkSession, sf_dir: str, paths: bool = False) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.contains_links(load(spark, sf_dir, "dep_edges")), Scratch(spark, "hierarchy"), paths)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("repo_id", "fqn", "root", "depth")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("repo_id", "fqn", "n_descendants", "on_cycle")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendant_pairs(Scratch(spark, "tree").cut(_tree(spark, sf_dir)))


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.full_paths(_tree(spark, sf_dir, paths=True))


def p3_dropped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.dropped_links(hierarchy.contains_links(load(spark, sf_dir, "dep_edges")))


def _drift(spark: SparkSession, sf_dir: str, distinct: bool = False) -> tuple[DataFrame, DataFrame, Scratch]:
    """Written records with their tagged cells, and the changes between files."""
    scratch = Scratch(spark, "drift")
    tagged = scratch.cut(drift.tagged_records(load(spark, sf_dir, "wire_records"), distinct))
    return tagged, drift.schema_changes(tagged, scratch), scratch


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir)[1].select("stream_id", "file_no", "field_name", "change_kind", "new_name")


def p5_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change with the types before and after it."""
    return _drift(spark, sf_dir)[1]


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent table, its typed branches as lines ``field=value``, of lists the length."""
    tagged, changes, scratch = _drift(spark, sf_dir, distinct=True)
    table = drift.union_table(tagged, changes, scratch)

    def lines(column: str, text) -> F.Column:
        return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), text(e["value"]))), "\n").alias(column)

    numbers = F.map_filter("canonical", lambda k, _: k.endswith("#number"))
    plain = table.withColumn("numbers", F.transform_keys(numbers, lambda k, _: F.regexp_replace(k, "#number$", "")))
    same = lambda v: v.cast("string")
    return plain.select(*drift.RECORD, lines("strings", same), lines("numbers", same), lines("booleans", same), lines("arrays", lambda v: F.size(v).cast("string")))


def p5_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the consistent table replaces, by family."""
    tagged, changes, scratch = _drift(spark, sf_dir)
    return drift.field_names(tagged, changes, scratch)


def p5_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.conflicts(drift.tagged_records(load(spark, sf_dir, "wire_records")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredding.innermost(load(spark, sf_dir, "eval_reports"))


def p6_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of the reports and how often it has a value."""
    return shredding.leaf_counts(load(spark, sf_dir, "eval_reports"))


def p6_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that stand in none of the flat tables."""
    return shredding.flat_tables(load(spark, sf_dir, "eval_reports"), Scratch(spark, "flat"))["other"]


def _flat(table: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shredding.flat_table(load(spark, sf_dir, "eval_reports"), table)

    return run


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changes(load(spark, sf_dir, "node_snapshots"), Scratch(spark, "snapshots"))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_found(spark, sf_dir).groupBy("line_id", "to_sha", "change_kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_cells, p3_found, p3_descendants, p3_pairs, p3_paths, p3_dropped_links, p5_found, p5_types, p5_table, p5_names, p5_conflicts, p6_found, p6_leaves, p6_other, p7_found, p7_totals)}
QUERIES |= {f"p6_{t}": _flat(t) for t in shredding.TABLES}

_ORPHANS = r"""
WITH r AS (
  SELECT constraint_id, repo_id, recorded_at, 'subject' AS field_name, 'P' AS kind, regexp_replace(trim(subject), '\.\*$', '') AS name FROM constraint_edges
  UNION ALL
  SELECT constraint_id, repo_id, recorded_at, 'object', 'P', regexp_replace(trim(object), '\.\*$', '') FROM constraint_edges WHERE coalesce(object_grounding.label, '') <> 'unique_suffix'
  UNION ALL
  SELECT constraint_id, repo_id, recorded_at, 'grounding', 'E', object_grounding.resolved_fqn FROM constraint_edges WHERE object_grounding.label IN ('exact', 'unique_suffix')),
k AS (
  SELECT repo_id, 'E' AS kind, fqn AS name, loaded_at, deleted_at FROM fqn_nodes
  UNION ALL
  SELECT repo_id, 'P', array_to_string(p[1:i], '.'), loaded_at, deleted_at FROM (SELECT *, string_split(fqn, '.') AS p FROM fqn_nodes), unnest(range(1, len(p) + 1)) AS u(i)),
j AS (
  SELECT r.*, bool_or(k.loaded_at <= recorded_at AND (deleted_at IS NULL OR deleted_at > recorded_at)) AS alive, bool_or(k.loaded_at > recorded_at) AS late, count(k.name) AS n
  FROM r LEFT JOIN k ON k.repo_id = r.repo_id AND k.name = r.name AND k.kind = r.kind WHERE r.name IS NOT NULL GROUP BY ALL),
found AS (
  SELECT DISTINCT constraint_id, field_name, strftime(recorded_at, '%Y-%m') AS ref_month, CASE WHEN late THEN 'late' WHEN n > 0 THEN 'deleted' ELSE 'missing' END AS reason
  FROM j WHERE NOT coalesce(alive, false))
"""
_DIFFS = r"""
WITH g AS (SELECT DISTINCT repo_id, CAST(regexp_extract(adr_id, '[0-9]+') AS BIGINT) AS adr_no, trim(c.subject) AS subject, c.predicate AS predicate, trim(c.object) AS object,
    trim(regexp_replace(c.justification, '\s+', ' ', 'g')) AS j, lower(coalesce(c.scope, 'runtime')) AS s, adr_path AS p FROM (SELECT *, unnest(constraints) AS c FROM gold_adrs)),
t AS (SELECT DISTINCT repo_id, CAST(regexp_extract(adr_id, '[0-9]+') AS BIGINT) AS adr_no, trim(subject) AS subject, predicate, trim(object) AS object,
    trim(regexp_replace(justification, '\s+', ' ', 'g')) AS j, lower(coalesce(scope, 'runtime')) AS s, adr_path AS p FROM constraint_edges),
b AS (SELECT coalesce(g.repo_id, t.repo_id) AS repo_id, coalesce(g.adr_no, t.adr_no) AS adr_no, coalesce(g.subject, t.subject) AS subject, coalesce(g.predicate, t.predicate) AS predicate,
    coalesce(g.object, t.object) AS object, g.repo_id IS NOT NULL AS in_gold, t.repo_id IS NOT NULL AS in_store, g.j AS gj, t.j AS tj, g.s AS gs, t.s AS ts, g.p AS gp, t.p AS tp
  FROM g FULL JOIN t ON g.repo_id = t.repo_id AND g.adr_no = t.adr_no AND g.subject = t.subject AND g.predicate = t.predicate AND g.object = t.object),
f AS (
  SELECT repo_id, adr_no, subject, predicate, object, 'missing_in_store' AS field_name, CAST(NULL AS VARCHAR) AS left_value, CAST(NULL AS VARCHAR) AS right_value FROM b WHERE NOT in_store
  UNION ALL SELECT repo_id, adr_no, subject, predicate, object, 'missing_in_gold', NULL, NULL FROM b WHERE NOT in_gold
  UNION ALL SELECT repo_id, adr_no, subject, predicate, object, 'justification', gj, tj FROM b WHERE in_gold AND in_store AND gj IS DISTINCT FROM tj
  UNION ALL SELECT repo_id, adr_no, subject, predicate, object, 'scope', gs, ts FROM b WHERE in_gold AND in_store AND gs IS DISTINCT FROM ts
  UNION ALL SELECT repo_id, adr_no, subject, predicate, object, 'adr_path', gp, tp FROM b WHERE in_gold AND in_store AND gp IS DISTINCT FROM tp)
"""
_WALK = """
WITH RECURSIVE c AS (SELECT repo_id, target AS fqn, min(source) AS parent FROM dep_edges WHERE lower(trim(kind)) = 'contains' GROUP BY 1, 2),
n AS (SELECT DISTINCT repo_id, unnest([source, target]) AS fqn FROM dep_edges WHERE lower(trim(kind)) = 'contains'),
w AS (
  SELECT repo_id, fqn, fqn AS root, 0 AS depth, fqn AS path FROM n ANTI JOIN c USING (repo_id, fqn)
  UNION ALL SELECT c.repo_id, c.fqn, w.root, w.depth + 1, w.path || ' > ' || c.fqn FROM w JOIN c ON c.repo_id = w.repo_id AND c.parent = w.fqn),
a AS (
  SELECT repo_id, parent AS ancestor, fqn, 1 AS distance FROM c SEMI JOIN w USING (repo_id, fqn)
  UNION ALL SELECT a.repo_id, c.parent, a.fqn, a.distance + 1 FROM a JOIN c ON c.repo_id = a.repo_id AND c.fqn = a.ancestor)
"""
_SNAPS = """
WITH l AS (SELECT line_id, to_sha, fqn, arg_max(lower(coalesce(code_hash, '')), row_no) AS h FROM node_snapshots GROUP BY ALL),
k AS (SELECT DISTINCT line_id, from_sha, to_sha FROM node_snapshots),
p AS (SELECT k.line_id, k.to_sha, l.fqn, l.h FROM k JOIN l ON k.line_id = l.line_id AND k.from_sha = l.to_sha),
n AS (SELECT l.* FROM l JOIN k USING (line_id, to_sha) JOIN (SELECT DISTINCT line_id, to_sha FROM k) q ON q.line_id = k.line_id AND q.to_sha = k.from_sha),
found AS (
  SELECT coalesce(p.line_id, n.line_id) AS line_id, coalesce(p.to_sha, n.to_sha) AS to_sha, coalesce(p.fqn, n.fqn) AS fqn, CASE WHEN p.fqn IS NULL THEN 'added' WHEN n.fqn IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM p FULL JOIN n ON p.line_id = n.line_id AND p.to_sha = n.to_sha AND p.fqn = n.fqn WHERE p.h IS DISTINCT FROM n.h)
"""

_ITEMS = "CASE json_type({x}) WHEN 'ARRAY' THEN {x} WHEN 'OBJECT' THEN json_array({x}) WHEN 'VARCHAR' THEN CASE json_type(CAST({x}->>'$' AS JSON)) WHEN 'OBJECT' THEN json_array(CAST({x}->>'$' AS JSON)) ELSE CAST({x}->>'$' AS JSON) END ELSE CAST('[]' AS JSON) END"


def _list(x: str) -> str:
    return _ITEMS.format(x=f"({x})")


def _each(source: str, keep: str, value: str, number: str) -> str:
    """Elements of a list-like JSON value with their position."""
    return f"(SELECT {keep}, i AS {number}, json_extract(a, '$[' || i || ']') AS x FROM (SELECT {keep}, {_list(value)} AS a FROM {source}), unnest(range(0, CAST(json_array_length(a) AS BIGINT))) AS u(i))"


_SHRED = f"""
WITH d AS (SELECT DISTINCT report_id, payload FROM eval_reports WHERE json_valid(payload)),
o AS (SELECT report_id, coalesce(CAST(payload AS JSON)->'report', CAST(payload AS JSON)) AS x FROM d),
m AS (SELECT report_id, CAST(payload AS JSON)->'_meta' AS x FROM d),
seconds AS {_each("o", "report_id", "x->'cost'->'per_case_detect_seconds'", "item_no")},
cases AS {_each("o", "report_id", "x->'detection'->'cases'", "case_no")},
violations AS {_each("cases", "report_id, case_no", "x->'violations'", "violation_no")},
hops AS {_each("violations", "report_id, case_no, violation_no", "coalesce(nullif(x->'path_hops', 'null'), x->'pathHops')", "item_no")},
snaps AS {_each("violations", "report_id, case_no, violation_no", "coalesce(nullif(x->'scope_snapshots', 'null'), x->'scopeSnapshots')", "snapshot_no")},
outs AS {_each("snaps", "report_id, case_no, violation_no, snapshot_no", "x->'outgoing'", "item_no")},
fps AS {_each("o", "report_id", "x->'ingestion'->'false_positive_edges'", "item_no")}
"""
_NO = {"case_no": "CAST(case_no AS INT) AS case_no", "violation_no": "CAST(violation_no AS INT) AS violation_no", "snapshot_no": "CAST(snapshot_no AS INT) AS snapshot_no", "item_no": "CAST(item_no AS INT) AS item_no"}


def _columns(links: str, **paths: str) -> str:
    return ", ".join([*[_NO[k] for k in links.split()], *[f"x->>'$.{path}' AS {name}" for name, path in paths.items()]])


_PLACE = {"adr_id": "constraint.adr_id", "subject": "constraint.subject", "predicate": "constraint.predicate", "object": "constraint.object", "file_path": "location.file_path", "line_start": "location.span.line_start", "line_end": "location.span.line_end"}
_SPLIT = {"presence_exact": "presence.exact", "presence_miss": "presence.miss", "scope_exact": "scope.exact", "scope_miss": "scope.miss", "scope_unknown": "scope.by_label.unknown"}
#: Per flat table of problem 6 the relation of _SHRED and the columns.
_FLAT = {
    "meta": ("m", _columns("", arm="arm", generated_at="generated_at", git_commit="git_commit", search_version="versions.search", resolver_model="versions.resolver.model")),
    "ingestion": ("o", _columns("", **{c: f"ingestion.{c}" for c in ("exact", "partial", "miss", "total", "false_positives")}, **{c: f"ingestion.class_split.{p}" for c, p in _SPLIT.items()})),
    "report": ("o", _columns("", repo_id="repo_id", arm="arm", run_index="run_index", pin_commit="pin_commit", detected_exact="detection.exact", detected_total="detection.total", parse_seconds="cost.parse_seconds")),
    "case_cost": ("seconds", "CAST(item_no AS INT) AS item_no, x->>'$' AS seconds"),
    "fp_edge": ("fps", _columns("item_no", adr_id="adr_id", subject="subject", predicate="predicate", object="object")),
    "case": ("cases", _columns("case_no", case_id="case_id", exact="exact", miss="miss", overlap="diagnostics.overlap")),
    "violation": ("violations", _columns("case_no violation_no", **{c: c for c in ("changed_fqn", "matched_fqn", "change_type", "match_status", "evidence", "fan_in", "code_fingerprint")}, **_PLACE)),
    "hop": ("hops", _columns("case_no violation_no item_no", kind="kind", target="target", file_path="file_path")),
    "snapshot": ("snaps", _columns("case_no violation_no snapshot_no", fqn="fqn", scope="scope")),
    "outgoing": ("outs", _columns("case_no violation_no snapshot_no item_no", kind="kind", target="target")),
}
_DRIFT = r"""
WITH RECURSIVE rec AS (SELECT DISTINCT family, stream_id, file_no, record_key, payload FROM wire_records),
lf AS (SELECT family, stream_id, file_no, record_key, payload, substr(t.fullkey, 3) AS path, CASE t.type WHEN 'VARCHAR' THEN 1 WHEN 'BOOLEAN' THEN 4 WHEN 'ARRAY' THEN 8 ELSE 2 END AS bit, replace(CAST(t.value AS VARCHAR), ' ', '') AS v, t.value AS raw
  FROM rec, json_tree(rec.payload) t WHERE t.type NOT IN ('OBJECT', 'NULL') AND NOT contains(t.fullkey, '[')),
fs AS (SELECT DISTINCT stream_id, file_no FROM rec), pairs AS (SELECT a.* FROM fs a JOIN fs b ON b.stream_id = a.stream_id AND b.file_no = a.file_no - 1),
fd AS (SELECT stream_id, file_no, path, bit_or(bit) AS types FROM lf GROUP BY 1, 2, 3),
ch AS (SELECT p.stream_id, p.file_no, f.path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'type_changed' END AS change_kind, o.types AS old, n.types AS now FROM pairs p
  JOIN (SELECT stream_id, file_no, path FROM fd UNION SELECT stream_id, file_no + 1, path FROM fd) f ON f.stream_id = p.stream_id AND f.file_no = p.file_no
  LEFT JOIN fd n ON n.stream_id = p.stream_id AND n.file_no = p.file_no AND n.path = f.path LEFT JOIN fd o ON o.stream_id = p.stream_id AND o.file_no = p.file_no - 1 AND o.path = f.path WHERE n.types IS DISTINCT FROM o.types),
ks AS (SELECT DISTINCT stream_id, file_no, record_key FROM rec), sh AS (SELECT a.* FROM ks a JOIN ks b ON b.stream_id = a.stream_id AND b.file_no = a.file_no - 1 AND b.record_key = a.record_key),
va AS (SELECT c.stream_id, c.file_no, c.path, l.record_key, list_sort(list(DISTINCT l.v)) AS v FROM ch c JOIN lf l ON l.stream_id = c.stream_id AND l.file_no = c.file_no - 1 AND l.path = c.path SEMI JOIN sh ON sh.stream_id = c.stream_id AND sh.file_no = c.file_no AND sh.record_key = l.record_key WHERE c.change_kind = 'removed' GROUP BY 1, 2, 3, 4),
vb AS (SELECT c.stream_id, c.file_no, c.path, l.record_key, list_sort(list(DISTINCT l.v)) AS v FROM ch c JOIN lf l ON l.stream_id = c.stream_id AND l.file_no = c.file_no AND l.path = c.path SEMI JOIN sh ON sh.stream_id = c.stream_id AND sh.file_no = c.file_no AND sh.record_key = l.record_key WHERE c.change_kind = 'added' GROUP BY 1, 2, 3, 4),
ma AS (SELECT a.stream_id, a.file_no, a.path, b.path AS new_name, count(*) AS n FROM va a JOIN vb b ON b.stream_id = a.stream_id AND b.file_no = a.file_no AND b.record_key = a.record_key AND b.v = a.v GROUP BY 1, 2, 3, 4),
rn AS (SELECT m.* FROM ma m WHERE n = (SELECT count(*) FROM va WHERE va.stream_id = m.stream_id AND va.file_no = m.file_no AND va.path = m.path) AND n = (SELECT count(*) FROM vb WHERE vb.stream_id = m.stream_id AND vb.file_no = m.file_no AND vb.path = m.new_name)),
dr AS (SELECT r.stream_id, r.file_no, r.path AS field_name, 'renamed' AS change_kind, r.new_name, o.old, w.now FROM rn r JOIN ch o ON o.stream_id = r.stream_id AND o.file_no = r.file_no AND o.path = r.path JOIN ch w ON w.stream_id = r.stream_id AND w.file_no = r.file_no AND w.path = r.new_name
  UNION SELECT stream_id, file_no, path, change_kind, '', old, now FROM ch WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.stream_id = ch.stream_id AND rn.file_no = ch.file_no AND ((ch.change_kind = 'removed' AND rn.path = ch.path) OR (ch.change_kind = 'added' AND rn.new_name = ch.path))))"""
_TYPES = "array_to_string(list_filter([CASE WHEN {m} & 8 > 0 THEN 'array' END, CASE WHEN {m} & 4 > 0 THEN 'boolean' END, CASE WHEN {m} & 2 > 0 THEN 'number' END, CASE WHEN {m} & 1 > 0 THEN 'string' END], lambda x: x IS NOT NULL), ',')"
_NAMES = _DRIFT + r""",
pr AS (SELECT DISTINCT f.family, d.field_name AS a, d.new_name AS b FROM dr d JOIN (SELECT DISTINCT family, stream_id FROM rec) f USING (stream_id) WHERE change_kind = 'renamed'),
lk AS (SELECT family, a, b FROM pr UNION SELECT family, b, a FROM pr),
rc AS (SELECT family, a, b FROM lk UNION SELECT rc.family, rc.a, lk.b FROM rc JOIN lk ON lk.family = rc.family AND lk.a = rc.b),
gp AS (SELECT family, a AS path, least(a, min(b)) AS g FROM rc GROUP BY family, a),
ff AS (SELECT DISTINCT family, stream_id, file_no, path FROM lf),
bs AS (SELECT DISTINCT family, g FROM (SELECT gp.family, g, stream_id, file_no FROM ff JOIN gp USING (family, path) GROUP BY ALL HAVING count(*) > 1)),
wh AS (SELECT gp.*, n FROM gp ANTI JOIN bs USING (family, g) JOIN (SELECT family, path, count(*) AS n FROM ff GROUP BY 1, 2) USING (family, path)),
nm AS (SELECT wh.family, wh.path, b.field FROM wh JOIN (SELECT family, g, arg_min(path, struct_pack(n := -n, p := path)) AS field FROM wh GROUP BY 1, 2) b USING (family, g) WHERE wh.path <> b.field)"""
_LINES = "coalesce(string_agg(field || '=' || {v}, chr(10) ORDER BY field) FILTER (bit = {b}), '')"

SQL = {
    "p1_found": _ORPHANS + "SELECT * FROM found",
    "p1_report": _ORPHANS
    + """, ed AS (SELECT ord, repo_id, loaded_at AS loaded, unnest(['source', 'target']) AS field_name, regexp_replace(trim(unnest([source, target])), '\\.\\*$', '') AS name FROM dep_edges),
ej AS (SELECT ed.ord, ed.loaded, ed.field_name, bool_or(k.loaded_at <= ed.loaded AND (k.deleted_at IS NULL OR k.deleted_at > ed.loaded)) AS alive, bool_or(k.loaded_at > ed.loaded) AS late, count(k.name) AS n
  FROM ed LEFT JOIN k ON k.repo_id = ed.repo_id AND k.name = ed.name AND k.kind = 'P' WHERE ed.name IS NOT NULL GROUP BY 1, 2, 3)
SELECT 'constraint_edges' AS table_name, field_name, ref_month, reason, count(*) AS n_orphans FROM found GROUP BY ALL
UNION ALL SELECT 'dep_edges', field_name, ref_month, reason, count(*) FROM (SELECT DISTINCT ord, field_name, strftime(loaded, '%Y-%m') AS ref_month, CASE WHEN late THEN 'late' WHEN n > 0 THEN 'deleted' ELSE 'missing' END AS reason FROM ej WHERE NOT coalesce(alive, false)) GROUP BY ALL""",
    "p2_found": _DIFFS
    + """SELECT DISTINCT repo_id, adr_no, subject, predicate, object, field_name FROM f
UNION SELECT s.repo_id, s.n, '', '', '', 'matches_gold' FROM (SELECT DISTINCT repo_id, CAST(regexp_extract(adr_id, '[0-9]+') AS BIGINT) AS n, matches_gold FROM seed_checks WHERE matches_gold IS NOT NULL) s
WHERE matches_gold = EXISTS (SELECT 1 FROM f WHERE f.repo_id = s.repo_id AND f.adr_no = s.n AND field_name LIKE 'missing%')""",
    "p2_cells": _DIFFS + "SELECT * FROM f",
    "p3_found": _WALK + "SELECT n.repo_id, n.fqn, coalesce(w.root, '') AS root, coalesce(w.depth, -1) AS depth FROM n LEFT JOIN w USING (repo_id, fqn)",
    "p3_descendants": _WALK + "SELECT n.repo_id, n.fqn, CASE WHEN w.fqn IS NOT NULL THEN count(a.fqn) END AS n_descendants, w.fqn IS NULL AS on_cycle FROM n LEFT JOIN w USING (repo_id, fqn) LEFT JOIN a ON a.repo_id = n.repo_id AND a.ancestor = n.fqn GROUP BY n.repo_id, n.fqn, w.fqn",
    "p3_pairs": _WALK + "SELECT repo_id, ancestor, fqn, distance FROM a",
    "p3_dropped_links": _WALK + "SELECT DISTINCT d.repo_id, d.target AS fqn, d.source AS parent FROM dep_edges d JOIN c ON c.repo_id = d.repo_id AND c.fqn = d.target WHERE lower(trim(d.kind)) = 'contains' AND d.source <> c.parent",
    "p3_paths": _WALK + "SELECT repo_id, fqn, path, depth FROM w",
    "p5_found": _DRIFT + " SELECT stream_id, file_no, field_name, change_kind, new_name FROM dr",
    "p5_types": _DRIFT + f" SELECT stream_id, file_no, field_name, change_kind, new_name, {_TYPES.format(m='coalesce(old, 0)')} AS old_types, {_TYPES.format(m='coalesce(now, 0)')} AS new_types FROM dr",
    "p5_names": _NAMES + " SELECT * FROM nm",
    "p5_table": _NAMES
    + f""", ce AS (SELECT lf.*, coalesce(nm.field, lf.path) AS field FROM lf LEFT JOIN nm ON nm.family = lf.family AND nm.path = lf.path)
SELECT rec.family, rec.stream_id, rec.file_no, rec.record_key, {_LINES.format(b=1, v="(raw->>'$')")} AS strings, {_LINES.format(b=2, v=r"regexp_replace(CAST(raw AS VARCHAR), '\.0$', '')")} AS numbers, {_LINES.format(b=4, v="CAST(raw AS VARCHAR)")} AS booleans, {_LINES.format(b=8, v="CAST(json_array_length(raw) AS VARCHAR)")} AS arrays
FROM rec LEFT JOIN ce ON ce.stream_id = rec.stream_id AND ce.file_no = rec.file_no AND ce.record_key = rec.record_key AND ce.payload = rec.payload GROUP BY rec.family, rec.stream_id, rec.file_no, rec.record_key, rec.payload""",
    "p5_conflicts": _DRIFT + f" SELECT family, path, {_TYPES.format(m='mask')} AS types, n_files FROM (SELECT family, path, bit_or(types) AS mask, count(*) AS n_files FROM (SELECT family, stream_id, file_no, path, bit_or(bit) AS types FROM lf GROUP BY ALL) GROUP BY 1, 2) WHERE bit_count(mask) > 1",
    "p6_found": _SHRED
    + """SELECT report_id, CAST(case_no AS INT) AS case_no, CAST(violation_no AS INT) AS violation_no, 'hop' AS item, -1 AS snapshot_no, CAST(item_no AS INT) AS item_no, coalesce(x->>'target', '') AS target FROM hops
UNION ALL SELECT report_id, CAST(case_no AS INT), CAST(violation_no AS INT), 'outgoing', CAST(snapshot_no AS INT), CAST(item_no AS INT), coalesce(x->>'target', '') FROM outs
UNION ALL SELECT report_id, -1, -1, 'fp_edge', -1, CAST(item_no AS INT), coalesce(x->>'object', '') FROM fps""",
    **{f"p6_{t}": _SHRED + f"SELECT report_id, {c} FROM {f}" for t, (f, c) in _FLAT.items()},
    "p7_found": _SNAPS + "SELECT * FROM found",
    "p7_totals": _SNAPS + "SELECT line_id, to_sha, change_kind, count(*) AS n FROM found GROUP BY ALL",
}
