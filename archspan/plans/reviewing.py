"""Queries of what a reviewer sees: snapshots, dismissals, updates, changes of commits, classes of fires, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archspan.functions import names
from archspan.operators import copydiff, grounding, model, reviews, scoring, shredding, snapshots, violations
from archspan.plans import analysis, dealt, rulecheck
from archspan.runtime import Scratch, count_by, load


def check_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scopes that each requires finding rests on, with their outgoing edges."""
    g, full, _ = rulecheck.checked(spark, sf_dir, Scratch(spark, "check"))
    return reviews.scope_snapshots(full, g.edges, g.modules)


def check_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hops of each finding's path with their files."""
    g, full, _ = rulecheck.checked(spark, sf_dir, Scratch(spark, "check"))
    return reviews.hop_files(full, g.nodes)


def _dismissed(full: DataFrame, gold: DataFrame) -> DataFrame:
    """Dismissals of the findings of rules that the gold doesn't hold."""
    held = copydiff.normal_rules(copydiff.gold_rules(gold)).select("repo_id", F.lpad(F.col("adr_no").cast("string"), 6, "0").alias("adr"), "subject", "predicate", "object").distinct()
    return violations.dismissals(full.join(held, ["repo_id", "adr", "subject", "predicate", "object"], "left_anti"))


def check_dismissals(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = rulecheck.checked(spark, sf_dir, Scratch(spark, "check"))[1]
    return _dismissed(full, load(spark, sf_dir, "gold_adrs"))


def check_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that no dismissal bears."""
    scratch = Scratch(spark, "check")
    full = scratch.cut(rulecheck.checked(spark, sf_dir, scratch)[1])
    return violations.not_dismissed(full, _dismissed(full, load(spark, sf_dir, "gold_adrs"))).select("constraint_id", "repo_id", "matched_fqn", "identity")


def update_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update per repository: changed files and names, rules kept, self-loops, orphans, open findings and dismissals applied."""
    scratch = Scratch(spark, "update")
    g, full, matches = rulecheck.checked(spark, sf_dir, scratch)
    full = scratch.cut(full)
    left = violations.not_dismissed(full, _dismissed(full, load(spark, sf_dir, "gold_adrs")))
    live = g.rules.where("scope <> 'tooling'")
    files = g.changed.join(g.nodes.where("file_path IS NOT NULL").select("repo_id", "fqn", "file_path"), ["repo_id", "fqn"]).select("repo_id", "file_path").distinct()
    counts = {
        "n_changed_files": files,
        "n_changed": g.changed,
        "n_rules": g.rules,
        "n_self_loops": live.where("subject = object"),
        "n_orphans": violations.orphan_rules(g.rules, matches),
        "n_findings": full,
        "n_open": left,
    }
    out = g.nodes.select("repo_id").distinct()
    for name, df in counts.items():
        out = out.join(count_by(df, "repo_id").withColumnRenamed("n", name), "repo_id", "left")
    return out.fillna(0, list(counts))


def scope_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers with object parameters that the subject of each object-scope rule matches, 0 included: a rule without any reports nothing."""
    rules = model.enforced(rulecheck._rules(spark, sf_dir)).where("predicate = 'requires_object_scope'").select("constraint_id", "repo_id", F.col("subject").alias("pattern"))
    handlers = rulecheck._nodes(spark, sf_dir).where(F.size("object_parameters") > 0).select("repo_id", F.explode(names.matching_patterns("fqn")).alias("pattern"))
    per = handlers.groupBy("repo_id", "pattern").agg(F.count(F.lit(1)).alias("n_handlers"))
    return rules.join(per, ["repo_id", "pattern"], "left").select("constraint_id", F.coalesce("n_handlers", F.lit(0)).alias("n_handlers"))


def _commits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "commits")
    rows = load(spark, sf_dir, "node_snapshots")
    return scratch.cut(snapshots.changes(rows, scratch)), rows


def diff_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that each commit added, deleted or modified; a module where nothing in its file was."""
    return reviews.changed_names(*_commits(spark, sf_dir))


def diff_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.renamed_files(*_commits(spark, sf_dir))


def _fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = load(spark, sf_dir, "eval_reports")
    scratch = Scratch(spark, "fires")
    tables = shredding.flat_tables(reports, scratch)
    return tables["violation"].join(tables["report"].select("report_id", "repo_id", "arm"), "report_id")


def fire_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the node_on reports per repository by class, those of node_off being the baseline."""
    fires = _fires(spark, sf_dir)
    return count_by(reviews.fire_classes(fires.where("arm = 'node_on'"), fires.where("arm = 'node_off'")), "repo_id", "fire_class")


def gold_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository: subjects of gold rules, those that cover no node any more, and the nodes that gold, store and both cover."""
    own = rulecheck._nodes(spark, sf_dir).where("kind <> 'external'").select("repo_id", "fqn", F.explode(names.ancestors("fqn")).alias("base"))
    sides = {"gold": analysis._gold(spark, sf_dir), "store": analysis._store(spark, sf_dir)}
    asked = {s: r.select("repo_id", names.base("subject").alias("base")).where("length(base) > 0").distinct() for s, r in sides.items()}
    met = {s: own.join(p, ["repo_id", "base"]) for s, p in asked.items()}
    live = met["gold"].select("repo_id", "base").distinct()
    n = count_by(asked["gold"], "repo_id").withColumnRenamed("n", "n_subjects").join(count_by(asked["gold"].join(live, ["repo_id", "base"], "left_anti"), "repo_id").withColumnRenamed("n", "n_stale"), "repo_id", "left")
    flags = met["gold"].select("repo_id", "fqn", F.lit(1).alias("g"), F.lit(0).alias("s")).unionByName(met["store"].select("repo_id", "fqn", F.lit(0).alias("g"), F.lit(1).alias("s"))).groupBy("repo_id", "fqn").agg(F.max("g").alias("g"), F.max("s").alias("s"))
    covered = flags.groupBy("repo_id").agg(F.sum("g").alias("n_gold"), F.sum("s").alias("n_store"), F.sum(F.col("g") * F.col("s")).alias("n_both"))
    return n.join(covered, "repo_id", "left").fillna(0)


def provenance_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the stated searches (ids divisible by 100) by what their search results ground."""
    scratch = Scratch(spark, "provenance")
    n, e = analysis.named_graph(spark, sf_dir, scratch)
    hits = analysis.searched(spark, sf_dir, n, e, scratch).where("fqn IS NOT NULL")
    payload = hits.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "fqn", "kind"))), lambda h: F.struct(h["fqn"].alias("fqn"), h["kind"].alias("kind")))).alias("payload"))
    results = scratch.cut(payload.select(F.col("query_id").alias("constraint_id"), F.explode(reviews.result_names(F.col("payload"))).alias("fqn")))
    rules = load(spark, sf_dir, "constraint_edges").where("constraint_id % 100 = 0").select("constraint_id", "repo_id", F.trim("subject").alias("subject"), F.trim("object").alias("object"))
    return reviews.provenance_classes(rules, results, grounding.roots(n, e))


def zero_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.zero_loss(analysis._scored(spark, sf_dir))


def wire_rules_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule lines per file by scope and by the reason why they are dropped, audited ones apart."""
    lines = load(spark, sf_dir, "wire_records").where("family = 'constraint'")
    parsed = reviews.parsed_rules(lines.select("stream_id", "file_no", "payload"))
    return count_by(parsed.withColumn("dropped", F.coalesce("dropped", F.lit(""))), "stream_id", "file_no", "scope", "dropped", "audited")


def guard_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that the guards of handlers bind, per repository."""
    guards = load(spark, sf_dir, "fqn_nodes").select("repo_id", F.explode("guards").alias("g")).select("repo_id", F.replace(F.substring_index("g.predicate", " ", 1), F.lit("."), F.lit("__")).alias("kwarg"))
    return count_by(guards.where("kwarg IS NOT NULL").select("repo_id", "kwarg", reviews.bound_field("kwarg").alias("field")), "repo_id", "kwarg", "field")


def dismissal_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule lines by repository and the bucket of their justification."""
    lines = load(spark, sf_dir, "wire_records").where("family = 'constraint'")
    why = F.coalesce(F.get_json_object("payload", "$.justification"), F.get_json_object("payload", "$.rationale"))
    return count_by(lines.select("repo_id", scoring.reason_bucket(why, F.lit(None).cast("string")).alias("bucket")), "repo_id", "bucket")


def arm_case_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean seconds per case over all cases of an arm's runs, each run counted once by its last report."""
    tables = shredding.flat_tables(load(spark, sf_dir, "eval_reports"), Scratch(spark, "costs"))
    at = load(spark, sf_dir, "eval_reports").select("report_id", "written_at").distinct()
    last = W.partitionBy("repo_id", "arm", "run_index").orderBy(F.desc("written_at"), F.desc("report_id"))
    runs = tables["report"].join(at, "report_id").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    cases = tables["case_cost"].join(runs.select("report_id", "repo_id", "arm"), "report_id")
    return cases.groupBy("repo_id", "arm").agg(F.round(F.avg(F.col("seconds").cast("double")), 6).alias("case_seconds"), F.count(F.lit(1)).alias("n_cases"))


QUERIES = {
    f.__name__: f
    for f in (
        *(check_snapshots, check_hops, check_dismissals, check_open, update_summary, scope_candidates, diff_names, diff_renames, fire_classes, gold_expansion),
        *(provenance_classes, zero_loss, wire_rules_parsed, guard_fields, dismissal_reasons, arm_case_costs),
    )
}

_GOLD = r""",
gold AS (SELECT DISTINCT repo_id, lpad(CAST(CAST(regexp_extract(adr_id, '[0-9]+') AS BIGINT) AS VARCHAR), 6, '0') AS adr, trim(c.subject) AS subject, c.predicate AS predicate, trim(c.object) AS object FROM (SELECT *, unnest(constraints) AS c FROM gold_adrs)),
dm AS (SELECT repo_id, substr(identity, 1, 5) AS short_id, identity AS identity_hash, subject, predicate, object, adr AS adr_id, fingerprint AS code_fingerprint, matched_fqn, governed_fqn FROM idn ANTI JOIN gold USING (repo_id, adr, subject, predicate, object) WHERE fingerprint IS NOT NULL),
op AS (SELECT * FROM idn i WHERE NOT EXISTS (SELECT 1 FROM dm WHERE dm.repo_id = i.repo_id AND dm.identity_hash = i.identity))"""
_CHECKED = rulecheck._FINAL + rulecheck._IDENTIFIED + _GOLD
_COMMIT = dealt._SNAPS + r""",
rw AS (SELECT line_id, to_sha, fqn, unnest(arg_max(struct_pack(from_sha, kind, file_path, code_hash), row_no)) FROM node_snapshots GROUP BY line_id, to_sha, fqn)"""
_LOOKUPS = ", ".join(f"'{x}'" for x in reviews.LOOKUPS)

SQL = {
    "check_snapshots": rulecheck._FINAL
    + """, k AS (SELECT DISTINCT constraint_id, repo_id, changed_fqn, matched_fqn FROM kept WHERE predicate IN ('requires_dependency', 'requires_implementation')),
sn AS (SELECT *, 0 AS snapshot_no, 'changed' AS scope, changed_fqn AS fqn FROM k UNION ALL SELECT k.*, 1, 'enclosing_module', m.module FROM k JOIN mods m ON m.repo_id = k.repo_id AND m.fqn = k.changed_fqn WHERE m.module <> k.changed_fqn),
oe AS (SELECT repo_id, source, kind, target, CAST(row_number() OVER (PARTITION BY repo_id, source ORDER BY ord) - 1 AS INT) AS item_no FROM e WHERE kind IN ('IMPORTS', 'CALLS', 'INHERITS'))
SELECT constraint_id, changed_fqn, matched_fqn, snapshot_no, scope, fqn, coalesce(item_no, -1) AS item_no, oe.kind, oe.target FROM sn LEFT JOIN oe ON oe.repo_id = sn.repo_id AND oe.source = sn.fqn""",
    "check_hops": rulecheck._FINAL + " SELECT k.constraint_id, k.changed_fqn, k.matched_fqn, k.ord3 AS object_fqn, CAST(u.i - 1 AS INT) AS hop_no, k.hops[u.i] AS target, n.file_path FROM kept k, unnest(range(1, len(k.hops) + 1)) AS u(i) LEFT JOIN n ON n.repo_id = k.repo_id AND n.fqn = k.hops[u.i]",
    "check_dismissals": _CHECKED + " SELECT * FROM dm",
    "check_open": _CHECKED + " SELECT constraint_id, repo_id, matched_fqn, identity FROM op",
    "update_summary": _CHECKED
    + """ SELECT q.repo_id, (SELECT count(DISTINCT n.file_path) FROM changed c JOIN n USING (repo_id, fqn) WHERE c.repo_id = q.repo_id) AS n_changed_files, (SELECT count(*) FROM changed c WHERE c.repo_id = q.repo_id) AS n_changed,
(SELECT count(*) FROM r WHERE r.repo_id = q.repo_id) AS n_rules, (SELECT count(*) FROM r WHERE r.repo_id = q.repo_id AND scope <> 'tooling' AND subject = object) AS n_self_loops,
(SELECT count(*) FROM r WHERE r.repo_id = q.repo_id AND scope <> 'tooling' AND constraint_id NOT IN (SELECT constraint_id FROM m)) AS n_orphans, (SELECT count(*) FROM idn WHERE idn.repo_id = q.repo_id) AS n_findings, (SELECT count(*) FROM op WHERE op.repo_id = q.repo_id) AS n_open
FROM (SELECT DISTINCT repo_id FROM n) q""",
    "scope_candidates": rulecheck._B + " SELECT r.constraint_id, (SELECT count(*) FROM keys k JOIN n USING (repo_id, fqn) WHERE k.repo_id = r.repo_id AND k.pattern = r.subject AND len(n.object_parameters) > 0) AS n_handlers FROM live r WHERE predicate = 'requires_object_scope'",
    "diff_names": _COMMIT
    + r""", lk AS (SELECT line_id, to_sha, min(from_sha) AS from_sha FROM rw GROUP BY 1, 2),
nd AS (SELECT f.*, rw.kind, rw.file_path FROM found f JOIN rw USING (line_id, to_sha, fqn) WHERE change_kind <> 'removed'
  UNION ALL SELECT f.*, rw.kind, rw.file_path FROM found f JOIN lk USING (line_id, to_sha) JOIN rw ON rw.line_id = f.line_id AND rw.to_sha = lk.from_sha AND rw.fqn = f.fqn WHERE change_kind = 'removed'),
pt AS (SELECT *, regexp_replace(regexp_replace(trim(file_path), '[\\/]+', '/', 'g'), '^\./', '') AS p, coalesce(kind, '') IN ('function', 'method', 'class') AS inner_ FROM nd),
py AS (SELECT *, bool_or(inner_) OVER (PARTITION BY line_id, to_sha, p) AS any_ FROM pt WHERE p LIKE '%.py' AND NOT regexp_matches(p, '(^|/)\.'))
SELECT line_id, to_sha, fqn, CASE change_kind WHEN 'added' THEN 'added' WHEN 'removed' THEN 'deleted' ELSE 'modified' END AS change_type, p AS file_path, CASE WHEN kind = 'method' AND contains(fqn, '.') THEN regexp_replace(fqn, '\.[^.]*$', '') END AS enclosing_class,
regexp_replace(regexp_replace(regexp_replace(p, '\.py$', ''), '[/\\]', '.', 'g'), '\.__init__$', '') AS enclosing_module FROM py WHERE inner_ OR NOT any_""",
    "diff_renames": _COMMIT
    + r""", fl AS (SELECT line_id, to_sha, file_path, string_agg(lower(code_hash), ',' ORDER BY lower(code_hash)) AS code FROM rw WHERE kind IN ('function', 'method', 'class') GROUP BY 1, 2, 3 HAVING count(*) = count(*) FILTER (length(code_hash) > 0)),
lk AS (SELECT line_id, to_sha, min(from_sha) AS from_sha FROM rw WHERE from_sha IS NOT NULL GROUP BY 1, 2), pa AS (SELECT DISTINCT line_id, to_sha, file_path FROM rw),
gn AS (SELECT lk.line_id, lk.to_sha, fl.file_path, code FROM lk JOIN fl ON fl.line_id = lk.line_id AND fl.to_sha = lk.from_sha WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pa.line_id = lk.line_id AND pa.to_sha = lk.to_sha AND pa.file_path = fl.file_path)),
cm AS (SELECT lk.line_id, lk.to_sha, fl.file_path, code FROM lk JOIN fl USING (line_id, to_sha) WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pa.line_id = lk.line_id AND pa.to_sha = lk.from_sha AND pa.file_path = fl.file_path))
SELECT line_id, to_sha, min(gn.file_path) AS old_path, min(cm.file_path) AS new_path FROM gn JOIN cm USING (line_id, to_sha, code) SEMI JOIN (SELECT DISTINCT line_id, to_sha FROM found) USING (line_id, to_sha) GROUP BY line_id, to_sha, code HAVING count(*) = 1""",
    "fire_classes": dealt._SHRED
    + """, fi AS (SELECT o.x->>'repo_id' AS repo_id, o.x->>'arm' AS arm, v.x->'constraint'->>'adr_id' AS a, v.x->'constraint'->>'predicate' AS p, v.x->'constraint'->>'subject' AS s, v.x->'constraint'->>'object' AS b, v.x->>'matched_fqn' AS f FROM violations v JOIN o USING (report_id))
SELECT repo_id, CASE WHEN EXISTS (SELECT 1 FROM fi y WHERE y.arm = 'node_off' AND y.repo_id IS NOT DISTINCT FROM x.repo_id AND y.a IS NOT DISTINCT FROM x.a AND y.p IS NOT DISTINCT FROM x.p AND y.s IS NOT DISTINCT FROM x.s AND y.b IS NOT DISTINCT FROM x.b AND y.f IS NOT DISTINCT FROM x.f) THEN 'structural'
WHEN starts_with(p, 'requires') AND s LIKE '%.*' THEN 'merge_mechanism' ELSE 'arm_candidate' END AS fire_class, count(*) AS n FROM fi x WHERE arm = 'node_on' GROUP BY 1, 2""",
    "gold_expansion": rulecheck._B
    + r""", gb AS (SELECT DISTINCT repo_id, regexp_replace(trim(c.subject), '\.\*$', '') AS base FROM (SELECT *, unnest(constraints) AS c FROM gold_adrs) WHERE length(trim(c.subject)) > 0), sb AS (SELECT DISTINCT repo_id, regexp_replace(trim(subject), '\.\*$', '') AS base FROM constraint_edges),
ow AS (SELECT * FROM anc WHERE kind <> 'external'), gn AS (SELECT DISTINCT o.repo_id, o.fqn FROM ow o JOIN gb ON gb.repo_id = o.repo_id AND gb.base = o.top), sn AS (SELECT DISTINCT o.repo_id, o.fqn FROM ow o JOIN sb ON sb.repo_id = o.repo_id AND sb.base = o.top)
SELECT repo_id, count(*) AS n_subjects, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ow WHERE ow.repo_id = gb.repo_id AND ow.top = gb.base)) AS n_stale, (SELECT count(*) FROM gn WHERE gn.repo_id = gb.repo_id) AS n_gold,
CASE WHEN (SELECT count(*) FROM gn WHERE gn.repo_id = gb.repo_id) + (SELECT count(*) FROM sn WHERE sn.repo_id = gb.repo_id) > 0 THEN (SELECT count(*) FROM sn WHERE sn.repo_id = gb.repo_id) ELSE 0 END AS n_store, (SELECT count(*) FROM gn JOIN sn USING (repo_id, fqn) WHERE gn.repo_id = gb.repo_id) AS n_both FROM gb GROUP BY repo_id""",
    "provenance_classes": analysis.SQL["name_search"].replace("\nSELECT query_id,", "\n, found AS (SELECT query_id,", 1)
    + rf"""), rr AS (SELECT DISTINCT repo_id, split_part(fqn, '.', 1) AS root FROM n WHERE kind = 'module' AND NOT EXISTS (SELECT 1 FROM e WHERE e.kind = 'CONTAINS' AND e.repo_id = n.repo_id AND e.target = n.fqn)),
pc AS (SELECT c.constraint_id, c.repo_id, trim(object) AS object, {", ".join(f"EXISTS (SELECT 1 FROM found f WHERE f.query_id = c.constraint_id AND f.fqn IS NOT NULL AND {analysis._REL.format(a='f.fqn', b=f'trim(c.{s})')} > 0) AS {s}_grounded" for s in ("subject", "object"))} FROM constraint_edges c WHERE constraint_id % 100 = 0)
SELECT constraint_id, subject_grounded, object_grounded, CASE WHEN subject_grounded OR object_grounded THEN 'B/C' WHEN NOT EXISTS (SELECT 1 FROM rr WHERE rr.repo_id = pc.repo_id AND rr.root = split_part(regexp_replace(pc.object, '[.*]+$', ''), '.', 1)) THEN 'A' ELSE 'other' END AS provenance_class FROM pc""",
    "zero_loss": rulecheck._B + analysis._FREQ + ", fl AS (SELECT min(score) FILTER (p > 0) AS t FROM fr) SELECT t AS threshold, CAST(coalesce(sum(p + q) FILTER (score >= t), 0) AS BIGINT) AS n_kept, CAST(coalesce(sum(q) FILTER (score < t), 0) AS BIGINT) AS dropped_neg, CAST(sum(p + q) AS BIGINT) AS n FROM fr, fl GROUP BY t",
    "wire_rules_parsed": r"""WITH w AS (SELECT stream_id, file_no, json_extract_string(payload, '$.subject') AS s, json_extract_string(payload, '$.predicate') AS p, json_extract_string(payload, '$.object') AS o, json_extract_string(payload, '$.scope') AS c, json_valid(payload) AND starts_with(ltrim(payload), '{') AS ok FROM wire_records WHERE family = 'constraint')
SELECT stream_id, file_no, CASE WHEN c = 'tooling' THEN 'tooling' ELSE 'runtime' END AS scope, CASE WHEN NOT ok THEN 'not_an_object' WHEN coalesce(s, '') = '' OR coalesce(o, '') = '' THEN 'missing_subject_or_object' WHEN coalesce(p, '') NOT IN ('prohibits_dependency', 'prohibits_implementation', 'requires_dependency', 'requires_implementation', 'requires_object_scope') THEN 'unknown_predicate'
WHEN c = 'none' THEN 'none_scope' WHEN s = o THEN 'self_loop' ELSE '' END AS dropped, coalesce(c = 'none', false) AND ok AND coalesce(s, '') <> '' AND coalesce(o, '') <> '' AND coalesce(p, '') IN ('prohibits_dependency', 'prohibits_implementation', 'requires_dependency', 'requires_implementation', 'requires_object_scope') AS audited, count(*) AS n FROM w GROUP BY ALL""",
    "dismissal_reasons": """SELECT repo_id, CASE WHEN contains(w, 'pre-existing') OR contains(w, 'preexisting') THEN 'pre-existing' WHEN contains(w, 'not a known violation') OR contains(w, 'known violation set') THEN 'not-in-known-set' ELSE 'other' END AS bucket, count(*) AS n
FROM (SELECT repo_id, lower(coalesce(json_extract_string(payload, '$.justification'), json_extract_string(payload, '$.rationale'), '')) AS w FROM wire_records WHERE family = 'constraint') GROUP BY 1, 2""",
    "guard_fields": f"""WITH k AS (SELECT repo_id, replace(split_part(g.predicate, ' ', 1), '.', '__') AS kwarg FROM (SELECT repo_id, unnest(guards) AS g FROM fqn_nodes))
SELECT repo_id, kwarg, coalesce(list_filter(list_reverse(string_split(kwarg, '__')), lambda x: lower(x) NOT IN ({_LOOKUPS}))[1], string_split(kwarg, '__')[1]) AS field, count(*) AS n FROM k WHERE kwarg IS NOT NULL GROUP BY ALL""",
    "arm_case_costs": dealt._SHRED
    + """, ru AS (SELECT DISTINCT o.report_id, o.x->>'repo_id' AS repo_id, o.x->>'arm' AS arm, o.x->>'run_index' AS run_index, written_at FROM o JOIN eval_reports USING (report_id) QUALIFY row_number() OVER (PARTITION BY o.x->>'repo_id', o.x->>'arm', o.x->>'run_index' ORDER BY written_at DESC, o.report_id DESC) = 1)
SELECT repo_id, arm, round(avg(CAST(s.x->>'$' AS DOUBLE)), 6) AS case_seconds, count(*) AS n_cases FROM seconds s JOIN ru USING (report_id) GROUP BY 1, 2""",
}
