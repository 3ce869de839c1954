"""Queries of grounding, search, scoring, comparison and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspan.functions import names
from archspan.operators import copydiff, grounding, model, scoring, shredding, vectors
from archspan.plans import dealt, rulecheck
from archspan.runtime import Scratch, load


def _g(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return rulecheck.g_nodes(spark, sf_dir), rulecheck.g_edges(spark, sf_dir), rulecheck._rules(spark, sf_dir)


def g_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, _ = _g(spark, sf_dir)
    return grounding.listed_roots(n, e)


def g_external_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, _ = _g(spark, sf_dir)
    return grounding.external_packages(n, e)


def g_suffix_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule's object as a name suffix."""
    n, _, r = _g(spark, sf_dir)
    return grounding.resolve_suffix(r.select("repo_id", names.strip_dots_stars("object").alias("text")), n)


def g_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, r = _g(spark, sf_dir)
    return grounding.ground_objects(r, n, e)


def g_grounding_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored grounding labels against those of the current graph."""
    now = g_grounding(spark, sf_dir).select("repo_id", "object", F.col("label").alias("now"))
    stored = load(spark, sf_dir, "constraint_edges").where("object_grounding.label IS NOT NULL").select("repo_id", F.trim("object").alias("object"), F.col("object_grounding.label").alias("stored"))
    return stored.join(now, ["repo_id", "object"]).groupBy("stored", "now").agg(F.count(F.lit(1)).alias("n"))


def g_rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, r = _g(spark, sf_dir)
    return grounding.validate_rules(r, n, e)


def g_externalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, r = _g(spark, sf_dir)
    return grounding.externalised(n, e, r)


def g_materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, _, r = _g(spark, sf_dir)
    return grounding.materialised(r, n).select("constraint_id", "subject", "object")


def g_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "members")
    n, e, _ = _g(spark, sf_dir)
    return grounding.inherited_members(scratch.cut(n), scratch.cut(e), scratch)


def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches the object of every rule whose id is divisible by 100 among all names of its repository."""
    scratch = Scratch(spark, "search")
    return searched(spark, sf_dir, *named_graph(spark, sf_dir, scratch), scratch)


def named_graph(spark: SparkSession, sf_dir: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), written: names and kinds, and the edges that imports and roots need."""
    rows = load(spark, sf_dir, "fqn_nodes").select("node_id", "repo_id", "fqn", "kind", "loaded_at", "deleted_at")
    edges = load(spark, sf_dir, "dep_edges").select("repo_id", "target", F.upper(F.trim("kind")).alias("kind"), "source")
    edges = edges.where(F.col("source").isNotNull() & F.col("kind").isin("IMPORTS", "CONTAINS")).select("repo_id", "target", "kind").dropna().distinct()
    nodes, edges = scratch.cut_all(model.current_nodes(rows).select("repo_id", "fqn", "kind"), edges)
    return nodes, edges


def searched(spark: SparkSession, sf_dir: str, n: DataFrame, e: DataFrame, scratch: Scratch) -> DataFrame:
    """The stated searches among the names of written nodes and edges."""
    queries = load(spark, sf_dir, "constraint_edges").where("constraint_id % 100 = 0").select(F.col("constraint_id").alias("query_id"), "repo_id", names.strip_dots_stars(F.trim("object")).alias("query"))
    return grounding.name_search(queries, grounding.search_candidates(n, e), scratch)


def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes around the middle lines of every 100th node row."""
    rows = load(spark, sf_dir, "fqn_nodes")
    mid = ((F.col("line_start") + F.col("line_end")) / 2).cast("int")
    hits = rows.where("node_id % 100 = 0 AND file_path IS NOT NULL").select(F.col("node_id").alias("hit_id"), "repo_id", "file_path", mid.alias("first_line"), (mid + 2).alias("last_line"))
    return grounding.span_overlaps(hits, model.current_nodes(rows))


def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    return vectors.cosine_top_k(v, v.where("vec_id % 100 = 0"), 10)


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copydiff.normal_rules(copydiff.gold_rules(load(spark, sf_dir, "gold_adrs")))


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copydiff.normal_rules(load(spark, sf_dir, "constraint_edges"))


def score_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rule_scores(_gold(spark, sf_dir), _store(spark, sf_dir))


def score_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.accuracy(score_rules(spark, sf_dir), "repo_id")


def score_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = scoring.false_positives(_gold(spark, sf_dir), _store(spark, sf_dir))
    return fp.groupBy("repo_id", "account").agg(F.count(F.lit(1)).alias("n"))


def score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.ratchet(score_rules(spark, sf_dir), 19.0, scoring.false_positives(_gold(spark, sf_dir), _store(spark, sf_dir)), 11)


def rule_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    triple = ["repo_id", "adr_no", "subject", "predicate", "object"]
    return scoring.multiset_difference(_gold(spark, sf_dir).select(*triple), _store(spark, sf_dir).select(*triple)).groupBy(*triple, "side").agg(F.count(F.lit(1)).alias("n"))


def seed_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per ADR the rules in gold and store, those missing on either side, and whether they match."""
    adr = ["repo_id", "adr_no"]
    triple = [*adr, "subject", "predicate", "object"]
    g, s = _gold(spark, sf_dir).select(*triple).distinct(), _store(spark, sf_dir).select(*triple).distinct()
    both = g.withColumn("g", F.lit(1)).join(s.withColumn("s", F.lit(1)), triple, "full")
    out = both.groupBy(*adr).agg(F.count("g").alias("n_gold"), F.count("s").alias("n_store"), F.count(F.when(F.col("s").isNull(), 1)).alias("n_missing"), F.count(F.when(F.col("g").isNull(), 1)).alias("n_extra"))
    return out.withColumn("matches", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))


def arm_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cells(load(spark, sf_dir, "eval_reports"))


def arm_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.arm_effects(scoring.long_cells(arm_cells(spark, sf_dir)))


def arm_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.arm_decision(arm_effects(spark, sf_dir))


def arm_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cost_means(arm_cells(spark, sf_dir))


def cost_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.upper_median(arm_cells(spark, sf_dir), "parse_seconds", "repo_id")


def fp_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False-positive edges of the reports by whether their ADR has gold rules."""
    edges = shredding.flat_table(load(spark, sf_dir, "eval_reports"), "fp_edge")
    repos = load(spark, sf_dir, "eval_reports").select("report_id", "repo_id").distinct()
    gold = _gold(spark, sf_dir).select("repo_id", "adr_no").distinct().withColumn("has_gold", F.lit(True))
    tagged = edges.join(repos, "report_id").withColumn("adr_no", copydiff.adr_number("adr_id")).join(gold, ["repo_id", "adr_no"], "left")
    return tagged.groupBy("repo_id").agg(F.count("has_gold").alias("has_gold"), (F.count(F.lit(1)) - F.count("has_gold")).alias("zero_gold"))


def fires_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and user, first against second half of the ids' range; the 40 largest moves."""
    e = load(spark, sf_dir, "events")
    mid = e.agg(((F.min("event_id") + F.max("event_id")) / 2).alias("mid"))
    both = e.crossJoin(F.broadcast(mid))
    return scoring.fires_moved(both.where("event_id <= mid"), both.where("event_id > mid"), ["event_type", "user_id"])


def _scope_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["repo_id", "adr_no", "subject", "predicate", "object"]
    g = _gold(spark, sf_dir).groupBy(*key).agg(F.min("scope").alias("expected"))
    s = _store(spark, sf_dir).groupBy(*key).agg(F.min("scope").alias("observed"))
    return g.join(s, key, "left").select("repo_id", "adr_no", "expected", F.coalesce("observed", F.lit("none")).alias("observed"))


def scope_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confusion(_scope_pairs(spark, sf_dir))


def scope_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.recall(scope_confusion(spark, sf_dir), "tooling")


def recall_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ADRs with gold rules: ``lost`` if none came out, ``mis_tagged`` if every rule that came out bears another scope than every gold rule, else ``dropped`` or ``safe``."""
    p = _scope_pairs(spark, sf_dir).groupBy("repo_id", "adr_no").agg(F.count(F.when(F.col("observed") == "none", 1)).alias("n_none"), F.count(F.lit(1)).alias("n"), F.max((F.col("expected") == F.col("observed")).cast("int")).alias("ok"))
    state = F.when(F.col("n_none") == F.col("n"), "lost").when(F.col("ok") == 0, "mis_tagged").when(F.col("n_none") > 0, "dropped").otherwise("safe")
    return p.select("repo_id", "adr_no", state.alias("state"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specificity of every rule; positive if nodes match both of its sides."""
    rules = model.enforced(rulecheck._rules(spark, sf_dir))
    hit = rulecheck.g_rule_matches(spark, sf_dir).select("constraint_id").distinct().withColumn("m", F.lit(True))
    return rules.join(hit, "constraint_id", "left").select(F.col("specificity").alias("score"), F.coalesce("m", F.lit(False)).alias("positive"))


def rank_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rank_auc(_scored(spark, sf_dir))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.threshold_sweep(_scored(spark, sf_dir))


def node_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long nodes stay, by kind, to the last load of the table; nodes still there are censored."""
    n = load(spark, sf_dir, "fqn_nodes").where("deleted_at IS NULL OR deleted_at > loaded_at")
    end = n.agg(F.max("loaded_at").alias("end"))
    spans = n.crossJoin(F.broadcast(end)).select("kind", F.datediff(F.coalesce("deleted_at", "end"), "loaded_at").alias("days"), F.col("deleted_at").isNotNull().alias("ended"))
    return scoring.survival(spans, "kind")


def wire_rules_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rule lines by the reason why they are dropped: a missing field, an unknown predicate or a loop; '' is kept."""
    known = ["prohibits_dependency", "prohibits_implementation", "requires_dependency", "requires_implementation", "requires_object_scope"]
    w = load(spark, sf_dir, "wire_records").where("family = 'constraint'").select("stream_id", "file_no", F.from_json("payload", "subject string, predicate string, object string, justification string, rationale string").alias("r"))
    reason = (
        F.when(F.col("r.subject").isNull() | F.col("r.object").isNull() | F.col("r.predicate").isNull(), "missing_field")
        .when(~F.col("r.predicate").isin(*known), "unknown_predicate")
        .when(F.col("r.subject") == F.col("r.object"), "self_loop")
        .when(F.coalesce("r.justification", "r.rationale").isNull(), "no_justification")
        .otherwise("")
    )
    return w.groupBy("stream_id", "file_no", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def rules_on_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that name a node of a file in which a node changed."""
    n = model.current_nodes(load(spark, sf_dir, "fqn_nodes"))
    files = n.join(model.changed_nodes(load(spark, sf_dir, "fqn_nodes")), ["repo_id", "fqn"]).select("repo_id", "file_path").where("file_path IS NOT NULL").distinct()
    touched = n.join(files, ["repo_id", "file_path"], "left_semi").select("repo_id", "fqn")
    ends = rulecheck._rules(spark, sf_dir).select("constraint_id", "repo_id", F.explode(F.array("subject", "object")).alias("p")).select("constraint_id", "repo_id", names.base("p").alias("fqn"))
    return ends.join(touched, ["repo_id", "fqn"], "left_semi").select("constraint_id").distinct()


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with several current rows, and the number of them (the uniqueness report of the store)."""
    return load(spark, sf_dir, "fqn_nodes").where("deleted_at IS NULL").groupBy("repo_id", "fqn").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


QUERIES = {
    f.__name__: f
    for f in (
        *(g_roots, g_external_packages, g_suffix_resolved, g_grounding, g_grounding_drift, g_rule_verdicts, g_externalised, g_materialised, g_inherited),
        *(name_search, span_overlaps, vector_top_k, score_rules, score_accuracy, score_false_positives, score_gate, rule_multiset_diff, seed_record),
        *(arm_cells, arm_effects, arm_decisions, arm_costs, cost_medians, fp_split, fires_moved, scope_confusion, scope_recall, recall_safety),
        *(rank_auc, threshold_sweep, node_survival, wire_rules_checked, rules_on_changed_files, duplicate_keys),
    )
}

_B = rulecheck._B
_BUILTINS = ", ".join(f"'{b}'" for b in grounding.BUILTINS)
_TOOLS = rulecheck._TOOLS
_ROOTS = """, roots AS (SELECT DISTINCT repo_id, split_part(fqn, '.', 1) AS root FROM n WHERE kind = 'module' AND NOT EXISTS (SELECT 1 FROM e WHERE e.kind = 'CONTAINS' AND e.repo_id = n.repo_id AND e.target = n.fqn)),
ext AS (SELECT DISTINCT repo_id, split_part(target, '.', 1) AS package FROM e WHERE kind = 'IMPORTS' AND NOT EXISTS (SELECT 1 FROM roots q WHERE q.repo_id = e.repo_id AND q.root = split_part(e.target, '.', 1)))"""
_SUFFIX = f""", suf AS (SELECT repo_id, fqn, array_to_string(p[i:], '.') AS text FROM (SELECT *, string_split(fqn, '.') AS p FROM n), unnest(range(1, len(p) + 1)) AS u(i)),
asked AS (SELECT DISTINCT repo_id, object, regexp_replace(object, '[.*]+$', '') AS text FROM r),
res AS (SELECT a.repo_id, a.text, arg_min(s.fqn, struct_pack(x := s.fqn <> s.text, y := len(string_split(s.fqn, '.')), z := s.fqn)) AS fqn, count(*) AS n FROM (SELECT DISTINCT repo_id, text FROM asked) a JOIN suf s USING (repo_id, text) WHERE contains(a.text, '.') OR a.text NOT IN ({_BUILTINS}) GROUP BY 1, 2)"""
_GROUND = _ROOTS + _SUFFIX + """, own AS (SELECT DISTINCT repo_id, fqn FROM n WHERE kind <> 'external'), up AS (SELECT DISTINCT repo_id, top, self FROM anc WHERE kind <> 'external'),
gr0 AS (SELECT a.repo_id, a.object, a.text, CASE WHEN EXISTS (SELECT 1 FROM own WHERE own.repo_id = a.repo_id AND own.fqn = a.text) THEN 'exact' WHEN EXISTS (SELECT 1 FROM res WHERE res.repo_id = a.repo_id AND res.text = a.text AND res.n = 1) THEN 'unique_suffix'
  WHEN EXISTS (SELECT 1 FROM up WHERE up.repo_id = a.repo_id AND up.top = a.text AND NOT up.self) THEN 'prefix' WHEN EXISTS (SELECT 1 FROM ext WHERE ext.repo_id = a.repo_id AND ext.package = split_part(a.text, '.', 1)) THEN 'external' ELSE 'unknown' END AS label FROM asked a),
gr AS (SELECT g.repo_id, g.object, g.label, CASE WHEN label = 'exact' THEN g.text WHEN label = 'unique_suffix' THEN res.fqn END AS resolved_fqn, CASE WHEN label = 'external' THEN split_part(g.text, '.', 1) END AS package FROM gr0 g LEFT JOIN res ON res.repo_id = g.repo_id AND res.text = g.text)"""
_RULES = r"""
WITH g AS (SELECT repo_id, CAST(regexp_extract(adr_id, '[0-9]+') AS BIGINT) AS adr_no, trim(c.subject) AS subject, c.predicate AS predicate, trim(c.object) AS object, lower(coalesce(c.scope, 'runtime')) AS scope FROM (SELECT *, unnest(constraints) AS c FROM gold_adrs)),
s AS (SELECT repo_id, CAST(regexp_extract(adr_id, '[0-9]+') AS BIGINT) AS adr_no, trim(subject) AS subject, predicate, trim(object) AS object, lower(coalesce(scope, 'runtime')) AS scope FROM constraint_edges)"""
_REL = "CASE WHEN {a} = {b} THEN 2 WHEN regexp_replace({a}, '[.*]+$', '') = regexp_replace({b}, '[.*]+$', '') OR starts_with(regexp_replace({a}, '[.*]+$', ''), regexp_replace({b}, '[.*]+$', '') || '.') OR starts_with(regexp_replace({b}, '[.*]+$', ''), regexp_replace({a}, '[.*]+$', '') || '.') THEN 1 ELSE 0 END"
_SCORES = _RULES + f""", sc AS (SELECT g.repo_id, g.adr_no, g.subject, g.predicate, g.object, CASE coalesce(max(least({_REL.format(a="g.subject", b="s.subject")}, {_REL.format(a="g.object", b="s.object")})), 0) WHEN 2 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'miss' END AS score
  FROM (SELECT DISTINCT * EXCLUDE scope FROM g) g LEFT JOIN s ON s.repo_id = g.repo_id AND s.adr_no = g.adr_no AND s.predicate = g.predicate GROUP BY 1, 2, 3, 4, 5)"""
_FPS = f""", fps AS (SELECT DISTINCT s.repo_id, s.adr_no, s.subject, s.predicate, s.object,
  CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.repo_id = s.repo_id AND g.predicate = s.predicate AND g.adr_no = s.adr_no AND {_REL.format(a="g.subject", b="s.subject")} > 0 AND {_REL.format(a="g.object", b="s.object")} > 0) THEN 'matched'
    WHEN EXISTS (SELECT 1 FROM g WHERE g.repo_id = s.repo_id AND g.predicate = s.predicate AND starts_with(regexp_replace(s.subject, '[.*]+$', ''), regexp_replace(g.subject, '[.*]+$', '') || '.') AND {_REL.format(a="g.object", b="s.object")} > 0) THEN 'fragment'
    WHEN s.scope = 'tooling' THEN 'tooling' ELSE 'false_positive' END AS account FROM s)"""
_PAIRS = _RULES + """, pr AS (SELECT x.repo_id, x.adr_no, x.scope AS expected, coalesce(y.scope, 'none') AS observed FROM (SELECT repo_id, adr_no, subject, predicate, object, min(scope) AS scope FROM g GROUP BY ALL) x
  LEFT JOIN (SELECT repo_id, adr_no, subject, predicate, object, min(scope) AS scope FROM s GROUP BY ALL) y USING (repo_id, adr_no, subject, predicate, object)),
cf AS (SELECT repo_id, expected, observed, count(*) AS n FROM pr GROUP BY GROUPING SETS ((repo_id, expected, observed), (expected, observed)))"""
_PATHS = {"ing_exact": "ingestion.exact", "ing_partial": "ingestion.partial", "ing_miss": "ingestion.miss", "ing_fp": "ingestion.false_positives", "ing_total": "ingestion.total", "presence_exact": "ingestion.class_split.presence.exact"}
_PATHS |= {"presence_miss": "ingestion.class_split.presence.miss", "scope_exact": "ingestion.class_split.scope.exact", "scope_miss": "ingestion.class_split.scope.miss", "det_exact": "detection.exact", "det_total": "detection.total", "parse_seconds": "cost.parse_seconds"}
_METRICS = ", ".join(m for m in _PATHS if m != "parse_seconds")
_AT = "coalesce(payload->>'$.{p}', payload->>'$.report.{p}')"
_CELLS = "WITH v AS (SELECT repo_id, " + ", ".join(
    [f"{_AT.format(p='arm')} AS arm", f"CAST({_AT.format(p='run_index')} AS INT) AS run_index", "written_at", "report_id"]
    + [f"CAST({_AT.format(p=p)} AS DOUBLE) AS {m}" for m, p in _PATHS.items()]
) + """ FROM eval_reports WHERE json_valid(payload)),
c AS (SELECT repo_id, arm, run_index, """ + _METRICS + """, parse_seconds FROM (SELECT DISTINCT * FROM v) QUALIFY row_number() OVER (PARTITION BY repo_id, arm, run_index ORDER BY written_at DESC, report_id DESC) = 1),
lg AS (SELECT repo_id, arm, run_index, metric, value FROM (UNPIVOT c ON """ + _METRICS + """ INTO NAME metric VALUE value))"""
_EFFECTS = _CELLS + """, a AS (SELECT repo_id, metric, avg(value) AS mean_on, max(value) - min(value) AS floor FROM lg WHERE arm = 'node_on' GROUP BY 1, 2),
b AS (SELECT repo_id, metric, avg(value) AS mean_off FROM lg WHERE arm = 'node_off' GROUP BY 1, 2),
sg AS (SELECT x.repo_id, x.metric, count(*) FILTER (x.value > y.value) AS ups, count(*) FILTER (x.value < y.value) AS downs FROM lg x JOIN lg y ON x.repo_id = y.repo_id AND x.metric = y.metric AND x.run_index = y.run_index AND x.arm = 'node_on' AND y.arm = 'node_off' GROUP BY 1, 2),
ef AS (SELECT repo_id, metric, mean_on, mean_off, floor, mean_on - mean_off AS delta, coalesce(CASE WHEN mean_on > mean_off THEN ups WHEN mean_on < mean_off THEN downs END, 0) AS n_consistent FROM a LEFT JOIN b USING (repo_id, metric) LEFT JOIN sg USING (repo_id, metric)),
ff AS (SELECT *, coalesce(abs(delta) > floor AND n_consistent >= 2, false) AS effect FROM ef)"""
_FREQ = ", fr AS (SELECT specificity AS score, count(*) FILTER (p) AS p, count(*) FILTER (NOT p) AS q FROM (SELECT *, constraint_id IN (SELECT constraint_id FROM m) AS p FROM live) GROUP BY 1)"

SQL = {
    "g_roots": _B + _ROOTS + " SELECT * FROM roots WHERE root NOT IN ('manage', 'setup', 'noxfile', 'conftest')",
    "g_external_packages": _B + _ROOTS + " SELECT * FROM ext",
    "g_suffix_resolved": _B + _SUFFIX + " SELECT * FROM res",
    "g_grounding": _B + _GROUND + " SELECT * FROM gr",
    "g_grounding_drift": _B + _GROUND + " SELECT c.object_grounding.label AS stored, gr.label AS now, count(*) AS n FROM constraint_edges c JOIN gr ON gr.repo_id = c.repo_id AND gr.object = trim(c.object) WHERE c.object_grounding.label IS NOT NULL GROUP BY 1, 2",
    "g_rule_verdicts": _B + _GROUND + """ SELECT r.constraint_id, CASE WHEN EXISTS (SELECT 1 FROM roots q WHERE q.repo_id = r.repo_id AND q.root = split_part(r.subject, '.', 1)) AND NOT EXISTS (SELECT 1 FROM up WHERE up.repo_id = r.repo_id AND up.top = regexp_replace(r.subject, '[.*]+$', '')) THEN 'subject'
WHEN EXISTS (SELECT 1 FROM roots q WHERE q.repo_id = r.repo_id AND q.root = split_part(r.object, '.', 1)) AND gr.label = 'unknown' THEN 'object' ELSE 'ok' END AS verdict FROM r JOIN gr ON gr.repo_id = r.repo_id AND gr.object = r.object""",
    "g_externalised": _B + rf""" SELECT DISTINCT repo_id, fqn, 'external' AS kind, CASE WHEN split_part(fqn, '.', 1) IN ({_TOOLS}) THEN 'dev_tool' ELSE 'unknown' END AS role
FROM (SELECT repo_id, regexp_replace(target, '\.\*$', '') AS fqn FROM e WHERE kind = 'IMPORTS' UNION SELECT repo_id, regexp_replace(unnest([subject, object]), '\.\*$', '') FROM r) x WHERE fqn <> '' AND NOT EXISTS (SELECT 1 FROM n WHERE n.repo_id = x.repo_id AND n.fqn = x.fqn)""",
    "g_materialised": _B + """ SELECT constraint_id, subject, object FROM (SELECT constraint_id, CASE WHEN a.fqn IS NOT NULL THEN subject || '.*' ELSE subject END AS subject, CASE WHEN b.fqn IS NOT NULL THEN object || '.*' ELSE object END AS object
FROM r LEFT JOIN n a ON a.repo_id = r.repo_id AND a.fqn = r.subject AND a.kind = 'module' LEFT JOIN n b ON b.repo_id = r.repo_id AND b.fqn = r.object AND b.kind = 'module') WHERE subject <> object""",
    "g_inherited": _B + r""", mro(repo_id, cls, b, way) USING KEY (repo_id, cls, b) AS (SELECT repo_id, fqn, fqn, CAST([] AS BIGINT[]) FROM n WHERE kind = 'class'
  UNION SELECT q.repo_id, q.cls, e.target, min(list_append(q.way, e.ord)) FROM mro q JOIN e ON e.kind = 'INHERITS' AND e.repo_id = q.repo_id AND e.source = q.b WHERE NOT EXISTS (SELECT 1 FROM recurring.mro k WHERE k.repo_id = q.repo_id AND k.cls = q.cls AND k.b = e.target) GROUP BY 1, 2, 3)
SELECT q.repo_id, q.cls, string_split(n.fqn, '.')[-1] AS member, arg_min(q.b, struct_pack(d := len(q.way), w := q.way, a := q.b)) AS definer, CAST(min(len(q.way)) AS INT) AS distance FROM mro q JOIN n ON n.repo_id = q.repo_id AND n.kind = 'method' AND regexp_replace(n.fqn, '\.[^.]*$', '') = q.b GROUP BY 1, 2, 3""",
    "name_search": _B + r""", cand AS (SELECT repo_id, fqn, kind FROM n UNION ALL SELECT DISTINCT repo_id, target, 'external_import' FROM e WHERE kind = 'IMPORTS' AND NOT EXISTS (SELECT 1 FROM n WHERE n.repo_id = e.repo_id AND n.fqn = e.target)),
q AS (SELECT constraint_id AS query_id, repo_id, lower(regexp_replace(trim(object), '[.*]+$', '')) AS q FROM constraint_edges WHERE constraint_id % 100 = 0),
h AS (SELECT query_id, fqn, kind, CASE WHEN lower(fqn) = q THEN 1 WHEN starts_with(lower(fqn), q) THEN 2 WHEN contains(lower(fqn), q) THEN 3 WHEN regexp_matches(replace(lower(fqn), '.', '/'), regexp_replace(regexp_replace(replace(q, '.', '/'), '[^A-Za-z0-9_/]', 'x', 'g'), '(.)', '\1.*', 'g')) THEN 4 END AS tier FROM q JOIN cand USING (repo_id)),
c0 AS (SELECT query_id, count(*) FILTER (tier = 1) AS a, count(*) FILTER (tier = 2) AS b, count(*) FILTER (tier = 3) AS c, count(*) FILTER (tier = 4) AS d FROM h WHERE tier IS NOT NULL GROUP BY 1),
c1 AS (SELECT query_id, a AS n_exact, b AS n_prefix, CASE WHEN a + b > 0 THEN 0 ELSE c END AS n_substring, CASE WHEN a + b > 0 OR c > 0 THEN 0 ELSE d END AS n_relaxed FROM c0),
c2 AS (SELECT *, n_exact + n_prefix = 0 AND n_substring + n_relaxed > 20 AS refused, n_exact + n_prefix + n_substring + n_relaxed > 20 AS truncated FROM c1),
k AS (SELECT c2.*, CAST(row_number() OVER (PARTITION BY h.query_id ORDER BY tier, fqn, kind) AS INT) AS rank, fqn, kind FROM h JOIN c2 USING (query_id) WHERE NOT refused AND tier <= CASE WHEN n_exact + n_prefix > 0 THEN 2 WHEN n_substring > 0 THEN 3 ELSE 4 END)
SELECT query_id, n_exact, n_prefix, n_substring, n_relaxed, refused, truncated, rank, fqn, kind FROM k WHERE rank <= 20 UNION ALL SELECT *, NULL, NULL, NULL FROM c2 WHERE refused""",
    "span_overlaps": _B + r""", h AS (SELECT node_id AS hit_id, repo_id, regexp_replace(regexp_replace(trim(file_path), '[\\/]+', '/', 'g'), '^\./', '') AS path, CAST(trunc((line_start + line_end) / 2.0) AS INT) AS lo FROM fqn_nodes WHERE node_id % 100 = 0 AND file_path IS NOT NULL)
SELECT hit_id, fqn, kind, CAST(rank AS INT) AS rank FROM (SELECT h.hit_id, n.fqn, n.kind, row_number() OVER (PARTITION BY h.hit_id ORDER BY n.line_start, n.fqn) AS rank FROM h JOIN n ON n.repo_id = h.repo_id AND regexp_replace(regexp_replace(trim(n.file_path), '[\\/]+', '/', 'g'), '^\./', '') = h.path AND n.line_start <= h.lo + 2 AND n.line_end >= h.lo) WHERE rank <= 5""",
    "vector_top_k": """SELECT query_id, vec_id, cosine, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS rank
FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 10""",
    "score_rules": _SCORES + " SELECT * FROM sc",
    "score_accuracy": _SCORES + """, t AS (SELECT repo_id, count(*) FILTER (score = 'exact') AS exact, count(*) FILTER (score = 'partial') AS partial, count(*) FILTER (score = 'miss') AS miss, count(*) AS total FROM sc GROUP BY 1)
SELECT *, round((exact + 0.5 * partial) / total, 6) AS accuracy, round((exact / total + 3.841458820694124 / (2 * total) - 1.959963984540054 * sqrt(exact / total * (1 - exact / total) / total + 3.841458820694124 / (4.0 * total * total))) / (1 + 3.841458820694124 / total), 6) AS low,
round((exact / total + 3.841458820694124 / (2 * total) + 1.959963984540054 * sqrt(exact / total * (1 - exact / total) / total + 3.841458820694124 / (4.0 * total * total))) / (1 + 3.841458820694124 / total), 6) AS high FROM t""",
    "score_false_positives": _RULES + _FPS + " SELECT repo_id, account, count(*) AS n FROM fps GROUP BY 1, 2",
    "score_gate": _SCORES + _FPS + """ SELECT b.blended, f.n_fp, b.blended >= 19 AND f.n_fp <= 11 AS passed FROM (SELECT CAST(sum(CASE score WHEN 'exact' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0 END) AS DOUBLE) AS blended FROM sc) b, (SELECT count(*) FILTER (account = 'false_positive') AS n_fp FROM fps) f""",
    "rule_multiset_diff": _RULES + """, a AS (SELECT repo_id, adr_no, subject, predicate, object FROM g), b AS (SELECT repo_id, adr_no, subject, predicate, object FROM s)
SELECT *, count(*) AS n FROM (SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY ALL""",
    "seed_record": _RULES + """, x AS (SELECT DISTINCT * EXCLUDE scope FROM g), y AS (SELECT DISTINCT * EXCLUDE scope FROM s), z AS (SELECT coalesce(x.repo_id, y.repo_id) AS repo_id, coalesce(x.adr_no, y.adr_no) AS adr_no, x.repo_id IS NOT NULL AS ing, y.repo_id IS NOT NULL AS ins FROM x FULL JOIN y ON x.repo_id = y.repo_id AND x.adr_no = y.adr_no AND x.subject = y.subject AND x.predicate = y.predicate AND x.object = y.object)
SELECT repo_id, adr_no, count(*) FILTER (ing) AS n_gold, count(*) FILTER (ins) AS n_store, count(*) FILTER (NOT ins) AS n_missing, count(*) FILTER (NOT ing) AS n_extra, count(*) FILTER (NOT ins) = 0 AND count(*) FILTER (NOT ing) = 0 AS matches FROM z GROUP BY 1, 2""",
    "arm_cells": _CELLS + " SELECT * FROM c",
    "arm_effects": _EFFECTS + " SELECT repo_id, metric, round(mean_on, 6) AS mean_on, round(mean_off, 6) AS mean_off, round(floor, 6) AS floor, round(delta, 6) AS delta, n_consistent, effect FROM ff",
    "arm_decisions": _EFFECTS + " SELECT repo_id, CASE WHEN max(CASE WHEN effect THEN sign(delta) * CASE WHEN metric IN ('ing_miss', 'ing_fp', 'presence_miss', 'scope_miss') THEN -1 WHEN metric IN ('ing_total', 'det_total') THEN 0 ELSE 1 END END) > 0 THEN 'keep' WHEN min(CASE WHEN effect THEN sign(delta) * CASE WHEN metric IN ('ing_miss', 'ing_fp', 'presence_miss', 'scope_miss') THEN -1 WHEN metric IN ('ing_total', 'det_total') THEN 0 ELSE 1 END END) < 0 THEN 'cut_candidate' ELSE 'no_movement' END AS decision FROM ff GROUP BY 1",
    "arm_costs": _CELLS + " SELECT repo_id, arm, coalesce(round(avg(parse_seconds), 6), CAST('NaN' AS DOUBLE)) AS parse_seconds, count(*) AS n_runs FROM c GROUP BY 1, 2",
    "cost_medians": _CELLS + " SELECT repo_id, list_sort(list(parse_seconds))[len(list(parse_seconds)) // 2 + 1] AS median, min(parse_seconds) AS least, max(parse_seconds) AS greatest FROM c WHERE parse_seconds IS NOT NULL GROUP BY 1",
    "fp_split": dealt._SHRED
    + _RULES.replace("\nWITH g AS", ", g AS", 1)
    + """, fe AS (SELECT DISTINCT f.report_id, f.item_no, r.repo_id, CAST(regexp_extract(f.x->>'adr_id', '[0-9]+') AS BIGINT) AS adr_no FROM fps f JOIN eval_reports r USING (report_id))
SELECT repo_id, count(*) FILTER (h) AS has_gold, count(*) FILTER (NOT h) AS zero_gold FROM (SELECT *, EXISTS (SELECT 1 FROM g WHERE g.repo_id = fe.repo_id AND g.adr_no = fe.adr_no) AS h FROM fe) GROUP BY 1""",
    "fires_moved": """WITH e AS (SELECT *, event_id <= (SELECT (min(event_id) + max(event_id)) / 2.0 FROM events) AS old FROM events), c AS (SELECT event_type, user_id, count(*) FILTER (old) AS n_old, count(*) FILTER (NOT old) AS n_new FROM e GROUP BY 1, 2)
SELECT * FROM c WHERE n_old <> n_new ORDER BY abs(n_new - n_old) DESC, event_type, user_id LIMIT 40""",
    "scope_confusion": _PAIRS + " SELECT * FROM cf",
    "scope_recall": _PAIRS + " SELECT repo_id, round(coalesce(sum(n) FILTER (expected = 'tooling' AND observed = 'tooling'), 0) / sum(n) FILTER (observed = 'tooling'), 6) AS precision, round(coalesce(sum(n) FILTER (expected = 'tooling' AND observed = 'tooling'), 0) / sum(n) FILTER (expected = 'tooling'), 6) AS recall FROM cf GROUP BY 1",
    "recall_safety": _PAIRS + " SELECT repo_id, adr_no, CASE WHEN count(*) FILTER (observed = 'none') = count(*) THEN 'lost' WHEN NOT bool_or(expected = observed) THEN 'mis_tagged' WHEN count(*) FILTER (observed = 'none') > 0 THEN 'dropped' ELSE 'safe' END AS state FROM pr GROUP BY 1, 2",
    "rank_auc": _B + _FREQ + " SELECT sum(p) AS n_pos, sum(q) AS n_neg, round(sum(p * (coalesce((SELECT sum(q) FROM fr y WHERE y.score < x.score), 0) + 0.5 * q)) / (sum(p) * sum(q)), 6) AS auc FROM fr x",
    "threshold_sweep": _B + _FREQ + ", gd AS (SELECT CAST(i AS INT) AS step, lo + (hi - lo) * i / 20 AS threshold FROM (SELECT min(score) AS lo, max(score) AS hi FROM fr), unnest(range(1, 20)) AS u(i)) SELECT step, round(threshold, 6) AS threshold, coalesce(sum(p) FILTER (score >= threshold), 0) AS kept_pos, coalesce(sum(q) FILTER (score < threshold), 0) AS dropped_neg, round(coalesce(sum(p) FILTER (score >= threshold), 0) / sum(p + q) FILTER (score >= threshold), 6) AS precision FROM fr, gd GROUP BY step, gd.threshold",
    "node_survival": """WITH x AS (SELECT kind, datediff('day', CAST(loaded_at AS DATE), CAST(coalesce(deleted_at, (SELECT max(loaded_at) FROM fqn_nodes WHERE deleted_at IS NULL OR deleted_at > loaded_at)) AS DATE)) AS days, deleted_at IS NOT NULL AS ended FROM fqn_nodes WHERE deleted_at IS NULL OR deleted_at > loaded_at),
f AS (SELECT kind, days, count(*) AS k, count(*) FILTER (ended) AS d FROM x GROUP BY 1, 2), r AS (SELECT *, sum(k) OVER (PARTITION BY kind ORDER BY days DESC) AS at_risk FROM f)
SELECT kind, days AS day, at_risk, d AS ended, round(exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE -1000 END) OVER (PARTITION BY kind ORDER BY days)), 6) AS share FROM r WHERE d > 0""",
    "wire_rules_checked": r"""WITH w AS (SELECT stream_id, file_no, json_extract_string(payload, '$.subject') AS s, json_extract_string(payload, '$.predicate') AS p, json_extract_string(payload, '$.object') AS o, coalesce(json_extract_string(payload, '$.justification'), json_extract_string(payload, '$.rationale')) AS j FROM wire_records WHERE family = 'constraint')
SELECT stream_id, file_no, CASE WHEN s IS NULL OR p IS NULL OR o IS NULL THEN 'missing_field' WHEN p NOT IN ('prohibits_dependency', 'prohibits_implementation', 'requires_dependency', 'requires_implementation', 'requires_object_scope') THEN 'unknown_predicate' WHEN s = o THEN 'self_loop' WHEN j IS NULL THEN 'no_justification' ELSE '' END AS reason, count(*) AS n FROM w GROUP BY ALL""",
    "rules_on_changed_files": _B + r""", f AS (SELECT DISTINCT n.repo_id, n.file_path FROM n JOIN changed USING (repo_id, fqn) WHERE n.file_path IS NOT NULL), t AS (SELECT n.repo_id, n.fqn FROM n SEMI JOIN f USING (repo_id, file_path))
SELECT DISTINCT constraint_id FROM (SELECT constraint_id, repo_id, regexp_replace(unnest([subject, object]), '\.\*$', '') AS fqn FROM r) x SEMI JOIN t USING (repo_id, fqn)""",
    "duplicate_keys": "SELECT repo_id, fqn, count(*) AS n FROM fqn_nodes WHERE deleted_at IS NULL GROUP BY 1, 2 HAVING count(*) > 1",
}
