"""SQL of the graph model and the rule check, in DuckDB's dialect."""

from __future__ import annotations

BASE = r"""
WITH RECURSIVE
n AS (SELECT repo_id, fqn, unnest(arg_max(struct_pack(node_id, kind, file_path, line_start, line_end, role, code_hash, object_parameters, guards, loaded_at), struct_pack(loaded_at, node_id)))
  FROM fqn_nodes WHERE deleted_at IS NULL GROUP BY repo_id, fqn),
e AS (SELECT repo_id, source, target, upper(trim(kind)) AS kind, min(ord) AS ord FROM dep_edges GROUP BY ALL),
r0 AS (SELECT repo_id, lpad(CAST(CAST(regexp_extract(adr_id, '[0-9]+') AS BIGINT) AS VARCHAR), 6, '0') AS adr, trim(subject) AS subject, predicate, trim(object) AS object, constraint_id,
    CASE WHEN lower(coalesce(scope, 'runtime')) = 'tooling' THEN 'tooling' ELSE 'runtime' END AS scope, justification, adr_path FROM constraint_edges),
r AS (SELECT min(constraint_id) AS constraint_id, repo_id, adr, subject, predicate, object, arg_min(scope, constraint_id) AS scope, arg_min(adr_path, constraint_id) AS adr_path,
    len(string_split(regexp_replace(subject, '\.\*$', ''), '.')) + CASE WHEN subject LIKE '%.*' THEN 0.0 ELSE 1.0 END AS specificity
  FROM r0 GROUP BY repo_id, adr, subject, predicate, object),
live AS (SELECT * FROM r WHERE scope <> 'tooling' AND subject <> object),
anc AS (SELECT repo_id, fqn, kind, array_to_string(p[1:i], '.') AS top, i = len(p) AS self FROM (SELECT *, string_split(fqn, '.') AS p FROM n), unnest(range(1, len(p) + 1)) AS u(i)),
keys AS (SELECT repo_id, fqn, CASE WHEN self THEN top ELSE top || '.*' END AS pattern FROM anc),
hits AS (SELECT constraint_id, r.repo_id, 'subject' AS side, fqn, CASE WHEN subject = fqn THEN 'EXACT' ELSE 'WILDCARD' END AS status FROM live r JOIN keys k ON k.repo_id = r.repo_id AND k.pattern = r.subject
  UNION ALL SELECT constraint_id, r.repo_id, 'object', fqn, CASE WHEN object = fqn THEN 'EXACT' ELSE 'WILDCARD' END FROM live r JOIN keys k ON k.repo_id = r.repo_id AND k.pattern = r.object),
m AS (SELECT * FROM hits WHERE constraint_id IN (SELECT constraint_id FROM hits GROUP BY 1 HAVING count(DISTINCT side) = 2)),
dev AS (SELECT repo_id, fqn FROM n WHERE lower(role) = 'dev_tool' OR (kind = 'external' AND split_part(fqn, '.', 1) IN ({tools}))),
mods AS (SELECT a.repo_id, a.fqn, arg_max(a.top, length(a.top)) AS module FROM anc a JOIN n p ON p.repo_id = a.repo_id AND p.fqn = a.top AND p.kind = 'module' WHERE NOT a.self AND a.kind IN ('function', 'method', 'class') GROUP BY 1, 2),
changed AS (SELECT n.repo_id, n.fqn, CASE WHEN c.k > 1 THEN 'modified' ELSE 'added' END AS change_type FROM n
  JOIN (SELECT repo_id, max(loaded_at) AS e FROM fqn_nodes GROUP BY 1) l USING (repo_id) JOIN (SELECT repo_id, fqn, count(*) AS k FROM fqn_nodes GROUP BY 1, 2) c USING (repo_id, fqn)
  WHERE n.loaded_at >= l.e - INTERVAL 60 DAYS)"""

CHECK = r""",
active AS (SELECT * FROM live WHERE constraint_id IN (SELECT constraint_id FROM m)),
te AS (SELECT f.family, e.* FROM e ANTI JOIN dev d ON d.repo_id = e.repo_id AND d.fqn = e.target CROSS JOIN (VALUES ('dependency'), ('implementation')) f(family) WHERE f.family = 'dependency' OR e.kind <> 'IMPORTS'),
objs AS (SELECT a.*, regexp_extract(a.predicate, '_(dependency|implementation)$', 1) AS family, m.fqn AS object_fqn, m.status AS object_status FROM m JOIN active a USING (constraint_id)
  ANTI JOIN dev d ON d.repo_id = m.repo_id AND d.fqn = m.fqn WHERE m.side = 'object'),
changed_up AS (SELECT repo_id, fqn, change_type, array_to_string(p[1:i], '.') AS top FROM (SELECT *, string_split(fqn, '.') AS p FROM changed), unnest(range(1, len(p) + 1)) AS u(i)),
asked AS (
  SELECT a.*, c.fqn AS changed_fqn, c.change_type, CASE WHEN a.subject LIKE '%.*' THEN c.fqn ELSE a.subject END AS start, CASE WHEN a.subject LIKE '%.*' THEN 'WILDCARD' ELSE 'EXACT' END AS subject_status,
    regexp_extract(a.predicate, '_(dependency|implementation)$', 1) AS family
  FROM active a JOIN changed_up c ON c.repo_id = a.repo_id AND c.top = regexp_replace(a.subject, '\.\*$', '') WHERE a.predicate IN ('requires_dependency', 'requires_implementation')),
starts AS (
  SELECT DISTINCT m.repo_id, regexp_extract(a.predicate, '_(dependency|implementation)$', 1) AS family, m.fqn AS start FROM m JOIN active a USING (constraint_id) WHERE m.side = 'subject' AND a.predicate LIKE 'prohibits_%'
  UNION SELECT repo_id, family, start FROM asked),
bfs(repo_id, family, start, node, descending, path) USING KEY (repo_id, family, start, node, descending) AS (
  SELECT repo_id, family, start, start, true, CAST([] AS BIGINT[]) FROM starts
  UNION
  SELECT repo_id, family, start, target, down, min(path) FROM (
    SELECT b.repo_id, b.family, b.start, t.target, b.descending AND t.kind = 'CONTAINS' AS down, list_append(b.path, t.ord) AS path
    FROM bfs b JOIN te t ON t.repo_id = b.repo_id AND t.family = b.family AND t.source = b.node WHERE t.kind <> 'CONTAINS' OR b.descending
    UNION ALL
    SELECT b.repo_id, b.family, b.start, t.target, false, [t.ord - 1152921504606846976]
    FROM bfs b JOIN mods s ON s.repo_id = b.repo_id AND s.fqn = b.start JOIN te t ON t.repo_id = b.repo_id AND t.family = b.family AND t.source = s.module
    WHERE len(b.path) = 0 AND t.kind <> 'CONTAINS' AND t.target <> s.module AND NOT starts_with(t.target, s.module || '.')) x
  WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs k WHERE k.repo_id = x.repo_id AND k.family = x.family AND k.start = x.start AND k.node = x.target AND k.descending = x.down)
  GROUP BY repo_id, family, start, target, down),
paths AS (SELECT repo_id, family, start, node AS target, min(struct_pack(l := len(path), path := path)) AS p FROM bfs WHERE len(path) > 0 GROUP BY 1, 2, 3, 4),
"""

RAW = CHECK + r"""
hit0 AS (SELECT o.constraint_id, o.repo_id, o.family, s.fqn AS start, s.status AS subject_status, o.object_fqn, o.object_status, p.target, p.p.l AS l, p.p.path AS path
  FROM objs o JOIN m s ON s.constraint_id = o.constraint_id AND s.side = 'subject' JOIN paths p ON p.repo_id = o.repo_id AND p.family = o.family AND p.start = s.fqn
    AND (p.target = o.object_fqn OR starts_with(p.target, o.object_fqn || '.')) WHERE o.predicate LIKE 'prohibits_%'),
steps AS (SELECT h.*, i AS at, CASE WHEN path[i] < 0 THEN path[i] + 1152921504606846976 ELSE path[i] END AS ord FROM hit0 h, unnest(range(1, l + 1)) AS u(i)),
hop AS (SELECT s.*, e.source, e.kind, e.target AS hop_target FROM steps s JOIN e ON e.repo_id = s.repo_id AND e.ord = s.ord),
pat AS (SELECT fqn, CASE WHEN i = len(p) THEN fqn ELSE array_to_string(p[1:i], '.') || '.*' END AS pattern FROM (SELECT fqn, string_split(fqn, '.') AS p FROM (SELECT source AS fqn FROM hop UNION SELECT object_fqn FROM hit0)), unnest(range(1, len(p) + 1)) AS u(i)),
cover AS (SELECT DISTINCT h.constraint_id, h.start, h.object_fqn, h.target, h.at FROM hop h JOIN pat ps ON ps.fqn = h.source JOIN pat po ON po.fqn = h.object_fqn
  JOIN active q ON q.repo_id = h.repo_id AND q.subject = ps.pattern AND q.object = po.pattern AND q.predicate IN ('requires_dependency', 'requires_implementation') AND regexp_extract(q.predicate, '_(dependency|implementation)$', 1) = h.family WHERE h.at > 1),
excused AS (SELECT h.constraint_id, h.start, h.object_fqn, h.target FROM hit0 h JOIN cover c USING (constraint_id, start, object_fqn, target) WHERE h.l > 1 GROUP BY 1, 2, 3, 4, h.l HAVING count(*) = h.l - 1),
chosen AS (SELECT constraint_id, start, object_fqn, arg_min(target, struct_pack(l, path)) AS target FROM hit0 ANTI JOIN excused USING (constraint_id, start, object_fqn, target) GROUP BY 1, 2, 3),
walked AS (SELECT h.constraint_id, h.repo_id, h.start, h.object_fqn, any_value(h.subject_status) AS ss, any_value(h.object_status) AS os, list(struct_pack(source := h.source, kind := h.kind, target := h.hop_target) ORDER BY h.at) AS hops
  FROM hop h JOIN chosen c USING (constraint_id, start, object_fqn, target) GROUP BY 1, 2, 3, 4),
owned AS (SELECT w.*, coalesce(s.module, w.start) AS report FROM walked w LEFT JOIN mods s ON s.repo_id = w.repo_id AND s.fqn = w.start),
bad AS (
  SELECT a.constraint_id, a.repo_id, a.adr, a.subject, a.predicate, a.object, a.specificity, w.start AS changed_fqn,
    CASE WHEN w.hops[1].kind = 'CONTAINS' THEN coalesce(list_filter(w.hops, lambda h: h.kind <> 'CONTAINS')[1].source, w.report) ELSE w.report END AS matched_fqn,
    CASE WHEN w.ss = 'EXACT' OR w.os = 'EXACT' THEN 'EXACT' ELSE 'WILDCARD' END AS status, w.object_fqn, w.hops
  FROM owned w JOIN active a USING (constraint_id)),
up AS (SELECT DISTINCT repo_id, family, start, array_to_string(seg[1:i], '.') AS object_fqn FROM (SELECT repo_id, family, start, string_split(target, '.') AS seg FROM paths), unnest(range(1, len(seg) + 1)) AS u(i)),
met AS (SELECT DISTINCT k.constraint_id, k.start FROM asked k JOIN m o ON o.constraint_id = k.constraint_id AND o.side = 'object' JOIN up ON up.repo_id = k.repo_id AND up.family = k.family AND up.start = k.start AND up.object_fqn = o.fqn),
raw AS (
  SELECT constraint_id, repo_id, adr, subject, predicate, object, specificity, changed_fqn, matched_fqn, status,
    matched_fqn || CASE predicate WHEN 'prohibits_dependency' THEN ' has dependency path to ' ELSE ' implements ' END || object_fqn || ' via ' || array_to_string(list_transform(hops, lambda h: h.kind || ' ' || h.target), ' -> ') AS evidence,
    'structural' AS change_type, list_transform(hops, lambda h: h.target) AS hops, 0 AS phase, printf('%020d', constraint_id) AS ord1, changed_fqn AS ord2, object_fqn AS ord3 FROM bad
  UNION ALL
  SELECT k.constraint_id, k.repo_id, k.adr, k.subject, k.predicate, k.object, k.specificity, k.changed_fqn, k.start,
    CASE WHEN k.subject_status = 'EXACT' OR EXISTS (SELECT 1 FROM m o WHERE o.constraint_id = k.constraint_id AND o.side = 'object' AND o.status = 'EXACT') THEN 'EXACT' ELSE 'WILDCARD' END,
    k.start || CASE k.predicate WHEN 'requires_dependency' THEN ' has no dependency on any module matching ' ELSE ' does not implement any module matching ' END || k.object, k.change_type, NULL, 1, k.changed_fqn, printf('%020d', k.constraint_id), k.start
  FROM asked k ANTI JOIN met USING (constraint_id, start) WHERE k.constraint_id IN (SELECT constraint_id FROM objs)
  UNION ALL
  SELECT a.constraint_id, a.repo_id, a.adr, a.subject, a.predicate, a.object, a.specificity, n.fqn, n.fqn, s.status,
    n.fqn || ' loads ' || array_to_string(n.object_parameters, ', ') || ' without an object-scope guard for ' || a.object || ': ' || a.predicate, 'structural', NULL, 2, printf('%020d', a.constraint_id), n.fqn, ''
  FROM active a JOIN m s ON s.constraint_id = a.constraint_id AND s.side = 'subject' JOIN n ON n.repo_id = a.repo_id AND n.fqn = s.fqn
  WHERE a.predicate = 'requires_object_scope' AND len(n.object_parameters) > 0
    AND EXISTS (SELECT 1 FROM unnest(n.object_parameters) AS u(q) WHERE NOT list_bool_or(list_transform(list_filter(coalesce(n.guards, []), lambda g: coalesce(g.scopes_object, false)), lambda g: coalesce(len(g.covers), 0) = 0 OR list_contains(g.covers, u.q)) || [false])))"""

FINAL = RAW + r""",
one AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY constraint_id, matched_fqn ORDER BY phase, ord1, ord2, ord3) = 1),
top AS (SELECT * FROM one o WHERE NOT EXISTS (SELECT 1 FROM one q WHERE q.constraint_id = o.constraint_id AND starts_with(o.matched_fqn, q.matched_fqn || '.'))),
kept AS (SELECT * FROM top v WHERE NOT EXISTS (
  SELECT 1 FROM active q WHERE q.repo_id = v.repo_id AND q.object = v.object
    AND (q.subject = v.matched_fqn OR (q.subject LIKE '%.*' AND (v.matched_fqn = regexp_replace(q.subject, '\.\*$', '') OR starts_with(v.matched_fqn, regexp_replace(q.subject, '\*$', '')))))
    AND ((v.predicate LIKE 'prohibits_%' AND q.predicate IN ('requires_dependency', 'requires_implementation') AND q.specificity > v.specificity)
      OR (v.predicate IN ('requires_dependency', 'requires_implementation') AND q.predicate LIKE 'prohibits_%' AND (q.specificity > v.specificity OR (q.specificity = v.specificity AND q.adr > v.adr))))))"""
