"""Rule check on hand-built graphs, differential search test, metamorphic tests."""

import random

import pytest
from pyspark.sql import functions as F

from archspan.functions import names
from archspan.operators import grounding, model, reach, scoring, search, vectors, violations
from archspan.plans import code, rulecheck
from archspan.runtime import Scratch

NODE = "repo_id string, fqn string, kind string, file_path string, line_start int, line_end int, role string, code_hash string, object_parameters array<string>, guards array<struct<symbol:string,scopes_object:boolean,covers:array<string>>>"
EDGE = "repo_id string, source string, target string, kind string, ord bigint"
RULE = "constraint_id bigint, repo_id string, adr_id string, subject string, predicate string, object string, scope string, justification string, adr_path string"
CHANGED = "repo_id string, fqn string, change_type string"


def node(fqn, kind="module", role="internal", code="h", params=(), guards=()):
    return ("r", fqn, kind, fqn.replace(".", "/") + ".py", 1, 9, role, code, list(params), list(guards))


def build(spark, nodes, edges, rules, changed=()):
    n = spark.createDataFrame(nodes, NODE)
    e = spark.createDataFrame([("r", a, b, k, i) for i, (a, b, k) in enumerate(edges)], EDGE)
    r = model.rules(spark.createDataFrame([(i, "r", adr, s, p, o, sc, "", "") for i, (adr, s, p, o, sc) in enumerate(rules)], RULE))
    return violations.Graph(n, e, r, spark.createDataFrame([("r", f, t) for f, t in changed], CHANGED))


def findings(spark, scratch, *args):
    raw, kept, _ = violations.check(build(spark, *args), scratch)
    return raw, kept


def test_prohibits_reports_owner_of_decisive_edge(spark, scratch):
    nodes = [node("a"), node("a.m"), node("a.m.f", "function"), node("db"), node("lib", role="dev_tool")]
    edges = [("a", "a.m", "CONTAINS"), ("a.m", "a.m.f", "CONTAINS"), ("a.m.f", "db", "CALLS"), ("a.m.f", "lib", "CALLS"), ("lib", "db", "IMPORTS")]
    _, kept = findings(spark, scratch, nodes, edges, [("1", "a", "prohibits_dependency", "db", None), ("2", "a", "prohibits_dependency", "lib", None), ("3", "a", "prohibits_dependency", "db", "tooling")])
    got = [(r.constraint_id, r.changed_fqn, r.matched_fqn, r.status, r.evidence) for r in kept.collect()]
    assert got == [(0, "a", "a.m.f", "EXACT", "a.m.f has dependency path to db via CONTAINS a.m -> CONTAINS a.m.f -> CALLS db")]


def test_wildcard_does_not_match_its_own_base_but_covers_it(spark):
    df = spark.createDataFrame([("a.b", "a.*"), ("a", "a.*"), ("ab", "a.*"), ("a.b", "a.b")], "f string, p string")
    got = [(r.m, r.c) for r in df.select(names.match_status("f", "p").alias("m"), names.subject_covers("p", "f").alias("c")).collect()]
    assert got == [("WILDCARD", True), (None, True), (None, False), ("EXACT", True)]


def test_required_connector_excuses_a_path(spark, scratch):
    nodes = [node(x) for x in ("svc", "conn", "db")]
    edges = [("svc", "conn", "IMPORTS"), ("conn", "db", "IMPORTS")]
    bar = ("1", "svc", "prohibits_dependency", "db", None)
    raw, _ = findings(spark, scratch, nodes, edges, [bar])
    assert raw.count() == 1
    raw, _ = findings(spark, scratch, nodes, edges, [bar, ("2", "conn", "requires_dependency", "db", None)])
    assert raw.count() == 0


def test_requires_and_higher_specificity(spark, scratch):
    nodes = [node("a"), node("a.m"), node("db")]
    edges = [("a", "a.m", "CONTAINS")]
    changed = [("a.m", "modified")]
    rules = [("1", "a.*", "requires_dependency", "db", None)]
    _, kept = findings(spark, scratch, nodes, edges, rules, changed)
    assert [(r.changed_fqn, r.matched_fqn, r.evidence) for r in kept.collect()] == [("a.m", "a.m", "a.m has no dependency on any module matching db")]
    _, kept = findings(spark, scratch, nodes, edges, [*rules, ("2", "a.m", "prohibits_dependency", "db", None)], changed)
    assert kept.count() == 0
    _, kept = findings(spark, scratch, nodes, [*edges, ("a.m", "db", "IMPORTS")], rules, changed)
    assert kept.count() == 0


def test_whole_check_judges_nodes_of_any_age(spark, tmp_path):
    times = {"app": "2024-01-01", "app.old": "2024-01-02", "app.new": "2025-01-01", "db": "2024-01-01"}
    n = spark.createDataFrame([node(f) for f in times], NODE).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz")).withColumn("node_id", F.crc32("fqn"))
    at = F.create_map(*[F.lit(x) for pair in times.items() for x in pair])
    n.withColumn("loaded_at", at[F.col("fqn")].cast("timestamp_ntz")).write.parquet(str(tmp_path / "fqn_nodes.parquet"))
    spark.createDataFrame([("r", "app.dep", "db", "IMPORTS", 0)], EDGE).write.parquet(str(tmp_path / "dep_edges.parquet"))
    rules = spark.createDataFrame([(1, "r", "ADR-1", "app.*", "requires_dependency", "db", None, "", ""), (2, "r", "ADR-2", "db", "requires_dependency", "app", None, "", "")], RULE)
    rules.withColumn("recorded_at", F.when(F.col("constraint_id") == 1, "2024-01-01").otherwise("2025-01-01").cast("timestamp_ntz")).write.parquet(str(tmp_path / "constraint_edges.parquet"))
    found = lambda q: sorted((r.constraint_id, r.changed_fqn) for r in q(spark, str(tmp_path)).collect())
    assert found(rulecheck.check_raw) == [(1, "app.new")]
    assert found(rulecheck.check_all_raw) == [(1, "app"), (1, "app.new"), (1, "app.old"), (2, "db")]
    assert sorted(r.fqn for r in code.all_scopes(spark, str(tmp_path)).collect()) == sorted(times)


@pytest.mark.parametrize("days", (60, None))
def test_nodes_and_changes_come_from_one_pass(spark, days):
    rnd = random.Random(3)
    at = [f"2024-0{m}-0{d} 00:00:00" for m in range(1, 8) for d in (1, 2)]
    rows = [(i, rnd.choice(["r", "s", None]), rnd.choice(["a", "a.b", "c", None, "d"]), rnd.choice(["module", "function"]), rnd.choice(at), rnd.choice([None, None, at[0]])) for i in range(40)]
    rows += [(100, "r", "gone", "module", "2024-09-30 00:00:00", at[0]), (101, "t", "new", "module", None, None)]
    nodes = spark.createDataFrame(rows, "node_id bigint, repo_id string, fqn string, kind string, loaded_at string, deleted_at string").selectExpr("node_id", "repo_id", "fqn", "kind", "cast(loaded_at AS timestamp_ntz) AS loaded_at", "cast(deleted_at AS timestamp_ntz) AS deleted_at")
    own = Scratch(spark, "test")
    current, changed = model.nodes_and_changes(nodes, own, days)
    assert own._n == 1
    for got, want in ((current, model.current_nodes(nodes)), (changed, model.changed_nodes(nodes, days))):
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and want.count()


def test_object_scope(spark, scratch):
    cover = lambda *c, scopes=True: ("g", scopes, list(c))
    nodes = [
        node("h.a", "function", params=["x", "y"], guards=[cover("x")]),
        node("h.b", "function", params=["x", "y"], guards=[cover("x"), cover("y")]),
        node("h.c", "function", params=["x"], guards=[cover()]),
        node("h.d", "function", params=["x"], guards=[cover("x", scopes=False)]),
        node("h.e", "function"),
        node("auth"),
    ]
    _, kept = findings(spark, scratch, nodes, [("h", "h.a", "CONTAINS")], [("1", "h.*", "requires_object_scope", "auth", None)])
    assert sorted(r.matched_fqn for r in kept.collect()) == ["h.a", "h.d"]


def test_fingerprint_and_dismissal(spark, scratch):
    nodes = [node("a", code="1"), node("b", code="2"), node("c", code=None)]
    edges = [("a", "b", "IMPORTS"), ("a", "c", "IMPORTS"), ("c", "b", "IMPORTS")]
    g = build(spark, nodes, edges, [("1", "a", "prohibits_dependency", "b", None), ("1", "c", "prohibits_dependency", "b", None)])
    _, kept, _ = violations.check(g, scratch)
    full = scratch.cut(violations.governed(violations.code_fingerprint(kept, g.nodes), g.edges, g.nodes))
    marks = {r.changed_fqn: r for r in full.collect()}
    assert marks["a"].fingerprint and marks["c"].fingerprint is None and len(marks["a"].short_id) == 5 and marks["c"].fan_in == 1
    off = violations.dismissals(full)
    assert off.count() == 1
    assert [r.changed_fqn for r in violations.not_dismissed(full, off).collect()] == ["c"]


def test_orphans_and_loops(spark, scratch):
    g = build(spark, [node("a"), node("b")], [("a", "b", "IMPORTS")], [("1", "a", "prohibits_dependency", "a", None), ("2", "a", "prohibits_dependency", "zz", None), ("3", "a", "prohibits_dependency", "b", None)])
    _, _, matches = violations.check(g, scratch)
    assert sorted(r.constraint_id for r in violations.orphan_rules(g.rules, matches).collect()) == [0, 1]
    assert [r.state for r in model.rule_states(g.rules).orderBy("constraint_id").collect()] == ["self_loop", "enforced", "enforced"]


def brute_paths(edges, start, kinds, dev, module):
    """Plain breadth-first search with the same opening rule for CONTAINS."""
    out_edges = {}
    for i, (a, b, k) in enumerate(edges):
        out_edges.setdefault(a, []).append((b, k, i))
    best, seen, level = {}, {(start, True)}, [(start, True)]
    seeds = [b for b, k, _ in out_edges.get(module, ()) if k in kinds and k != "CONTAINS" and b != module and not b.startswith(module + ".") and b not in dev] if module else []
    length = 0
    while level or (seeds and length == 0):
        length += 1
        ahead = {(b, False) for b in seeds} if length == 1 else set()
        for at, down in level:
            ahead |= {(b, down and k == "CONTAINS") for b, k, _ in out_edges.get(at, ()) if k in kinds and (k != "CONTAINS" or down) and b not in dev}
        level = [x for x in ahead if x not in seen]
        seen |= ahead
        for b, _ in ahead:
            best.setdefault(b, length)
    return best


@pytest.mark.parametrize("seed", range(2))
def test_search_against_plain_search(spark, scratch, seed):
    rnd = random.Random(seed)
    names_ = ["p", *(f"p.m{i}" for i in range(3)), *(f"p.m{i}.f{j}" for i in range(3) for j in range(2)), "x", "y", "z"]
    kinds = {n: "package" if n == "p" else "module" if n.count(".") == 1 or len(n) == 1 else "function" for n in names_}
    edges = [(n.rpartition(".")[0], n, "CONTAINS") for n in names_ if "." in n]
    edges += [(rnd.choice(names_), rnd.choice(names_), rnd.choice(["IMPORTS", "CALLS", "INHERITS"])) for _ in range(25)]
    edges = list(dict.fromkeys(edges))
    g = build(spark, [node(n, kinds[n], role="dev_tool" if n == "z" else "internal") for n in names_], edges, [])
    starts = spark.createDataFrame([("r", f, n) for n in names_ for f in ("dependency", "implementation")], "repo_id string, family string, start string")
    got = {}
    for r in reach.first_paths(starts, reach.steps(g.edges, g.dev), ["repo_id", "family"], g.modules, scratch).collect():
        got.setdefault((r.family, r.start), {})[r.target] = r.len
    mods = {r.fqn: r.module for r in g.modules.collect()}
    for f, ks in model.FAMILIES.items():
        for n in names_:
            assert got.get((f, n), {}) == brute_paths(edges, n, set(ks), {"z"}, mods.get(n)), (f, n)


def test_a_rule_between_two_packages_makes_no_pairs(spark, scratch):
    """Every name of a against every name of b would be 16 million pairs; only the edges count."""
    nodes = [node(x, "module") for p in "ab" for x in (p, *(f"{p}.m{i}" for i in range(4000)))]
    edges = [("a.m1", "b.m7", "IMPORTS"), ("a.m1", "a.m2", "IMPORTS"), ("a.m2", "b.m8", "CALLS"), ("b.m8", "a.m3", "IMPORTS")]
    raw, _ = findings(spark, scratch, nodes, edges, [("1", "a.*", "prohibits_dependency", "b.*", None)])
    assert {(r.changed_fqn, r.evidence.split(" via ")[0].split()[-1]) for r in raw.collect()} == {("a.m1", "b.m7"), ("a.m1", "b.m8"), ("a.m2", "b.m8")}


@pytest.mark.parametrize("seed", range(2))
def test_search_of_a_check_against_rounds(spark, scratch, seed, monkeypatch):
    """Every first path to every name, in several blocks of groups, is the one that the search in rounds finds."""
    monkeypatch.setattr(search, "GROUPS", 9)
    rnd = random.Random(seed)
    names_ = ["p", *(f"p.m{i}" for i in range(3)), *(f"p.m{i}.f{j}" for i in range(3) for j in range(2)), "x", "x.y", "z"]
    kinds = {n: "package" if n == "p" else "module" if n.count(".") == 1 or len(n) == 1 else "function" for n in names_}
    edges = [(n.rpartition(".")[0], n, "CONTAINS") for n in names_ if "." in n] + [(rnd.choice(names_), rnd.choice(names_), rnd.choice(["IMPORTS", "CALLS", "INHERITS", "CONTAINS", "OTHER"])) for _ in range(30)]
    edges = list(dict.fromkeys(edges))
    rnd.shuffle(edges)
    g = build(spark, [node(n, kinds[n], role="dev_tool" if n == "z" else "internal") for n in names_], edges, [])
    keys = [(i, "r", f, n) for i, (f, n) in enumerate((f, n) for f in model.FAMILIES for n in names_)]
    objs = spark.createDataFrame(keys, "g bigint, repo_id string, family string, object_fqn string")
    starts = spark.createDataFrame([(i, r, f, n, True) for i, r, f, _ in keys for n in [*names_, "gone"]], "g bigint, repo_id string, family string, start string, walk boolean")
    found = search.searched(objs, starts, g.edges, g.dev, g.modules).collect()
    of = {i: (f, o) for i, _, f, o in keys}
    got = {(*of[r.g], r.start, r.target): r.path for r in found if r.target is not None}
    assert {(*of[r.g], r.start) for r in found if r.target is None} == {k[:3] for k in got}
    rounds = reach.first_paths(starts.select("repo_id", "family", "start"), reach.steps(g.edges, g.dev), ["repo_id", "family"], g.modules, scratch).collect()
    assert got == {(r.family, o, r.start, r.target): r.path for r in rounds for o in names_ if r.target == o or r.target.startswith(o + ".")} and got


def test_search_gives_the_edges_of_its_paths(spark):
    """Hops and excuses need the edges on paths only, not a look at all edges of all repositories."""
    nodes = [node("p"), node("p.f", "function"), *(node(x) for x in "abcd")]
    edges = [("p", "a", "IMPORTS"), ("a", "b", "CALLS"), ("b", "c", "INHERITS"), ("d", "a", "IMPORTS"), ("p", "p.f", "CONTAINS"), ("c", "d", "CALLS")]
    g = build(spark, nodes, edges, [])
    objs = spark.createDataFrame([(1, "r", "dependency", "c")], "g bigint, repo_id string, family string, object_fqn string")
    starts = spark.createDataFrame([(1, "r", "dependency", x, True) for x in ("p.f", "b")], "g bigint, repo_id string, family string, start string, walk boolean")
    args = (objs, starts, g.edges, g.dev, g.modules)
    found = search.found_and_edges(*args).collect()
    assert sorted(tuple(r.edge) for r in found if r.edge) == [("r", i, *(edges[i][j] for j in (0, 2, 1))) for i in range(3)]
    assert all((r.edge is None) != (r.g is None) for r in found)
    assert sorted(map(repr, search.searched(*args).collect())) == sorted(repr(r).replace(", edge=None", "") for r in found if r.g)


def test_rule_matches_leave_out_patterns_that_no_rule_has(spark, scratch):
    rnd = random.Random(1)
    names_ = [f"{a}.{b}{i}.{c}" for a in "pq" for b in "xy" for i in range(30) for c in "fg"]
    patterns = [*rnd.sample(names_, 8), *(f"p.x{i}.*" for i in range(5)), "q.*", "p.none.*"]
    g = build(spark, [node(n, "function") for n in names_] + [node(x) for x in ("p", "p.x1", "q")], [], [(str(i), rnd.choice(patterns), "prohibits_dependency", rnd.choice(patterns), None) for i in range(40)])
    written = reach.rule_matches(g.rules, g.nodes, scratch)
    assert sorted(written.collect()) == sorted(reach.rule_matches(g.rules, g.nodes).collect()) and written.count()
    some = g.nodes.where("fqn LIKE 'p.x1.%'")
    assert [tuple(r) for r in model.enclosing_modules(g.nodes, some).sort("fqn").collect()] == [("r", f"p.x1.{c}", "p.x1") for c in "fg"]


def test_tables_of_a_check_do_not_grow_with_depth(spark):
    """A round of jobs per few steps filled the driver with plans; the number of written tables must not depend on the graph."""
    made = []
    for depth in (3, 40):
        scratch = Scratch(spark, "test")
        raw, _ = findings(spark, scratch, [node(f"m{i}") for i in range(depth)], [(f"m{i}", f"m{i + 1}", "IMPORTS") for i in range(depth - 1)], [("1", "m0", "prohibits_dependency", f"m{depth - 1}", None)])
        assert [r.evidence.count("IMPORTS") for r in raw.collect()] == [depth - 1]
        made.append(scratch._n)
    assert made[0] == made[1]


def test_partitions_change_nothing(spark, scratch):
    nodes = [node(f"m{i}") for i in range(8)]
    edges = [(f"m{i}", f"m{(i * 3 + d) % 8}", k) for i in range(8) for d, k in ((1, "IMPORTS"), (2, "CALLS"))]
    rules = [("1", f"m{i}", "prohibits_dependency", f"m{(i + 5) % 8}", None) for i in range(8)]
    raw, _ = findings(spark, scratch, nodes, edges, rules)
    want = sorted(raw.select("constraint_id", "changed_fqn", "matched_fqn", "evidence").collect())
    g = build(spark, nodes, edges, rules)
    g2 = violations.Graph(g.nodes.repartition(7), g.edges.repartition(5), g.rules.repartition(3), g.changed)
    raw2, _, _ = violations.check(g2, scratch)
    assert sorted(raw2.select("constraint_id", "changed_fqn", "matched_fqn", "evidence").collect()) == want and want


def test_search_tiers(spark, scratch):
    c = spark.createDataFrame([("r", "app.Users", "class"), ("r", "app.users.api", "module"), ("r", "lib.app_users", "module"), ("r", "a.p.p", "module")], "repo_id string, fqn string, kind string")
    q = spark.createDataFrame([(1, "r", "APP.users"), (2, "r", "app_u"), (3, "r", "app"), (4, "r", " "), (5, "r", None), (6, "r", "apsr"), (7, "r", "zzz")], "query_id int, repo_id string, query string")
    got = {}
    for r in grounding.name_search(q, c, scratch).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.fqn)
    assert got == {1: ["app.Users", "app.users.api"], 2: ["lib.app_users"], 3: ["app.Users", "app.users.api"], 6: ["app.Users", "app.users.api", "lib.app_users"]}
    refused = grounding.name_search(q.where("query_id = 6"), c, scratch, cap=2).collect()
    assert [(r.refused, r.n_relaxed, r.fqn) for r in refused] == [(True, 3, None)]


def brute_resolved(rows, active):
    """Resolution as it is stated: first per rule and name, parents over children, pairs of findings, then active rules."""
    covers = lambda p, f: p == f or (p.endswith(".*") and (f == p[:-2] or f.startswith(p[:-1])))
    stance = lambda r: "p" if r["predicate"].startswith("prohibits") else "r" if r["predicate"] in ("requires_dependency", "requires_implementation") else ""
    kept = list({(r["constraint_id"], r["matched_fqn"]): r for r in reversed(rows)}.values())
    kept = [r for r in kept if not any(q["constraint_id"] == r["constraint_id"] and r["matched_fqn"].startswith(q["matched_fqn"] + ".") for q in kept)]
    gone = set()
    for i, a in enumerate(kept):
        for j, b in enumerate(kept):
            if i == j or i in gone or j in gone or a["object"] != b["object"] or {stance(a), stance(b)} != {"p", "r"}:
                continue
            for x, y, n in ((a, b, i), (b, a, j)):
                if covers(y["subject"], x["matched_fqn"]) and y["specificity"] > x["specificity"]:
                    gone.add(n)
    kept = [r for i, r in enumerate(kept) if i not in gone]
    over = lambda q, r: q["object"] == r["object"] and covers(q["subject"], r["matched_fqn"])
    kept = [r for r in kept if not (stance(r) == "p" and any(stance(q) == "r" and q["specificity"] > r["specificity"] and over(q, r) for q in active))]
    return [r for r in kept if not (stance(r) == "r" and any(stance(q) == "p" and (q["specificity"], q["adr"]) > (r["specificity"], r["adr"]) and over(q, r) for q in active))]


def test_resolution_against_pairwise_conflicts(spark):
    """The outweighing rules alone give what pairwise conflicts and outweighing rules give together."""
    rnd = random.Random(11)
    fqns = ["a", "a.b", "a.b.c", "a.d", "e"]
    predicates = ["prohibits_dependency", "requires_dependency", "prohibits_implementation", "requires_implementation", "requires_object_scope"]
    schema = "constraint_id bigint, repo_id string, adr string, subject string, predicate string, object string, specificity double, matched_fqn string, phase int, ord1 string, ord2 string, ord3 string"
    for _ in range(6):
        active, rows = [], []
        for i in range(14):
            subject = rnd.choice(fqns) + rnd.choice(["", ".*"])
            rule = {"constraint_id": i, "repo_id": "r", "adr": f"{rnd.randint(1, 3):06}", "subject": subject, "predicate": rnd.choice(predicates), "object": rnd.choice(["x", "y"]), "specificity": subject.rstrip(".*").count(".") + 1 + (0.0 if subject.endswith("*") else 1.0)}
            active.append(rule)
            rows += [rule | {"matched_fqn": f} for f in fqns if rnd.random() < 0.5]
        rows = [r | {"phase": 0, "ord1": f"{n:06}", "ord2": "", "ord3": ""} for n, r in enumerate(rows)]
        found = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
        rules = found.sparkSession.createDataFrame([tuple(r[c] for c in ("constraint_id", "repo_id", "adr", "subject", "predicate", "object", "specificity")) for r in active], "constraint_id bigint, repo_id string, adr string, subject string, predicate string, object string, specificity double")
        got = violations.outweighed(violations.without_covered_children(violations.deduplicated(found)), rules)
        assert {(r.constraint_id, r.matched_fqn) for r in got.collect()} == {(r["constraint_id"], r["matched_fqn"]) for r in brute_resolved(rows, active)}


def test_rule_scores(spark):
    s = "repo_id string, adr_no bigint, subject string, predicate string, object string, scope string"
    gold = spark.createDataFrame([("r", 1, "a.b.*", "p", "x", None), ("r", 1, "a.c", "p", "y", None), ("r", 2, "q", "p", "z", None)], s)
    store = spark.createDataFrame([("r", 1, "a.b.*", "p", "x", "runtime"), ("r", 1, "a.c.d", "p", "y.*", "runtime"), ("r", 3, "a.b.k", "p", "x", "tooling"), ("r", 3, "w", "p", "x", "tooling"), ("r", 3, "v", "p", "x", "runtime")], s)
    assert {r.subject: r.score for r in scoring.rule_scores(gold, store).collect()} == {"a.b.*": "exact", "a.c": "partial", "q": "miss"}
    assert {r.subject: r.account for r in scoring.false_positives(gold, store).collect()} == {"a.b.*": "matched", "a.c.d": "matched", "a.b.k": "fragment", "w": "tooling", "v": "false_positive"}
    gate = scoring.ratchet(scoring.rule_scores(gold, store), 1.5, scoring.false_positives(gold, store), 1).first()
    assert (gate.blended, gate.n_fp, gate.passed) == (1.5, 1, True)


def test_upper_median_and_auc(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 9.0), ("b", 5.0), ("b", None)], "g string, v double")
    assert {r.g: (r.median, r.least, r.greatest) for r in scoring.upper_median(df, "v", "g").collect()} == {"a": (3.0, 1.0, 9.0), "b": (5.0, 5.0, 5.0)}
    rnd = random.Random(3)
    data = [(float(rnd.randint(0, 5)), rnd.random() < 0.4) for _ in range(80)]
    pos, neg = [s for s, p in data if p], [s for s, p in data if not p]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    assert scoring.rank_auc(spark.createDataFrame(data, "score double, positive boolean")).first().auc == pytest.approx(want, abs=1e-6)
    assert scoring.rank_auc(spark.createDataFrame([], "score double, positive boolean")).first().auc is None


def test_vectors_blocks_agree(spark):
    rnd = random.Random(5)
    v = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(50)] + [(50, [0.0] * 4), (51, None)], "vec_id bigint, embedding array<float>")
    q = v.where("vec_id % 10 = 0 AND vec_id < 50")
    a = sorted(map(tuple, vectors.cosine_top_k(v, q, 3).collect()))
    assert a == sorted(map(tuple, vectors.cosine_top_k(v, q, 3, queries_per_block=2).collect())) and len(a) == 15
    assert vectors.cosine_top_k(v, q.limit(0), 3).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("a/b/__init__.py",), ("a\\b.py",), (None,), ("x.py",)], "p string")
    assert [r[0] for r in df.select(names.path_to_fqn("p")).collect()] == ["a.b", "a.b", None, "x"]
    ok = spark.createDataFrame([("a.b",), ("",), (".a",), ("a..b",), ("a.",), (None,)], "f string").select(names.is_fqn("f")).collect()
    assert [r[0] for r in ok] == [True, False, False, False, False, False]
    r = spark.createDataFrame([("a.b.c",)], "f string").select(names.ancestors("f").alias("a"), names.suffixes("f").alias("s"), names.parent("f").alias("p"), names.ancestors(F.lit("x"), proper=True).alias("e")).first()
    assert (r.a, r.s, r.p, r.e) == (["a", "a.b", "a.b.c"], ["a.b.c", "b.c", "c"], "a.b", [])
