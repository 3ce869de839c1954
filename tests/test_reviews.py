"""Snapshots of scopes, changes of commits, classes of fires, provenance, parsed rules."""

import json

from pyspark.sql import functions as F

from archspan.operators import reviews, scoring
from archspan.plans import analysis, reviewing, rulecheck

SNAP = "row_no bigint, line_id bigint, from_sha string, to_sha string, fqn string, kind string, file_path string, code_hash string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_scope_snapshots(spark):
    found = spark.createDataFrame([(1, "r", "requires_dependency", "m.f", "m.f"), (2, "r", "prohibits_dependency", "m.f", "m.f"), (3, "r", "requires_implementation", "m", "m")], "constraint_id bigint, repo_id string, predicate string, changed_fqn string, matched_fqn string")
    edges = spark.createDataFrame([("r", "m", "x", "IMPORTS", 4), ("r", "m", "m.f", "CONTAINS", 1), ("r", "m", "y", "CALLS", 2), ("q", "m", "z", "CALLS", 3)], "repo_id string, source string, target string, kind string, ord bigint")
    modules = spark.createDataFrame([("r", "m.f", "m")], "repo_id string, fqn string, module string")
    got = rows(reviews.scope_snapshots(found, edges, modules).drop("matched_fqn"))
    assert got == [
        (1, "m.f", 0, "changed", "m.f", -1, None, None),
        (1, "m.f", 1, "enclosing_module", "m", 0, "CALLS", "y"),
        (1, "m.f", 1, "enclosing_module", "m", 1, "IMPORTS", "x"),
        (3, "m", 0, "changed", "m", 0, "CALLS", "y"),
        (3, "m", 0, "changed", "m", 1, "IMPORTS", "x"),
    ]
    assert reviews.scope_snapshots(found.limit(0), edges, modules).count() == 0


def test_changed_names_and_renamed_files(spark):
    def snap(sha, before, *names):
        return [(0, 1, before, sha, f, k, p, h) for f, k, p, h in names]

    old = snap("s1", None, ("a", "module", "a.py", "1"), ("a.f", "function", "a.py", "2"), ("a.K.m", "method", "a.py", "3"), ("b", "module", "b.py", "4"), ("o", "module", "o.py", "5"), ("o.g", "function", "o.py", "Q"), (".x.f", "function", ".x/f.py", "1"))
    new = snap("s2", "s1", ("a", "module", "a.py", "9"), ("a.f", "function", "a.py", "2"), ("a.K.m", "method", "a.py", "8"), ("b", "module", "./b.py", "7"), ("n", "module", "n.py", "6"), ("n.g", "function", "n.py", "q"))
    df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(old + new)], SNAP)
    changes = spark.createDataFrame([(1, "s2", f, k) for f, k in (("a", "changed"), ("a.K.m", "changed"), ("b", "changed"), ("o", "removed"), ("o.g", "removed"), ("n", "added"), ("n.g", "added"), (".x.f", "removed"))], "line_id bigint, to_sha string, fqn string, change_kind string")
    got = {(r.fqn, r.change_type, r.file_path, r.enclosing_class, r.enclosing_module) for r in reviews.changed_names(changes, df).collect()}
    assert got == {("a.K.m", "modified", "a.py", "a.K", "a"), ("b", "modified", "b.py", None, "b"), ("o.g", "deleted", "o.py", None, "o"), ("n.g", "added", "n.py", None, "n")}
    assert rows(reviews.renamed_files(changes, df)) == [(1, "s2", "o.py", "n.py")]
    two = df.unionByName(spark.createDataFrame([(99, 1, "s1", "s2", "n2.g", "function", "n2.py", "q")], SNAP))
    assert reviews.renamed_files(changes, two).count() == 0, "two candidates are no rename"
    assert reviews.changed_names(changes.limit(0), df).count() == 0 and reviews.renamed_files(changes, df.limit(0)).count() == 0


def test_fire_classes(spark):
    schema = "repo_id string, adr_id string, predicate string, subject string, object string, matched_fqn string"
    base = spark.createDataFrame([("r", "1", "requires_dependency", "a.*", "b", "a.m"), ("r", None, "prohibits_dependency", "a", "b", "a")], schema)
    fires = base.unionByName(spark.createDataFrame([("r", "1", "requires_dependency", "a.*", "b", "a.n"), ("r", "1", "requires_dependency", "a", "b", "a.n"), ("q", "1", "prohibits_dependency", "a.*", "b", "a")], schema))
    got = [r.fire_class for r in reviews.fire_classes(fires, base).orderBy("repo_id", "adr_id", "subject", "matched_fqn").collect()]
    assert sorted(got) == ["arm_candidate", "arm_candidate", "merge_mechanism", "structural", "structural"]


def test_result_names_and_provenance(spark):
    data = [(1, json.dumps([{"fqn": "app.users"}, {"fqn": "app.users"}, {"x": 1}])), (2, json.dumps({"entries": [{"fqn": "lib"}], "truncated": True})), (3, "error: no such package"), (4, json.dumps([{"fqn": "x" * 16_000}])), (5, None)]
    got = spark.createDataFrame(data, "constraint_id bigint, payload string").select("constraint_id", reviews.result_names(F.col("payload")).alias("f"))
    assert {r.constraint_id: r.f for r in got.collect() if r.f} == {1: ["app.users"], 2: ["lib"]}
    rules = spark.createDataFrame([(1, "r", "app.*", "lib"), (2, "r", "z", "lib.x"), (3, "r", "z", "ext.y"), (5, "r", "z", "app.q")], "constraint_id bigint, repo_id string, subject string, object string")
    results = got.select("constraint_id", F.explode("f").alias("fqn"))
    roots = spark.createDataFrame([("r", "app")], "repo_id string, root string")
    assert rows(reviews.provenance_classes(rules, results, roots)) == [(1, True, False, "B/C"), (2, False, True, "B/C"), (3, False, False, "A"), (5, False, False, "other")]


def test_bound_fields_and_packages(spark):
    kwargs = {"id__in": "id", "user__tenant": "tenant", "created_by__in": "created_by", "in": "in", "a__b__date__GTE": "b", "exact__in": "exact"}
    got = spark.createDataFrame([(k,) for k in kwargs], "k string").select("k", reviews.bound_field("k").alias("f")).collect()
    assert {r.k: r.f for r in got} == kwargs
    specs = {"pytest>=8.2": "pytest", "python-dateutil": "python_dateutil", " ruamel.yaml [x] ; python_version": "ruamel_yaml", "": None, "==1": None}
    assert {r.k: r.f for r in spark.createDataFrame([(k,) for k in specs], "k string").select("k", reviews.package_name("k").alias("f")).collect()} == specs


def test_parsed_rules(spark):
    rule = {"subject": "a", "predicate": "prohibits_dependency", "object": "b"}
    lines = [json.dumps(x) for x in (rule, rule | {"scope": "tooling"}, rule | {"scope": "none"}, rule | {"scope": 3}, rule | {"object": "a"}, rule | {"predicate": "likes"}, rule | {"subject": ""}, [rule])] + ["no json", None]
    got = reviews.parsed_rules(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, payload string")).orderBy("i").collect()
    assert [r.dropped for r in got] == [None, None, "none_scope", None, "self_loop", "unknown_predicate", "missing_subject_or_object", "not_an_object", "not_an_object", "not_an_object"]
    assert [r.scope for r in got[:4]] == ["runtime", "tooling", "runtime", "runtime"] and [r.i for r in got if r.audited] == [2]


def test_zero_loss_and_auc(spark, monkeypatch):
    scored = spark.createDataFrame([(0.1, False), (0.2, False), (0.5, True), (0.5, False), (0.9, True), (0.3, False)], "score double, positive boolean")
    assert tuple(scoring.zero_loss(scored).first()) == (0.5, 3, 3, 6)
    assert tuple(scoring.zero_loss(scored.where("NOT positive")).first()) == (None, 0, 0, 4)
    for ranges in (4096, 2):
        monkeypatch.setattr(scoring, "SCORE_RANGES", ranges)
        assert scoring.rank_auc(scored).first().auc == (3.5 + 4) / 8


def test_json_in_answers(spark):
    from archspan.functions import text

    answers = {
        "Here:\n```json\n[1, 2]\n```\nbye": "[1, 2]",
        'So {"a": [1]} it is': "[1]",
        'So {"a": {"b": 1}} and {"c": 2}': '{"a": {"b": 1}}',
        "[1, [2]": "[1, [2]",
        " none ": "none",
        "": "",
    }
    df = spark.createDataFrame([(a,) for a in answers] + [(None,)], "a string")
    got = {r.a: r.j for r in df.select("a", text.extract_json("a").alias("j")).collect()}
    assert got == answers | {None: None}


def test_page_sizes_can_be_lifted(spark, scratch):
    from archspan.operators import grounding, model

    nodes = spark.createDataFrame([("r", "m", "module"), *(("r", f"m.f{i:03}", "function") for i in range(200))], "repo_id string, fqn string, kind string")
    edges = spark.createDataFrame([("r", "m", f"m.f{i:03}", "CONTAINS", i) for i in range(200)], "repo_id string, source string, target string, kind string, ord bigint")
    assert model.children(edges, nodes).count() == 150 and model.children(edges, nodes, None).count() == 200
    q = spark.createDataFrame([(1, "r", "f1"), (2, "r", "m.f")], "query_id int, repo_id string, query string")
    found = grounding.name_search(q, nodes, scratch, None).groupBy("query_id").agg(F.count("fqn").alias("n"), F.max("truncated").alias("t")).collect()
    assert {r.query_id: (r.n, r.t) for r in found} == {1: (100, False), 2: (200, False)}


def test_search_compares_characters_only_where_no_name_contains_the_query(spark, scratch, monkeypatch):
    from archspan.operators import grounding

    nodes = spark.createDataFrame([("r", f, "module") for f in ("app.core", "app.co-re", "App.Core.io", "x.acr", "b.öre")], "repo_id string, fqn string, kind string")
    q = spark.createDataFrame([(1, "r", "app.core"), (2, "r", "acr"), (3, "r", "a/e"), (4, "r", "ap.ce"), (5, "r", "a-e"), (6, "s", "app")], "query_id int, repo_id string, query string")
    written, real = [], scratch.cut
    monkeypatch.setattr(scratch, "cut", lambda df: written.append(real(df)) or written[-1])
    found = {}
    for r in grounding.name_search(q, nodes, scratch).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.n_exact, r.n_prefix, r.n_substring, r.n_relaxed, r.fqn))
    assert found == {
        1: [(1, 1, 0, 0, "app.core"), (1, 1, 0, 0, "App.Core.io")],
        2: [(0, 0, 1, 0, "x.acr")],
        3: [(0, 0, 0, 3, f) for f in ("App.Core.io", "app.co-re", "app.core")],
        4: [(0, 0, 0, 3, f) for f in ("App.Core.io", "app.co-re", "app.core")],
    }
    compared = next(t for t in written if "pattern" in t.columns)
    assert sorted(r.query_id for r in compared.collect()) == [3, 4, 5, 6]


def test_reason_buckets(spark):
    data = [("It was Pre-Existing", None), ("not a known violation here", "x"), (None, "compliant_probe"), ("", "injected"), ("preexisting", "compliant_probe")]
    got = spark.createDataFrame(data, "w string, c string").select(scoring.reason_bucket(F.col("w"), F.col("c")).alias("b")).collect()
    assert [r.b for r in got] == ["pre-existing", "not-in-known-set", "case-metadata", "other", "pre-existing"]


def test_dev_packages(spark, tmp_path):
    from archspan.operators import grounding
    from archspan.sources import dependencies

    toml = '[project.optional-dependencies]\ndev = ["Fake-Lint>=2", "x.y"]\nweb = ["flask"]\n'
    cfg = "[options.extras_require]\ntest =\n    py-thing ==1\n    other\nweb = django\n"
    configs = spark.createDataFrame([("a", "pyproject.toml", toml), ("a", "setup.cfg", cfg), ("b", "sub/setup.cfg", cfg), ("b", "pyproject.toml", "[project]\nname='b'\n"), ("c", "pyproject.toml", "broken ["), ("d", "setup.cfg", None)], "repo_id string, file_path string, content string")
    own = dependencies.dev_packages(configs)
    assert rows(own) == [("a", "fake_lint"), ("a", "x_y"), ("b", "other"), ("b", "py_thing")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "pyproject.toml").write_text(toml)
    assert dependencies.read_configs(spark, str(tmp_path)).count() == 1
    edges = spark.createDataFrame([("a", "m", "fake_lint.core", "IMPORTS"), ("b", "m", "fake_lint.core", "IMPORTS"), ("b", "m", "pytest", "IMPORTS")], "repo_id string, source string, target string, kind string")
    nodes = spark.createDataFrame([("a", "m"), ("b", "m")], "repo_id string, fqn string")
    rules = spark.createDataFrame([], "repo_id string, subject string, object string")
    assert rows(grounding.externalised(nodes, edges, rules, own)) == [("a", "fake_lint.core", "external", "dev_tool"), ("b", "fake_lint.core", "external", "unknown"), ("b", "pytest", "external", "dev_tool")]


def test_hop_files_and_merged_dismissals(spark):
    from archspan.operators import violations

    found = spark.createDataFrame([(1, "r", "a", "a", "c", ["b", "c"]), (2, "r", "z", "z", "", None)], "constraint_id bigint, repo_id string, changed_fqn string, matched_fqn string, ord3 string, hops array<string>")
    nodes = spark.createDataFrame([("r", "b", "b.py"), ("q", "c", "c.py")], "repo_id string, fqn string, file_path string")
    assert rows(reviews.hop_files(found, nodes)) == [(1, "a", "a", "c", 0, "b", "b.py"), (1, "a", "a", "c", 1, "c", None)]
    schema = "repo_id string, identity_hash string, code_fingerprint string"
    stored = spark.createDataFrame([("r", "1", "old"), ("q", "1", "old"), ("r", "2", None)], schema)
    new = spark.createDataFrame([("r", "1", "new"), ("r", "1", "new"), ("r", "3", "new")], schema)
    assert rows(violations.merged_dismissals(stored, new)) == [("q", "1", "old"), ("r", "1", "new"), ("r", "2", None), ("r", "3", "new")]


def test_provenance_classes_read_nodes_and_edges_once(spark, tmp_path, monkeypatch):
    day = "timestamp_ntz '2024-01-01 00:00:00'"
    spark.sql(f"SELECT id AS node_id, 'r' AS repo_id, element_at(array('a', 'a.b', 'x'), cast(id + 1 AS int)) AS fqn, if(id = 2, 'external', 'module') AS kind, {day} AS loaded_at, cast(null AS timestamp_ntz) AS deleted_at FROM range(3)").write.parquet(f"{tmp_path}/fqn_nodes.parquet")
    spark.sql(f"SELECT * FROM VALUES (1L, 'r', 'a', 'a.b', 'contains '), (2L, 'r', 'a.b', 'y.z', 'Imports'), (3L, 'r', null, 'w', 'IMPORTS') AS t(ord, repo_id, source, target, kind)").write.parquet(f"{tmp_path}/dep_edges.parquet")
    spark.sql("SELECT * FROM VALUES (100L, 'r', 'a', 'y.z'), (200L, 'r', 'a', 'w'), (300L, 'r', 'x', 'a.c') AS t(constraint_id, repo_id, subject, object)").write.parquet(f"{tmp_path}/constraint_edges.parquet")
    read = []
    plain = analysis.load
    for module in (analysis, rulecheck, reviewing):
        monkeypatch.setattr(module, "load", lambda s, d, table: (read.append(table), plain(s, d, table))[1])
    got = rows(reviewing.provenance_classes(spark, str(tmp_path)))
    assert got == [(100, False, True, "B/C"), (200, False, False, "A"), (300, False, False, "other")]
    assert read.count("fqn_nodes") == read.count("dep_edges") == 1
