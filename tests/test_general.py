"""General data problems: small cases, nulls, ties, repeats, empty tables and random brute-force checks."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from archspan.operators import copydiff, drift, hierarchy, orphans, shredding, snapshots

T = lambda d, h=0: dt.datetime(2025, 1, d, h)
GROUND = "object_grounding struct<label:string,resolved_fqn:string,package:string>"
RULES = f"constraint_id bigint, repo_id string, subject string, object string, {GROUND}, recorded_at timestamp_ntz, loaded_at string"
NODES = "repo_id string, fqn string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, name string, kind string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- orphans -------------------------------------------------------------------


def test_orphans_reasons_and_edges(spark):
    nodes = spark.createDataFrame(
        [
            ("r", "a.b", T(1), None, "x", "y"),
            ("r", "a.gone", T(1), T(5), None, None),
            ("r", "a.late", T(20), None, None, None),
            ("r", "a.back", T(1), T(3), None, None),
            ("r", "a.back", T(8), T(12), None, None),
            ("r", "a.never", T(9), T(9), None, None),
            ("r", None, T(1), None, None, None),
        ],
        NODES,
    )
    g = lambda label, fqn=None: (label, fqn, None)
    rules = [
        (1, "r", " a.b.* ", "a", g("exact", "a.b"), T(10), "x"),
        (2, "r", "a.gone", "a.late", g("exact", "a"), T(10), "x"),
        (3, "r", "a.back", "a.nope", g("unique_suffix", "a.b"), T(10), "x"),
        (4, "r", "a.back.*", "a.b", None, T(12), "x"),
        (5, "r", "a.never", "", None, T(9), "x"),
        (6, None, "a", "q", None, T(9), "x"),
        (7, "r", None, "a", None, None, "x"),
        (8, "r", "A.b", "a.b", g(None), T(2), "x"),
    ]
    df = spark.createDataFrame(rules + rules[:2], RULES)
    got = rows(orphans.orphan_references(df, nodes))
    assert got == sorted(
        [
            (2, "subject", "2025-01", "deleted"),
            (2, "object", "2025-01", "late"),
            (2, "grounding", "2025-01", "missing"),
            (4, "subject", "2025-01", "deleted"),
            (5, "subject", "2025-01", "deleted"),
            (5, "object", "2025-01", "missing"),
            (8, "subject", "2025-01", "missing"),
        ],
        key=repr,
    )
    # a filter too large to be broadcast is joined by block
    assert rows(orphans.orphan_references(df, nodes, broadcast_words=0)) == got
    assert orphans.orphan_references(df.limit(0), nodes).count() == 0
    assert {r[3] for r in rows(orphans.orphan_references(df, nodes.limit(0)))} == {"missing"}
    report = orphans.orphan_report({"rules": orphans.orphan_references(df, nodes), "none": orphans.orphan_references(df.limit(0), nodes)})
    assert report.agg(F.sum("n_orphans")).first()[0] == 7 and {r.table_name for r in report.collect()} == {"rules"}
    edges = spark.createDataFrame([(1, "r", "a", "a.b.c", T(9)), (2, "r", "zz", None, T(9)), (3, None, "a", "a", T(9))], "ord bigint, repo_id string, source string, target string, loaded_at timestamp_ntz")
    assert (2, "source", "2025-01", "missing") in rows(orphans.edge_orphans(edges, nodes))


def test_orphans_random(spark):
    rnd = random.Random(1)
    for _ in range(2):
        names = ["a", "a.b", "a.b.c", "b", "b.x", "c.d.e"]
        ns = [("r", rnd.choice(names), T(rnd.randint(1, 20)), None if rnd.random() < 0.4 else T(rnd.randint(1, 25)), None, None) for _ in range(60)]
        cs = [(i, "r", rnd.choice([*names, "zz", "a.*"]), rnd.choice(names), ("exact", rnd.choice(names), None), T(rnd.randint(1, 25)), "") for i in range(60)]
        want = set()
        for i, repo, s, o, (label, fqn, _p), at, _ in cs:
            for field, name, exact in (("subject", s, False), ("object", o, False), ("grounding", fqn, True)):
                base = name.removesuffix(".*")
                m = [n for n in ns if n[1] == base or (not exact and n[1].startswith(base + "."))]
                if not any(n[2] <= at and (n[3] is None or n[3] > at) for n in m):
                    want.add((i, field, "2025-01", "late" if any(n[2] > at for n in m) else "deleted" if m else "missing"))
        got = orphans.orphan_references(spark.createDataFrame(cs, RULES), spark.createDataFrame(ns, NODES))
        assert set(map(tuple, got.collect())) == want


def test_bloom_has_no_false_negative(spark):
    parents = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    refs = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    for n, limit in ((5000, orphans.BROADCAST_WORDS), (5000, 10)):
        words, blocks = orphans.bloom_filter(parents, ["k"], n)
        assert blocks * orphans.KEYS_PER_WORD >= n
        out = orphans.probe(refs, words, blocks, ["k"], limit).where("maybe")
        assert out.where("cast(k as int) < 5000").count() == 5000
        assert out.count() < 5000 + 15000 * 0.15


# -- copies --------------------------------------------------------------------


def test_diff_copies(spark):
    schema = "k string, n bigint, v string, w string, field_name string, bucket int"
    left = [("a", 1, "x", None, "z", 1), ("a", 1, "x", None, "z", 1), ("b", None, "x", "1", "z", 1), ("c", 2, "p", "q", "", 0), ("c", 2, "p2", "q", "", 0), ("d", 1, "", "", "", 1)]
    right = [("a", 1, "x", "", "z", 2), ("b", None, "y", "1", "z", 1), ("c", 2, "p2", "q", "", 0), ("c", 2, "p", "q", "", 5), ("e", 1, "", "", "", 1)]
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = rows(copydiff.diff_copies(a, b, ["k", "n"], ["v", "w"]))
    assert got == sorted([("a", 1, "w", None, ""), ("b", None, "v", "x", "y"), ("d", 1, "missing_in_right", None, None), ("e", 1, "missing_in_left", None, None)], key=repr)
    assert {r[2] for r in rows(copydiff.diff_copies(a, b.limit(0), ["k", "n"], ["v"]))} == {"missing_in_right"}
    assert copydiff.diff_copies(a.limit(0), b.limit(0), ["k", "n"], ["v"]).count() == 0
    assert rows(copydiff.diff_copies(a, b, ["k", "n"], ["v", "w"], buckets=1)) == got
    clash = {"k": "key", "n": "hash", "v": "v0", "w": "bucket"}
    other = [df.drop("bucket").withColumnsRenamed(clash) for df in (a, b)]
    assert rows(copydiff.diff_copies(*other, ["key", "hash"], ["v0", "bucket"])) == sorted([(*r[:2], clash.get(r[2], r[2]), *r[3:]) for r in got], key=repr)


def test_keys_that_share_a_hash_are_told_apart():
    import pyarrow as pa

    side = lambda keys, hashes: pa.table({"key": pa.array(keys, pa.string()), "hash": pa.array(hashes, pa.int64())})
    for left, right in (((["a", "b"], [1, 1]), (["b"], [1])), ((["b"], [1]), (["c"], [1])), ((["a", "b"], [1, 2]), (["b", "a"], [2, 1])), (([], []), (["a"], [1]))):
        il, ir, ol, orr = copydiff._aligned(side(*left), side(*right))
        assert [left[0][i] for i in il] == [right[0][i] for i in ir] and set(left[0]) & set(right[0]) == {left[0][i] for i in il}
        assert {left[0][i] for i in ol} == set(left[0]) - set(right[0]) and {right[0][i] for i in orr} == set(right[0]) - set(left[0])


def test_contradicted_flags(spark):
    diffs = spark.createDataFrame([("r", 1, "missing_in_store"), ("r", 2, "scope")], "repo_id string, adr_no bigint, field_name string")
    seeds = spark.createDataFrame([("r", "ADR-0001", True), ("r", "adr 2", True), ("r", "3", False), ("r", "ADR-4", None), ("r", "ADR-1", False)], "repo_id string, adr_id string, matches_gold boolean")
    assert rows(copydiff.contradicted_flags(seeds, diffs)) == [("r", 1), ("r", 3)]


# -- hierarchy -----------------------------------------------------------------


def brute_tree(links):
    parent = {}
    for p, c in sorted(links):
        parent.setdefault(c, p)
    names = {x for link in links for x in link}
    out = {}
    for n in names:
        at, d, seen = n, 0, set()
        while at in parent and at not in seen:
            seen.add(at)
            at, d = parent[at], d + 1
        out[n] = ("", -1) if at in parent else (at, d)
    return parent, out


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_random(spark, scratch, seed):
    rnd = random.Random(seed)
    n = 60
    links = {(f"n{rnd.randrange(i)}" if rnd.random() < 0.9 else f"n{rnd.randrange(n)}", f"n{i}") for i in range(1, n)}
    links |= {("s", "s"), *((f"c{i}", f"c{i + 1}") for i in range(40)), ("z1", "n5"), ("z2", "n5")}
    edges = spark.createDataFrame([("r", p, c, rnd.choice(["CONTAINS", " contains"]), 1) for p, c in links] * 2 + [("r", None, "x", "CONTAINS", 1), ("r", "q", "w", "CALLS", 1)], "repo_id string, source string, target string, kind string, fqn int")
    tree = scratch.cut(hierarchy.hierarchy(hierarchy.contains_links(edges), scratch, paths=True))
    parent, want = brute_tree(links)
    assert {(r.parent, r.fqn) for r in hierarchy.dropped_links(hierarchy.contains_links(edges)).collect()} == {(p, c) for p, c in links if parent[c] != p}
    got = {r.fqn: r for r in tree.collect()}
    assert {k: (r.root, r.depth) for k, r in got.items()} == want
    shuffled = hierarchy.hierarchy(hierarchy.contains_links(edges), scratch, paths=True, broadcast_nodes=0)
    assert {r.fqn: (r.root, r.depth, r.n_descendants, r.path) for r in shuffled.collect()} == {k: (r.root, r.depth, r.n_descendants, r.path) for k, r in got.items()}
    above = {}
    for k in want:
        if want[k][1] >= 0:
            at, up = k, []
            while at in parent:
                at = parent[at]
                up.append(at)
            above[k] = up
    pairs = {(a, k, i + 1) for k, up in above.items() for i, a in enumerate(up)}
    rows_ = hierarchy.descendant_pairs(tree).collect()
    assert len(rows_) == len(pairs) and {(r.ancestor, r.fqn, r.distance) for r in rows_} == pairs
    assert {r.fqn: r.path for r in hierarchy.full_paths(tree).collect()} == {k: " > ".join([*reversed(up), k]) for k, up in above.items()}
    for k, up in above.items():
        assert got[k].n_descendants == sum(k in u for u in above.values())


def test_hierarchy_empty(spark, scratch):
    edges = spark.createDataFrame([], "repo_id string, source string, target string, kind string")
    assert hierarchy.hierarchy(hierarchy.contains_links(edges), scratch).count() == 0


def test_hierarchy_wide_parent(spark, scratch, monkeypatch):
    monkeypatch.setattr(hierarchy, "SIBLINGS_PER_BLOCK", 7)
    links = spark.createDataFrame([("r", f"k{i}", "top") for i in range(100)], "repo_id string, fqn string, parent string")
    out = hierarchy.hierarchy(links, scratch).collect()
    assert sorted(r.lft for r in out) == list(range(101))


# -- drift ---------------------------------------------------------------------

WIRE = "stream_id bigint, family string, file_no int, record_key string, payload string, path string"


def test_drift(spark, scratch):
    r = lambda n, k, **o: (1, "f", n, k, json.dumps(o), "clash")
    data = [
        r(1, "a", x=1, same="s", gone=[1], t="1", o={"k": 5}),
        r(1, "b", x=2, same="t", t="2", o={"k": 6}),
        r(1, "c", x=9, same=None, t="2"),
        r(2, "a", y=1.0, same="s", new=True, t=1, o2={"k": 5}),
        r(2, "b", y=2, same="t", t="2", o2={"k": 7}),
        r(2, "b", y=2, same="t", t="2", o2={"k": 7}),
        r(4, "a", z=1),
        (1, "f", 2, "d", "not json", None),
        (1, "f", 2, "e", None, None),
        (1, "f", 2, None, "[1]", None),
    ]
    df = spark.createDataFrame(data, WIRE)
    tagged = scratch.cut(drift.tagged_records(df, distinct=True))
    changes = scratch.cut(drift.schema_changes(tagged, scratch))
    got = rows(changes.select("stream_id", "file_no", "field_name", "change_kind", "new_name"))
    assert got == sorted(
        [
            (1, 2, "x", "renamed", "y"),
            (1, 2, "gone", "removed", ""),
            (1, 2, "new", "added", ""),
            (1, 2, "t", "type_changed", ""),
            (1, 2, "o.k", "removed", ""),
            (1, 2, "o2.k", "added", ""),
        ],
        key=repr,
    )
    types = {r.field_name: (r.old_types, r.new_types) for r in changes.collect()}
    assert types == {"x": ("number", "number"), "gone": ("array", ""), "new": ("", "boolean"), "t": ("string", "number,string"), "o.k": ("number", ""), "o2.k": ("", "number")}
    for limit in (drift.BROADCAST_NAMES, 0):
        table = {(x.file_no, x.record_key): x for x in drift.union_table(tagged, changes, scratch, limit).collect()}
        assert table[(1, "a")].numbers == {"x": 1.0, "o.k": 5.0} and table[(2, "a")].booleans == {"new": True} and table[(1, "a")].arrays == {"gone": ["1"]} and table[(1, "b")].strings == {"same": "t", "t": "2"}
        assert table[(2, "b")].numbers == {"x": 2.0, "o2.k": 7.0} and table[(2, "a")].canonical["t#number"] == "1" and table[(2, "d")].strings == {}
        assert len(table) == 9
    assert rows(drift.conflicts(tagged)) == [("f", "t", "number,string", 2)]
    empty = drift.tagged_records(df.limit(0))
    assert drift.schema_changes(empty, scratch).count() == 0 and drift.field_names(empty, drift.schema_changes(empty, scratch), scratch).count() == 0


def test_drift_of_keys_with_several_payloads(spark, scratch):
    """A field is renamed only if a key's whole set of values moved."""
    r = lambda n, k, **o: (1, "f", n, k, json.dumps(o), "")
    data = [r(1, "a", p=1, q="u"), r(1, "a", p=2, q="u"), r(2, "a", p2=2, q2="u"), r(2, "a", p2=1, q2="u"), r(3, "a", p3=1, q3="u"), r(3, "b", p3=9)]
    changes = drift.schema_changes(drift.tagged_records(spark.createDataFrame(data, WIRE)), scratch)
    assert rows(changes.select("file_no", "field_name", "change_kind", "new_name")) == sorted([(2, "p", "renamed", "p2"), (2, "q", "renamed", "q2"), (3, "q2", "renamed", "q3"), (3, "p2", "removed", ""), (3, "p3", "added", "")], key=repr)


def test_names_that_stand_side_by_side_stay_apart(spark, scratch):
    r = lambda s, n, k, **o: (s, "f", n, k, json.dumps(o), "")
    data = [r(1, 1, "a", x=1), r(1, 2, "a", y=1), r(1, 3, "a", z=1), r(2, 1, "a", c=1), r(2, 2, "a", d=1), r(3, 1, "a", c=1, d=2), r(1, 4, "a", z=3)]
    tagged = drift.tagged_records(spark.createDataFrame(data, WIRE))
    assert rows(drift.field_names(tagged, drift.schema_changes(tagged, scratch), scratch)) == [("f", "x", "z"), ("f", "y", "z")]


# -- shredding -----------------------------------------------------------------


def test_shredding(spark):
    hop = lambda t: {"kind": "CALLS", "target": t}
    v = {"pathHops": json.dumps([hop("a"), hop(None)]), "scope_snapshots": {"fqn": "m", "outgoing": hop("o")}}
    full = {"_meta": {}, "report": {"ingestion": {"false_positive_edges": {"object": "x"}}, "detection": {"cases": [{"violations": []}, {"violations": [v, {"path_hops": hop("b")}]}]}}}
    data = [(1, json.dumps(full), 5), (1, json.dumps(full), 5), (2, '{"detection": {"cases": [', 5), (3, None, 5), (4, "{}", 5), (5, json.dumps({"detection": {"Cases": {"violations": {"path_hops": [hop("q")]}}}}), 5), (6, "[]", 1)]
    df = spark.createDataFrame(data, "report_id bigint, payload string, leaf int")
    assert rows(shredding.innermost(df)) == sorted(
        [
            (1, -1, -1, "fp_edge", -1, 0, "x"),
            (1, 1, 0, "hop", -1, 0, "a"),
            (1, 1, 0, "hop", -1, 1, ""),
            (1, 1, 0, "outgoing", 0, 0, "o"),
            (1, 1, 1, "hop", -1, 0, "b"),
            (5, 0, 0, "hop", -1, 0, "q"),
        ],
        key=repr,
    )
    assert shredding.innermost(df.limit(0)).count() == 0
    hops = {(r.report_id, r.case_no, r.violation_no, r.item_no): (r.kind, r.target) for r in shredding.flat_table(df, "hop").collect()}
    assert hops[(1, 1, 0, 1)] == ("CALLS", None) and len(hops) == 4
    assert shredding.flat_table(df, "case").count() == 3
    assert {r.report_id for r in shredding.flat_table(df, "meta").collect()} == {1, 4, 5, 6}


def test_no_leaf_is_lost(spark, scratch):
    one = {"_meta": {"arm": "on", "odd": {"deep": True}}, "report": {"cost": {"per_case_detect_seconds": [1.5, 2], "other": [{"a": 1}, {"b": [["x"], []]}]}, "detection": {"cases": [{"caseId": "c", "note": "n"}]}}}
    df = spark.createDataFrame([(1, json.dumps(one)), (2, '{"run_index": 3, "runIndex": 4, "cases": "[{\\"exact\\": 1}]"}')], "report_id bigint, payload string")
    tables = shredding.flat_tables(df, scratch)
    assert set(tables) == {*shredding.TABLES, "other"}
    assert rows(tables["case_cost"]) == [(1, 0, "1.5"), (1, 1, "2")]
    assert {(r.report_id, r.case_no, r.case_id, r.exact) for r in tables["case"].collect()} == {(1, 0, "c", None), (2, 0, None, "1")}
    assert {r.report_id: (r.run_index, r.parse_seconds) for r in tables["report"].collect()} == {1: (None, None), 2: ("3", None)}
    assert rows(tables["other"].select("levels", "leaf", "value")) == sorted([("", "meta.odd.deep", "true"), ("cases", "note", "n"), ("cost.other", "a", "1"), ("cost.other/b/item", "", "x")], key=repr)
    assert shredding.leaf_counts(df).agg(F.sum("n_values")).first()[0] == 10


def test_shredding_round_trip(spark):
    rnd = random.Random(4)
    reports, want = [], set()
    for i in range(40):
        cases = []
        for c in range(rnd.randint(0, 3)):
            vs = []
            for k in range(rnd.randint(0, 3)):
                snaps = [{"outgoing": [{"target": f"t{rnd.randint(0, 9)}"} for _ in range(rnd.randint(0, 3))]} for _ in range(rnd.randint(0, 3))]
                want |= {(i, c, k, "outgoing", s, o, x["target"]) for s, sn in enumerate(snaps) for o, x in enumerate(sn["outgoing"])}
                vs.append({"scope_snapshots": snaps})
            cases.append({"violations": vs})
        reports.append((i, json.dumps({"detection": {"cases": cases}})))
    got = shredding.innermost(spark.createDataFrame(reports, "report_id bigint, payload string"))
    assert set(map(tuple, got.collect())) == want


# -- snapshots -----------------------------------------------------------------

SNAP = "row_no bigint, line_id bigint, from_sha string, to_sha string, fqn string, code_hash string, idx int"


def brute_changes(data):
    last, links = {}, {}
    for no, line, a, b, f, h, _ in data:
        if line is None or b is None or f is None:
            continue
        if (line, b, f) not in last or last[line, b, f][0] < no:
            last[line, b, f] = (no, (h or "").lower())
        links.setdefault((line, b), a)
    out = set()
    for (line, b), a in links.items():
        if (line, a) not in links:
            continue
        now = {f: h for (q, s, f), (_, h) in last.items() if (q, s) == (line, b)}
        old = {f: h for (q, s, f), (_, h) in last.items() if (q, s) == (line, a)}
        out |= {(line, b, f, "added") for f in now.keys() - old.keys()} | {(line, b, f, "removed") for f in old.keys() - now.keys()}
        out |= {(line, b, f, "changed") for f in now.keys() & old.keys() if now[f] != old[f]}
    return out


@pytest.mark.parametrize("fork", [False, True])
def test_snapshots_random(spark, scratch, fork):
    rnd = random.Random(7)
    data, no = [], 0
    for line in range(4):
        shas = [f"s{line}{i}" for i in range(6)]
        for i, sha in enumerate(shas):
            before = None if i == 0 else shas[max(0, i - 2)] if fork and i == 4 else shas[i - 1]
            if line == 3 and i == 2:
                before = "never delivered"
            for _ in range(12):
                no += 1
                data.append((no, line, before, sha, f"f{rnd.randint(0, 9)}", rnd.choice(["A", "a", "b", "", None]), 0))
    data += [(no + 1, None, None, "x", "f", "a", 0), (no + 2, 1, None, None, "f", "a", 0), (no + 3, 1, None, "s10", None, "a", 0)]
    rnd.shuffle(data)
    got = snapshots.changes(spark.createDataFrame(data, SNAP), scratch)
    out = got.collect()
    assert len(out) == len(set(out)) and set(map(tuple, out)) == brute_changes(data)
    assert set(map(tuple, snapshots.changes(spark.createDataFrame(data, SNAP), scratch, broadcast_snapshots=0).collect())) == set(map(tuple, out))


def test_snapshots_empty(spark, scratch):
    assert snapshots.changes(spark.createDataFrame([], SNAP), scratch).count() == 0
