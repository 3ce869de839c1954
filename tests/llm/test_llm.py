"""Training-text operators: brute-force checks, round trips and edge cases."""

import datetime as dt
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archspan.llm import handwritten, leakage, mixture, splitting
from archspan.llm.tokens import Tokenizer

TEXTS = st.text(alphabet=st.sampled_from(list("ab Z9_.,\n\r\t'é漢😀-{}\"")), max_size=120)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer()


# -- tokens --------------------------------------------------------------------


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_counts_and_lengths_are_exact(tokenizer, text):
    ids = tokenizer.encoding.encode_ordinary(text)
    assert tokenizer.count(text) == len(ids)
    assert [int(x) for x in tokenizer.lengths(text)] == [len(tokenizer.encoding.decode_single_token_bytes(i)) for i in ids]


# -- splitting -----------------------------------------------------------------


@settings(max_examples=120, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS, st.integers(4, 20), st.integers(0, 6))
def test_pieces_cover_and_fit(tokenizer, text, limit, overlap):
    raw = text.encode()
    got = splitting.pieces(text, limit, overlap, tokenizer)
    if tokenizer.count(text) <= limit:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(raw)
    for (_, end, _, end_token, _, _), (start, _, first_token, _, _, _) in zip(got, got[1:], strict=False):
        assert start <= end and first_token <= end_token
    for lo, hi, _, _, n, _ in got:
        assert lo < hi and n <= limit
        assert tokenizer.count(raw[lo:hi].decode()) == n


def test_counts_from_offsets_are_exact(tokenizer):
    rnd = random.Random(3)
    for alphabet in ("ab  .\n", "a1 \t\u00a0é漢 .", "xY_  's\r\n-"):
        for _ in range(60):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(5, 300)))
            prepared = splitting.Prepared(text, tokenizer)
            prepared.find()
            for _ in range(5):
                i, j = sorted((int(rnd.choice(prepared.safe)), int(rnd.choice(prepared.safe))))
                lo, hi = prepared.ends[i], prepared.ends[j]
                assert prepared.count(lo, hi) == tokenizer.count(prepared.raw[lo:hi].decode())


def test_piece_shorter_than_the_overlap(tokenizer):
    got = splitting.pieces("9Z漢", 4, 3, tokenizer)
    assert [g[:2] for g in got] == [(0, 2), (1, 5)]


def test_pieces_keep_the_overlap_and_cut_at_paragraphs(tokenizer):
    text = "\n\n".join(f"Paragraph {i} holds a handful of plain words." for i in range(60))
    got = splitting.pieces(text, 100, 10, tokenizer)
    assert {g[5] for g in got[:-1]} == {"paragraph"}
    assert all(a[3] - b[2] == 10 for a, b in zip(got, got[1:], strict=False))


def test_early_boundary_comes_before_a_hard_cut(tokenizer):
    head = "A few plain words.\n\n"
    got = splitting.pieces(head + "QUJD,REVG" * 200, 100, 3, tokenizer)
    assert got[0][1] == len(head) and got[0][5] == "paragraph"
    assert all(b[2] > a[2] and b[1] > a[1] for a, b in zip(got, got[1:], strict=False))
    assert {g[5] for g in got[1:-1]} == {"mark"}


def test_split_documents(spark):
    docs = spark.createDataFrame([(1, "w " * 400, "clash"), (2, "short", "c"), (3, None, "c"), (4, "", "c"), (5, "x" * 3000, "c"), (6, "漢字" * 300, "c"), (1, "w " * 400, "clash")], "doc_id bigint, text string, piece string")
    limits = spark.createDataFrame([(100, 10), (50, None), (None, 5)], "max_tokens int, overlap_tokens int")
    out = splitting.split_documents(docs, limits).collect()
    assert {r.doc_id for r in out} == {1, 5, 6} and all(r.n_tokens <= r.max_tokens for r in out)
    for doc, limit in {(r.doc_id, r.max_tokens) for r in out}:
        mine = sorted({(r.piece_no, r.first_byte, r.end_byte, r.piece) for r in out if (r.doc_id, r.max_tokens) == (doc, limit)})
        text = dict((r.doc_id, r.text) for r in docs.collect())[doc].encode()
        assert mine[0][1] == 0 and mine[-1][2] == len(text) and all(text[a:b].decode() == p for _, a, b, p in mine)
    assert splitting.split_documents(docs, limits.limit(0)).count() == 0
    assert splitting.split_documents(docs.limit(0), limits).count() == 0


# -- leakage -------------------------------------------------------------------


def brute_leaks(docs, items, n=12):
    words = lambda t: [w.lower() for w in re.findall("[A-Za-z0-9]+", t or "")]
    grams = {}
    for i, p in items:
        w = words(p)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_leaks_random(spark, seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "bb", "Ccc", "d4", "the", "é"] + [f"w{i}" for i in range(4 + seed)]
    run = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, run(rnd.randint(8, 40))) for i in range(30)] + [(90, None), (91, "one two"), (92, "")]
    docs = [(i, run(rnd.randint(0, 60))) for i in range(60)]
    for i in range(60, 120):
        w = items[rnd.randrange(30)][1].split()
        k = rnd.randrange(len(w))
        piece = rnd.choice([" ", "--", "\n", " é "]).join(w[k : k + rnd.randint(10, 14)])
        docs.append((i, f"{run(rnd.randint(0, 5))} {piece.upper() if i % 2 else piece}{rnd.choice(['', 'x', ' ', '.'])}{run(rnd.randint(0, 5))}"))
    docs += [(200, None), (201, ""), (202, items[0][1] * 2), (202, items[0][1] * 2)]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([(a, f"c{a}", b) for a, b in items], "item_id bigint, case_id string, passage string")
    got = leakage.leaked(d, i).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_leaks(docs, items)
    assert set(map(tuple, leakage.leaked(d, i, table_bytes=400, tables_per_pass=2).collect())) == set(map(tuple, got))


def test_leaks_empty(spark):
    d = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, "c", "some text")], "item_id bigint, case_id string, passage string")
    assert leakage.leaked(d.limit(0), i).count() == 0 and leakage.leaked(d, i.limit(0)).count() == 0 and leakage.leaked(d, i).count() == 0
    assert [tuple(r) for r in leakage.leak_report(leakage.leaked(d, i), i).collect()] == [(1, "c", 0)]


# -- mixture -------------------------------------------------------------------


def mix_inputs(spark):
    rnd = random.Random(2)
    docs, n = [], 0
    for source, count in (("Big", 300), ("mid ", 60), ("small", 6)):
        for _ in range(count):
            n += 1
            docs.append((n, " ".join(f"word{rnd.randrange(9999)}" for _ in range(rnd.randint(3, 40))), rnd.choice([source, source.upper()]), 9))
    docs += [(n + 1, docs[0][1], "small", 9), (n + 2, docs[0][1], "big", 9), (n + 3, None, "big", 9), (n + 4, "", "mid", 9), (n + 5, "unlisted text", "other", 9), (n + 6, "none", None, 9)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("Mid", 0.3, 2), ("small", 0.15, 3), ("absent", 0.05, 4)], "source string, target_share double, max_repeats int")
    return docs, spark.createDataFrame(docs, "doc_id bigint, text string, source string, copies int"), targets


def test_mixture_meets_shares_and_caps(spark, scratch):
    docs, df, targets = mix_inputs(spark)
    mixed = scratch.cut(mixture.mixture(df, targets, scratch))
    shares = {r.source: r for r in mixture.actual_shares(mixed, targets).collect()}
    assert shares["absent"].used_tokens == 0
    for s in ("big", "mid", "small"):
        assert shares[s].actual_share == pytest.approx(shares[s].target_share / 0.95, abs=0.01)
        assert shares[s].most_copies <= shares[s].max_repeats
    texts = {d: t for d, t, _, _ in docs}
    used = [texts[r.doc_id] for r in mixed.collect()]
    assert len(used) == len(set(used)), "a text may stand under one id only"
    assert shares["small"].most_copies == 3
    again = mixture.mixture(df.repartition(5), targets, scratch)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def test_mixture_of_a_given_size_and_empty(spark, scratch):
    _, df, targets = mix_inputs(spark)
    mixed = mixture.mixture(df, targets, scratch, total_tokens=2000)
    assert mixed.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] == pytest.approx(2000, abs=120)
    assert mixture.mixture(df.limit(0), targets, scratch).count() == 0
    assert mixture.mixture(df, targets.limit(0), scratch).count() == 0


def test_mixture_hot_source_buckets(spark, scratch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"), F.when(F.col("id") < 2700, "hot").otherwise("cold").alias("source"))
    targets = spark.createDataFrame([("hot", 0.5, 1), ("cold", 0.5, 2)], "source string, target_share double, max_repeats int")
    shares = {r.source: r.actual_share for r in mixture.actual_shares(mixture.mixture(docs, targets, scratch), targets).collect()}
    assert shares["hot"] == pytest.approx(0.5, abs=0.005)


def test_inclusion_matches_the_odds(spark, scratch):
    """200 independent draws (one a source) of texts of very different sizes: how often each is in, against its odds; tokens meet the budget."""
    rnd = random.Random(5)
    sizes = [rnd.choice([5, 20, 80, 300, 1200]) for _ in range(80)]
    draws, rest = 200, sum(sizes) * 2 // 5
    texts = scratch.cut(spark.createDataFrame([(d * 1000 + i, f"s{d}", n, rnd.random()) for d in range(draws) for i, n in enumerate(sizes)], "doc_id bigint, source string, n_tokens bigint, u double"))
    rests = {f"s{d}": rest for d in range(draws)}
    for power in (0.5, 0.0, 1.0):
        scales = mixture.inclusion_scales(texts, rests, scratch, power)
        got = mixture.pareto_sample(texts, rests, scales, power).collect()
        odds = {r.n_tokens: r.inclusion for r in got}
        assert sum(odds.get(n, 0) * n for n in sizes) == pytest.approx(rest, rel=0.001), "expected tokens"
        tokens = dict.fromkeys(rests, 0)
        seen: dict[int, int] = {}
        for r in got:
            tokens[r.source] += r.n_tokens
            seen[r.n_tokens] = seen.get(r.n_tokens, 0) + 1
        assert all(abs(t - rest) <= 600 for t in tokens.values()), "missed by at most half of the largest text"
        assert sum(tokens.values()) / draws == pytest.approx(rest, rel=0.01)
        for n, pi in odds.items():
            assert seen[n] / (draws * sizes.count(n)) == pytest.approx(pi, abs=0.04), (power, n)


def test_long_texts_do_not_spoil_the_share(spark, scratch):
    """Large texts are drawn first, the smaller ones fill the rest: tokens are met closely, and the odds stay what they are."""
    rnd = random.Random(9)
    sizes = [1500] * 6 + [rnd.choice([20, 40, 60]) for _ in range(1000)]
    draws, rest = 40, 20_000
    rests = {f"s{d}": rest for d in range(draws)}
    texts = scratch.cut(spark.createDataFrame([(d * 10_000 + i, f"s{d}", n, rnd.random()) for d in range(draws) for i, n in enumerate(sizes)], "doc_id bigint, source string, n_tokens bigint, u double"))
    drawn = scratch.cut(mixture.draw(texts, rests, scratch))
    assert all(abs(r.n - rest) <= 100 for r in drawn.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect())
    c = mixture.inclusion_scales(texts, rests, scratch)["s0"]
    for r in drawn.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("k")).collect():
        assert r.k / (draws * sizes.count(r.n_tokens)) == pytest.approx(min(1, c * r.n_tokens**0.5), abs=0.06)


def test_certain_texts_are_taken(spark, scratch):
    texts = scratch.cut(spark.createDataFrame([(1, "s", 1000, 0.999999), (2, "s", 10, 0.5), (3, "s", 10, 0.1), (4, "s", 10, 0.2)], "doc_id bigint, source string, n_tokens bigint, u double"))
    scales = mixture.inclusion_scales(texts, {"s": 1020}, scratch, 1.0)
    assert sorted(r.doc_id for r in mixture.pareto_sample(texts, {"s": 1020}, scales, 1.0).collect()) == [1, 3, 4]


# -- source files --------------------------------------------------------------

HAND = "".join(f'def load_{w}(value):\n    """Reads the {w}; see the guide."""\n    if value is {i}:\n        return {w}_table[value]\n    return check_{w}(value, {i})\n\n\n' for i, w in enumerate(["row", "page", "token", "ledger", "route", "scope"]))
LIB = "".join(f"def helper_{w}(a, b):\n    total = a * {i} + b\n    for item in range(total):\n        emit_{w}(item)\n    return total\n\n" for i, w in enumerate("abcdefgh"))


def judged(spark, files, known=()):
    rows = [(i, "r", path, content, 1, dt.datetime(2025, 1, 1)) for i, (path, content) in enumerate(files)]
    f = spark.createDataFrame(rows, "file_id bigint, repo_id string, file_path string, content string, share int, lines timestamp")
    k = spark.createDataFrame([("lib", "1", "core.py", c) for c in known], "lib string, version string, file_name string, content string")
    return [r.reason for r in handwritten.judged(f, k).orderBy("file_id").collect()]


def test_files_by_reason(spark):
    numbers = "TABLE = [\n" + "".join(f"    ({i}.125, -{i * 7}.5, {i * 31}),\n" for i in range(40)) + "]\n"
    blob = 'B = "' + "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo" * 40 + '"\n'
    stub = "from ._rt import pack\n\n" + "".join(f"class M{c}(object):\n    __slots__ = ('_a',)\n    FIELD = {i}\n    def Serialize(self):\n        return pack({i}, self._a)\n\n" for i, c in enumerate("abcdefghij"))
    files = [
        ("a/hand.py", HAND),
        ("a/made.py", "# Code generated by toolgen. DO NOT EDIT.\n" + HAND),
        ("a/made2.py", HAND + "\n# Diese Datei wurde automatisch von toolgen erzeugt\n"),
        ("a/emit.py", 'HEADER = "# Code generated by toolgen. DO NOT EDIT.\\n"\n' + HAND),
        ("a/check.py", "# Checks what the generator wrote; written by hand.\n" + HAND),
        ("a/doc.py", '"""Automatically retries the rows; do not edit limits without review."""\n' + HAND),
        ("a/x.js", "var t=r(s,781);for(var i=0;i<3;i++)m[i]=y^i;" * 60),
        ("a/y.js", "// keeps rows\nfunction load(a) {\n  return a;\n}\n" * 3),
        ("a/data.py", numbers),
        ("a/blob.py", blob),
        ("a/stub.py", stub),
        ("a/copy.py", "import os\r\n\r\n" + LIB.replace("\n", "\r\n")),
        ("a/altered.py", HAND[:120] + "\n" + LIB.replace("return total", "return total  # local fix", 1)),
        ("a/lib/core.py", "# lib 1.2, upstream copy. Copyright (c) the lib authors.\n" + HAND),
        ("a/adapter.py", "from lib import core as _core\n" + HAND),
        ("a/empty.py", ""),
        ("a/null.py", None),
        ("noext", "plain words\n"),
    ]
    got = judged(spark, files, [LIB])
    assert got == [None, "generated", "generated", None, None, None, "minified", None, "data", "data", "generated", "vendored", "vendored", "vendored", None, None, None, None]
    f = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(files)], "file_id bigint, file_path string, content string")
    layout = {r.file_path: r.layout_reason for r in handwritten.judged(f, spark.createDataFrame([], "file_name string, content string")).join(f, "file_id").collect()}
    assert {p for p, r in layout.items() if r} == {"a/x.js", "a/data.py", "a/blob.py", "a/stub.py", "a/copy.py", "a/altered.py"}  # LIB is one function eight times


def test_generated_code_shows_without_a_mark(spark):
    fields = "class Migration(migrations.Migration):\n    operations = [\n" + "".join(f"        migrations.AddField(model_name='{m}', name='n{i}', field=models.Char(max_length={i * 7})),\n" for i, m in enumerate(("rows", "pages", "tokens", "state", "quota", "pins", "edges"))) + "    ]\n"
    types = "".join(f"export interface {n}Spec {{ id: number; {n.lower()}?: string; }}\n" for n in ("Row", "Page", "Token", "Batch", "Rule", "Pin", "Edge", "Quota"))
    assert judged(spark, [("a/migrations/0004_auto.py", fields), ("a/t.d.ts", types), ("a/hand.py", HAND * 2)]) == ["generated", "generated", None]


def test_copy_indented_with_tabs(spark):
    tabs = "\n".join("\t" * ((len(x) - len(x.lstrip())) // 4) + x.lstrip() for x in LIB.split("\n"))
    assert "\n\t" in tabs and judged(spark, [("a/core.py", tabs), ("a/hand.py", HAND.replace("    ", "\t"))], [LIB]) == ["vendored", None]
    f = spark.createDataFrame([(1, "a.py", "\tx = 1\n\t\n  x  =  2 \n \x0b\n\f# c\n"), (2, "a.py", "x = 1\nx = 2")], "file_id bigint, file_path string, content string")
    row, plain = handwritten.layout(f).orderBy("file_id").collect()
    assert row.shingles == plain.shingles and len(row.shingles) == 1 and (row.n_lines, plain.n_lines) == (3, 2)


def test_files_empty_tables(spark):
    assert judged(spark, [("a.py", HAND)]) == [None]
    f = spark.createDataFrame([], "file_id bigint, file_path string, content string")
    k = spark.createDataFrame([], "file_name string, content string")
    assert handwritten.found(f, k).count() == 0 and handwritten.hand_written(f, k).count() == 0


def test_long_text_and_repeats(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    long = "".join(HAND.replace("_", f"_{letters[i // 26]}{letters[i % 26]}_").replace("see the", f"see {letters[i % 26] * 3}").replace("value", f"value_{letters[i // 26]}{letters[i % 26]}") for i in range(200))
    f = spark.createDataFrame([(1, "a.py", long), (1, "a.py", long), (2, "b.js", "a" * 300_000)], "file_id bigint, file_path string, content string")
    k = spark.createDataFrame([("core.py", LIB)], "file_name string, content string")
    assert [r.file_id for r in handwritten.found(f, k).collect()] == [2]
