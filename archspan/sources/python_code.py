"""Definitions, imports, base classes and calls of Python source, as rows.

The syntax tree needs Python and is read file by file in Arrow batches; names are
resolved afterwards by joins.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspan.functions import names
from archspan.operators import grounding
from archspan.runtime import spread

#: Output rows are sent on from this number.
FLUSH_ROWS = 100_000
FACTS = "file_id bigint, repo_id string, module string, fact string, owner string, name string, kind string, line_start int, line_end int"


def _text(node: ast.AST) -> str | None:
    """Dotted name of an expression, or None."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _facts(tree: ast.Module, module: str, package: bool, lines: list[str]) -> Iterator[tuple]:
    """(fact, owner, name, kind, first line, last line) in document order.

    The owner of a call is the definition around it. A call on self, cls or a name that the function around
    it assigns is of kind ``shadowed``, as its first name tells nothing.
    """
    yield "def", module, module, "module", 1, max([1, *(getattr(n, "end_lineno", 1) or 1 for n in tree.body)])
    stack = [(child, module, "module", "") for child in reversed(tree.body)]
    while stack:
        node, owner, above, scope = stack.pop()
        inner, kind = owner, above
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            scope = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if above == "class" else "function"
            inner = f"{owner}.{node.name}"
            yield "def", owner, inner, kind, node.lineno, node.end_lineno
            for b in getattr(node, "bases", []):
                if _text(b):
                    yield "base", inner, _text(b), kind, node.lineno, node.lineno
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield "import", module, a.name, a.asname or a.name.split(".")[0], node.lineno, node.lineno
        elif isinstance(node, ast.ImportFrom):
            up = module.split(".")[: len(module.split(".")) - node.level + package] if node.level else []
            base = ".".join([*up, *([node.module] if node.module else [])])
            for a in node.names:
                yield "import", module, f"{base}.{a.name}" if base else a.name, a.asname or a.name, node.lineno, node.lineno
        elif isinstance(node, ast.Call) and _text(node.func):
            name = _text(node.func)
            root = name.split(".")[0]
            hidden = root in ("self", "cls") or re.search(rf"\b{re.escape(root)}\s*=(?!=)", scope)
            yield "call", owner, name, "shadowed" if hidden else "", node.lineno, node.lineno
        stack.extend((child, inner, kind if inner != owner else above, scope) for child in reversed(list(ast.iter_child_nodes(node))))


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file_id", pa.int64()), ("repo_id", pa.string()), ("module", pa.string()), ("fact", pa.string()), ("owner", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())])
    for batch in batches:
        rows: list[tuple] = []
        for r in batch.to_pylist():
            try:
                text = (r["content"] or "").lstrip("\ufeff")
                tree = ast.parse(text)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue
            rows += [(r["file_id"], r["repo_id"], r["module"], *f) for f in _facts(tree, r["module"], bool(r["package"]), text.splitlines())]
            if len(rows) >= FLUSH_ROWS:
                yield _packed(rows, schema)
                rows = []
        yield _packed(rows, schema)


def code_facts(files: DataFrame) -> DataFrame:
    """One row per definition, base, import and call of ``files`` (file_id, repo_id, file_path, content).

    Only ``.py`` files are read; files that don't parse have no rows. Relative
    imports are made absolute from the file's own name.
    """
    path = F.regexp_replace(F.regexp_replace(F.trim("file_path"), r"[\\/]+", "/"), r"^\./", "")
    py = files.where(path.endswith(".py")).select("file_id", "repo_id", names.path_to_fqn(path).alias("module"), path.endswith("__init__.py").alias("package"), "content")
    return spread(py, files).mapInArrow(_read, FACTS)


def definitions(facts: DataFrame) -> DataFrame:
    """(repo_id, file_id, fqn, kind, line_start, line_end)."""
    return facts.where("fact = 'def'").select("repo_id", "file_id", F.col("name").alias("fqn"), "kind", "line_start", "line_end")


def code_edges(facts: DataFrame) -> DataFrame:
    """(repo_id, source, target, kind) of CONTAINS, IMPORTS, INHERITS and CALLS, distinct.

    An import names the imported member where that is defined in the repository,
    else its module if that is, else itself. Calls and bases resolve by the suffix index
    of the repository's names (itself, else fewest parts, else least). A dotted call
    that doesn't is taken for its first name, unless that is shadowed; a base that doesn't
    goes through the module's imports. What resolves to nothing is no edge.
    """
    defined = definitions(facts).select("repo_id", "fqn").distinct()
    known = defined.withColumnRenamed("fqn", "known")
    contains = facts.where("fact = 'def' AND owner <> name").select("repo_id", F.col("owner").alias("source"), F.col("name").alias("target"), F.lit("CONTAINS").alias("kind"))
    up = definitions(facts).where("kind = 'module'").select("repo_id", names.parent("fqn").alias("source"), F.col("fqn").alias("target"), F.lit("CONTAINS").alias("kind"))
    packages = up.join(known.withColumnRenamed("known", "source"), ["repo_id", "source"], "left_semi")
    imported = facts.where("fact = 'import'").select("repo_id", "module", "name", F.col("kind").alias("alias"), names.parent("name").alias("above"))
    a = known.withColumnRenamed("known", "name").withColumn("full", F.col("name"))
    b = known.withColumnRenamed("known", "above").withColumn("part", F.col("above"))
    resolved = imported.join(a, ["repo_id", "name"], "left").join(b, ["repo_id", "above"], "left")
    imports = resolved.select("repo_id", F.col("module").alias("source"), F.coalesce("full", "part", "name").alias("target"), F.lit("IMPORTS").alias("kind"))

    first = F.substring_index("name", ".", 1)
    uses = facts.where("fact IN ('base', 'call')").select("repo_id", "module", "fact", "owner", "name", "kind", first.alias("root"))
    asked = uses.select("repo_id", F.explode(F.array("name", "root")).alias("text")).distinct()
    by_suffix = grounding.resolve_suffix(asked, defined).select("repo_id", "text", "fqn")
    named = uses.join(by_suffix.select("repo_id", F.col("text").alias("name"), F.col("fqn").alias("whole")), ["repo_id", "name"], "left")
    calls = named.where("fact = 'call'").join(by_suffix.select("repo_id", F.col("text").alias("root"), F.col("fqn").alias("of_root")), ["repo_id", "root"], "left")
    target = F.coalesce("whole", F.when((F.col("name") != F.col("root")) & (F.col("kind") != "shadowed"), F.col("of_root")))
    called = calls.select("repo_id", F.col("owner").alias("source"), target.alias("target"), F.lit("CALLS").alias("kind")).where("target IS NOT NULL")
    aliases = imported.select("repo_id", "module", F.col("alias").alias("root"), F.when(F.col("alias") == F.substring_index("name", ".", 1), F.when(F.col("above").isNull() | (names.last_part("name") != F.col("alias")), F.col("alias")).otherwise(F.col("name"))).otherwise(F.col("name")).alias("bound"))
    aliases = aliases.groupBy("repo_id", "module", "root").agg(F.min("bound").alias("bound"))
    rest = F.when(F.col("name") == F.col("root"), "").otherwise(F.expr("substring(name, length(root) + 1)"))
    bases = named.where("fact = 'base'").join(aliases, ["repo_id", "module", "root"], "left")
    inherited = bases.select("repo_id", F.col("owner").alias("source"), F.coalesce("whole", F.concat("bound", rest)).alias("target"), F.lit("INHERITS").alias("kind")).where("target IS NOT NULL")
    return contains.unionByName(packages).unionByName(imports).unionByName(inherited).unionByName(called).distinct()


def _hashes(content: str, module: str) -> Iterator[tuple[str, str]]:
    """(fqn, hash) of a file and of each definition in it.

    Hashed is the text of the definition without comments (by tokens, so that a mark in a
    string stays), without its own name and with white space folded: a rename, a new
    comment or another layout changes nothing.
    """
    tree = ast.parse(content)
    lines = [line.encode() for line in content.splitlines(keepends=True)]
    at = lambda row, column: (row - 1, len(content_lines[row - 1][:column].encode()))
    content_lines = content.splitlines(keepends=True)
    comments: list[tuple[int, int, int]] = []
    name_after: dict[tuple[int, int], tuple[int, int, int]] = {}
    keyword = None
    for t in tokenize.generate_tokens(io.StringIO(content).readline):
        if t.type == tokenize.COMMENT:
            row, start = at(*t.start)
            comments.append((row, start, start + len(t.string.encode())))
        elif t.type == tokenize.NAME:
            row, start = at(*t.start)
            if keyword is not None:
                name_after[keyword] = (row, start, start + len(t.string.encode()))
                keyword = None
            elif t.string in ("def", "class"):
                keyword = (row, start)
    by_row: dict[int, list[tuple[int, int]]] = {}
    for row, start, end in comments:
        by_row.setdefault(row, []).append((start, end))

    def digest(first: tuple[int, int], last: tuple[int, int], name: tuple[int, int, int] | None) -> str:
        parts = []
        for row in range(first[0], min(last[0] + 1, len(lines))):
            low = first[1] if row == first[0] else 0
            high = last[1] if row == last[0] else len(lines[row])
            cuts = sorted(by_row.get(row, []) + ([name[1:]] if name and name[0] == row else []))
            for start, end in cuts:
                if start >= low and end <= high:
                    parts.append(lines[row][low:start])
                    low = end
            parts.append(lines[row][low:high])
        return hashlib.sha256(b" ".join(b"".join(parts).split())).hexdigest()

    yield module, digest((0, 0), (len(lines), 0), None)
    stack: list[tuple[ast.AST, str]] = [(tree, module)]
    while stack:
        node, owner = stack.pop()
        inner = owner
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            inner = f"{owner}.{node.name}"
            first = (node.lineno - 1, node.col_offset)
            word = first
            if isinstance(node, ast.AsyncFunctionDef):  # the name follows def, which follows async
                word = min(k for k in name_after if k > first)
            yield inner, digest(first, (node.end_lineno - 1, node.end_col_offset), name_after.get(word))
        stack.extend((child, inner) for child in ast.iter_child_nodes(node))


def _read_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            try:
                out += [(r["file_id"], r["repo_id"], fqn, h) for fqn, h in _hashes((r["content"] or "").lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n"), r["module"])]
            except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError):
                continue
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))], names=["file_id", "repo_id", "fqn", "code_hash"])


def code_hash(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, fqn, code_hash) of every ``.py`` file (as a module) and every definition in it; see `_hashes`.

    Files that don't parse have no rows. A name that a file defines twice has two rows.
    """
    path = F.regexp_replace(F.regexp_replace(F.trim("file_path"), r"[\\/]+", "/"), r"^\./", "")
    py = files.where(path.endswith(".py")).select("file_id", "repo_id", names.path_to_fqn(path).alias("module"), "content")
    return spread(py, files).mapInArrow(_read_hashes, "file_id bigint, repo_id string, fqn string, code_hash string")
