"""The typed graph as DataFrames: current nodes, typed edges, rules, roles and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspan.functions import names
from archspan.operators.copydiff import adr_number
from archspan.runtime import Scratch

DEPENDENCY = ("IMPORTS", "CALLS", "INHERITS")
#: Edge kinds that a rule family follows.
FAMILIES = {"dependency": ("CONTAINS", "IMPORTS", "CALLS", "INHERITS"), "implementation": ("CONTAINS", "CALLS", "INHERITS")}
#: Top-level packages that are development tools.
DEV_TOOLS = (
    "pytest", "py", "nose", "nose2", "unittest", "black", "autopep8", "yapf", "mypy", "pyre", "pytype", "flake8", "pylint", "pyflakes", "pydocstyle", "ruff",
    "isort", "bandit", "tox", "nox", "coverage", "pytest_cov", "sphinx", "mkdocs", "setuptools", "wheel", "pip", "build", "twine", "pre_commit",
)
#: Scripts that every repository has; hidden from listings.
ENTRY_POINT_ROOTS = ("manage", "setup", "noxfile", "conftest")


def current_nodes(nodes: DataFrame) -> DataFrame:
    """One row per (repo_id, fqn): of the rows that were not deleted the last loaded (then the highest node_id)."""
    keep = [c for c in nodes.columns if c not in ("repo_id", "fqn", "deleted_at")]
    order = F.struct("loaded_at", "node_id")
    live = nodes.where(F.col("deleted_at").isNull() & F.col("repo_id").isNotNull() & F.col("fqn").isNotNull())
    return live.groupBy("repo_id", "fqn").agg(F.max_by(F.struct(*keep), order).alias("_n")).select("repo_id", "fqn", "_n.*")


def typed_edges(edges: DataFrame) -> DataFrame:
    """Distinct (repo_id, source, target, kind) with the least ord; kind in upper case without outer blanks."""
    return edges.dropna(subset=["repo_id", "source", "target", "kind"]).groupBy("repo_id", "source", "target", F.upper(F.trim("kind")).alias("kind")).agg(F.min("ord").alias("ord"))


def rules(constraints: DataFrame) -> DataFrame:
    """Rules by value key (repo_id, adr, subject, predicate, object), the first by constraint_id, with scope and specificity.

    Subject and object lose outer blanks; a missing or unknown scope is ``runtime``.
    Rules without subject, predicate or object are dropped.
    """
    scope = F.lower(F.coalesce("scope", F.lit("runtime")))
    plain = constraints.select(
        "repo_id",
        F.lpad(adr_number("adr_id").cast("string"), 6, "0").alias("adr"),
        F.trim("subject").alias("subject"),
        "predicate",
        F.trim("object").alias("object"),
        "constraint_id",
        F.when(scope == "tooling", "tooling").otherwise("runtime").alias("scope"),
        "justification",
        "adr_path",
    ).where((F.length("subject") > 0) & (F.length("object") > 0) & F.col("predicate").isNotNull())
    first = plain.groupBy("repo_id", "adr", "subject", "predicate", "object").agg(F.min(F.struct("constraint_id", "scope", "justification", "adr_path")).alias("_r"))
    return first.select("_r.constraint_id", "repo_id", "adr", "subject", "predicate", "object", "_r.scope", "_r.justification", "_r.adr_path", names.specificity("subject").alias("specificity"))


def enforced(rules_: DataFrame) -> DataFrame:
    """Rules that are checked: not tooling, subject and object differ."""
    return rules_.where((F.col("scope") != "tooling") & (F.col("subject") != F.col("object")))


def rule_states(rules_: DataFrame) -> DataFrame:
    """(constraint_id, state): tooling, self_loop or enforced."""
    state = F.when(F.col("scope") == "tooling", "tooling").when(F.col("subject") == F.col("object"), "self_loop").otherwise("enforced")
    return rules_.select("constraint_id", state.alias("state"))


def dev_tools(nodes: DataFrame) -> DataFrame:
    """(repo_id, fqn) whose stored role is dev_tool or whose root package is a known tool and that is external."""
    root = F.substring_index("fqn", ".", 1)
    return nodes.where((F.lower("role") == "dev_tool") | ((F.col("kind") == "external") & root.isin(*DEV_TOOLS))).select("repo_id", "fqn")


def enclosing_modules(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(repo_id, fqn, module): the nearest module above each function, method and class; of the names in ``of`` (repo_id, fqn) only, if given."""
    inside = nodes.where(F.col("kind").isin("function", "method", "class")).select("repo_id", "fqn")
    inner = (inside if of is None else inside.join(of.select("repo_id", "fqn").distinct(), ["repo_id", "fqn"], "left_semi")).select("repo_id", "fqn", F.explode(names.ancestors("fqn", proper=True)).alias("module"))
    modules = nodes.where(F.col("kind") == "module").select("repo_id", F.col("fqn").alias("module"))
    return inner.join(modules, ["repo_id", "module"]).groupBy("repo_id", "fqn").agg(F.max_by("module", F.length("module")).alias("module"))


def changed_nodes(nodes: DataFrame, days: int | None = 60) -> DataFrame:
    """(repo_id, fqn, change_type): current nodes loaded in the last ``days`` of their repository, or all; ``modified`` if an older row exists."""
    last = nodes.groupBy("repo_id").agg(F.max("loaded_at").alias("_end"))
    older = nodes.groupBy("repo_id", "fqn").agg(F.count(F.lit(1)).alias("_n"))
    recent = current_nodes(nodes)
    if days is not None:
        recent = recent.join(last, "repo_id").where(F.col("loaded_at") >= F.col("_end") - F.expr(f"INTERVAL {days} DAYS"))
    return recent.join(older, ["repo_id", "fqn"]).select("repo_id", "fqn", F.when(F.col("_n") > 1, "modified").otherwise("added").alias("change_type"))


def nodes_and_changes(nodes: DataFrame, scratch: Scratch, days: int | None = 60) -> tuple[DataFrame, DataFrame]:
    """`current_nodes` and `changed_nodes` out of one written pass over the rows."""
    keep = [c for c in nodes.columns if c not in ("repo_id", "fqn", "deleted_at")]
    live = F.col("deleted_at").isNull()
    best = F.max_by(F.when(live, F.struct(*keep)), F.when(live, F.struct("loaded_at", "node_id")))
    per = nodes.groupBy("repo_id", "fqn").agg(best.alias("_c"), F.count(F.lit(1)).alias("_n"), F.max("loaded_at").alias("_last"))
    per = scratch.cut(per.select("repo_id", "fqn", F.col("_c").isNotNull().alias("_live"), "_c.*", "_n", "_last"))
    current = per.where(F.col("_live") & F.col("repo_id").isNotNull() & F.col("fqn").isNotNull())
    recent = current
    if days is not None:
        recent = current.join(per.groupBy("repo_id").agg(F.max("_last").alias("_end")), "repo_id").where(F.col("loaded_at") >= F.col("_end") - F.expr(f"INTERVAL {days} DAYS"))
    return current.drop("_live", "_n", "_last"), recent.select("repo_id", "fqn", F.when(F.col("_n") > 1, "modified").otherwise("added").alias("change_type"))


def importer_counts(edges: DataFrame) -> DataFrame:
    """(repo_id, fqn, fan_in): distinct sources that import a name or anything under it."""
    up = edges.where(F.col("kind") == "IMPORTS").select("repo_id", "source", F.explode(names.ancestors("target")).alias("fqn"))
    return up.groupBy("repo_id", "fqn").agg(F.count_distinct("source").alias("fan_in"))


def children(edges: DataFrame, nodes: DataFrame, cap: int | None = 150) -> DataFrame:
    """(repo_id, fqn, child, kind, child_no, truncated): CONTAINS children that are nodes, in edge order, the first ``cap`` per parent.

    The cap is the listing's page size (None lists all); ``truncated`` tells that there are more.
    """
    from pyspark.sql import Window as W

    kids = edges.where(F.col("kind") == "CONTAINS").select("repo_id", F.col("source").alias("fqn"), F.col("target").alias("child"), "ord").groupBy("repo_id", "fqn", "child").agg(F.min("ord").alias("ord"))
    known = kids.join(nodes.select("repo_id", F.col("fqn").alias("child"), "kind"), ["repo_id", "child"])
    w = W.partitionBy("repo_id", "fqn")
    numbered = known.withColumn("child_no", F.row_number().over(w.orderBy("ord"))).withColumn("truncated", F.count(F.lit(1)).over(w) > cap if cap is not None else F.lit(False))
    return (numbered if cap is None else numbered.where(F.col("child_no") <= cap)).select("repo_id", "fqn", "child", "kind", "child_no", "truncated")
