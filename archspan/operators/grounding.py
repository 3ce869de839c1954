"""Suffix resolution, grounding of rule objects, externals, listings and tiered search."""

from __future__ import annotations

import builtins
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archspan.functions import names
from archspan.operators.model import DEV_TOOLS, ENTRY_POINT_ROOTS
from archspan.runtime import Scratch

#: Bare names of the language's builtins never resolve to a repository's own names.
BUILTINS = tuple(sorted(n for n in dir(builtins) if not n.startswith("_")))
SEARCH_CAP = 20


def suffix_index(nodes: DataFrame) -> DataFrame:
    """(repo_id, suffix, fqn): every dotted suffix of every name; bare builtin names are left out."""
    flat = nodes.select("repo_id", "fqn").distinct().select("repo_id", "fqn", F.explode(names.suffixes("fqn")).alias("suffix"))
    return flat.where((F.instr("suffix", ".") > 0) | ~F.col("suffix").isin(*BUILTINS))


def resolve_suffix(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, text, fqn, n): the name that ends with the text (itself, else fewest parts, else least) and how many do.

    ``texts`` holds (repo_id, text). The name is unique where n = 1. The index is
    reduced to one row per suffix before it meets the texts, so a suffix that very many names have is none the dearer.
    """
    order = F.struct((F.col("fqn") != F.col("suffix")).alias("a"), names.depth("fqn").alias("b"), "fqn")
    best = suffix_index(nodes).groupBy("repo_id", "suffix").agg(F.min(order)["fqn"].alias("fqn"), F.count(F.lit(1)).alias("n"))
    return texts.select("repo_id", "text").distinct().join(best.withColumnRenamed("suffix", "text"), ["repo_id", "text"])


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, root): first segments of modules that nothing contains."""
    kids = edges.where(F.col("kind") == "CONTAINS").select("repo_id", F.col("target").alias("fqn")).distinct()
    return nodes.where(F.col("kind") == "module").join(kids, ["repo_id", "fqn"], "left_anti").select("repo_id", F.substring_index("fqn", ".", 1).alias("root")).distinct()


def listed_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Roots without the scripts that every repository has."""
    return roots(nodes, edges).where(~F.col("root").isin(*ENTRY_POINT_ROOTS))


def external_packages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, package): first segments of import targets that are no root."""
    seen = edges.where(F.col("kind") == "IMPORTS").select("repo_id", F.substring_index("target", ".", 1).alias("package")).distinct()
    return seen.join(roots(nodes, edges).withColumnRenamed("root", "package"), ["repo_id", "package"], "left_anti")


def ground_objects(objects: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, object, label, resolved_fqn, package) for distinct (repo_id, object).

    Labels in order: exact (an own node), unique_suffix, prefix (own nodes below),
    external (root of an import), unknown. A tie of suffixes grounds nothing.
    """
    asked = objects.select("repo_id", "object").distinct().withColumn("text", names.strip_dots_stars("object"))
    own = nodes.where(F.col("kind") != "external")
    exact = own.select("repo_id", F.col("fqn").alias("text"), F.lit(True).alias("is_exact")).distinct()
    suffix = resolve_suffix(asked, nodes).where("n = 1").select("repo_id", "text", F.col("fqn").alias("suffix_fqn"))
    above = own.select("repo_id", F.explode(names.ancestors("fqn", proper=True)).alias("text")).distinct().withColumn("is_prefix", F.lit(True))
    outside = external_packages(nodes, edges).select("repo_id", F.col("package").alias("first"), F.lit(True).alias("is_external"))
    joined = asked.withColumn("first", F.substring_index("text", ".", 1)).join(exact, ["repo_id", "text"], "left").join(suffix, ["repo_id", "text"], "left").join(above, ["repo_id", "text"], "left").join(outside, ["repo_id", "first"], "left")
    label = F.when(F.col("is_exact"), "exact").when(F.col("suffix_fqn").isNotNull(), "unique_suffix").when(F.col("is_prefix"), "prefix").when(F.col("is_external"), "external").otherwise("unknown")
    return joined.withColumn("label", label).select("repo_id", "object", "label", F.when(F.col("label") == "exact", F.col("text")).when(F.col("label") == "unique_suffix", F.col("suffix_fqn")).alias("resolved_fqn"), F.when(F.col("label") == "external", F.col("first")).alias("package"))


def validate_rules(rules: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(constraint_id, verdict): ``ok``, ``subject`` or ``object``: which side of a rule looks internal but names nothing.

    External subjects and objects pass; an internal subject must be a node or have
    nodes below, an internal object must be grounded.
    """
    own = nodes.where(F.col("kind") != "external").select("repo_id", F.explode(names.ancestors("fqn")).alias("subject_base")).distinct().withColumn("known", F.lit(True))
    inner = roots(nodes, edges)
    labels = ground_objects(rules, nodes, edges).select("repo_id", "object", "label")
    r = rules.select("constraint_id", "repo_id", "subject", "object", names.strip_dots_stars("subject").alias("subject_base"), F.substring_index("subject", ".", 1).alias("s_root"), F.substring_index("object", ".", 1).alias("o_root"))
    r = r.join(inner.select("repo_id", F.col("root").alias("s_root"), F.lit(True).alias("s_in")), ["repo_id", "s_root"], "left").join(inner.select("repo_id", F.col("root").alias("o_root"), F.lit(True).alias("o_in")), ["repo_id", "o_root"], "left")
    r = r.join(own, ["repo_id", "subject_base"], "left").join(labels, ["repo_id", "object"])
    return r.select("constraint_id", F.when(F.col("s_in") & F.col("known").isNull(), "subject").when(F.col("o_in") & (F.col("label") == "unknown"), "object").otherwise("ok").alias("verdict"))


def scopes_under(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(repo_id, fqn) of the nodes at or under any prefix; ``prefixes`` holds (repo_id, top)."""
    up = nodes.select("repo_id", "fqn", F.explode(names.ancestors("fqn")).alias("top"))
    return up.join(prefixes.where(F.length("top") > 0).select("repo_id", "top").distinct(), ["repo_id", "top"], "left_semi").select("repo_id", "fqn").distinct()


def externalised(nodes: DataFrame, edges: DataFrame, rules: DataFrame, dev_packages: DataFrame | None = None) -> DataFrame:
    """(repo_id, fqn, kind, role): placeholders for import targets and rule ends that no node names; patterns count as their base.

    A development tool is one of the known tools, or of the repository's own ``dev_packages`` (repo_id, package).
    """
    ends = rules.select("repo_id", F.explode(F.array("subject", "object")).alias("fqn")).select("repo_id", names.base("fqn").alias("fqn"))
    used = edges.where(F.col("kind") == "IMPORTS").select("repo_id", names.base("target").alias("fqn")).unionByName(ends).where(F.length("fqn") > 0).distinct()
    outside = used.join(nodes.select("repo_id", "fqn").distinct(), ["repo_id", "fqn"], "left_anti").withColumn("package", F.substring_index("fqn", ".", 1))
    tool = F.col("package").isin(*DEV_TOOLS)
    if dev_packages is not None:
        outside = outside.join(dev_packages.select("repo_id", "package", F.lit(True).alias("_own")).distinct(), ["repo_id", "package"], "left")
        tool = tool | F.coalesce("_own", F.lit(False))
    return outside.select("repo_id", "fqn", F.lit("external").alias("kind"), F.when(tool, "dev_tool").otherwise("unknown").alias("role"))


def materialised(rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rules whose subject or object names a module get ``.*`` there; rules whose sides become equal are dropped."""
    modules = nodes.where(F.col("kind") == "module").select("repo_id", "fqn").distinct()
    out = rules
    for side in ("subject", "object"):
        out = out.join(modules.select("repo_id", F.col("fqn").alias(side), F.lit(True).alias("_m")), ["repo_id", side], "left").withColumn(side, F.when(F.col("_m"), F.concat(F.col(side), F.lit(".*"))).otherwise(F.col(side))).drop("_m")
    return out.where(F.col("subject") != F.col("object"))


def _subsequence(plain: Column) -> Column:
    """Pattern in which the characters of a plain text follow in order within a line; each part ends at the next character, so none is tried again."""
    return F.concat(F.lit("(?md)^"), F.regexp_replace(plain, "(.)", r"[^$1\\n]*+$1"))


def _characters(text: Column) -> Column:
    """A bit for each of the characters a-z, 0-9, _ and / that a text has."""
    return reduce(Column.bitwiseOR, [F.when(F.contains(text, F.lit(c)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789_/")])


def search_candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, fqn, kind): nodes, and import targets that are none as ``external_import``."""
    own = nodes.select("repo_id", "fqn", "kind")
    imported = edges.where(F.col("kind") == "IMPORTS").select("repo_id", F.col("target").alias("fqn")).distinct().join(own, ["repo_id", "fqn"], "left_anti").withColumn("kind", F.lit("external_import"))
    return own.unionByName(imported)


def name_search(queries: DataFrame, candidates: DataFrame, scratch: Scratch, cap: int | None = SEARCH_CAP) -> DataFrame:
    """(query_id, n_exact, n_prefix, n_substring, n_relaxed, refused, truncated, rank, fqn, kind): tiered name search.

    ``queries`` holds (query_id, repo_id, query): a stated set, compared with all names
    of its repository. Tiers without case: exact and prefix together, else substring,
    else characters in order (compared only for queries that no name contains). A query without exact or prefix hit and more than
    ``cap`` hits is refused (one row without name); otherwise the first ``cap`` by tier and name come out. With None all hits come out and none is refused. Queries
    without a hit, empty or null give no rows.
    """
    q = queries.select("query_id", "repo_id", F.lower(F.trim("query")).alias("q")).where(F.length("q") > 0)
    spark = candidates.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    c = scratch.cut(candidates.select("repo_id", "fqn", "kind", F.lower("fqn").alias("low")).repartition(n))
    tier = F.when(F.col("low") == F.col("q"), 1).when(F.col("low").startswith(F.col("q")), 2).otherwise(3)
    whole = scratch.cut(c.join(F.broadcast(q), "repo_id").where(F.contains("low", "q")).select("query_id", tier.alias("tier"), "fqn", "kind"))
    # the dear tier is for the queries that no name contains, and for names that have all characters of the query
    plain = F.regexp_replace(F.translate("q", ".", "/"), r"([^A-Za-z0-9_/])", "x")
    left = scratch.cut(q.join(whole.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "repo_id", _subsequence(plain).alias("pattern"), F.length("q").alias("n"), _characters(plain).alias("needs")))
    slashed = c.withColumn("low", F.translate("low", ".", "/")).withColumn("has", _characters(F.col("low")))
    near = slashed.join(F.broadcast(left), "repo_id").where((F.col("has").bitwiseAND(F.col("needs")) == F.col("needs")) & (F.length("low") >= F.col("n"))).where(F.regexp_like("low", F.col("pattern")))
    hits = whole.unionByName(scratch.cut(near.select("query_id", F.lit(4).alias("tier"), "fqn", "kind")))
    counts = hits.groupBy("query_id").agg(*[F.count(F.when(F.col("tier") == i, 1)).alias(f"c{i}") for i in (1, 2, 3, 4)])
    sharp = F.col("c1") + F.col("c2") > 0
    counts = counts.select("query_id", F.col("c1").alias("n_exact"), F.col("c2").alias("n_prefix"), F.when(sharp, 0).otherwise(F.col("c3")).alias("n_substring"), F.when(sharp | (F.col("c3") > 0), 0).otherwise(F.col("c4")).alias("n_relaxed"))
    cap = (1 << 31) - 1 if cap is None else cap
    total = F.col("n_exact") + F.col("n_prefix") + F.col("n_substring") + F.col("n_relaxed")
    counts = counts.withColumn("refused", (F.col("n_exact") + F.col("n_prefix") == 0) & (total > cap)).withColumn("truncated", total > cap)
    top = F.when(F.col("n_exact") + F.col("n_prefix") > 0, 2).when(F.col("n_substring") > 0, 3).otherwise(4)
    kept = hits.join(counts.where(~F.col("refused")), "query_id").where(F.col("tier") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("tier", "fqn", "kind"))).where(F.col("rank") <= cap)
    columns = ["query_id", "n_exact", "n_prefix", "n_substring", "n_relaxed", "refused", "truncated", "rank", "fqn", "kind"]
    none = counts.where("refused").select(*columns[:7], F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("fqn"), F.lit(None).cast("string").alias("kind"))
    return ranked.select(*columns).unionByName(none)


def inherited_members(nodes: DataFrame, edges: DataFrame, scratch) -> DataFrame:
    """(repo_id, cls, member, definer, distance): for each class and method name the nearest class along INHERITS that defines it.

    Own methods have distance 0; of bases at one distance the first by edge order
    wins. Bases are followed round by round to a fixpoint, so rings end.
    """
    from archspan.operators.reach import MAX_ROUNDS

    classes = nodes.where(F.col("kind") == "class").select("repo_id", F.col("fqn").alias("cls"))
    bases = edges.where(F.col("kind") == "INHERITS").select("repo_id", F.col("source").alias("at"), F.col("target").alias("base"), "ord")
    frontier, left = scratch.cut_counting(classes.select("repo_id", "cls", F.col("cls").alias("at"), F.array().cast("array<bigint>").alias("way")), F.lit(True))
    parts = [frontier]
    while left:
        if len(parts) > MAX_ROUNDS:
            raise RuntimeError(f"bases not complete after {MAX_ROUNDS} rounds")
        step = frontier.join(bases, ["repo_id", "at"]).groupBy("repo_id", "cls", F.col("base").alias("at")).agg(F.min(F.concat("way", F.array("ord"))).alias("way"))
        frontier, left = scratch.cut_counting(step.join(reduce(DataFrame.unionByName, parts).select("repo_id", "cls", "at"), ["repo_id", "cls", "at"], "left_anti"), F.lit(True))
        parts.append(frontier)
    seen = reduce(DataFrame.unionByName, parts)
    methods = nodes.where(F.col("kind") == "method").select("repo_id", names.parent("fqn").alias("at"), names.last_part("fqn").alias("member"))
    found = seen.join(methods, ["repo_id", "at"]).groupBy("repo_id", "cls", "member").agg(F.min(F.struct(F.size("way").alias("d"), "way", "at")).alias("_m"))
    return found.select("repo_id", "cls", "member", F.col("_m.at").alias("definer"), F.col("_m.d").alias("distance"))


def span_overlaps(hits: DataFrame, nodes: DataFrame, top_k: int | None = 5) -> DataFrame:
    """(hit_id, fqn, kind, rank): nodes whose lines overlap a hit's in the same file, by first line, the first ``top_k``.

    ``hits`` holds (hit_id, repo_id, file_path, first_line, last_line). The top k is the search's page size, None for all.
    """
    path = F.regexp_replace(F.regexp_replace(F.trim("file_path"), r"[\\/]+", "/"), r"^\./", "")
    h = hits.select("hit_id", "repo_id", path.alias("path"), "first_line", "last_line")
    n = nodes.where(F.col("file_path").isNotNull()).select("repo_id", path.alias("path"), "fqn", "kind", "line_start", "line_end")
    met = h.join(n, ["repo_id", "path"]).where((F.col("line_start") <= F.col("last_line")) & (F.col("line_end") >= F.col("first_line")))
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("hit_id").orderBy("line_start", "fqn")))
    return (ranked if top_k is None else ranked.where(F.col("rank") <= top_k)).select("hit_id", "fqn", "kind", "rank")
