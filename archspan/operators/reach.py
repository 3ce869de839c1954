"""Rule matching and typed reachability (the graph joins).

The searches run when they are called, in rounds that are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspan.functions import names
from archspan.operators import orphans
from archspan.operators.model import FAMILIES
from archspan.runtime import Scratch

#: Rounds after which a closure fails loudly instead of being cut short.
MAX_ROUNDS = 2000
#: Steps followed per written round.
UNROLL = 4
PATTERN = ["repo_id", "pattern"]


def family_of(predicate: Column | str) -> Column:
    return F.regexp_extract(names.col(predicate), r"_(dependency|implementation)$", 1)


def rule_matches(rules: DataFrame, nodes: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(constraint_id, repo_id, side, fqn, status): nodes that the subject or object pattern of a rule matches.

    Only rules with a match on both sides come out. Names are turned into the
    patterns that match them, so the join is an equality. With ``scratch`` the
    patterns of names that no rule has are left out by a Bloom filter of the rules'
    patterns, if that is small enough to be broadcast, and the hits are written.
    """
    keys = nodes.select("repo_id", "fqn", F.explode(names.matching_patterns("fqn")).alias("pattern"))
    sides = rules.select("constraint_id", "repo_id", F.explode(F.array(F.struct(F.lit("subject").alias("side"), F.col("subject").alias("pattern")), F.struct(F.lit("object").alias("side"), F.col("object").alias("pattern")))).alias("_s")).select("constraint_id", "repo_id", "_s.*")
    if scratch:
        asked, n = scratch.cut_counting(sides.select(*PATTERN).distinct(), F.lit(True))
        words, blocks = orphans.bloom_filter(asked, PATTERN, n)
        if blocks <= orphans.BROADCAST_WORDS:
            keys = orphans.probe(keys, words, blocks, PATTERN).where("maybe").drop("maybe")
    hits = sides.join(keys, ["repo_id", "pattern"]).select("constraint_id", "repo_id", "side", "fqn", F.when(F.col("pattern") == F.col("fqn"), "EXACT").otherwise("WILDCARD").alias("status"))
    hits = scratch.cut(hits) if scratch else hits
    both = hits.groupBy("constraint_id").agg(F.count_distinct("side").alias("_n")).where("_n = 2").select("constraint_id")
    return hits.join(both, "constraint_id", "left_semi")


def families(edges: DataFrame) -> DataFrame:
    """Each edge once per rule family that follows it."""
    follows = F.array_compact(F.array(*[F.when(F.col("kind").isin(*kinds), F.lit(f)) for f, kinds in FAMILIES.items()]))
    return edges.withColumn("family", F.explode(follows))


def steps(edges: DataFrame, dev: DataFrame) -> DataFrame:
    """(repo_id, family, node, target, kind, ord): the edges that a search follows; development tools are not entered."""
    open_ = families(edges).join(dev.select("repo_id", F.col("fqn").alias("target")), ["repo_id", "target"], "left_anti")
    return open_.select("repo_id", "family", F.col("source").alias("node"), "target", "kind", "ord")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _merged(parts: list[DataFrame], scratch: Scratch) -> list[DataFrame]:
    """Many written parts become one, so that plans stay short; the parts are deleted."""
    if len(parts) <= 12:
        return parts
    whole = scratch.cut(_union(parts))
    scratch.drop(*parts[:-1])
    return [whole]


def first_paths(starts: DataFrame, edges: DataFrame, group: list[str], modules: DataFrame, scratch: Scratch) -> DataFrame:
    """(group ..., start, target, len, path): the first path, in breadth-first order, from each start to each target.

    ``starts`` holds (group ..., repo_id, start) and ``edges`` (group ..., node, target, kind, ord).
    A node opens its CONTAINS edges only while the path has descended from the start
    by CONTAINS alone. A start inside a module also sees the module's other edges,
    ahead of its own, except into the module itself. ``path`` is the array of edge ords
    (the least in order among shortest ones); its first element is lowered by SEED for
    an edge of the module. All starts advance together, level by level, so the first
    label that a state gets is its least one; a round follows UNROLL levels.
    """
    edges = scratch.cut(edges.select(*group, "node", "target", "kind", "ord"))
    begin = starts.select(*dict.fromkeys([*group, "repo_id", "start"])).distinct()
    key = [*group, "start", "node", "descending"]
    own = begin.select(*group, "start", F.col("start").alias("node"), F.lit(True).alias("descending"), F.array().cast("array<bigint>").alias("path"))
    seeded = (
        begin.join(modules.select("repo_id", F.col("fqn").alias("start"), F.col("module").alias("node")), ["repo_id", "start"])
        .join(edges.where(F.col("kind") != "CONTAINS"), [*group, "node"])
        .where(~names.at_or_under("target", "node"))
        .select(*group, "start", F.col("target").alias("node"), F.lit(False).alias("descending"), F.array(F.col("ord") - SEED).alias("path"))
    )
    label = F.struct(F.size("path").alias("len"), "path")
    frontier, left = scratch.cut_counting(own, F.lit(True))
    first: DataFrame | None = seeded
    parts = [frontier]
    rounds = 0
    while left:
        now, reached = frontier, None
        for _ in range(UNROLL):
            step = now.join(edges, [*group, "node"]).where((F.col("kind") != "CONTAINS") | F.col("descending"))
            onward = step.select(*group, "start", F.col("target").alias("node"), (F.col("descending") & (F.col("kind") == "CONTAINS")).alias("descending"), F.concat("path", F.array("ord")).alias("path"))
            if first is not None:
                onward, first = onward.unionByName(first), None
            now = onward.groupBy(*key).agg(F.min("path").alias("path"))
            reached = now if reached is None else reached.unionByName(now)
        fresh = reached.groupBy(*key).agg(F.min(label)["path"].alias("path")).join(_union(parts), key, "left_anti")
        frontier, left = scratch.cut_counting(fresh, F.lit(True))
        parts = _merged([*parts, frontier], scratch)
        rounds += 1
        if rounds > MAX_ROUNDS:
            raise RuntimeError(f"search not complete after {MAX_ROUNDS} rounds")
    found = _union(parts).where(F.size("path") > 0)
    best = found.groupBy(*group, "start", F.col("node").alias("target")).agg(F.min(label).alias("_p"))
    return best.select(*group, "start", "target", "_p.len", "_p.path")


#: Lowers the ord of a module's edge, so that it sorts before the start's own edges.
SEED = 1 << 60
