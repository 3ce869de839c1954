"""Parent-child links to full hierarchies (problem 3).

Subtree sizes are summed upward, siblings get preorder ranges by prefix sums, and
the ranges are carried downward with root and depth; ancestors and descendants
then follow from nested ranges. Both directions go by doubling (every round doubles
the distance that a pointer spans), so a tree of depth d takes log2(d) rounds and not
d. Nodes whose pointer never reaches a root are unprocessed: they lie on or below a
cycle. The rounds run when `hierarchy` is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archspan.runtime import Scratch

#: Open nodes of a round (some 50 bytes each) are broadcast up to this number, so that a round near the end shuffles no finished nodes.
BROADCAST_NODES = 100_000
#: Siblings per prefix-sum block, about; a parent with more children is split into blocks.
SIBLINGS_PER_BLOCK = 4096


def contains_links(edges: DataFrame) -> DataFrame:
    """(repo_id, parent, fqn) of CONTAINS edges (kind without case and outer blanks), as often as they are there.

    Rows with a null repo_id, source or target are ignored.
    """
    kind = F.lower(F.trim("kind")) == "contains"
    return edges.where(kind).select("repo_id", F.col("source").alias("parent"), F.col("target").alias("fqn")).dropna()


def _near(df: DataFrame, n: int, broadcast_nodes: int) -> DataFrame:
    return F.broadcast(df) if n <= broadcast_nodes else df


def _kept(links: DataFrame) -> DataFrame:
    return links.groupBy("repo_id", "fqn").agg(F.min("parent").alias("parent"))


def dropped_links(links: DataFrame) -> DataFrame:
    """(repo_id, fqn, parent) of links that a forest can't hold: all but the least parent of an FQN."""
    return links.select("repo_id", "fqn", "parent").distinct().join(_kept(links), ["repo_id", "fqn", "parent"], "left_anti")


def numbered(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, parent, repo_id, fqn, parent_fqn): nodes at either end of a link, with written ids; parent is null at a root."""
    ends = links.select("repo_id", F.explode(F.array("fqn", "parent")).alias("fqn")).distinct()
    ids = scratch.cut(ends.withColumn("id", F.monotonically_increasing_id()))
    parents = ids.select("repo_id", F.col("fqn").alias("parent_fqn"), F.col("id").alias("parent"))
    withp = ids.join(_kept(links).withColumnRenamed("parent", "parent_fqn"), ["repo_id", "fqn"], "left").join(parents, ["repo_id", "parent_fqn"], "left")
    return scratch.cut(withp.select("id", "parent", "repo_id", "fqn", "parent_fqn"))


def _upward(nodes: DataFrame, scratch: Scratch, broadcast_nodes: int) -> tuple[DataFrame, DataFrame]:
    """(id, size) of every node that has anything below it, and the ids of unprocessed nodes.

    In round k the open nodes are those whose ancestor 2^k links up exists (``ptr``), and
    ``size`` counts their subtree down to 2^k - 1 links; adding the sizes of the nodes
    that point at a node doubles its reach. A node whose pointer is not open itself
    comes past its root and is done; what it gains later is only noted. A round in
    which no node gets done ends the loop: all that is left circles.
    """
    state, left = scratch.cut_counting(nodes.where(F.col("parent").isNotNull()).select("id", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("size")), F.lit(True))
    gains = []
    while left:
        gained = scratch.cut(state.groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("gain")))
        gains.append(gained)
        far = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"))
        jumped = state.join(_near(far, left, broadcast_nodes), "ptr").select("id", F.col("ptr2").alias("ptr"), "size")
        grown = jumped.join(_near(gained, left, broadcast_nodes), "id", "left").select("id", "ptr", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"))
        new, now = scratch.cut_counting(grown, F.lit(True))
        scratch.drop(state)
        state = new
        if now == left:
            break
        left = now
    noted = gains[0] if gains else nodes.select("id", F.lit(0).cast("bigint").alias("gain")).where("false")
    for more in gains[1:]:
        noted = noted.unionByName(more)
    return noted.groupBy("id").agg((F.sum("gain") + 1).alias("size")), state.select("id")


def _offsets(placed: DataFrame) -> DataFrame:
    """(id, offset): size of the siblings before a node, by a two-level prefix sum.

    The siblings of a parent that has very many are dealt into blocks by hash; block sums are
    prefixed per parent and sizes within a block, so a parent with a third of all nodes fills many tasks.
    """
    kids = placed.where(F.col("parent").isNotNull()).select("id", "parent", "size")
    many = kids.groupBy("parent").agg(F.ceil(F.count(F.lit(1)) / SIBLINGS_PER_BLOCK).alias("n_blocks")).where("n_blocks > 1")
    dealt = kids.join(many, "parent", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("n_blocks")), F.lit(0)))
    sums = dealt.where("n_blocks > 1").groupBy("parent", "block").agg(F.sum("size").alias("block_size"))
    prefix = sums.select("parent", "block", F.sum("block_size").over(W.partitionBy("parent").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("base"))
    within = F.sum("size").over(W.partitionBy("parent", "block").orderBy("id").rowsBetween(W.unboundedPreceding, -1))
    whole = dealt.withColumn("within", within).join(prefix, ["parent", "block"], "left")
    return whole.select("id", (F.coalesce("base", F.lit(0)) + F.coalesce("within", F.lit(0))).alias("offset"))


def _downward(placed: DataFrame, scratch: Scratch, paths: bool, broadcast_nodes: int) -> DataFrame:
    """(id, size, lft, depth, root, path): preorder position within the tree, links up to the root, the root's FQN and, if asked, the names on the way.

    lft is the sum of 1 + offset over the links up to the root. Each round writes
    only the nodes that are still on their way; those that arrived stay where they are.
    """
    open_ = F.col("ptr").isNotNull()
    top = F.col("parent").isNull()
    path = F.array("fqn") if paths else F.lit(None).cast("array<string>")
    begin = placed.join(_offsets(placed), "id", "left")
    start = begin.select("id", "size", F.col("parent").alias("ptr"), F.when(top, F.lit(0).cast("bigint")).otherwise(F.col("offset") + 1).alias("lft"), F.when(top, 0).otherwise(1).alias("depth"), F.when(top, F.col("fqn")).alias("root"), path.alias("path"))
    last, left = scratch.cut_counting(start, open_)
    done = last.where(~open_)
    while left:
        far = done.unionByName(last.where(open_)).select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("lft").alias("lft2"), F.col("depth").alias("depth2"), F.col("root").alias("root2"), F.col("path").alias("path2"))
        moved = _near(last.where(open_), left, 0 if paths else broadcast_nodes).join(far, "ptr").select("id", "size", F.col("ptr2").alias("ptr"), (F.col("lft") + F.col("lft2")).alias("lft"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("root2").alias("root"), F.concat("path2", "path").alias("path"))
        last, left = scratch.cut_counting(moved, open_)
        done = done.unionByName(last.where(~open_))
    return done.drop("ptr")


def hierarchy(links: DataFrame, scratch: Scratch, paths: bool = False, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(repo_id, fqn, parent, root, depth, lft, rgt, n_descendants, on_cycle, path) per FQN at either end of a link.

    lft is the preorder position in the node's tree and rgt the last position below
    it: b lies below a exactly if both have one root and a.lft < b.lft <= a.rgt. FQNs
    on a cycle or below one have root '', depth -1, null positions and ``on_cycle``
    true. A link from an FQN to itself is a cycle. ``path`` holds the FQNs from the root
    down if ``paths``, else null. An FQN with several parents hangs under the least;
    `dropped_links` lists the other links, whose ends are nodes all the same. No links
    give an empty table.
    """
    nodes = numbered(links, scratch)
    sizes, stuck = _upward(nodes, scratch, broadcast_nodes)
    kept = nodes.join(stuck, "id", "left_anti") if stuck.head(1) else nodes
    placed = scratch.cut(kept.select("id", "parent", "fqn").join(sizes, "id", "left").fillna(1, ["size"]))
    order = _downward(placed, scratch, paths, broadcast_nodes)
    known = order.select("id", "root", "depth", "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("n_descendants"), F.lit(False).alias("on_cycle"), "path")
    lost = stuck.select("id", F.lit("").alias("root"), F.lit(-1).alias("depth"), *[F.lit(None).cast("bigint").alias(c) for c in ("lft", "rgt", "n_descendants")], F.lit(True).alias("on_cycle"), F.lit(None).cast("array<string>").alias("path"))
    named = nodes.select("id", "repo_id", "fqn", F.col("parent_fqn").alias("parent"))
    return named.join(known.unionByName(lost), "id").select("repo_id", "fqn", "parent", "root", "depth", "lft", "rgt", "n_descendants", "on_cycle", "path")


def descendant_pairs(tree: DataFrame) -> DataFrame:
    """(repo_id, ancestor, fqn, distance) for every proper ancestor, from the nested ranges alone.

    A range (lft, rgt] is cut into blocks whose length is a power of two and that
    start at a multiple of it; a position lies in one block of each length. Equality
    on (root, level, block) then replaces the range condition: the join emits
    exactly the true pairs, each once, and compares no others.
    """
    t = tree.where(~F.col("on_cycle"))
    a = t.where("n_descendants > 0").select("repo_id", "root", F.col("fqn").alias("ancestor"), F.col("depth").alias("a_depth"), (F.col("lft") + 1).alias("lo"), (F.col("rgt") + 1).alias("hi"))
    top = t.agg(F.coalesce(F.max("rgt"), F.lit(0))).first()[0]
    levels = list(range(0, max(1, int(top + 1).bit_length() + 1)))
    up = F.array(*[F.lit(k) for k in levels])

    def side(k):  # blocks that the canonical cover of [lo, hi) uses at level k: at most one at each end
        step = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        first, last = F.ceil(F.col("lo") / step).cast("bigint"), F.floor(F.col("hi") / step).cast("bigint")
        left = F.when((first < last) & (F.pmod(first, F.lit(2)) == 1), F.struct(k.alias("level"), first.alias("block")))
        right = F.when((first < last) & (F.pmod(last, F.lit(2)) == 1) & ~((F.pmod(first, F.lit(2)) == 1) & (last - 1 == first)), F.struct(k.alias("level"), (last - 1).alias("block")))
        return F.array_compact(F.array(left, right))

    cover = a.select("repo_id", "root", "ancestor", "a_depth", F.explode(F.flatten(F.transform(up, side))).alias("_b")).select("repo_id", "root", "ancestor", "a_depth", "_b.*")
    points = t.where("depth > 0").select("repo_id", "root", "fqn", "depth", F.explode(F.transform(up, lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col("lft"), k).alias("block")))).alias("_p")).select("repo_id", "root", "fqn", "depth", "_p.*")
    return cover.join(points, ["repo_id", "root", "level", "block"]).select("repo_id", "ancestor", "fqn", (F.col("depth") - F.col("a_depth")).alias("distance"))


def full_paths(tree: DataFrame) -> DataFrame:
    """(repo_id, fqn, path, depth) of a tree with paths: the FQNs from the root down, joined by `` > ``; FQNs on or below a cycle have none."""
    return tree.where(~F.col("on_cycle")).select("repo_id", "fqn", F.array_join("path", " > ").alias("path"), "depth")
