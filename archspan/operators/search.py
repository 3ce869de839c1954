"""The searches of a rule check, one repository's graph in a task's memory at a time."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspan.operators.model import FAMILIES
from archspan.operators.reach import SEED

#: Groups that a task searches for, about; each block of groups gets the edges of its repository.
GROUPS = 2000
FOUND = "g bigint, start string, target string, len int, path array<bigint>"
KINDS = ("CONTAINS", "IMPORTS", "CALLS", "INHERITS")


def searched(objs: DataFrame, starts: DataFrame, edges: DataFrame, dev: DataFrame, modules: DataFrame) -> DataFrame:
    """(g, start, target, len, path): the rows of `found_and_edges` without the edges."""
    return found_and_edges(objs, starts, edges, dev, modules).where("g IS NOT NULL").drop("edge")


def found_and_edges(objs: DataFrame, starts: DataFrame, edges: DataFrame, dev: DataFrame, modules: DataFrame) -> DataFrame:
    """(g, start, target, len, path, edge): which starts come to an object of their group, and their paths to it.

    ``objs`` holds (g, repo_id, family, object_fqn) and ``starts`` (g, repo_id, family, start, walk).
    A start that comes to an object, or to a name under one, by an edge at least
    gives a row without target; where ``walk`` is set also the first path, in
    breadth-first order, to each of these names (`reach.first_paths`). Development
    tools are not entered. The searches of a block of groups run in one task, over integer arrays
    of the repository's edges; so the number of jobs depends neither on depth nor on size.
    Each block also gives the edges of its paths, in rows that hold ``edge`` (repo_id, ord, source, kind, target) alone,
    so that nobody has to look for them among all edges; another block may give the same edge.
    """
    n_blocks = objs.groupBy("repo_id").agg(F.ceil(F.count_distinct("g") / GROUPS).cast("int").alias("n_blocks"))
    kinds = sorted({k for ks in FAMILIES.values() for k in ks})
    open_ = edges.where(F.col("kind").isin(*kinds)).join(dev.select("repo_id", F.col("fqn").alias("target")), ["repo_id", "target"], "left_anti")
    dealt = open_.join(F.broadcast(n_blocks), "repo_id").select("repo_id", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "source", "target", (F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1).cast("byte").alias("kind"), "ord")
    none = F.lit(None).cast("string")
    asked = objs.select("repo_id", "g", "family", F.lit(True).alias("is_object"), F.lit(False).alias("walk"), F.col("object_fqn").alias("fqn"), none.alias("module")).unionByName(
        starts.groupBy("repo_id", "g", "family", F.col("start").alias("fqn")).agg(F.max("walk").alias("walk")).join(modules.select("repo_id", "fqn", "module"), ["repo_id", "fqn"], "left").withColumn("is_object", F.lit(False))
    )
    blocks = asked.join(F.broadcast(n_blocks), "repo_id").withColumn("block", F.pmod(F.xxhash64("g"), "n_blocks").cast("int")).drop("n_blocks")
    spark = edges.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left, right = (x.repartition(n, "repo_id", "block").groupBy("repo_id", "block") for x in (dealt, blocks))
    return left.cogroup(right).applyInArrow(_search, f"{FOUND}, edge struct<repo_id: string, ord: bigint, source: string, kind: string, target: string>")


def _search(edges: pa.Table, asked: pa.Table) -> pa.Table:
    out: tuple[list, ...] = ([], [], [], [], [])
    repo = edges["repo_id"][0].as_py() if edges.num_rows else None
    graph = Graph(edges.select(["source", "target", "kind", "ord"]))
    del edges
    groups: dict[tuple[int, str], tuple[list, list]] = {}
    for g, family, is_object, walk, fqn, module in zip(*(asked.column(c).to_pylist() for c in ("g", "family", "is_object", "walk", "fqn", "module"))):
        objects, starts = groups.setdefault((g, family), ([], []))
        if is_object:
            objects.append(fqn)
        else:
            starts.append((fqn, module, walk))
    for family in sorted({f for _, f in groups}):
        walker = Walker(graph, family)
        for (g, of), (objects, starts) in groups.items():
            if of == family and starts:
                for row in walker.found(objects, starts):
                    for column, value in zip(out, (g, *row)):
                        column.append(value)
    types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()))
    rows = [pa.array(c, t) for c, t in zip(out, types)]
    edge = graph.edges(repo, rows[-1].flatten().to_numpy(zero_copy_only=False))
    columns = [pa.concat_arrays([r, pa.nulls(len(edge), r.type)]) for r in rows]
    return pa.table([*columns, pa.concat_arrays([pa.nulls(len(rows[0]), edge.type), edge])], names=["g", "start", "target", "len", "path", "edge"])


class Graph:
    """Edges of one repository as integers; names are numbered in their order, so those under a name stand side by side."""

    def __init__(self, edges: pa.Table) -> None:
        ends = pa.chunked_array(edges["source"].chunks + edges["target"].chunks, pa.string())
        names = pc.unique(ends)
        names = names.take(pc.sort_indices(names))
        self.source, self.target = (pc.index_in(edges[c], value_set=names).to_numpy() for c in ("source", "target"))
        self.kind, self.ord = (edges[c].to_numpy() for c in ("kind", "ord"))
        self.names: list[str] = names.to_pylist()

    def number(self, name: str | None) -> int:
        """A name's number, -1 where no edge has it."""
        if name is None:
            return -1
        at = bisect_left(self.names, name)
        return at if at < len(self.names) and self.names[at] == name else -1

    def edges(self, repo: str | None, path_ords: np.ndarray) -> pa.StructArray:
        """The edges with these ords, each once; those of a module's edges may be lowered by SEED."""
        ords = np.unique(np.where(path_ords < 0, path_ords + SEED, path_ords).astype(np.int64))
        order = np.argsort(self.ord)
        at = order[np.searchsorted(self.ord, ords, sorter=order)]
        names, kinds = pa.array(self.names, pa.string()), pa.array(KINDS, pa.string())
        columns = [pa.array([repo] * len(ords), pa.string()), pa.array(ords, pa.int64()), names.take(pa.array(self.source[at])), kinds.take(pa.array(self.kind[at])), names.take(pa.array(self.target[at]))]
        return pa.StructArray.from_arrays(columns, names=["repo_id", "ord", "source", "kind", "target"])

    def under(self, name: str) -> range:
        return range(bisect_left(self.names, name + "."), bisect_left(self.names, name + "/"))


def _rows(keys: np.ndarray, n: int, order: np.ndarray, *values: np.ndarray) -> list[array]:
    """Where the rows of each key begin, and the values in the order of their keys."""
    return [array("q", x.astype(np.int64).tobytes()) for x in (np.concatenate(([0], np.cumsum(np.bincount(keys, minlength=n)))), *(v[order] for v in values))]


class Walker:
    """Searches along the edges of one family."""

    def __init__(self, graph: Graph, family: str) -> None:
        self.graph, n = graph, len(graph.names)
        follow = np.ones(len(graph.kind), bool) if family == "dependency" else graph.kind != 1
        s, t, k, o = (x[follow] for x in (graph.source, graph.target, graph.kind, graph.ord))
        holds = k == 0
        self.at_kids, self.kids, self.kid_ords = _rows(s[holds], n, np.lexsort((o[holds], s[holds])), t[holds], o[holds])
        self.at_uses, self.uses, self.use_ords = _rows(s[~holds], n, np.lexsort((o[~holds], s[~holds])), t[~holds], o[~holds])
        self.at_owners, self.owners = _rows(t[holds], n, np.argsort(t[holds], kind="stable"), s[holds])
        self.at_users, self.users = _rows(t[~holds], n, np.argsort(t[~holds], kind="stable"), s[~holds])
        #: Whether a node comes to an object by dependency edges alone, and whether by CONTAINS edges first.
        self.by_use, self.by_kid = bytearray(n), bytearray(n)

    def found(self, objects: list[str], starts: list[tuple[str, str | None, bool]]) -> Iterator[tuple]:
        """(start, target, len, path): rows of the (start, module, walk) that come to an object."""
        g = self.graph
        goals = {v for o in objects for v in (g.number(o), *g.under(o)) if v >= 0}
        if not goals:
            return
        used, held = self._back(goals)
        for start, module, walk in starts:
            at, inside = g.number(start), g.number(module)
            first = self._module_edges(inside, module)
            leads = first or at >= 0 and any(self.by_use[t] for t in self.uses[self.at_uses[at] : self.at_uses[at + 1]])
            # a ring of CONTAINS edges from a goal to itself is no path
            if leads or at >= 0 and self.by_kid[at] and (at not in goals or next(self._walk(at, first, goals), None)):
                yield start, None, None, None
                if walk:
                    for target, path in self._walk(at, first, goals):
                        yield start, g.names[target], len(path), path
        for v in used:
            self.by_use[v] = 0
        for v in held:
            self.by_kid[v] = 0

    def _back(self, goals: set[int]) -> tuple[list[int], list[int]]:
        """Marks the nodes that come to a goal. A search descends by CONTAINS first and then follows dependency edges alone."""
        by_use, by_kid = self.by_use, self.by_kid
        used = list(goals)
        for v in used:
            by_use[v] = 1
        for v in used:
            for u in self.users[self.at_users[v] : self.at_users[v + 1]]:
                if not by_use[u]:
                    by_use[u] = 1
                    used.append(u)
        held: list[int] = []
        for some in (used, held):
            for v in some:
                for u in self.owners[self.at_owners[v] : self.at_owners[v + 1]]:
                    if not by_kid[u]:
                        by_kid[u] = 1
                        held.append(u)
        return used, held

    def _module_edges(self, inside: int, module: str | None) -> list[tuple[int, int]]:
        """(target, ord) of the enclosing module's edges on the way to a goal, without those into the module itself."""
        if inside < 0:
            return []
        names, below = self.graph.names, f"{module}."
        return [(self.uses[i], self.use_ords[i]) for i in range(self.at_uses[inside], self.at_uses[inside + 1]) if self.by_use[self.uses[i]] and names[self.uses[i]] != module and not names[self.uses[i]].startswith(below)]

    def _walk(self, at: int, first: list[tuple[int, int]], goals: set[int]) -> Iterator[tuple[int, list[int]]]:
        """(goal, path) of the goals that the start ``at`` comes to; ``first`` are the edges of its module.

        Edges are taken in their order and nodes in the order of their paths, so the
        first path to a state is the least one. A state is a node, and whether the path has descended by CONTAINS alone.
        """
        come: dict[int, tuple[int, int]] = {}
        queue: list[int] = []
        for t, o in first:  # ahead of the start's own edges
            if 2 * t not in come:
                come[2 * t] = (-1, o - SEED)
                queue.append(2 * t)
        if at >= 0:
            come[2 * at + 1] = (-1, 0)
            self._onward(at, True, -1, come, queue)
        seen: set[int] = set()
        for state in queue:
            v = state >> 1
            if v in goals and v not in seen:
                seen.add(v)
                path, s = [], state
                while s != -1:
                    s, o = come[s]
                    path.append(o)
                yield v, path[::-1]
            self._onward(v, state & 1, state, come, queue)

    def _onward(self, v: int, down: bool, state: int, come: dict[int, tuple[int, int]], queue: list[int]) -> None:
        """Adds the states one edge beyond node ``v``, in the order of the edges."""
        ahead = [(self.use_ords[i], 2 * self.uses[i]) for i in range(self.at_uses[v], self.at_uses[v + 1]) if self.by_use[self.uses[i]]]
        if down:
            kids = [(self.kid_ords[i], 2 * self.kids[i] + 1) for i in range(self.at_kids[v], self.at_kids[v + 1]) if self.by_use[self.kids[i]] or self.by_kid[self.kids[i]]]
            ahead = sorted(ahead + kids)
        for o, to in ahead:
            if to not in come:
                come[to] = (state, o)
                queue.append(to)
