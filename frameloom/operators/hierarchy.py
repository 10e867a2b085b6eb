"""Parent-child rows to full hierarchies: paths, depths, roots, descendants and cycles."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.runtime import cut, discard

#: Edges up to which each task may hold all of them (two numbers an edge: about 100 MB with their index).
FEW_EDGES = 2_000_000
#: So many tasks get a copy at most.
MOST_COPIES = 32
#: What raking leaves is searched by one task if it is no more than so many edges.
FEW_ROWS = 50_000
#: Nodes without child or parent are raked off as long as that takes this share of the edges; then chains are drawn together.
RAKED = 0.25


def clean_edges(edges: DataFrame, nodes: DataFrame, child: str, parent: str, node: str) -> DataFrame:
    """Distinct (child, parent) rows whose ends are both nodes; null ends fall away."""
    known = nodes.select(F.col(node).alias("id")).where("id is not null").distinct()
    pairs = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).distinct()
    return pairs.join(known.withColumnRenamed("id", "child"), "child", "left_semi").join(known.withColumnRenamed("id", "parent"), "parent", "left_semi").select("child", "parent")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _levels_in_task(edges: DataFrame, tops: DataFrame, with_path: bool) -> DataFrame:
    """``root_levels`` where every task can hold the edges: the roots are spread over tasks, and each task takes its roots down level by level.

    The copies of the edges reach the tasks by a shuffle, not through the driver."""
    kind = edges.schema["child"].dataType
    tasks = min(MOST_COPIES, edges.sparkSession.sparkContext.defaultParallelism)
    roots = tops.select((F.pmod(F.xxhash64("node"), F.lit(tasks))).alias("task"), F.col("node").alias("root"))
    copies = edges.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).alias("task"), "child", "parent")

    def walk(starts: pa.Table, links: pa.Table) -> pa.Table:
        ids = pa.chunked_array([*links["child"].chunks, *links["parent"].chunks], links.schema.field("child").type).unique()
        ids = ids.take(pa.compute.sort_indices(ids))
        at = lambda c: pa.compute.index_in(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c, ids).to_numpy(zero_copy_only=False).astype(np.int64)
        child, parent = at(links["child"]), at(links["parent"])
        order = np.argsort(parent, kind="stable")
        child, first = child[order], np.searchsorted(parent[order], np.arange(len(ids) + 1))
        names = ids.to_pylist() if with_path else []
        seen, nodes, roots_, depths, paths = np.full(len(ids), -1), [], [], [], []
        for r in at(starts["root"]) if starts.num_rows else []:
            level, depth, seen[r] = np.array([r]), 0, r
            path = {int(r): str(names[r])} if with_path else {}
            while level.size:
                nodes.append(level)
                roots_.append(np.full(level.size, r))
                depths.append(np.full(level.size, depth, np.int32))
                if with_path:
                    paths += [path[int(x)] for x in level]
                n = first[level + 1] - first[level]
                # the children of the whole level; ``level`` is in ascending order, so that the first row of a child has its smallest parent
                below = child[np.repeat(first[level] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                above = np.repeat(level, n)[seen[below] != r]
                level, one = np.unique(below[seen[below] != r], return_index=True)
                seen[level] = r
                if with_path:
                    path = {int(x): f"{path[int(a)]}/{names[x]}" for x, a in zip(level, above[one])}
                depth += 1
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        made = [ids.take(pa.array(join(nodes, np.int64))), ids.take(pa.array(join(roots_, np.int64))), pa.array(join(depths, np.int32))]
        return pa.table(made + ([pa.array(paths, pa.string())] if with_path else []), names=["node", "root", "depth"] + ["path"] * with_path)

    schema = f"node {kind.simpleString()}, root {kind.simpleString()}, depth int" + ", path string" * with_path
    return roots.repartition(tasks, "task").groupBy("task").cogroup(copies.repartition(tasks, "task").groupBy("task")).applyInArrow(walk, schema)


def root_levels(edges: DataFrame, with_path: bool = False, few_edges: int = FEW_EDGES) -> DataFrame:
    """(node, root, depth[, path]) of every root that a node of the clean (child, parent) edges leads up to, roots themselves at depth 0.

    Frontiers start at the roots (nodes that are a parent and no child) and go down level by level, each pair carrying its root, depth and path; a pair that comes up
    again, by a longer way or around a cycle, is a repeat and ends there. So depth is the shortest one, and of the
    shortest paths (ids from root to node, parted by ``/``) the one with the smallest parent at every step up is kept.

    Up to ``few_edges`` edges every task holds a copy of them and takes a share of the roots down all levels, so that depth costs no rounds; more
    are joined to the frontier level by level, a round each. Both give the same rows.
    """
    tops = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    if edges.count() <= few_edges:
        return cut(_levels_in_task(edges, tops, with_path))
    carried = ["path"] if with_path else []
    level = cut(tops.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), *([F.col("node").cast("string").alias("path")] if with_path else [])))
    known = [level]
    while level.take(1):
        step = level.join(edges.select(F.col("parent").alias("node"), F.col("child").alias("to")), "node")
        best = [F.min(F.struct("node", "path"))["path"].alias("path")] if with_path else []
        grown = step.groupBy(F.col("to").alias("node"), "root").agg((F.max("depth") + 1).alias("depth"), *best)
        grown = grown.withColumn("path", F.concat_ws("/", "path", "node")) if with_path else grown
        level = cut(grown.join(_union(known).select("node", "root"), ["node", "root"], "left_anti").select("node", "root", "depth", *carried), True)
        known.append(level)
        if len(known) > 32:
            known = [cut(_union(known), True)]
    return _union(known)


def ancestor_pairs(edges: DataFrame) -> DataFrame:
    """All pairs (node, ancestor, distance) along clean (child, parent) edges: every node with all of its descendants.

    The frontier of a round is the set of pairs at distance exactly k, the reach all pairs at distances up to k;
    joining the frontier to the reach extends every pair by 1 to k further levels at once. So depth d takes
    log2(d) + 1 rounds instead of d, and each new pair is derived once per shortest path midpoint, not once per level.
    Pairs that come up again at a larger distance are repeats and are dropped: that ends cycles. Distance is the
    shortest one (>= 1); a node on a cycle is an ancestor of itself. The result is as large as the descendants it lists.
    """
    reach = cut(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    k = 1
    while True:
        frontier = reach.where(F.col("distance") == k).alias("f")
        onward = reach.alias("r")
        grown = frontier.join(onward, F.col("f.ancestor") == F.col("r.node")).select("f.node", "r.ancestor", (F.col("f.distance") + F.col("r.distance")).alias("distance"))
        before, reach = reach, cut(reach.unionByName(grown).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")), True)
        discard(before)
        k *= 2
        if not reach.where(F.col("distance") == k).take(1):
            return reach


def _rake(live: DataFrame) -> DataFrame:
    """The edges from nodes that have a child to nodes that have a parent."""
    with_child = live.select(F.col("parent").alias("child")).distinct()
    with_parent = live.select(F.col("child").alias("parent")).distinct()
    return live.join(with_child, "child", "left_semi").join(with_parent, "parent", "left_semi").select("child", "parent")


def _draw_together(chain: DataFrame) -> DataFrame:
    """Follows chains of nodes (node, prev, next) to their ends: prev and next become the nodes outside of the chains,
    ``low`` the smallest id on the way, ``open`` says that a node has no end: its chain is a cycle by itself.

    Each round doubles the stretch a node looks over. A chain with an end settles further nodes in every round, so when none
    settles all open ones lie on cycles; these go on until their stretch is as long as there are open nodes."""
    state = cut(chain.select("node", "prev", "next", F.col("node").alias("low"), F.lit(True).alias("open"), F.lit(True).alias("open_back")))
    reach, still, settled_all = 1, None, False
    while True:
        ahead = state.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"), F.col("open").alias("open2"))
        behind = state.select(F.col("node").alias("prev"), F.col("prev").alias("prev2"), F.col("open_back").alias("back2"))
        joined = state.join(ahead, "next", "left").join(behind, "prev", "left")
        grown = joined.select("node", F.coalesce("prev2", "prev").alias("prev"), F.coalesce("next2", "next").alias("next"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.coalesce("open2", F.lit(False)).alias("open"), F.coalesce("back2", F.lit(False)).alias("open_back"))
        before, state = state, cut(grown, True)
        discard(before)
        reach *= 2
        left = state.where("open or open_back").count()
        settled_all = settled_all or left == still
        still = left
        if not left or settled_all and reach >= left:
            return state


def _core_components(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members (node, label) of some components that lead to themselves, edges still to be looked at).

    Every node takes the smallest id that leads to it. A node that keeps its own is the smallest of its component, which are the
    nodes of its colour that it can be reached from; edges between colours belong to no cycle."""
    color = cut(live.select(F.explode(F.array("child", "parent")).alias("node")).distinct().withColumn("color", F.col("node")))
    while True:
        come = live.join(color.withColumnRenamed("node", "child"), "child").select(F.col("parent").alias("node"), F.col("color").alias("came"))
        come = come.groupBy("node").agg(F.min("came").alias("came"))
        before, color = color, cut(color.join(come, "node", "left").select("node", F.least("color", F.coalesce("came", "color")).alias("color"), F.coalesce(F.col("came") < F.col("color"), F.lit(False)).alias("changed")), True)
        changed, color = color.where("changed").take(1), color.drop("changed")
        discard(before)
        if not changed:
            break
    inner = live.join(color.withColumnsRenamed({"node": "child", "color": "c"}), "child").join(color.withColumnsRenamed({"node": "parent", "color": "p"}), "parent").where("c = p")
    inner = cut(inner.select("child", "parent", F.col("c").alias("color")))
    members = frontier = color.where("node = color").select("node", "color")
    while True:
        onward = inner.join(frontier.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node"), "color").distinct()
        frontier = cut(onward.join(members, "node", "left_anti"), True)
        if not frontier.take(1):
            break
        members = cut(members.unionByName(frontier), True)
    large = members.groupBy("color").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rest = _without(inner, members.select("node")).select("child", "parent")
    return members.join(large, "color").select("node", F.col("color").alias("label")), rest


def _components_in_task(live: DataFrame) -> DataFrame:
    """(node, label) of the components of more than one node, found by one task in a depth-first search; for few edges only."""
    kind = live.schema["child"].dataType.simpleString()

    def search(links: pa.Table) -> pa.Table:
        above: dict = {}
        for c, p in zip(links["child"].to_pylist(), links["parent"].to_pylist()):
            above.setdefault(c, []).append(p)
        entered: dict = {}
        lowest: dict = {}
        waiting, on, found = [], set(), []
        for start in above:
            if start in entered:
                continue
            walk = [(start, iter(above[start]))]
            entered[start] = lowest[start] = len(entered)
            waiting.append(start)
            on.add(start)
            while walk:
                node, rest = walk[-1]
                for p in rest:
                    if p not in entered:
                        entered[p] = lowest[p] = len(entered)
                        waiting.append(p)
                        on.add(p)
                        walk.append((p, iter(above.get(p, ()))))
                        break
                    if p in on:
                        lowest[node] = min(lowest[node], entered[p])
                else:
                    walk.pop()
                    if walk:
                        lowest[walk[-1][0]] = min(lowest[walk[-1][0]], lowest[node])
                    if lowest[node] == entered[node]:
                        at = len(waiting) - 1
                        while waiting[at] != node:
                            at -= 1
                        members = waiting[at:]
                        del waiting[at:]
                        on.difference_update(members)
                        if len(members) > 1:
                            found += [(m, min(members)) for m in members]
        return pa.table([pa.array([x[i] for x in found], links.schema.field("child").type) for i in (0, 1)], names=["node", "label"])

    return live.groupBy().applyInArrow(search, f"node {kind}, label {kind}")


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.withColumnRenamed("node", "child"), "child", "left_anti").join(nodes.withColumnRenamed("node", "parent"), "parent", "left_anti")


def cycle_members(edges: DataFrame, few_rows: int = FEW_ROWS) -> DataFrame:
    """(node, cycle): every node of the clean (child, parent) edges that leads back to itself, with the smallest node among those that it leads to
    and that lead to it. One row per node, however long the cycle.

    Cycles are among the nodes that frontiers from outside never reach: nodes without child or parent are raked off level by level, and what is left lies on or between
    cycles. If that is few edges, one task searches them. Else, so that neither deep trees nor long cycles take a round per
    level, chains (nodes with one edge in and one out) are drawn together
    into one edge by pointer doubling: a tree vanishes in about log2(nodes) rounds, and a chain that has no end is a cycle. What neither step makes
    smaller is coloured by the smallest id that leads to a node. At last the nodes of drawn-together chains follow the nodes at their
    ends, the last chain first: they lie on a cycle where both ends do.
    """
    kind = edges.schema["child"].dataType.simpleString()
    live = cut(edges)
    n = live.count()
    none = live.sparkSession.createDataFrame([], f"node {kind}, label {kind}")
    labels, chains, loops = [none], [], [live.where("child = parent").select(F.col("child").alias("node"))]
    live = live.where("child <> parent")
    while n:
        before, live = n, cut(_rake(_rake(live)), True)
        n = live.count()
        if n <= few_rows:
            labels.append(cut(_components_in_task(live), True))
            break
        if n <= (1 - RAKED) * before:
            continue
        ends = live.select(F.explode(F.array(F.struct(F.col("child").alias("node"), F.col("parent").alias("next"), F.lit(None).cast(kind).alias("prev")), F.struct(F.col("parent").alias("node"), F.lit(None).cast(kind).alias("next"), F.col("child").alias("prev")))).alias("x")).select("x.*")
        chain = ends.groupBy("node").agg(F.count("next").alias("out"), F.count("prev").alias("in"), F.max("next").alias("next"), F.max("prev").alias("prev")).where("out = 1 and in = 1")
        chain = cut(chain.select("node", "prev", "next"))
        if chain.take(1):
            drawn = _draw_together(chain)
            labels.append(drawn.where("open").select("node", F.col("low").alias("label")))
            chains.append(drawn.where("not open").select("node", "prev", "next"))
            heads = chain.join(chain.select(F.col("node").alias("prev")), "prev", "left_anti").select("node")
            drawn_edges = drawn.where("not open").join(heads, "node", "left_semi").select(F.col("prev").alias("child"), F.col("next").alias("parent"))
            every = cut(_without(live, chain.select("node")).unionByName(drawn_edges).distinct(), True)
            loops.append(every.where("child = parent").select(F.col("child").alias("node")))
            live = every.where("child <> parent")
            n = live.count()
        elif n == before:
            found, rest = _core_components(live)
            labels.append(found)
            live = cut(rest, True)
            n = live.count()
    looped = cut(_union(loops).distinct())
    known = _union(labels)
    in_chains = _union([c.select("node") for c in chains]) if chains else none.select("node")
    known = cut(known.unionByName(looped.join(known, "node", "left_anti").join(in_chains, "node", "left_anti").select("node", F.col("node").alias("label"))))
    for c in reversed(chains):
        start, end = known.select(F.col("node").alias("prev"), F.col("label").alias("a")), known.select(F.col("node").alias("next"), F.col("label").alias("b"))
        at = c.join(start, "prev", "left").join(end, "next", "left").join(looped.withColumn("looped", F.lit(True)), "node", "left")
        followed = at.select("node", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.when(F.col("looped"), F.col("node"))).alias("label")).where("label is not null")
        known = cut(known.unionByName(followed), True)
    smallest = known.groupBy("label").agg(F.min("node").alias("cycle"))
    return known.join(smallest, "label").select("node", "cycle")


def hierarchy(nodes: DataFrame, edges: DataFrame, node: str, child: str, parent: str, with_paths: bool = False) -> dict[str, DataFrame]:
    """Full hierarchies of parent-child rows.

    Returns ``pairs`` (node, ancestor, distance), ``roots`` (node, root, depth[, path]) with one row per root a
    node leads up to, and ``cycles`` (node, cycle) with the smallest id of the cycle a node lies on. A root is a node
    without parent; its own row in ``roots`` is not listed. Nodes that reach no root occur in no ``roots`` row. Null or unknown ends, repeated edges and repeated nodes
    change nothing; a self-loop is a cycle of one and keeps its node from being a root; empty tables give empty results.
    """
    kept = cut(clean_edges(edges, nodes, child, parent, node))
    return {"pairs": ancestor_pairs(kept), "roots": root_levels(kept, with_paths).where("depth > 0"), "cycles": cycle_members(kept)}
