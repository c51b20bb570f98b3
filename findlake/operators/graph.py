"""Graphs as edge tables (src, dst): reachability, bypasses, components, levels, and flow analyses per small graph.

Reachability is a loop of frontier joins: each round joins only the new nodes, drops those already seen and writes the
result to the shared folder, so lineage stays short and a lost executor repeats one round. Strong components and levels
of a graph that is counted to have at most LOCAL_EDGES edges are computed in one task; larger graphs use rounds.
Analyses of control-flow graphs are per graph (a function), i.e. per bounded group. Self-loops and repeated edges are
fine; nodes are what occurs in an edge; null ends make no edge; empty input gives empty output.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.session import bounded, written

#: Edges up to which a whole graph may go to one task.
LOCAL_EDGES = 2_000_000


def edge_table(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, depth of all nodes that can be reached from the seeds (column node), the seeds being at depth 0."""
    edges = written(edge_table(edges), "edges")
    frontier = written(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "reach")
    seen, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        steps = edges.join(bounded(frontier.select(F.col("node").alias("src"))), "src").select(F.col("dst").alias("node")).distinct()
        known = seen[0].select("node")
        for part in seen[1:]:
            known = known.unionByName(part.select("node"))
        fresh = written(steps.join(known, "node", "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if not fresh.limit(1).count():
            break
        seen.append(fresh)
        if len(seen) > 16:  # keep the union short
            merged = seen[0]
            for part in seen[1:]:
                merged = merged.unionByName(part)
            seen = [written(merged, "seen")]
        frontier = fresh
    out = seen[0]
    for part in seen[1:]:
        out = out.unionByName(part)
    return out


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def bypasses(calls: DataFrame, target: DataFrame, enforcer: DataFrame) -> DataFrame:
    """node: callers (at any distance) of the target that no enforcer's callers are among; none without an enforcer."""
    back = reverse(calls)
    callers = reachable(back, target).where("depth > 0").select("node")
    guarded = reachable(back, enforcer).select("node")
    if not enforcer.limit(1).count():
        return callers.limit(0)
    return callers.join(guarded, "node", "left_anti").join(target.select("node"), "node", "left_anti")


def tarjan(adj: dict) -> dict:
    """node -> component number; components come in reverse topological order."""
    index: dict = {}
    low: dict = {}
    on: set = set()
    stack: list = []
    comp: dict = {}
    for root in sorted(adj):
        if root in index:
            continue
        work = [(root, iter(sorted(adj[root])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(sorted(adj[nxt]))))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    number = comp[next(reversed(comp))] + 1 if comp else 0
                    while True:
                        member = stack.pop()
                        on.discard(member)
                        comp[member] = number
                        if member == node:
                            break
    return comp


def _adjacency(pdf: pd.DataFrame) -> dict:
    adj: dict = defaultdict(list)
    for s, t in zip(pdf["src"], pdf["dst"]):
        adj[s].append(t)
        adj.setdefault(t, [])
    return adj


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    comp = tarjan(_adjacency(pdf))
    least: dict = {}
    for node, c in comp.items():
        least[c] = min(least.get(c, node), node)
    return pd.DataFrame([(n, least[c]) for n, c in comp.items()], columns=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the strongly connected components."""
    edges = written(edge_table(edges), "edges")
    kind = edges.schema["src"].dataType.simpleString()
    if edges.count() <= LOCAL_EDGES:
        return edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_components, f"node {kind}, component {kind}")
    return _components_by_rounds(edges)


def _components_by_rounds(edges: DataFrame) -> DataFrame:
    """Strong components of a large graph: trim nodes that lie on no cycle, colour forward with the least node that
    reaches each, take backward what has its colour, and go on with the rest."""
    done = None
    rest = edges
    while rest.limit(1).count():
        while True:  # nodes without an arc in or out are components of their own
            core = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            core = written(core, "core")
            stable = core.count() == rest.count()
            rest = core
            if stable:
                break
        nodes = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
        colour = written(nodes.withColumn("c", F.col("node")), "colour")
        while True:
            via = rest.join(colour, rest.src == colour.node).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            new = written(colour.join(via, "node", "left").select("node", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")), "colour")
            colour = new.select("node", "c")
            if not new.where("moved").limit(1).count():
                break
        back = rest.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where("node = c").select("node")
        inside = written(reachable(back, roots).select("node").join(colour, "node").select("node", F.col("c").alias("component")), "inside")
        done = inside if done is None else written(done.unionByName(inside), "done")
        taken = inside.select("node")
        rest = written(rest.join(taken.withColumnRenamed("node", "src"), "src", "left_anti").join(taken.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "rest")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    if done is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def levels(edges: DataFrame) -> DataFrame:
    """node, level: length of the longest way down from the node's component, so ordering by level is bottom-up."""
    edges = written(edge_table(edges), "edges")
    kind = edges.schema["src"].dataType.simpleString()
    if edges.count() > LOCAL_EDGES:
        return _levels_by_rounds(edges)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adj = _adjacency(pdf)
        comp = tarjan(adj)
        level: dict = {}
        members: dict = defaultdict(list)
        for node, c in comp.items():
            members[c].append(node)
        for c in sorted(members):  # reverse topological: callees first
            below = [level[comp[t]] + 1 for n in members[c] for t in adj[n] if comp[t] != c]
            level[c] = max(below, default=0)
        return pd.DataFrame([(n, level[c]) for n, c in comp.items()], columns=["node", "level"])

    return edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"node {kind}, level int")


def _levels_by_rounds(edges: DataFrame) -> DataFrame:
    """Levels of a large graph: condense, then peel off what has nothing below."""
    comp = written(components(edges), "comp")
    a = comp.select(F.col("node").alias("src"), F.col("component").alias("s"))
    b = comp.select(F.col("node").alias("dst"), F.col("component").alias("t"))
    rest = written(edges.join(a, "src").join(b, "dst").where("s <> t").select("s", "t").distinct(), "dag")
    left = comp.select(F.col("component").alias("c")).distinct()
    out, level = None, 0
    while left.limit(1).count():
        ready = written(left.join(rest.select(F.col("s").alias("c")).distinct(), "c", "left_anti").withColumn("level", F.lit(level)), "level")
        out = ready if out is None else written(out.unionByName(ready), "levels")
        left = written(left.join(ready, "c", "left_anti").select("c"), "left")
        rest = written(rest.join(ready.select(F.col("c").alias("t")), "t", "left_anti").select("s", "t"), "dag")
        level += 1
    return comp.join(out.withColumnRenamed("c", "component"), "component").select("node", "level")


def dominators(edges: DataFrame, graph: str, entry: int = 0) -> DataFrame:
    """graph, node, idom of the nodes that the entry reaches (int nodes); one task per graph (a function's blocks)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adj = _adjacency(pdf)
        order, seen, stack = [], {entry}, [(entry, iter(adj.get(entry, [])))]
        while stack:
            node, rest = stack[-1]
            for nxt in rest:
                if nxt not in seen:
                    seen.add(nxt)
                    stack.append((nxt, iter(adj[nxt])))
                    break
            else:
                order.append(node)
                stack.pop()
        place = {n: k for k, n in enumerate(order)}
        preds: dict = defaultdict(list)
        for s in seen:
            for t in adj.get(s, []):
                preds[t].append(s)
        idom = {entry: entry}
        changed = True
        while changed:
            changed = False
            for node in reversed(order):
                if node == entry:
                    continue
                best = None
                for p in preds[node]:
                    if p in idom:
                        a, c = p, best
                        while c is not None and a != c:
                            while place[a] < place[c]:
                                a = idom[a]
                            while place[c] < place[a]:
                                c = idom[c]
                        best = a
                if best is not None and idom.get(node) != best:
                    idom[node] = best
                    changed = True
        key = pdf[graph].iloc[0]
        return pd.DataFrame([(key, int(n), int(d)) for n, d in idom.items() if n != entry], columns=[graph, "node", "idom"])

    kind = edges.schema[graph].dataType.simpleString()
    return edges.groupBy(graph).applyInPandas(run, f"{graph} {kind}, node int, idom int")


def reaching_definitions(edges: DataFrame, defs: DataFrame, graph: str) -> DataFrame:
    """graph, node, var, def_node: definitions that reach the entry of each node (gen/kill to the fixed point).

    defs(graph, node, var): the variables each node defines."""
    marked = edges.select(graph, "src", "dst", F.lit(None).cast("string").alias("var")).unionByName(defs.select(graph, F.col("node").alias("src"), F.lit(None).cast("int").alias("dst"), "var"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own: dict = defaultdict(set)
        for n, v in pdf.loc[pdf["var"].notna(), ["src", "var"]].itertuples(index=False):
            own[n].add(v)
        flow = pdf.loc[pdf["var"].isna()]
        adj = _adjacency(flow.assign(dst=flow["dst"].astype("int64"), src=flow["src"].astype("int64")))
        into: dict = defaultdict(set)
        work = deque(sorted(set(adj) | set(own)))
        while work:
            n = work.popleft()
            out = {(v, d) for v, d in into[n] if v not in own[n]} | {(v, n) for v in own[n]}
            for t in adj.get(n, []):
                if not out <= into[t]:
                    into[t] |= out
                    work.append(t)
        key = pdf[graph].iloc[0]
        return pd.DataFrame([(key, int(n), v, int(d)) for n, s in into.items() for v, d in s], columns=[graph, "node", "var", "def_node"])

    kind = edges.schema[graph].dataType.simpleString()
    return marked.groupBy(graph).applyInPandas(run, f"{graph} {kind}, node int, var string, def_node int")


def unguarded(edges: DataFrame, sources: DataFrame, sinks: DataFrame, guards: DataFrame) -> DataFrame:
    """node: sinks that a source reaches on a way without a guard node."""
    free = edge_table(edges).join(guards.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    start = sources.join(guards, "node", "left_anti")
    return reachable(free, start).select("node").join(sinks.select("node").distinct(), "node", "left_semi")
