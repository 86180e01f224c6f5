"""Graph measures and iterative graph operators over edge tables (src, dst, weight)."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._session import written
from ..functions.columns import safe_ratio
from ..functions.ranking import global_row_number, quantiles

# the functions that tasks run travel whole, so executors need not find this library
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def nodes_of(edges: DataFrame, *keys: str) -> DataFrame:
    return edges.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct()


def canonical(edges: DataFrame, *keys: str) -> DataFrame:
    """Distinct unordered pairs u <= v."""
    return edges.select(*keys, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def graph_stats(edges: DataFrame, directed: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Nodes, edges, density, average degree and weight statistics (sample deviation); undirected pairs count once."""
    if not directed:
        edges = edges.groupBy(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))
    n_nodes = nodes_of(edges, *keys).groupBy(*keys).agg(F.count("*").alias("nodes"))
    w = edges.groupBy(*keys).agg(
        F.count("*").alias("edges"), F.min("weight").alias("weight_min"), F.max("weight").alias("weight_max"), F.avg("weight").alias("weight_mean"), F.stddev_samp("weight").alias("weight_std")
    )
    both = n_nodes.join(w, list(keys)) if keys else n_nodes.crossJoin(w)
    n, m = F.col("nodes"), F.col("edges")
    factor = 1 if directed else 2
    return both.select(
        *keys, "nodes", "edges", F.coalesce(safe_ratio(factor * m, n * (n - 1)), F.lit(0.0)).alias("density"), F.coalesce(safe_ratio(2 * m, n), F.lit(0.0)).alias("avg_degree"),
        "weight_min", "weight_max", "weight_mean", "weight_std",
    )


def _ends_known(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def _ordered_by_name(edges: DataFrame) -> bool:
    """True if all edges run from the smaller to the larger name, or all the other way: no cycle, by one scan."""
    r = edges.agg(F.bool_and(F.col("src") < F.col("dst")).alias("up"), F.bool_and(F.col("src") > F.col("dst")).alias("down")).first()
    return r["up"] is None or r["up"] or r["down"]


def _follow(parents: DataFrame) -> DataFrame:
    """(node, end, steps) of ``parents(node, parent)``: where each node's chain of parents ends and after how many steps.

    Both are null for chains that run into a cycle. A round follows four times as many steps as the one before, so rounds
    grow with the logarithm of the longest chain.
    """
    go = F.col("parent").isNotNull()
    now = written(parents.select("node", F.col("parent").alias("to"), F.when(~go, F.col("node")).alias("end"), go.cast("long").alias("steps")))
    n, reach = now.count(), 1
    while reach <= n and not now.where(F.col("to").isNotNull()).isEmpty():
        step = now
        for _ in range(3):
            ahead = now.select(F.col("node").alias("__n"), F.col("to").alias("__to"), F.col("end").alias("__end"), F.col("steps").alias("__steps"))
            step = step.join(ahead, F.col("to") == F.col("__n"), "left").select(
                "node", F.col("__to").alias("to"), F.coalesce("end", "__end").alias("end"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps")
            )
        now, reach = written(step), reach * 4
    return now.select("node", "end", F.when(F.col("end").isNotNull(), F.col("steps")).alias("steps"))


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer): the edges of the longest path that ends in each node, null for nodes that a cycle leads to.

    Every node first picks any of its predecessors; the chains of picks are followed (``_follow``), nodes whose other
    predecessor is deeper pick that one, and so on until none is. Layers of acyclic nodes are then a certificate: each
    edge ascends. Picks that run in a circle are a cycle. The orders tried here settle in five to fifteen turns, whatever
    their depth; a turn takes rounds in the logarithm of the depth. There is no limit on either.

    Edges with a null end and repeated edges are ignored; a loop is a cycle. No edges give no rows.
    """
    pairs = written(_ends_known(edges).select("src", "dst").distinct())
    first = pairs.groupBy(F.col("dst").alias("node")).agg(F.max("src").alias("parent"))
    parents = written(nodes_of(pairs).join(first, "node", "left"))
    endless = F.lit(1 << 62)
    while True:
        found = _follow(parents)
        depth = found.select(F.col("node").alias("src"), F.coalesce("steps", endless).alias("depth"))
        best = pairs.join(depth, "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.struct("depth", "src")).alias("best"))
        better = written(found.join(best, "node").where(F.col("steps").isNotNull() & (F.col("best.depth") >= F.col("steps"))).select("node", F.col("best.src").alias("deeper")))
        if better.isEmpty():
            return found.select("node", F.col("steps").alias("layer"))
        parents = written(parents.join(better, "node", "left").select("node", F.coalesce("deeper", "parent").alias("parent")))


def is_dag(edges: DataFrame) -> bool:
    """True if no cycle exists: all edges ascend by name or descend, or every node has a layer. An empty graph has none."""
    known = _ends_known(edges)
    return _ordered_by_name(known) or layers(known).where(F.col("layer").isNull()).isEmpty()


def cyclic_core(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): the edges that a cycle leads to and that lead to a cycle, which is what peeling nodes without an
    incoming or an outgoing edge leaves. Empty exactly if the graph has no cycle, whatever its depth (``layers``).

    Repeated edges stay repeated; edges with a null end are left out.
    """
    now = written(_ends_known(edges).select("src", "dst", "weight"))
    if _ordered_by_name(now):
        return now.limit(0)
    for src, dst in (("src", "dst"), ("dst", "src")):
        behind = layers(now.select(F.col(src).alias("src"), F.col(dst).alias("dst"))).where(F.col("layer").isNull())
        now = written(now.join(behind.select(F.col("node").alias("src")), "src", "left_semi").join(behind.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "weight"))
        if now.isEmpty():
            break
    return now


def _least_reaching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): of the nodes that reach each node along the edges, itself included, the least by hash and name.

    What reaches the node of a label reaches its holder too, so labels leap, and by hashes the rounds do not follow the
    order of the names.
    """
    label = written(nodes.select("node", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n")).alias("label")))
    while True:
        other = label.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        pushed = edges.join(other, F.col("src") == F.col("__n")).select(F.col("dst").alias("node"), F.col("__l").alias("label"))
        leapt = label.join(other, F.col("label.n") == F.col("__n")).select("node", F.col("__l").alias("label"))
        new = written(label.unionByName(pushed).unionByName(leapt).groupBy("node").agg(F.min("label").alias("label")))
        changed = new.join(label.select("node", F.col("label").alias("old")), "node").where(F.col("label") != F.col("old"))
        if changed.isEmpty():
            return new.select("node", F.col("label.n").alias("label"))
        label = new


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes in strongly connected components of two nodes or more, and of loops; named by the least node.

    Forward and backward labels: where both name one node, the nodes share its component; the rest is searched again
    within equal label pairs, until no cycle is left.
    """
    left = cyclic_core(edges)
    found = None
    while not left.isEmpty():
        nodes = nodes_of(left)
        ahead = _least_reaching(left, nodes).withColumnRenamed("label", "f")
        back = _least_reaching(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes).withColumnRenamed("label", "b")
        labels = written(ahead.join(back, "node"))
        done = labels.where("f = b").select("node", F.col("f").alias("component"))
        found = done if found is None else found.unionByName(done)
        rest = labels.where("f <> b")
        inner = left.join(rest.select(F.col("node").alias("src"), F.struct("f", "b").alias("ls")), "src").join(rest.select(F.col("node").alias("dst"), F.struct("f", "b").alias("ld")), "dst")
        left = cyclic_core(inner.where("ls = ld").select("src", "dst", "weight"))
    if found is None:
        return nodes_of(left).select("node", F.col("node").alias("component"))
    linked = edges.join(found.select(F.col("node").alias("src"), F.col("component").alias("cs")), "src").join(found.select(F.col("node").alias("dst"), F.col("component").alias("cd")), "dst").where("cs = cd")
    kept = written(found.join(nodes_of(linked), "node", "left_semi"))
    least = kept.groupBy("component").agg(F.min("node").alias("least"))
    return kept.join(least, "component").select("node", F.col("least").alias("component"))


#: Edges whose cycles one task breaks, and parts into which more are cut by weight at a time.
TASK_EDGES, PARTS = 1_000_000, 8


def _strong(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The number of the strongly connected component of each of ``n`` nodes (Tarjan's search, without recursion)."""
    order = np.argsort(a, kind="stable")
    heads, starts = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    at, seen, low, component = starts[:-1], [0] * n, [0] * n, [-1] * n
    count, found, open_nodes = 0, 0, []
    for root in range(n):
        if seen[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not seen[v]:
                count += 1
                seen[v] = low[v] = count
                open_nodes.append(v)
            k, end = at[v], starts[v + 1]
            while k < end:
                w = heads[k]
                if not seen[w]:
                    break
                if component[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
                k += 1
            at[v] = k
            if k < end:
                path.append(w)
                at[v] += 1
                continue
            path.pop()
            if low[v] == seen[v]:
                while True:
                    w = open_nodes.pop()
                    component[w] = found
                    if w == v:
                        break
                found += 1
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
    return np.array(component, dtype=np.int64)


def _closing(a: np.ndarray, b: np.ndarray, judge: np.ndarray) -> np.ndarray:
    """Of edges from the heaviest down, which of those to be judged close a cycle of heavier ones.

    That is so if both ends are in one strongly connected component of the edge and those before it. The edges are halved:
    lighter ones inside a component of the heavier half close a cycle, the heavier ones inside it are told by themselves,
    and the rest among the components. An edge is in one part only at each level, so the work is that of sorting.
    """
    out = np.zeros(len(a), dtype=bool)
    parts = [(np.arange(len(a)), a, b)]
    while parts:
        rows, a, b = parts.pop()
        told = np.cumsum(judge[rows])
        if not len(rows) or not told[-1]:
            continue
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = ends[: len(rows)], ends[len(rows) :]
        cut = int(np.searchsorted(told, (told[-1] + 1) // 2)) + 1
        component = _strong(a[:cut], b[:cut], len(nodes))
        a, b = component[a], component[b]
        inside, first = a == b, np.arange(len(rows)) < cut
        done = inside & ~first if told[-1] > 1 else inside
        out[rows[done & judge[rows]]] = True
        if told[-1] > 1:
            # named by component no more: the nodes of each part keep their own names
            old = ends[: len(rows)], ends[len(rows) :]
            left = inside & first
            parts.append((rows[left], old[0][left], old[1][left]))
            # the heavier edges between components are passed on as connections, told already
            judge[rows[~inside & first]] = False
            parts.append((rows[~inside], a[~inside], b[~inside]))
    return out


def _heaviest_first(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """A group's edges in order, and its nodes: the numbers of both ends of each edge, and the names."""
    ordered = group.sort_values(["weight", "src", "dst"], ascending=False, ignore_index=True)
    numbers, names = pd.factorize(pd.concat([ordered["a"], ordered["b"]], ignore_index=True))
    return ordered, numbers[: len(ordered)], numbers[len(ordered) :], names


def _on_cycles(group: pd.DataFrame) -> pd.DataFrame:
    """The edges (a, b) of a group, if they are to be judged, that close a cycle of heavier ones."""
    ordered, a, b, _ = _heaviest_first(group)
    return ordered.loc[_closing(a, b, ordered["judge"].to_numpy(dtype=bool).copy()), ["src", "dst", "weight"]]


def _told(rows: DataFrame, sizes: DataFrame, schema: str) -> DataFrame:
    """``_on_cycles`` of the groups in ``sizes(g, m)``; small ones share a task, as their nodes have names of their own."""
    groups, total = sizes.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    bins = max(int(total * 4 // TASK_EDGES) + 1, min(rows.sparkSession.sparkContext.defaultParallelism, groups))
    return rows.join(sizes, "g", "left_semi").withColumn("bin", F.pmod(F.xxhash64("g"), F.lit(bins))).repartition(bins, "bin").groupBy("bin").applyInPandas(_on_cycles, schema)


def _forest(edges: DataFrame) -> DataFrame:
    """Edges enough to connect what ``edges(src, dst)`` connect: each task drops those whose ends it has connected already."""

    def connecting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict = {}
        parent: list[int] = []
        for batch in batches:
            if len(number) > FOREST_NODES:
                number, parent = {}, []
            ends = []
            for column in batch.columns:
                coded = column.dictionary_encode()
                named = [number.setdefault(x, len(number)) for x in coded.dictionary.to_pylist()]
                ends.append(np.array(named, dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)].tolist() if named else [])
            parent.extend(range(len(parent), len(number)))
            kept = []
            for i, (x, y) in enumerate(zip(*ends)):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                while parent[y] != y:
                    parent[y] = y = parent[parent[y]]
                if x != y:
                    parent[x] = y
                    kept.append(i)
            if kept:
                yield batch.take(pa.array(kept))

    return edges.mapInArrow(connecting, edges.schema)


#: Nodes that a task of ``_forest`` remembers before it begins anew.
FOREST_NODES = 1_000_000


def _without_peak(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges found to close a cycle of heavier ones, and what is left of the groups when the nodes that their TASK_EDGES
    heaviest edges connect strongly are one node each.

    Those heaviest edges are told by a task a group. Lighter ones inside a node close a cycle; the rest are left, and the
    heaviest as connections only.
    """
    numbered = written(global_row_number(rows, ["g", F.desc("weight"), F.desc("src"), F.desc("dst")]))
    least = numbered.groupBy("g").agg(F.min("rn").alias("lo"))
    ranked = written(numbered.join(least, "g").withColumn("top", F.col("rn") - F.col("lo") < TASK_EDGES).drop("rn", "lo"))

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        _, a, b, names = _heaviest_first(group)
        component = pd.Series(_strong(a, b, len(names)))
        found = pd.DataFrame({"node": names, "c": pd.Series(names).groupby(component).transform("min")})
        return found.assign(g=group["g"].iloc[0])[["g", "node", "c"]][(component.map(component.value_counts()) > 1).to_numpy()]

    kind = rows.schema["a"].dataType.simpleString()
    groups = rows.schema["g"].dataType.simpleString()
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("src", "dst", "weight"))
    top = ranked.where("top")
    nodes = written(top.repartition("g").groupBy("g").applyInPandas(merged, f"g {groups}, node {kind}, c {kind}"))
    at = lambda end: nodes.select("g", F.col("node").alias(end), F.col("c").alias(f"c_{end}"))
    met = ranked.join(at("a"), ["g", "a"], "left").join(at("b"), ["g", "b"], "left")
    met = written(met.withColumns({"a": F.coalesce("c_a", "a"), "b": F.coalesce("c_b", "b")}).drop("c_a", "c_b"))
    closing = met.where("a = b AND NOT top AND judge").select("src", "dst", "weight")
    told = top.repartition("g").groupBy("g").applyInPandas(_on_cycles, schema)
    left = met.where("a <> b").withColumn("judge", F.col("judge") & ~F.col("top")).drop("top")
    return closing.unionByName(told), written(left.join(left.where("judge").select("g").distinct(), "g", "left_semi").select(*rows.columns))


def _cut_by_weight(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges found to close a cycle of heavier ones, and smaller groups of those that are left to be told.

    The edges of a group (g) that are to be judged are cut into PARTS by weight. Every edge goes where its ends first come
    into one strongly connected component of the parts so far: an edge for which that is before its own part closes a
    cycle of heavier ones; it is judged further if that is its own part; and if it is a later one, it closes none and goes
    there as one of the heavier edges. In a part's group, what the parts before connect is one node.
    """
    order = ["g", F.desc("judge"), F.desc("weight"), F.desc("src"), F.desc("dst")]
    numbered = written(global_row_number(rows, order))
    sizes = numbered.groupBy("g").agg(F.min("rn").alias("lo"), F.sum(F.col("judge").cast("long")).alias("m"))
    part = F.when(F.col("judge"), F.floor((F.col("rn") - F.col("lo")) * PARTS / F.col("m"))).otherwise(-1).cast("int")
    placed = written(numbered.join(sizes, "g").withColumn("part", part).drop("lo", "m"))
    upto = lambda low: placed.where(low < PARTS).withColumn("upto", F.explode(F.sequence(low, F.lit(PARTS - 1))))
    node = lambda c: F.struct("g", "upto", F.col(c).alias("n"))
    inside = strongly_connected(upto(F.greatest(F.col("part") + 1, F.lit(1))).select(node("a").alias("src"), node("b").alias("dst"), "weight"))
    inside = written(inside.select(F.col("node.g").alias("g"), F.col("node.upto").alias("upto"), F.col("node.n").alias("n"), F.col("component.n").alias("c")))
    at = lambda end: inside.select("g", "upto", F.col("n").alias(end), F.col("c").alias(f"c_{end}"))
    met = upto(F.greatest("part", F.lit(1))).join(at("a"), ["g", "upto", "a"]).join(at("b"), ["g", "upto", "b"]).where("c_a = c_b")
    met = met.groupBy("rn").agg(F.min(F.struct("upto", "c_a")).alias("met"))
    told = placed.join(met, "rn", "left").select(*placed.columns, F.coalesce("met.upto", F.lit(PARTS)).alias("upto"), F.col("met.c_a").alias("own"))
    told = written(told.withColumn("closes", F.col("judge") & (F.col("upto") <= F.col("part"))))
    left = told.where(~F.col("closes")).withColumns({"judge": F.col("judge") & (F.col("upto") - 1 == F.col("part")), "upto": F.col("upto") - 1})
    left = left.join(at("a"), ["g", "upto", "a"], "left").join(at("b"), ["g", "upto", "b"], "left")
    named = F.to_json(F.struct("g", "upto", "own"))
    left = written(left.select(named.alias("g"), F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"), "weight", "src", "dst", "judge"))
    # the one edge of its part that comes into a component there comes in by itself
    judged = left.where("judge").groupBy("g").agg(F.count("*").alias("m"))
    alone = left.where("judge").join(judged.where("m = 1"), "g", "left_semi")
    closing = told.where("closes").select("src", "dst", "weight").unionByName(alone.select("src", "dst", "weight"))
    return closing, written(left.join(judged.where("m > 1"), "g", "left_semi"))


def break_cycles(edges: DataFrame) -> DataFrame:
    """Edges without those that, by (weight, src, dst), are the least of a cycle: what is left when the least edge of each
    strongly connected component is removed again and again.

    An edge goes exactly if its target reaches its source over heavier edges, so if both are in one strongly connected
    component of it and the heavier ones. A task tells that of weakly connected components of TASK_EDGES edges at most. Of
    larger ones it tells the heaviest TASK_EDGES, whose components become nodes, again while that leaves less than half
    (``_without_peak``); what is still larger is cut at weights, all components at a time (``_cut_by_weight``). The rule is
    the same at every size.

    Loops go. Rows that repeat an edge and its weight share their fate. Edges with a null end are kept.
    """
    now = written(edges)
    known, columns = now.where("src <> dst"), ["src", "dst", "weight"]
    gone = [now.where("src = dst").select(*columns)]
    if _ordered_by_name(known):
        return now.join(gone[0], columns, "left_anti").select(*edges.columns)
    pieces = written(connected_components(_forest(known.select("src", "dst"))).withColumnRenamed("component", "g"))
    rows = known.join(pieces.withColumnRenamed("node", "src"), "src").select("g", F.col("src").alias("a"), F.col("dst").alias("b"), "weight", "src", "dst", F.lit(True).alias("judge"))
    schema = ", ".join(f"{c} {now.schema[c].dataType.simpleString()}" for c in columns)
    before = None
    while True:
        sizes = written(rows.groupBy("g").agg(F.count("*").alias("m")))
        gone.append(_told(rows, sizes.where(F.col("m") <= TASK_EDGES), schema))
        large = sizes.where(F.col("m") > TASK_EDGES)
        if large.isEmpty():
            break
        rows = written(rows.join(large, "g", "left_semi").distinct())
        size = rows.count()
        if before is not None and size > before / 2:
            gone += _cut_to_the_end(rows, schema)
            break
        before = size
        closing, rows = _without_peak(rows)
        gone.append(closing)
    return now.join(reduce(DataFrame.unionByName, gone), columns, "left_anti").select(*edges.columns)


def _cut_to_the_end(rows: DataFrame, schema: str) -> list[DataFrame]:
    """The edges that close a cycle of heavier ones, of groups cut by weight until a task can tell each."""
    inside = written(strongly_connected(rows.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")))
    at = lambda end: inside.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    rows = rows.join(at("a"), "a").join(at("b"), "b").where("c_a = c_b").select(F.to_json(F.struct("c_a")).alias("g"), "a", "b", "weight", "src", "dst", "judge")
    rows, gone = written(rows), []
    while True:
        large = written(rows.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > TASK_EDGES))
        gone.append(rows.join(large, "g", "left_anti").groupBy("g").applyInPandas(_on_cycles, schema))
        if large.isEmpty():
            return gone
        closing, rows = _cut_by_weight(rows.join(large, "g", "left_semi"))
        gone.append(closing)


#: Edges of a DAG up to which each task holds all of them, and nodes to which one task follows the paths.
REDUCED_EDGES, TARGETS = 2_000_000, 2048


def _topological(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """The ``n`` nodes, each after all that have an edge to it; without those that a cycle leads to."""
    order = np.argsort(a, kind="stable")
    heads, starts, left = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist(), np.bincount(b, minlength=n).tolist()
    out = [v for v in range(n) if not left[v]]
    for v in out:
        for w in heads[starts[v] : starts[v + 1]]:
            left[w] -= 1
            if not left[w]:
                out.append(w)
    return out


def _replaced(a: np.ndarray, b: np.ndarray, low: int, high: int) -> np.ndarray:
    """Of edges that ascend, sorted by ``a``, the places of those to a node from ``low`` to before ``high`` that a longer path replaces.

    Node by node from the last one, a bit for each of these nodes tells whether a path leads there.
    """
    starts = np.searchsorted(a, np.arange(high + 1))
    reached = np.zeros((high, (high - low + 63) // 64), dtype=np.uint64)
    found = []
    for u in range(high - 1, -1, -1):
        i, j = starts[u], starts[u + 1]
        to = b[i:j]
        to = to[to < high]
        if not len(to):
            continue
        beyond = np.bitwise_or.reduce(reached[to], axis=0) if len(to) > 1 else reached[to[0]].copy()
        near = np.flatnonzero((b[i:j] >= low) & (b[i:j] < high))
        if len(near):
            at = b[i + near] - low
            word, bit = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            found.append(i + near[(beyond[word] & bit) != 0])
            np.bitwise_or.at(beyond, word, bit)
        reached[u] = beyond
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def _reduced_in_tasks(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``edges`` without the ``pairs`` that a longer path replaces: each task holds all pairs as numbers, and the paths to TARGETS nodes."""
    places = written(global_row_number(nodes_of(pairs), ["node"], "i").select("node", (F.col("i") - 1).alias("i")))
    at = lambda end: places.select(F.col("node").alias(end), F.col("i").alias(f"__{end}"))
    table = pairs.join(at("src"), "src").join(at("dst"), "dst").select("__src", "__dst").toArrow()
    a, b = (c.to_numpy().astype(np.int64) for c in table.columns)
    n = places.count()
    named = np.array(_topological(a, b, n), dtype=np.int64)
    if len(named) < n:
        raise ValueError("the graph has a cycle")
    place = np.empty(n, dtype=np.int64)
    place[named] = np.arange(n)
    a, b = place[a], place[b]
    order = np.lexsort((b, a))
    shared = edges.sparkSession.sparkContext.broadcast((a[order].astype(np.int32), b[order].astype(np.int32), named))
    tasks = max(1, -(-n // TARGETS))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, named = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                gone = _replaced(a, b, k * TARGETS, min(n, (k + 1) * TARGETS))
                yield pa.RecordBatch.from_arrays([pa.array(named[a[gone]]), pa.array(named[b[gone]])], names=["__src", "__dst"])

    gone = edges.sparkSession.range(tasks).repartitionById(tasks, F.col("id").cast("int")).mapInArrow(follow, "__src long, __dst long")
    return edges.join(gone.join(at("src"), "__src").join(at("dst"), "__dst").select("src", "dst"), ["src", "dst"], "left_anti")


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges of a DAG for which no longer path exists.

    Up to REDUCED_EDGES edges are numbered and sent to each task, which follows the paths to some of the nodes
    (``_reduced_in_tasks``). Of more, nodes are covered by chains of edges that climb one layer each (``layers``). A node's label is the least layer that it
    reaches on each chain, which stands for all it reaches there: rows follow nodes times the chains met (one, where an
    order is total), not pairs of nodes. Labels are handed down each chain, in rounds of the logarithm of its length, then
    composed with themselves, until they hold. An edge goes if a successor of its source reaches its target. Edges that climb one layer always stay.

    Raises if there is a cycle. Repeated edges stay or go together; edges with a null end are kept.
    """
    pairs = written(_ends_known(edges).select("src", "dst").distinct())
    if pairs.count() <= REDUCED_EDGES:
        return _reduced_in_tasks(edges, pairs)
    layer = layers(pairs)
    if not layer.where(F.col("layer").isNull()).isEmpty():
        raise ValueError("the graph has a cycle")
    of = lambda c, name: layer.select(F.col("node").alias(c), F.col("layer").alias(name))
    ranked = written(pairs.join(of("src", "ls"), "src").join(of("dst", "ld"), "dst"))
    up = ranked.where(F.col("ld") == F.col("ls") + 1).groupBy(F.col("dst").alias("node")).agg(F.max("src").alias("parent"))
    only = up.groupBy("parent").agg(F.max("node").alias("node"))  # one successor on the chain
    chains = _follow(layer.select("node").join(only, "node", "left")).select("node", F.col("end").alias("chain"))
    label = written(chains.join(layer, "node").withColumnRenamed("layer", "at"))
    place = label.select(F.col("node").alias("dst"), "chain", F.col("at").alias("low"))
    own = label.select("node", F.col("chain").alias("own"), "at")
    least = lambda rows: written(rows.groupBy("node", "own", "at", "chain").agg(F.min("low").alias("low")))
    reached = least(pairs.join(place, "dst").select(F.col("src").alias("node"), "chain", "low").join(own, "node"))
    deepest = label.agg(F.max("at")).first()[0] or 0
    while True:
        step = 1
        while step <= deepest:  # what later nodes of its chain reach, a node reaches too: twice as far each time
            before = own.select(F.col("node").alias("earlier"), "own", F.col("at").alias("at0"))
            pushed = reached.withColumn("at0", F.col("at") - step).join(before, ["own", "at0"]).select(F.col("earlier").alias("node"), "own", F.col("at0").alias("at"), "chain", "low")
            reached, step = least(reached.unionByName(pushed)), step * 2
        size = tuple(reached.agg(F.count("*"), F.sum("low")).first())
        via = own.select(F.col("node").alias("via"), F.col("own").alias("chain"), F.col("at").alias("low"))
        further = reached.select(F.col("node").alias("via"), F.col("chain").alias("chain2"), F.col("low").alias("low2"))
        composed = reached.join(via, ["chain", "low"]).join(further, "via").select("node", "own", "at", F.col("chain2").alias("chain"), F.col("low2").alias("low"))
        reached = least(reached.unionByName(composed))
        if tuple(reached.agg(F.count("*"), F.sum("low")).first()) == size:
            break
    reached = reached.select("node", "chain", "low")
    far = ranked.where(F.col("ld") > F.col("ls") + 1)
    twice = pairs.join(far.select("src").distinct(), "src", "left_semi").join(reached.withColumnRenamed("node", "dst"), "dst").groupBy("src", "chain").agg(F.min("low").alias("low"))
    longer = far.join(chains.withColumnRenamed("node", "dst"), "dst").join(twice, ["src", "chain"]).where(F.col("low") <= F.col("ld"))
    return edges.join(longer.select("src", "dst"), ["src", "dst"], "left_anti")


def _toward_least(directed: DataFrame) -> DataFrame:
    """(u, v, m) of (u, v): m is the least of u and all its v. A hub's least is found map-side, and its rows are split by the skew join."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each weakly connected component.

    Alternating star rounds: the larger neighbours of each node, then the smaller ones, are linked to the least of all, and
    in the end each component is a star around its least node. No round joins on the component, whose one key may hold most
    nodes; rounds grow with the logarithm of the nodes.

    Edges with a null end are ignored; a node with nothing but a loop is a component. No edges give no rows.
    """
    known = written(_ends_known(edges).select("src", "dst").distinct())
    now = written(known.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    before = None
    while True:
        size = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if size == before:
            break
        before = size
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _toward_least(large)
        pairs = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = written(pairs.where("a <> b").distinct())
    rest = nodes_of(known).join(now.select(F.col("a").alias("node")), "node", "left_anti")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(rest.select("node", F.col("node").alias("component")))


def edge_provenance_audit(edges: DataFrame, keys: tuple[str, ...] = ("relation_type",)) -> DataFrame:
    """Rows, unique directed and undirected edges, mirrored pairs, loops, duplicates, support and weight statistics, limit check.

    Rows are collapsed map-side to one per pair of ends, with marks of the directions that occur, and then per key.
    Edges with a null end count as rows only. No edges give no rows.
    """
    mark = lambda condition: F.max(F.when(condition, 1).otherwise(0))
    src, dst = F.col("src"), F.col("dst")
    pairs = edges.groupBy(*keys, F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).agg(
        F.count("*").alias("rows"), mark(src < dst).alias("up"), mark(src > dst).alias("down"), F.sum(F.when(src == dst, 1).otherwise(0)).alias("loops"), F.sum("support_count").alias("s"),
        F.count("support_count").alias("s_n"), F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.sum("weight").alias("w"), F.count("weight").alias("w_n"),
    )
    base = pairs.groupBy(*keys).agg(
        F.sum("rows").alias("raw_rows"), F.sum(F.col("up") + F.col("down") + F.least("loops", F.lit(1))).alias("unique_directed"), F.sum(F.greatest("up", "down")).alias("unique_undirected"),
        F.sum(F.col("up") * F.col("down")).alias("mirrored_pairs"), F.sum("loops").alias("self_loops"), F.sum("s").alias("support_sum"), safe_ratio(F.sum("s"), F.sum("s_n")).alias("support_mean"),
        F.min("lo").alias("weight_min"), F.max("hi").alias("weight_max"), safe_ratio(F.sum("w"), F.sum("w_n")).alias("weight_mean"),
    )
    middle = quantiles(edges, list(keys), "support_count", {"support_median": 0.5})
    n = nodes_of(edges, *keys).groupBy(*keys).agg(F.count("*").alias("nodes"))
    out = base.join(n, list(keys)).join(middle, list(keys), "left")
    limit = F.floor(F.col("nodes") * (F.col("nodes") - 1) / 2)
    return out.select(
        *keys, "raw_rows", "unique_directed", "unique_undirected", "mirrored_pairs", "self_loops",
        (F.col("raw_rows") - F.col("unique_directed")).alias("duplicate_rows"), "support_sum", "support_mean", "support_median", "weight_min", "weight_max", "weight_mean", "nodes",
        (F.col("unique_undirected") <= limit).alias("within_limit"),
        F.when(F.col("mirrored_pairs") == F.col("unique_undirected"), "mirrored").when(F.col("mirrored_pairs") > 0, "partly mirrored").otherwise("one row per edge").alias("interpretation"),
    )


def relation_availability(edges: DataFrame, n_skills: DataFrame, relations: list[tuple[str, bool]], cuts: tuple[float, float, float] = (0.05, 0.5, 0.8)) -> DataFrame:
    """(relation_type, edges, density, flag) of every relation named, absent ones included; undirected pairs count once."""
    spark = edges.sparkSession
    named = spark.createDataFrame(relations, "relation_type string, is_directed boolean")
    directed = edges.groupBy("relation_type").agg(F.countDistinct("src", "dst").alias("d"), F.countDistinct(F.least("src", "dst"), F.greatest("src", "dst")).alias("u"))
    joined = F.broadcast(named).join(directed, "relation_type", "left").crossJoin(F.broadcast(n_skills))
    m = F.coalesce(F.when(F.col("is_directed"), F.col("d")).otherwise(F.col("u")), F.lit(0))
    n = F.col("n_skills")
    density = F.coalesce(safe_ratio(F.when(F.col("is_directed"), m).otherwise(2 * m), n * (n - 1)), F.lit(0.0))
    flag = F.when(m == 0, "absent").when(density < cuts[0], "sparse").when(density < cuts[1], "moderate").when(density < cuts[2], "dense").otherwise("very_dense")
    return joined.select("relation_type", m.alias("edges"), density.alias("density"), flag.alias("flag"))


def _degrees(edges: DataFrame) -> DataFrame:
    return canonical(edges).where("u <> v").select(F.explode(F.array("u", "v")).alias("skill_id")).groupBy("skill_id").agg(F.count("*").alias("degree"))


def graph_coverage(edges: DataFrame, train: DataFrame, cuts: tuple[int, ...] = (50, 100, 200)) -> DataFrame:
    """One row over the union of relations as an undirected graph: edges, covered and isolated skills, degrees, coverage of rare skills."""
    sizes = train.groupBy("skill_id").agg(F.count("*").alias("n"))
    joined = sizes.join(_degrees(edges), "skill_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    covered = F.col("degree") > 0
    aggs = [
        F.count("*").alias("n_skills"), F.sum(covered.cast("int")).alias("covered"), F.sum((~covered).cast("int")).alias("isolated"),
        F.avg(covered.cast("double")).alias("covered_ratio"), F.avg("degree").alias("mean_degree"), F.median("degree").alias("median_degree"),
        F.avg(F.when(covered, F.col("degree"))).alias("mean_degree_covered"), F.median(F.when(covered, F.col("degree"))).alias("median_degree_covered"),
        *[F.avg(F.when(F.col("n") <= c, covered.cast("double"))).alias(f"covered_le_{c}") for c in cuts],
    ]
    total = canonical(edges).where("u <> v").agg(F.count("*").alias("edges"))
    return joined.agg(*aggs).crossJoin(total)


def sparse_coverage(e_co: DataFrame, train: DataFrame, at_most: int = 100) -> DataFrame:
    """Share of skills with at most ``at_most`` interactions that have a co-occurrence neighbour."""
    sizes = train.groupBy("skill_id").agg(F.count("*").alias("n")).where(F.col("n") <= at_most)
    joined = sizes.join(_degrees(e_co), "skill_id", "left")
    return joined.agg(F.count("*").alias("sparse_skills"), F.count("degree").alias("covered"), safe_ratio(F.count("degree"), F.count("*")).alias("sparse_coverage"))


def stratum_degree_support(edges: DataFrame, strata: DataFrame, test: DataFrame) -> DataFrame:
    """Per stratum: skills, mean degree per relation, coverage, isolation, test interactions, median co-occurrence degree.

    ``edges(relation_type, src, dst)`` with relations pre, sim and co; ``strata(skill_id, stratum)``.
    """
    ends = canonical(edges, "relation_type").where("u <> v").select("relation_type", F.explode(F.array("u", "v")).alias("skill_id"))
    degree = ends.groupBy("skill_id").agg(*[F.sum(F.when(F.col("relation_type") == r, 1).otherwise(0)).alias(f"d_{r}") for r in ("pre", "sim", "co")])
    seen = test.groupBy("skill_id").agg(F.count("*").alias("n_test"))
    joined = strata.select("skill_id", "stratum").join(degree, "skill_id", "left").join(seen, "skill_id", "left").na.fill(0, ["d_pre", "d_sim", "d_co", "n_test"])
    any_edge = (F.col("d_pre") + F.col("d_sim") + F.col("d_co")) > 0
    return joined.groupBy("stratum").agg(
        F.count("*").alias("n_skills"), *[F.avg(f"d_{r}").alias(f"mean_degree_{r}") for r in ("pre", "sim", "co")],
        F.avg(any_edge.cast("double")).alias("coverage"), F.avg((~any_edge).cast("double")).alias("isolation_rate"),
        F.sum("n_test").alias("test_interactions"), F.median("d_co").alias("median_degree_co"),
    )


def degree_feature(edges: DataFrame, skills: DataFrame, relations: list[str]) -> DataFrame:
    """(skill_id, degree, degree_norm) over the named relations, rows counted at both ends; norm is 0 without edges."""
    chosen = edges.where(F.col("relation_type").isin(relations) if relations else F.lit(False))
    counts = chosen.select(F.explode(F.array("src", "dst")).alias("skill_id")).groupBy("skill_id").agg(F.count("*").alias("degree"))
    joined = skills.select("skill_id").distinct().join(counts, "skill_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = joined.agg(F.max("degree").alias("top"))
    return joined.crossJoin(F.broadcast(top)).select("skill_id", "degree", F.coalesce(safe_ratio(F.col("degree"), F.col("top")), F.lit(0.0)).alias("degree_norm"))


def gate_grid(spark: SparkSession, gates: list[tuple[str, float, float, float]], betas: list[float]) -> DataFrame:
    """All candidates (variant, alpha_pre, alpha_sim, alpha_co, beta) of gates and a sparse boost sweep."""
    grid = spark.createDataFrame(gates, "variant string, alpha_pre double, alpha_sim double, alpha_co double")
    return grid.withColumn("beta", F.explode(F.array(*[F.lit(b) for b in betas])))


def gated_degree(edges: DataFrame, grid: DataFrame, strata: DataFrame, skills: DataFrame) -> DataFrame:
    """(variant, beta, skill_id, degree, degree_norm): sums of gate x weight, boosted by 1 + beta where an end is (very) sparse.

    Gates are rows, so all candidates come from one job; the norm divides by the candidate's largest degree.
    """
    rare = strata.where(F.col("stratum").isin("very_sparse", "sparse")).select("skill_id")
    flags = edges.join(rare.select(F.col("skill_id").alias("src"), F.lit(1).alias("rs")), "src", "left").join(rare.select(F.col("skill_id").alias("dst"), F.lit(1).alias("rd")), "dst", "left")
    flags = flags.withColumn("rare", F.col("rs").isNotNull() | F.col("rd").isNotNull())
    ends = flags.select("relation_type", "rare", "weight", F.explode(F.array("src", "dst")).alias("skill_id")).groupBy("relation_type", "rare", "skill_id").agg(F.sum("weight").alias("w"))
    alpha = F.when(F.col("relation_type") == "pre", F.col("alpha_pre")).when(F.col("relation_type") == "sim", F.col("alpha_sim")).otherwise(F.col("alpha_co"))
    part = alpha * F.col("w") * F.when(F.col("rare"), 1 + F.col("beta")).otherwise(F.lit(1.0))
    sums = ends.crossJoin(grid).groupBy("variant", "beta", "skill_id").agg(F.sum(part).alias("degree"))
    every = skills.select("skill_id").distinct().crossJoin(grid.select("variant", "beta"))
    joined = every.join(sums, ["variant", "beta", "skill_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))
    top = joined.groupBy("variant", "beta").agg(F.max("degree").alias("top"))
    return joined.join(top, ["variant", "beta"]).select("variant", "beta", "skill_id", "degree", F.when(F.col("top") > 0, F.col("degree") / F.col("top")).otherwise(0.0).alias("degree_norm"))


def density_audit(edges: DataFrame, train: DataFrame) -> DataFrame:
    """Per relation: undirected edges, density and coverage with the train skills as the denominator."""
    n = train.agg(F.countDistinct("skill_id").alias("n"))
    m = canonical(edges, "relation_type").where("u <> v").groupBy("relation_type").agg(F.count("*").alias("edges"))
    own = nodes_of(edges, "relation_type").groupBy("relation_type").agg(F.count("*").alias("covered"))
    joined = m.join(own, "relation_type").crossJoin(F.broadcast(n))
    return joined.select("relation_type", "edges", "covered", safe_ratio(2 * F.col("edges"), F.col("n") * (F.col("n") - 1)).alias("density"), safe_ratio(F.col("covered"), F.col("n")).alias("coverage"))
