"""Graphs as node and edge tables: reachability, components, levels, order checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from ..durable import cut


def path_edges(nodes: DataFrame, keys: list[str], order: str, node: str) -> DataFrame:
    """Distinct edges between consecutive nodes of paths."""
    w = Window.partitionBy(*keys).orderBy(order)
    return nodes.select(F.col(node).alias("src"), F.lead(node).over(w).alias("dst")).where("dst IS NOT NULL").distinct()


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, hops): nodes reachable from ``starts`` (node), with the fewest hops."""
    edges = cut(edges.select("src", "dst").distinct(), "edges")
    seen = cut(starts.select("node").distinct().withColumn("hops", F.lit(0)), "seen")
    front, hops = seen, 0
    while not front.isEmpty():
        hops += 1
        fresh = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(fresh.join(seen, "node", "left_anti").withColumn("hops", F.lit(hops)), "front")
        seen = seen.unionByName(front)
    return seen


def unreachable(nodes: DataFrame, edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Nodes that lie on no path from a source to a sink."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    live = reachable(edges, sources).select("node").intersect(reachable(back, sinks).select("node"))
    return nodes.select("node").distinct().join(live, "node", "left_anti")


def is_valid(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> bool:
    """Whether some sink can be reached from some source."""
    return not reachable(edges, sources).join(sinks, "node", "left_semi").isEmpty()


def components(edges: DataFrame, chunk: int = 1 << 19) -> DataFrame:
    """(node, component): weakly connected components named by their least node.

    Edges are dealt out by ranges of their nodes, and a kernel settles each run of ``chunk`` edges by itself,
    whatever it holds.  A node that several runs have seen links their components; only these links, few where
    neighbours have near ids, go through rounds over whole tables.  An edge with a null end links nothing.

    Labels are as many as nodes, but their Parquet files are small, by which a join would take them for
    tables to broadcast from the driver; so every join here is told to be one of sorted partitions.
    """
    ends = edges.select("src").union(edges.select("dst")).schema[0].dataType
    pairs = cut(edges.select(F.col("src").cast(ends).alias("src"), F.col("dst").cast(ends).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL"), "edges")
    w = Window.partitionBy("node").orderBy("root")
    seen = cut(_settled(pairs.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst"), chunk).withColumn("was", F.lag("root").over(w)), "seen")
    links = seen.where("was IS NOT NULL").select(F.col("was").alias("src"), F.col("root").alias("dst"))
    labels = seen.where("was IS NULL").select("node", F.col("root").alias("_root"))
    names = _labelled(links).select(F.col("node").alias("_root"), "component")
    return labels.join(names.hint("merge"), "_root", "left").select("node", F.coalesce("component", "_root").alias("component"))


def _settled(pairs: DataFrame, chunk: int) -> DataFrame:
    """(node, root): the nodes of each run of ``chunk`` edges, with the least node they are connected to by the run's edges."""

    def roots(src, dst):
        names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b = np.split(at.reshape(-1), 2)
        root = np.arange(len(names))
        while len(a):
            x, y = root[a], root[b]
            low = np.minimum(x, y)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
        return names, names[root]

    def run(batches):
        held, n = [], 0

        def found():
            table = pa.Table.from_batches(held)
            made = roots(*(c.to_numpy() for c in table.columns))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, table.schema)], names=["node", "root"])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= chunk:
                yield found()
                held, n = [], 0
        if n:
            yield found()

    kind = pairs.schema["src"].dataType
    return pairs.mapInArrow(run, StructType([StructField("node", kind), StructField("root", kind)]))


def _labelled(edges: DataFrame) -> DataFrame:
    """(node, component) by rounds in which nodes take the least label of their neighbours and of their label."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least("node", F.min("dst")).alias("component")), "labels")
    while True:
        low = both.join(labels.select(F.col("node").alias("dst"), "component").hint("merge"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        near = labels.join(low.hint("merge"), "node").withColumn("low", F.least("low", "component")).join(jump.hint("merge"), "low", "left")
        moved = cut(near.select("node", F.coalesce(F.least("low", "further"), "low").alias("component"), F.col("component").alias("was")), "labels")
        labels = moved.select("node", "component")
        if moved.where("component <> was").isEmpty():
            return labels


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): length of the longest path that ends at a node of an acyclic graph.

    Ordering by (level, node) is a topological order.  Each round takes off the nodes without
    predecessors; raises once none is left to take off a cycle.
    """
    edges = cut(edges.select("src", "dst").distinct(), "edges")
    left = cut(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct(), "left")
    done, level = left.limit(0).withColumn("level", F.lit(0)), 0
    while not left.isEmpty():
        front = cut(left.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"), "front")
        if front.isEmpty():
            raise ValueError("the graph has a cycle")
        done = done.unionByName(front.withColumn("level", F.lit(level)))
        left = cut(left.join(front, "node", "left_anti"), "left")
        edges = cut(edges.join(front, F.col("src") == F.col("node"), "left_anti"), "edges")
        level += 1
    return done


def is_topological(order: DataFrame, edges: DataFrame) -> bool:
    """Whether positions (node, pos) hold the nodes of the edges, each once and no other, sources first."""
    if not order.groupBy("node").count().where("count > 1").isEmpty():
        return False
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    ends = ends.withColumn("_known", F.lit(True))
    if not ends.join(order, "node", "full").where("pos IS NULL OR _known IS NULL").isEmpty():
        return False
    a, b = order.select(F.col("node").alias("src"), F.col("pos").alias("a")), order.select(F.col("node").alias("dst"), F.col("pos").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a >= b").isEmpty()


def without(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that are left when ``removed`` (node) go with all their edges."""
    gone = removed.select("node").distinct()
    kept = edges.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti")
    return nodes.join(gone, "node", "left_anti"), kept


def levels_within(edges: DataFrame, key: str) -> DataFrame:
    """(key, node, level) as ``levels``, for tables of many graphs that each fit one task.

    Graphs are rows for a kernel that takes nodes off in Kahn's order; nodes of a cycle have level null.
    """

    def run(batches):
        for batch in batches:
            keys, nodes, found = [], [], []
            for g in batch.to_pylist():
                after: dict = {}
                waiting: dict = {}
                for e in g["edges"]:
                    after.setdefault(e["src"], []).append(e["dst"])
                    waiting.setdefault(e["src"], 0)
                    waiting[e["dst"]] = waiting.get(e["dst"], 0) + 1
                level = {n: 0 for n, d in waiting.items() if not d}
                todo = list(level)
                for n in todo:
                    for m in after.get(n, ()):
                        level[m] = max(level.get(m, 0), level[n] + 1)
                        waiting[m] -= 1
                        if not waiting[m]:
                            todo.append(m)
                done = set(todo)
                for n in waiting:
                    keys.append(g["key"])
                    nodes.append(n)
                    found.append(level[n] if n in done else None)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.array(found, pa.int32())], names=[key, "node", "level"])

    rows = edges.select(F.col(key).cast("long").alias("key"), F.struct(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).alias("e")).distinct()
    return rows.groupBy("key").agg(F.collect_list("e").alias("edges")).mapInArrow(run, f"{key} long, node long, level int")


def leaf_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, is_start, is_stop): nodes without predecessors start, those without successors stop."""
    into = edges.select(F.col("dst").alias("node")).distinct().withColumn("_in", F.lit(True))
    out = edges.select(F.col("src").alias("node")).distinct().withColumn("_out", F.lit(True))
    return nodes.select("node").distinct().join(into, "node", "left").join(out, "node", "left").select("node", F.col("_in").isNull().alias("is_start"), F.col("_out").isNull().alias("is_stop"))
