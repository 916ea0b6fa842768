"""Connected components by randomised contraction, with the lineage cut in every round; a small rest is one task's work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, cut, join_hot, release


#: Edges (16 bytes each) that one task takes at most.
FEW = 1 << 20


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the least node that each reaches: roots are hung below lesser ones and paths shortened, until nothing moves."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(node))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            return node, node[root]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(e: DataFrame) -> DataFrame:
    """(node, to) of a graph of at most FEW edges."""

    def run(batches):
        found = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if found:
            node, to = least_reachable(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(to)], ["node", "to"])

    return cut(e.coalesce(1).mapInArrow(run, "node long, to long"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of edges (a, b); loops and repeated edges are harmless.

    In each round every node moves to the least of its neighbours and itself, and edges are drawn between what is left.
    Rounds alternate between the least number, which settles stars at once, and the least hash, which shrinks any graph,
    long paths too, by a constant share. Minima are aggregated before they are shuffled. Nodes and labels that hold more
    than a fixed share of the rows (so there are few, whatever the size) are joined where the rows lie. Once no more than FEW
    edges are left (rounds shrink them by a constant share, and most inputs begin there), one task settles them.
    """
    e = cut(edges.select("a", "b").where("a <> b").distinct())
    labels, turn = None, 0
    while (n := e.count()) > FEW:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if turn % 2:
            best = F.least(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))), F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n")))["n"]
        else:
            best = F.least(F.min("b"), F.col("a"))
        turn += 1
        moved = cut(both.groupBy("a").agg(best.alias("to"), (F.count("*") * HOT > 2 * n).alias("hot")).withColumnRenamed("a", "node"))
        old_edges, old_labels = e, labels
        if labels is None:
            labels = cut(moved.select("node", F.col("to").alias("label")))
        else:
            labels = _relabelled(labels, moved)
        e = cut(_renamed(_renamed(e, moved, "a"), moved, "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
        release(old_edges, old_labels, moved)
    moved = _in_one_task(e)
    release(e)
    if labels is None:
        return moved.select("node", F.col("to").alias("component"))
    last = _relabelled(labels, moved)
    release(labels, moved)
    out = named(last, last.groupBy("label").agg(F.min("node").alias("name")))
    release(last)
    return out.withColumnRenamed("name", "component")


def _relabelled(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """labels with every label replaced by where it moved."""
    left = labels.select(F.col("node").alias("origin"), F.col("label").alias("node"))
    return cut(join_hot(left, moved.select("node", "to"), "node", "left").select(F.col("origin").alias("node"), F.coalesce("to", "node").alias("label")))


def _renamed(e: DataFrame, moved: DataFrame, side: str) -> DataFrame:
    """e with each node of a side replaced by where it moved; nodes of very many edges are joined where the edges lie."""
    to = moved.select(F.col("node").alias(side), F.col("to").alias("_to"), "hot")
    hot = F.broadcast(to.where("hot").select(side, "_to"))
    first = e.join(hot, side, "left")
    rest = first.where("_to is null").drop("_to").join(to.where("not hot").select(side, "_to"), side)
    return first.where("_to is not null").unionByName(rest).withColumn(side, F.col("_to")).drop("_to")


def named(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(node, name) from written (node, label) and (label, name), whose labels are distinct."""
    names = cut(names)
    out = cut(join_hot(labels, names, "label").select("node", "name"))
    release(names)
    return out
