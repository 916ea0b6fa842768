"""Selectors over the node relation: each combinator is a semi-join, each negation an anti-join.

Chains are evaluated from the left: the nodes that match a prefix are a relation, and the next compound keeps those of its
nodes that stand in the combinator's relation to one of them. Every join has the page as an equality key, so descendant
joins are hash joins with an interval as residual.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import ELEMENT, TEXT
from ..plans.css import Chain, parse
from .predicates import own, relations

KEY = ["page_id", "node_id"]


def parsed_once(nodes: DataFrame) -> DataFrame:
    """A node relation that several joins read: kept as columns (in memory, on disk where it does not fit) after the first of them.

    Without it every join would parse the pages anew. Only the columns that a join names are read back; lost blocks are
    parsed again. Call unpersist() when done; for a corpus larger than the disks of the cluster write the nodes to a table.
    """
    return nodes.persist(StorageLevel.MEMORY_AND_DISK)


def _pair(combinator: str, up: str, low: str) -> Column:
    """low stands in the combinator's relation to up, both given as aliases."""
    u, v = lambda c: F.col(f"{up}.{c}"), lambda c: F.col(f"{low}.{c}")
    page = u("page_id") == v("page_id")
    if combinator == ">":
        return page & (v("parent_id") == u("node_id"))
    if combinator == "+":
        return page & (v("prev_el") == u("node_id"))
    if combinator == "~":
        return page & (v("parent_id") == u("parent_id")) & (u("child_idx") < v("child_idx")) & (u("child_idx") > 0)
    return page & (u("node_id") < v("node_id")) & (v("node_id") <= u("dfs_out"))


def compound(nodes: DataFrame, c) -> DataFrame:
    """The nodes that match a compound."""
    found = nodes.where(own(F.col, c))
    for p in relations(c):
        if p.name == "empty":
            filled = nodes.where((F.col("node_type") == ELEMENT) | (F.col("node_type") == TEXT) & (F.col("data") != ""))
            found = found.alias("u").join(filled.alias("v"), _pair(">", "u", "v"), "left_anti")
        elif p.name == "has":
            found = found.join(_union([_having(nodes, found, c) for c in p.arg], nodes), KEY, "left_semi")
        else:
            other = _union([chain(nodes, x).select(*KEY) for x in p.arg], nodes)
            found = found.join(other, KEY, "left_semi" if p.name == "is" else "left_anti")
    return found


def _union(parts: list[DataFrame], nodes: DataFrame) -> DataFrame:
    if not parts:
        return nodes.select(*KEY).where(F.lit(False))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _having(nodes: DataFrame, found: DataFrame, inner: Chain | str) -> DataFrame:
    """Keys of the found nodes from which the inner chain leads somewhere; the chain is folded from its end."""
    if inner == "text":
        blank = F.trim(F.regexp_replace("data", r"\s", "")) != ""
        return found.alias("u").join(nodes.where((F.col("node_type") == TEXT) & blank).alias("v"), _pair(">", "u", "v"), "left_semi").select(*KEY)
    ends = compound(nodes, inner.parts[-1][1])
    for (_, up), (combinator, _) in zip(reversed(inner.parts[:-1]), reversed(inner.parts[1:]), strict=True):
        ends = compound(nodes, up).alias("u").join(ends.alias("v"), _pair(combinator, "u", "v"), "left_semi")
    return found.alias("u").join(ends.alias("v"), _pair(inner.parts[0][0], "u", "v"), "left_semi").select(*KEY)


def chain(nodes: DataFrame, c: Chain) -> DataFrame:
    """The nodes that end a chain."""
    lead, first = c.parts[0]
    found = compound(nodes, first)
    if lead in ("+", "~"):
        found = found.where("prev_el >= 0")
    for combinator, part in c.parts[1:]:
        found = compound(nodes, part).alias("v").join(found.alias("u"), _pair(combinator, "u", "v"), "left_semi")
    return found


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """The nodes of every page that match any group of the selector, each once (read them by page_id, node_id)."""
    groups = [chain(nodes, c) for c in parse(selector)]
    if len(groups) == 1:
        return groups[0]
    return nodes.join(_union([g.select(*KEY) for g in groups], nodes).distinct(), KEY, "left_semi")


def first(found: DataFrame) -> DataFrame:
    """The first node of each page in document order, by a partial minimum."""
    cols = [c for c in found.columns if c != "page_id"]
    return found.groupBy("page_id").agg(F.min_by(F.struct(*cols), "node_id").alias("n")).select("page_id", "n.*")


def text(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, node_id, text: all text below each of the found nodes, in order."""
    t = nodes.where(F.col("node_type") == TEXT).select("page_id", F.col("node_id").alias("t_id"), "data")
    f = found.select("page_id", "node_id", "dfs_out")
    hit = f.join(t, (f["page_id"] == t["page_id"]) & (t["t_id"] > f["node_id"]) & (t["t_id"] <= f["dfs_out"]), "left").select(f["page_id"], "node_id", "t_id", "data")
    parts = F.array_sort(F.collect_list(F.when(F.col("t_id").isNotNull(), F.struct("t_id", "data"))))
    return hit.groupBy("page_id", "node_id").agg(F.array_join(F.transform(parts, lambda x: x["data"]), "").alias("text"))


# --- sets of nodes ------------------------------------------------------------------------------------------------------


def concatenate(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY).distinct(), KEY, "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.dropDuplicates(KEY).join(b.select(*KEY).distinct(), KEY, "left_semi")


def ranked(found: DataFrame) -> DataFrame:
    """found with ord (from 1) and ord_rev (from the end) on each page."""
    from pyspark.sql import Window

    up = Window.partitionBy("page_id").orderBy("node_id")
    down = Window.partitionBy("page_id").orderBy(F.desc("node_id"))
    return found.withColumn("ord", F.row_number().over(up)).withColumn("ord_rev", F.row_number().over(down))


def item(found: DataFrame, i: int, n: int | None = None) -> DataFrame:
    """Element i (negative from the end) of each page's set, or n elements from it."""
    r = ranked(found)
    size = n if n is not None else 1
    if i >= 0:
        return r.where(F.col("ord").between(i + 1, i + size)).drop("ord", "ord_rev")
    return r.where(F.col("ord_rev").between(max(1, -i - size + 1), -i)).drop("ord", "ord_rev")


def reverse(found: DataFrame) -> DataFrame:
    """found with ord counted from the end of each page's set."""
    return ranked(found).drop("ord").withColumnRenamed("ord_rev", "ord")


def without_last(found: DataFrame) -> DataFrame:
    return ranked(found).where("ord_rev > 1").drop("ord", "ord_rev")


def without_first(found: DataFrame) -> DataFrame:
    return ranked(found).where("ord > 1").drop("ord", "ord_rev")


def index_of(found: DataFrame, other: DataFrame) -> DataFrame:
    """page_id, node_id, index (from 0; null if absent) of the nodes of other in each page's set."""
    place = ranked(found).select(*KEY, (F.col("ord") - 1).alias("index"))
    return other.select(*KEY).join(place, KEY, "left")


def includes(found: DataFrame, other: DataFrame) -> DataFrame:
    return index_of(found, other).select(*KEY, F.col("index").isNotNull().alias("included"))


def joined_text(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, text: the texts of each page's set, one after another."""
    parts = F.array_sort(F.collect_list(F.struct("node_id", "text")))
    return text(nodes, found).groupBy("page_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
