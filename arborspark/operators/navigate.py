"""From nodes to their neighbours, attributes and text, over the node relation; and what a document says about itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import clean_col
from ..functions.html import ELEMENT, Dom
from ..plans import css
from .nodes import map_rows
from .relational import KEY, _pair, select


def _step(nodes: DataFrame, found: DataFrame, condition) -> DataFrame:
    """Nodes related to any of the found ones, each once."""
    return nodes.alias("v").join(found.select("page_id", "node_id", "parent_id", "dfs_out", "child_idx", "prev_el", "next_el").alias("u"), condition, "left_semi")


def _u(c: str):
    return F.col(f"u.{c}")


def _v(c: str):
    return F.col(f"v.{c}")


def parent(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return _step(nodes, found, (_u("page_id") == _v("page_id")) & (_u("parent_id") == _v("node_id")) & (_v("node_type") == ELEMENT))


def children(nodes: DataFrame, found: DataFrame, elements_only: bool = True) -> DataFrame:
    kids = nodes.where(F.col("node_type") == ELEMENT) if elements_only else nodes
    return _step(kids, found, _pair(">", "u", "v"))


def descendants(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return _step(nodes, found, _pair(" ", "u", "v"))


def ancestors(nodes: DataFrame, found: DataFrame, selector: str | None = None) -> DataFrame:
    above = _step(nodes.where(F.col("node_type") == ELEMENT), found, (_u("page_id") == _v("page_id")) & (_v("node_id") < _u("node_id")) & (_u("node_id") <= _v("dfs_out")))
    return above if selector is None else above.join(select(nodes, selector).select(*KEY), KEY, "left_semi")


def next_element(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return _step(nodes, found, _pair("+", "u", "v"))


def previous_element(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return _step(nodes, found, (_u("page_id") == _v("page_id")) & (_u("prev_el") == _v("node_id")))


def first_element_child(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return children(nodes.where("child_idx = 1"), found)


def last_element_child(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return children(nodes.where("child_idx_rev = 1"), found)


def attributes(found: DataFrame) -> DataFrame:
    """page_id, node_id, name, value: a row for each attribute."""
    return found.where("attrs is not null").select("page_id", "node_id", F.explode("attrs").alias("name", "value"))


def with_class(found: DataFrame, name: str) -> DataFrame:
    """found with has_class."""
    return found.withColumn("has_class", F.array_contains("classes", name))


def matches(nodes: DataFrame, found: DataFrame, selector: str) -> DataFrame:
    """found with matches: whether each node fits the selector."""
    hit = select(nodes, selector).select(*KEY, F.lit(True).alias("_hit"))
    return found.join(hit, KEY, "left").withColumn("matches", F.coalesce("_hit", F.lit(False))).drop("_hit")


def texts(pages: DataFrame, selector: str, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """ord, text, clean_text, visible_text, own_text and blank of every matching node."""

    def compute(dom: Dom, row: dict):
        for k, i in enumerate(css.select(dom, selector)):
            t = dom.text(i)
            yield k, t, dom.visible_text(i), "".join(dom.direct_texts(i)), not t.strip()

    got = map_rows(pages, html_col, compute, "ord int, text string, visible_text string, own_text string, blank boolean", keep)
    return got.withColumn("clean_text", clean_col(F.col("text")))


def documents(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """title, doctype, whether head and body exist, numbers of nodes, elements, texts, distinct tags, classes and ids, and depth."""

    def compute(dom: Dom, row: dict):
        tags, classes, ids = dom.index
        title = next((dom.text(i) for i in tags.get("title", ())), None)
        yield title, dom.doctype, "head" in tags, "body" in tags, len(dom), len(dom.elements), len(dom.texts), len(tags), len(classes), len(ids), max(dom.depth)

    return map_rows(pages, html_col, compute, "title string, doctype string, has_head boolean, has_body boolean, nodes int, elements int, texts int, tags int, classes int, ids int, depth int", keep)
