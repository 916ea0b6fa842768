"""Selectors as higher-order functions over the dom array: page-local and without a shuffle, for chains that stay short."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.html import ELEMENT, TEXT
from ..plans.css import Chain, Compound, parse
from .predicates import all_of, any_of, own, relations


def _at(dom: Column, i: Column) -> Column:
    return F.get(dom, i)


def compound(dom: Column, n: Column, c: Compound) -> Column:
    parts = [own(lambda name: n[name], c)]
    for p in relations(c):
        if p.name == "empty":
            kid = lambda k: (k["parent_id"] == n["node_id"]) & ((k["node_type"] == ELEMENT) | (k["node_type"] == TEXT) & (k["data"] != ""))  # noqa: E731, B023
            parts.append(~F.exists(dom, kid))
        elif p.name == "has":
            parts.append(any_of([_having(dom, n, x) for x in p.arg]))
        else:
            inner = any_of([ends(dom, n, x) for x in p.arg])
            parts.append(inner if p.name == "is" else ~inner)
    return all_of(parts)


def _having(dom: Column, n: Column, inner: Chain | str, at: int = 0) -> Column:
    if inner == "text":
        return F.exists(dom, lambda k: (k["parent_id"] == n["node_id"]) & (k["node_type"] == TEXT) & (F.trim(F.regexp_replace(k["data"], r"\s", "")) != ""))
    combinator, c = inner.parts[at]

    def ok(k: Column) -> Column:
        related = {
            ">": lambda: k["parent_id"] == n["node_id"],
            "+": lambda: k["prev_el"] == n["node_id"],
            "~": lambda: (k["parent_id"] == n["parent_id"]) & (k["child_idx"] > n["child_idx"]),
        }.get(combinator, lambda: (k["node_id"] > n["node_id"]) & (k["node_id"] <= n["dfs_out"]))()
        test = related & compound(dom, k, c)
        return test & _having(dom, k, inner, at + 1) if at + 1 < len(inner.parts) else test

    return F.exists(dom, ok)


def ends(dom: Column, n: Column, c: Chain, at: int | None = None) -> Column:
    """Whether n ends the chain."""
    at = len(c.parts) - 1 if at is None else at
    combinator, part = c.parts[at]
    test = compound(dom, n, part)
    if at == 0:
        return test & (n["prev_el"] >= 0) if combinator in ("+", "~") else test
    if combinator == ">":
        up = _at(dom, n["parent_id"])
        return test & (n["parent_id"] > 0) & F.coalesce(ends(dom, up, c, at - 1), F.lit(False))
    if combinator == "+":
        return test & (n["prev_el"] >= 0) & F.coalesce(ends(dom, _at(dom, F.greatest(n["prev_el"], F.lit(0))), c, at - 1), F.lit(False))
    if combinator == "~":
        return test & F.exists(dom, lambda k: (k["parent_id"] == n["parent_id"]) & (k["child_idx"] > 0) & (k["child_idx"] < n["child_idx"]) & ends(dom, k, c, at - 1))
    return test & F.exists(n["ancestors"], lambda a: ends(dom, _at(dom, a), c, at - 1))


def select(dom: Column, selector: str) -> Column:
    """The matching node structs of a dom column, in document order."""
    chains = parse(selector)
    return F.filter(dom, lambda n: any_of([ends(dom, n, c) for c in chains]))


def text(dom: Column, n: Column) -> Column:
    """All text below a node."""
    below = F.filter(F.slice(dom, n["node_id"] + 2, n["dfs_out"] - n["node_id"]), lambda k: k["node_type"] == TEXT)
    return F.array_join(F.transform(below, lambda k: k["data"]), "")
