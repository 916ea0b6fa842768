"""Compound selectors as Spark predicates, whatever holds the node: columns of a relation or a struct in an array."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.html import ELEMENT
from ..plans.css import STATES, Attr, Compound, Pseudo, SelectorError

Get = Callable[[str], Column]


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def attribute(get: Get, t: Attr) -> Column:
    v = F.element_at(get("attrs"), F.lit(t.name))
    have = v.isNotNull()
    if not t.op:
        return have
    want = t.value
    if t.fold:
        v, want = F.lower(v), want.lower()
    lit = F.lit(want)
    test = {
        "=": lambda: v == lit,
        "*=": lambda: F.contains(v, lit),
        "^=": lambda: F.startswith(v, lit),
        "$=": lambda: F.endswith(v, lit),
        "~=": lambda: F.array_contains(F.split(v, r"\s+"), want) & (lit != ""),
        "|=": lambda: (v == lit) | F.startswith(v, F.lit(want + "-")),
    }[t.op]()
    return have & F.coalesce(test, F.lit(False))


def nth(k: Column, ab: tuple[int, int]) -> Column:
    a, b = ab
    if a == 0:
        return k == b
    return ((k - b) % a == 0) & ((k - b) / a >= 0)


def state(get: Get, name: str) -> Column:
    v = F.element_at(get("attrs"), F.lit(name))
    return v.isNotNull() & (F.lower(v) != "false")


def positional(get: Get, p: Pseudo) -> Column | None:
    """Pseudo-classes that a node's own columns decide; None for the others."""
    one = F.lit(1)
    simple = {
        "first-child": lambda: get("child_idx") == one,
        "last-child": lambda: get("child_idx_rev") == one,
        "only-child": lambda: (get("child_idx") == one) & (get("child_idx_rev") == one),
        "first-of-type": lambda: get("type_idx") == one,
        "last-of-type": lambda: get("type_idx_rev") == one,
        "only-of-type": lambda: (get("type_idx") == one) & (get("type_idx_rev") == one),
        "nth-child": lambda: nth(get("child_idx"), p.arg),
        "nth-last-child": lambda: nth(get("child_idx_rev"), p.arg),
        "nth-of-type": lambda: nth(get("type_idx"), p.arg),
        "nth-last-of-type": lambda: nth(get("type_idx_rev"), p.arg),
        "root": lambda: get("parent_id") == 0,
        "scope": lambda: F.lit(True),
        "enabled": lambda: ~state(get, "disabled"),
        "optional": lambda: ~state(get, "required"),
        "read-only": lambda: state(get, "readonly"),
        "read-write": lambda: ~state(get, "readonly"),
        "any-link": lambda: get("tag").isin("a", "area") & F.element_at(get("attrs"), F.lit("href")).isNotNull(),
    }
    simple["link"] = simple["any-link"]
    for name, attr in STATES.items():
        simple[name] = lambda attr=attr: state(get, attr)
    if p.name in simple:
        return F.coalesce(simple[p.name](), F.lit(False))
    if p.name in ("not", "is", "has", "empty"):
        return None
    return F.lit(False)


def own(get: Get, c: Compound) -> Column:
    """The part of a compound that needs nothing but the node: cheap tests first."""
    parts = [get("node_type") == ELEMENT]
    if c.tag != "*":
        parts.append(get("tag") == c.tag)
    parts += [F.coalesce(get("el_id") == x, F.lit(False)) for x in c.ids]
    parts += [F.array_contains(get("classes"), x) for x in c.classes]
    parts += [attribute(get, t) for t in c.attrs]
    parts += [x for p in c.pseudos if (x := positional(get, p)) is not None]
    return all_of(parts)


def relations(c: Compound) -> list[Pseudo]:
    """The pseudo-classes that look at other nodes."""
    out = [p for p in c.pseudos if p.name in ("not", "is", "has", "empty")]
    if any(p.name == "scope-self" for p in c.pseudos):
        raise SelectorError("a pseudo-element without a selector needs a scope node")
    return out
