"""Changed documents: edits are values, applied to every page in one pass that gives the new markup."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.html import COMMENT, ELEMENT, RAW, TEXT, VOID, Dom, escape
from ..plans import css
from .nodes import map_rows

KINDS = "set_attribute remove_attribute add_class remove_class content inner_html remove append prepend before after replace swap wrap rename".split()


@dataclass(frozen=True)
class Edit:
    """kind, the nodes it is for, and its arguments (a name and value, or markup)."""

    kind: str
    select: str
    name: str = ""
    value: str = ""

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"no edit {self.kind!r}")


def apply(html: str, edits: list[Edit]) -> str:
    """The markup after the edits, each judged on what the one before left."""
    for e in edits:
        dom = Dom(html)
        chosen = set(css.select(dom, e.select))
        html = _write(dom, 0, lambda i, e=e, chosen=chosen: e if i in chosen else None)
    return html


def _attrs(dom: Dom, i: int, e: Edit | None) -> dict[str, str]:
    attrs = dict(dom.attrs[i])
    if e is None:
        return attrs
    if e.kind == "set_attribute":
        attrs[e.name.lower()] = e.value
    elif e.kind == "remove_attribute":
        attrs.pop(e.name.lower(), None)
    elif e.kind in ("add_class", "remove_class"):
        have = attrs.get("class", "").split()
        if e.kind == "add_class":
            have += [c for c in e.value.split() if c not in have]
        else:
            have = [c for c in have if e.value and c not in e.value.split()]
        attrs["class"] = " ".join(have)
        if not have:
            del attrs["class"]
    return attrs


def _write(dom: Dom, i: int, edit: Callable[[int], Edit | None]) -> str:
    kind = dom.kind[i]
    if kind == TEXT:
        return dom.data[i] if dom.tag[dom.parent[i]] in RAW else escape(dom.data[i])
    if kind == COMMENT:
        return f"<!--{dom.data[i]}-->"
    inner = lambda: "".join(_write(dom, k, edit) for k in dom.children[i])
    if kind != ELEMENT:
        return (f"<!DOCTYPE {dom.doctype}>" if dom.doctype else "") + inner()
    e = edit(i)
    what = e.kind if e else ""
    if what == "remove":
        return ""
    if what in ("replace", "swap"):
        return e.value
    tag = e.name.lower() if what == "rename" else dom.tag[i]
    body = escape(e.value) if what == "content" else e.value if what == "inner_html" else inner()
    body = body + e.value if what == "append" else e.value + body if what == "prepend" else body
    start = tag + "".join(f' {k}="{escape(v, quote=True)}"' for k, v in _attrs(dom, i, e).items())
    out = f"<{start}>" if tag in VOID else f"<{start}>{body}</{tag}>"
    if what == "before":
        return e.value + out
    if what == "after":
        return out + e.value
    if what == "wrap":
        w = Dom(e.value)
        first = next((k for k in w.elements), None)
        return out if first is None else _around(w, first, out)
    return out


def _around(w: Dom, i: int, body: str) -> str:
    start = w.tag[i] + "".join(f' {k}="{escape(v, quote=True)}"' for k, v in w.attrs[i].items())
    return f"<{start}>{w.inner_html(i)}{body}</{w.tag[i]}>"


def mutate(pages: DataFrame, edits: list[Edit], html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep and html after the edits."""
    needs = (html_col,) if html_col not in keep else ()
    return map_rows(pages, html_col, lambda dom, row: [(apply(row[html_col], edits) if row[html_col] is not None else None,)], "new_html string", keep, needs).withColumnRenamed("new_html", html_col)


def serialize(pages: DataFrame, selector: str | None = None, inner: bool = False, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """ord and markup of every matching node (of the document where no selector is given)."""

    def compute(dom: Dom, row: dict):
        for k, i in enumerate(css.select(dom, selector) if selector else [0]):
            yield k, dom.inner_html(i) if inner else dom.html(i)

    return map_rows(pages, html_col, compute, "ord int, markup string", keep)
