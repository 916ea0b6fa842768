"""Markup from Python values and from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import escape_col
from .html import VOID, escape


class Raw(str):
    """Markup that is not escaped."""


def comment(text: str) -> Raw:
    return Raw(f"<!--{text}-->")


def doctype(name: str = "html") -> Raw:
    return Raw(f"<!DOCTYPE {name}>")


def tag(name: str, *children, **attrs) -> Raw:
    """An element; attributes that are True stand alone, those that are None or False are left out; class_ and data_x lose or change their marks."""
    out = []
    for k, v in attrs.items():
        if v is None or v is False:
            continue
        k = k.rstrip("_").replace("_", "-")
        out.append(f" {k}" if v is True else f' {k}="{escape(str(v), quote=True, apostrophe=True)}"')
    start = f"<{name}{''.join(out)}>"
    return Raw(start if name in VOID else start + fragment(*children) + f"</{name}>")


def fragment(*children) -> Raw:
    out = []
    for c in children:
        if isinstance(c, (list, tuple)):
            out.append(fragment(*c))
        elif c is not None:
            out.append(c if isinstance(c, Raw) else escape(str(c)))
    return Raw("".join(out))


def tag_col(name: str, *children: Column, **attrs: Column) -> Column:
    """An element from columns of markup (text goes through escape_col first) and of attribute values; a null attribute is left out."""
    start = [F.lit(f"<{name}")]
    for k, v in attrs.items():
        key = k.rstrip("_").replace("_", "-")
        start.append(F.when(v.isNull(), "").otherwise(F.concat(F.lit(f' {key}="'), escape_col(v.cast("string"), True, True), F.lit('"'))))
    body = [] if name in VOID else [*(F.coalesce(c, F.lit("")) for c in children), F.lit(f"</{name}>")]
    return F.concat(*start, F.lit(">"), *body)
