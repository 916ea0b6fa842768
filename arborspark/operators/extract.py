"""Declarative extraction: a schema over every page, as one pass that parses and reads (arrow) or as expressions (catalyst).

The arrow engine parses a page and evaluates the whole schema in one call; the catalyst engine parses to the dom array once
and leaves selection, coercion and nesting to Spark expressions. Both give the same rows for what the second can express.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import coerce
from ..functions.html import Dom, clean
from ..plans import css
from ..plans.schema import Field, Group, Schema, SchemaError
from . import arrays
from .nodes import map_rows, parse


class ExtractionError(ValueError):
    """A required value is missing."""


def _convert(f: Field, raw: str, base: str | None) -> Any:
    if f.clean:
        raw = clean(raw)
    match f.type:
        case "integer":
            return coerce.integer(raw)
        case "float":
            return coerce.floating(raw)
        case "money":
            return coerce.money(raw)
        case "boolean":
            return coerce.boolean(raw)
        case "date":
            return coerce.date(raw)
        case "url":
            return coerce.absolute(raw, base) if f.normalize_url else raw
        case "json":
            v = coerce.parsed_json(raw)
            return None if v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        case "list":
            return coerce.listing(raw, f.delimiter, f.literal_delimiter)
    return raw


def _raw(dom: Dom, f: Field, i: int) -> str | None:
    if f.attr:
        return dom.attr(i, f.attr.lower())
    return dom.inner_html(i) if f.type == "html" else dom.text(i)


def value(dom: Dom, f: Field, scope: int, base: str | None) -> Any:
    """Select, read, clean, coerce, default, required, transform. The first selector with a raw value decides."""
    if f.multi:
        got: list = []
        for s in f.select or (None,):
            nodes = [scope] if s is None else css.select(dom, s, scope)
            got = [v for i in nodes if (r := _raw(dom, f, i)) is not None and (v := _convert(f, r, base)) is not None]
            if got:
                break
        v: Any = got
        missing = not got
    else:
        v = None
        for s in f.select or (None,):
            nodes = [scope] if s is None else css.select(dom, s, scope, limit=1)
            if nodes and (r := _raw(dom, f, nodes[0])) is not None:
                v = _convert(f, r, base)
                break
        missing = v is None
    if missing and f.default is not None:
        v, missing = f.default, False
    if missing and f.required:
        raise ExtractionError(f"no value for {f.name!r}")
    return f.transform(v) if f.transform and v is not None else v


def record(dom: Dom, items: tuple[Field | Group, ...], scope: int = 0, base: str | None = None) -> dict[str, Any]:
    return {i.name: [record(dom, i.items, n, base) for n in css.select(dom, i.select, scope)] if isinstance(i, Group) else value(dom, i, scope, base) for i in items}


def extract(pages: DataFrame, schema: Schema, html_col: str = "html", keep: tuple[str, ...] = ("page_id",), base_col: str | None = None, engine: str = "arrow", on_missing: str = "fail") -> DataFrame:
    """keep and the schema's columns for every page.

    on_missing says what a missing required value does: fail (the query), drop (the page), or null (a column _error names it).
    """
    if engine == "catalyst":
        return _catalyst(pages, schema, html_col, keep, base_col)
    out = schema.spark_type()
    if on_missing == "null":
        out = StructType([*out.fields, StructField("_error", StringType())])
    names = [i.name for i in schema.items]

    def compute(dom: Dom, row: dict):
        base = row.get(base_col) if base_col else None
        try:
            got = record(dom, schema.items, 0, base)
        except ExtractionError as e:
            if on_missing == "fail":
                raise
            if on_missing == "null":
                yield (*([] if isinstance(i, Group) or i.multi else None for i in schema.items), str(e))
            return
        yield (*(got[n] for n in names), *([None] if on_missing == "null" else []))

    return map_rows(pages, html_col, compute, out, keep, (base_col,) if base_col else ())


def extract_css(pages: DataFrame, selectors: dict[str, str], html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """All values of each selector, as arrays: many selectors, one parse."""
    return map_rows(pages, html_col, lambda dom, row: [tuple(css.values(dom, s) for s in selectors.values())], ", ".join(f"`{k}` array<string>" for k in selectors), keep)


def extract_map(pages: DataFrame, selectors: dict[str, str], html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The first value of each selector."""

    def compute(dom: Dom, row: dict):
        yield tuple(next(iter(css.values(dom, s)), None) for s in selectors.values())

    return map_rows(pages, html_col, compute, ", ".join(f"`{k}` string" for k in selectors), keep)


def extract_each(pages: DataFrame, outer: str, selectors: dict[str, str], html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row for each node that outer matches: ord, and the first value of each selector inside it (a bare pseudo-element reads the node itself)."""

    def compute(dom: Dom, row: dict):
        for k, i in enumerate(css.select(dom, outer)):
            yield (k, *(next(iter(css.values(dom, s, i)), None) for s in selectors.values()))

    return map_rows(pages, html_col, compute, "ord int, " + ", ".join(f"`{k}` string" for k in selectors), keep)


def matching(pages: DataFrame, selector: str, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row for each matching node: ord, node_id, tag, text, css_path, xpath_path."""

    def compute(dom: Dom, row: dict):
        for k, i in enumerate(css.select(dom, selector)):
            yield k, i, dom.tag[i], dom.text(i), dom.css_path(i), dom.xpath_path(i)

    return map_rows(pages, html_col, compute, "ord int, node_id int, tag string, text string, css_path string, xpath_path string", keep)


def xpath(pages: DataFrame, expression: str, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row for each item of the expression's result: ord and its string value."""
    from ..plans import xpath as xp

    xp.parse(expression)
    return map_rows(pages, html_col, lambda dom, row: list(enumerate(xp.strings(dom, expression))), "ord int, value string", keep)


# --- catalyst -------------------------------------------------------------------------------------------------------------


def _column(f: Field, raw: Column) -> Column:
    if f.clean:
        raw = coerce.clean_col(raw)
    simple = {"integer": coerce.integer_col, "float": coerce.float_col, "money": coerce.money_col, "boolean": coerce.boolean_col, "date": coerce.date_col}
    if f.type in simple:
        return simple[f.type](raw)
    if f.type == "list" and not f.literal_delimiter:
        return coerce.list_col(raw, f.delimiter)
    if f.type in ("text", "url") and not f.normalize_url:
        return raw
    raise SchemaError(f"the catalyst engine has no type {f.type!r} with these options")


def _scoped(dom: Column, scope: Column | None, selector: str) -> Column:
    found = arrays.select(dom, selector)
    return found if scope is None else F.filter(found, lambda n: (n["node_id"] >= scope["node_id"]) & (n["node_id"] <= scope["dfs_out"]))


def _expression(item: Field | Group, dom: Column, scope: Column | None) -> Column:
    if isinstance(item, Group):
        return F.transform(_scoped(dom, scope, item.select), lambda n: F.struct(*[_expression(i, dom, n).alias(i.name) for i in item.items]))
    if item.transform is not None or item.required:
        raise SchemaError("the catalyst engine takes no transform and no required values")
    read = lambda n: F.element_at(n["attrs"], F.lit(item.attr.lower())) if item.attr else arrays.text(dom, n)
    sets = [F.array(scope if scope is not None else F.get(dom, F.lit(0))) if s is None else _scoped(dom, scope, s) for s in item.select or (None,)]
    if item.multi:
        got = [F.filter(F.transform(F.filter(F.transform(s, read), lambda r: r.isNotNull()), lambda r: _column(item, r)), lambda v: v.isNotNull()) for s in sets]
        out = got[-1]
        for g in reversed(got[:-1]):
            out = F.when(F.size(g) > 0, g).otherwise(out)
        return out if item.default is None else F.when(F.size(out) > 0, out).otherwise(F.lit(item.default))
    out = _column(item, F.coalesce(*[read(F.get(s, F.lit(0))) for s in sets]))
    return out if item.default is None else F.coalesce(out, F.lit(item.default))


def _catalyst(pages: DataFrame, schema: Schema, html_col: str, keep: tuple[str, ...], base_col: str | None) -> DataFrame:
    parsed = parse(pages, html_col, keep)
    return parsed.select(*keep, *[_expression(i, F.col("dom"), None).cast(i.spark_type()).alias(i.name) for i in schema.items])
