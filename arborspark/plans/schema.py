"""Extraction schemas: what to take from each page, known before any page is read, with a JSON form."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, LongType, StringType, StructField, StructType

TYPES: dict[str, DataType] = {
    "text": StringType(), "html": StringType(), "url": StringType(), "json": StringType(), "integer": LongType(), "float": DoubleType(),
    "money": DoubleType(), "boolean": BooleanType(), "date": DateType(), "list": ArrayType(StringType()),
}


class SchemaError(ValueError):
    """A schema that cannot be built or stored."""


@dataclass(frozen=True)
class Field:
    """One value: selectors in order of preference (none: the scope itself), where to read it, its type and what to do without it."""

    name: str
    select: tuple[str, ...] = ()
    attr: str | None = None
    type: str = "text"
    clean: bool = False
    multi: bool = False
    normalize_url: bool = False
    default: Any = None
    required: bool = False
    transform: Callable[[Any], Any] | None = None
    delimiter: str = r"\s*,\s*"
    literal_delimiter: bool = False

    def spark_type(self) -> DataType:
        kind = TYPES[self.type]
        return ArrayType(kind) if self.multi else kind


@dataclass(frozen=True)
class Group:
    """Repeated records: every node that matches is one, with fields and groups of its own."""

    select: str
    name: str
    items: tuple[Field | Group, ...] = ()

    def spark_type(self) -> DataType:
        return ArrayType(struct(self.items))


def struct(items: tuple[Field | Group, ...]) -> StructType:
    return StructType([StructField(i.name, i.spark_type()) for i in items])


@dataclass(frozen=True)
class Schema:
    items: tuple[Field | Group, ...] = field(default=())

    def field(self, name: str, select: str | list[str] | None = None, **options) -> Schema:
        return Schema((*self.items, make_field(name, select, **options)))

    def repeated(self, select: str, name: str, inner: Schema) -> Schema:
        return Schema((*self.items, Group(select, name, inner.items)))

    def spark_type(self) -> StructType:
        return struct(self.items)

    def to_json(self) -> str:
        return json.dumps([_plain(i) for i in self.items])

    @staticmethod
    def from_json(text: str) -> Schema:
        return Schema(tuple(_made(x) for x in json.loads(text)))


def make_field(name: str, select: str | list[str] | None = None, **options) -> Field:
    selectors = () if select is None else (select,) if isinstance(select, str) else tuple(select)
    f = Field(name, selectors, **options)
    if f.type == "array":
        f = replace(f, type="text", multi=True)
    if f.type not in TYPES:
        raise SchemaError(f"no type {f.type!r}")
    return f


def _plain(item: Field | Group) -> dict:
    if isinstance(item, Group):
        return {"group": item.name, "select": item.select, "items": [_plain(i) for i in item.items]}
    if item.transform is not None:
        raise SchemaError(f"the transform of {item.name!r} cannot be stored")
    return {k: list(v) if isinstance(v, tuple) else v for k, v in item.__dict__.items() if k != "transform"}


def _made(x: dict) -> Field | Group:
    if "group" in x:
        return Group(x["select"], x["group"], tuple(_made(i) for i in x["items"]))
    return Field(**{**x, "select": tuple(x["select"])})
