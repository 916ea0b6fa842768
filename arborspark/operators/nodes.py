"""Pages to nodes: the parsed document as an array column, and exploded as a relation.

Each page is parsed where it lies; nothing is shuffled. Node columns carry the pre-order number, the end of the subtree and
the positions among siblings, so that selectors are filters and interval joins on plain columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.html import ELEMENT, Dom, events

NODE = (
    "node_id int, parent_id int, dfs_out int, depth int, node_type tinyint, tag string, attrs map<string,string>, el_id string, classes array<string>, data string, "
    "child_idx int, child_idx_rev int, type_idx int, type_idx_rev int, prev_el int, next_el int, ancestors array<int>"
)
_ARROW = [
    ("node_id", pa.int32()), ("parent_id", pa.int32()), ("dfs_out", pa.int32()), ("depth", pa.int32()), ("node_type", pa.int8()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("el_id", pa.string()), ("classes", pa.list_(pa.string())), ("data", pa.string()),
    ("child_idx", pa.int32()), ("child_idx_rev", pa.int32()), ("type_idx", pa.int32()), ("type_idx_rev", pa.int32()), ("prev_el", pa.int32()), ("next_el", pa.int32()), ("ancestors", pa.list_(pa.int32())),
]


def _columns(doms: list[Dom]) -> list[pa.Array]:
    """Node columns of several documents, one after another."""
    cols: dict[str, list] = {name: [] for name, _ in _ARROW}
    for d in doms:
        n = len(d)
        idx, rev, tidx, trev, before, after = d.places
        up: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):  # root first
            p = d.parent[i]
            up[i] = [*up[p], p] if p > 0 else []
        cols["node_id"] += range(n)
        cols["parent_id"] += d.parent
        cols["dfs_out"] += d.out
        cols["depth"] += d.depth
        cols["node_type"] += d.kind
        cols["tag"] += d.tag
        cols["attrs"] += [list(a.items()) if a is not None else None for a in d.attrs]
        cols["el_id"] += [a.get("id") if a else None for a in d.attrs]
        cols["classes"] += [list(dict.fromkeys(a["class"].split())) if a and "class" in a else [] for a in d.attrs]
        cols["data"] += d.data
        cols["child_idx"] += idx
        cols["child_idx_rev"] += rev
        cols["type_idx"] += tidx
        cols["type_idx_rev"] += trev
        cols["prev_el"] += before
        cols["next_el"] += after
        cols["ancestors"] += up
    return [pa.array(cols[name], kind) for name, kind in _ARROW]


#: Bytes (as the optimizer estimates them) below which a table is one task's work.
SMALL = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table read in less than half as many tasks as there are cores (one file of one row group, say) dealt out over them.

    Only plain reads of files are looked at: other plans have the partitions of their own shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or cores < 2:
        return df
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if "FileScan" not in plan or any(x in plan for x in ("Exchange", "Join", "Aggregate", "Sort", "Window")):
        return df
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL:
        return df
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def map_rows(df: DataFrame, html_col: str, compute: Callable[[Dom, dict[str, Any]], Iterable[tuple]], schema: str | StructType, keep: tuple[str, ...], needs: tuple[str, ...] = ()) -> DataFrame:
    """Rows that compute(document, row) makes of every page, after the columns keep; a null page is an empty document.

    Only html_col, keep and needs are read and sent to the workers.
    """
    names = list(dict.fromkeys([*keep, *needs, html_col]))
    source = spread(df.select(*names))
    out = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    full = StructType([*(df.schema[k] for k in keep), *out.fields])
    arrow = to_arrow_schema(full)
    at = names.index(html_col)
    extra = [names.index(k) for k in needs]

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in out.fields]
            row = []
            side = {k: b.column(j).to_pylist() for k, j in zip(needs, extra, strict=True)}
            for i, html in enumerate(b.column(at).to_pylist()):
                for got in compute(Dom(html or ""), {k: v[i] for k, v in side.items()}):
                    row.append(i)
                    for c, v in zip(cols, got, strict=True):
                        c.append(v)
            take = pa.array(row, pa.int64())
            made = [pa.array(c, arrow.field(len(keep) + j).type) for j, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(k)).take(take) for k in keep), *made], schema=arrow)

    return source.mapInArrow(run, full)


def parse(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep and dom, an array of node structs for each page."""
    names = list(dict.fromkeys([*keep, html_col]))
    fields = StructType([*(df.schema[k] for k in keep), *_parse_datatype_string(f"dom array<struct<{_struct()}>>").fields])

    def run(batches):
        for b in batches:
            doms = [Dom(h or "") for h in b.column(names.index(html_col)).to_pylist()]
            offsets = [0]
            for d in doms:
                offsets.append(offsets[-1] + len(d))
            nodes = pa.StructArray.from_arrays(_columns(doms), names=[n for n, _ in _ARROW])
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(k)) for k in keep), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes)], [*keep, "dom"])

    return spread(df.select(*names)).mapInArrow(run, fields)


def _struct() -> str:
    return ", ".join(f.split(" ", 1)[0] + ":" + f.split(" ", 1)[1] for f in NODE.split(", "))


def nodes(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep and the node columns, a row for each node (the document itself, node 0, too)."""
    names = list(dict.fromkeys([*keep, html_col]))
    fields = StructType([*(df.schema[k] for k in keep), *_parse_datatype_string(NODE).fields])

    def run(batches):
        for b in batches:
            doms = [Dom(h or "") for h in b.column(names.index(html_col)).to_pylist()]
            row = pa.array([i for i, d in enumerate(doms) for _ in range(len(d))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(k)).take(row) for k in keep), *_columns(doms)], [*keep, *(n for n, _ in _ARROW)])

    return spread(df.select(*names)).mapInArrow(run, fields)


def elements(df: DataFrame, **options) -> DataFrame:
    return nodes(df, **options).where(F.col("node_type") == ELEMENT)


def tokens(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep and seq, kind, name, attrs, data: the stream parser's events."""
    names = list(dict.fromkeys([*keep, html_col]))
    fields = StructType([*(df.schema[k] for k in keep), *_parse_datatype_string("seq int, kind string, name string, attrs map<string,string>, data string").fields])

    def run(batches):
        for b in batches:
            rows = [(i, s, *e) for i, h in enumerate(b.column(names.index(html_col)).to_pylist()) for s, e in enumerate(events(h or ""))]
            take = pa.array([r[0] for r in rows], pa.int64())
            attrs = pa.array([None if r[4] is None else list(r[4].items()) for r in rows], pa.map_(pa.string(), pa.string()))
            text = [pa.array([r[k] for r in rows], pa.string()) for k in (2, 3, 5)]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(k)).take(take) for k in keep), pa.array([r[1] for r in rows], pa.int32()), text[0], text[1], attrs, text[2]], [*keep, "seq", "kind", "name", "attrs", "data"])

    return spread(df.select(*names)).mapInArrow(run, fields)
