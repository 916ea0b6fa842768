"""One page at hand, and many pages at once: the short names."""

from __future__ import annotations

from typing import IO

from pyspark.sql import DataFrame, SparkSession

from .functions import encoding
from .functions.html import Dom
from .operators.extract import record
from .operators.nodes import parse as parse_table
from .plans.schema import Schema


def parse(html: str | bytes) -> Dom:
    """A document from markup; bytes are decoded as a browser would."""
    return Dom(encoding.to_text(html) if isinstance(html, bytes) else html)


HTML = HTML5 = parse_html = parse_fragment = fragment = parse


def parse_io(stream: IO) -> Dom:
    return parse(stream.read())


def parse_file(path: str) -> Dom:
    with open(path, "rb") as f:
        return parse(f.read())


def parallel_parse(spark: SparkSession, pages: list[str], tasks: int | None = None) -> DataFrame:
    """page_id (the place in the list) and dom, parsed by the cluster."""
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return parse_table(df.repartition(tasks) if tasks else df)


def extract(html: str | bytes | Dom, schema: Schema, base_url: str | None = None) -> dict:
    """The values of one page; a missing required value raises."""
    return record(html if isinstance(html, Dom) else parse(html), schema.items, 0, base_url)


def extract_file(path: str, schema: Schema, base_url: str | None = None) -> dict:
    return extract(parse_file(path), schema, base_url)
