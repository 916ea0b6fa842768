"""Plans by template: pages of one structural fingerprint are read by one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import Schema
from .extract import extract
from .structured import fingerprints


class TemplateRegistry:
    """Schemas by fingerprint; all of them have the same columns."""

    def __init__(self):
        self.plans: dict[int, Schema] = {}

    def register(self, fingerprint: int, schema: Schema) -> None:
        if self.plans and next(iter(self.plans.values())).spark_type() != schema.spark_type():
            raise ValueError("schemas of one registry need the same columns")
        self.plans[fingerprint] = schema

    def extract(self, pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
        """keep, fingerprint and the schema's columns of the pages whose template is known."""
        if not self.plans:
            raise ValueError("no plan is registered")
        named = fingerprints(pages.select(*keep, html_col), html_col=html_col, keep=(*keep, html_col))
        parts = [extract(named.where(F.col("fingerprint") == k), s, html_col, (*keep, "fingerprint")) for k, s in self.plans.items()]
        return reduce(DataFrame.unionByName, parts)
