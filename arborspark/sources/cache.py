"""Parsed pages kept by content: a Parquet table keyed by the SHA-256 of the markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nodes import parse


def keyed(pages: DataFrame, html_col: str = "html") -> DataFrame:
    return pages.withColumn("sha", F.sha2(F.col(html_col), 256))


def parse_distinct(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep and dom, each distinct page parsed once: for tables with many copies."""
    k = keyed(pages, html_col)
    once = parse(k.select("sha", html_col).dropDuplicates(["sha"]), html_col, ("sha",))
    return k.select(*keep, "sha").join(once, "sha", "left").drop("sha")


class ParseCache:
    """store() adds what is missing, load() reads, clear() empties."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.parquet(self.path) if fs.exists(p) and len(fs.listStatus(p)) else None

    def missing(self, pages: DataFrame, html_col: str = "html") -> DataFrame:
        """The distinct pages that the cache does not hold."""
        k = keyed(pages, html_col).select("sha", html_col).dropDuplicates(["sha"])
        have = self._table()
        return k if have is None else k.join(have.select("sha"), "sha", "left_anti")

    def store(self, pages: DataFrame, html_col: str = "html") -> None:
        parse(self.missing(pages, html_col), html_col, ("sha",)).withColumn("prefix", F.substring("sha", 1, 2)).write.mode("append").partitionBy("prefix").parquet(self.path)

    warm = store

    def load(self, pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
        """keep and dom of the pages that are held."""
        have = self._table()
        if have is None:
            raise FileNotFoundError(self.path)
        k = keyed(pages, html_col).select(*keep, "sha").withColumn("prefix", F.substring("sha", 1, 2))
        return k.join(have, ["prefix", "sha"]).select(*keep, "dom")

    def clear(self) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def disk_usage(self) -> int:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0
