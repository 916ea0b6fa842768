"""Pages from files: one page a file, from text or raw bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import encoding


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """url (the file) and html of UTF-8 files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def decode_pages(raw: DataFrame, bytes_col: str = "content", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """keep, encoding and html of raw pages; bytes that cannot be read are dropped."""
    @F.pandas_udf("encoding string, html string")
    def read(b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"encoding": [None if x is None else encoding.detect(bytes(x)) for x in b], "html": [None if x is None else encoding.to_text(bytes(x)) for x in b]})

    return raw.select(*keep, read(bytes_col).alias("r")).select(*keep, "r.encoding", "r.html")


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """url, encoding and html of files in any encoding."""
    return decode_pages(spark.read.format("binaryFile").load(path).select(F.col("path").cast(StringType()).alias("url"), "content"))
