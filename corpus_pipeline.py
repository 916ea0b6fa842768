"""A training corpus from raw documents: five stages, each of them one operator over all that the stage before kept.

1. language: documents that language identification rejects go.
2. near_duplicates: one document of each group of near-copies (five-word shingles, Jaccard 0.8) stays.
3. decontamination: every passage that a benchmark window covers is cut out of the texts.
4. secrets: what the forest takes for a secret is replaced by a mask.
5. packing: the texts become token pieces placed in sequences of 2048.

All but the last return the columns of documents; n_chars follows a text that changes. Other columns, whatever their names,
pass through. A null text, an empty one and one without a letter are rejected by the first stage, so later stages see none in
a whole run; each takes them nevertheless, as its operator's docstring states. Rows with a null doc_id are documents of their
own. Of rows that share a doc_id one passes the second stage (the first by text), so ties and repeated rows end there. An
empty table gives no rows in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm import decontaminate, jaccard, langid, packing, secrets
from arborspark.llm.common import remove, shared_dir
from arborspark.llm.queries import table, tokenizer_path


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.when(docs["n_chars"].isNotNull() & docs["text"].isNotNull(), size).otherwise(docs["n_chars"]))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = langid.identify(docs, langid.fit(docs)).where(~F.col("rejected"))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secrets.redact(docs, secrets.train(secrets.labelled_findings(), secrets.learn_dictionary(docs))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: No SQL expresses a trained classifier, a forest or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again by the next, then removed (also on failure).

    The folder of the last stage stays, as the result reads it.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"
        try:
            stage(spark, docs, sf_dir).write.parquet(path)
        except BaseException:
            remove(spark, path)
            raise
        finally:
            if last:
                remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
