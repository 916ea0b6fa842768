"""All pairs within groups of any size, in blocks: a group is dealt to as many tasks as it has pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def deal(rows: DataFrame, key: str, count: str, spread: str, block: int) -> DataFrame:
    """rows with _i and _j: the pair of blocks that each copy is for, and _b, its own block; count is the size of its group."""
    n = F.ceil(F.col(count) / block).cast("int")
    own = rows.withColumn("_n", n).withColumn("_b", F.pmod(F.xxhash64(spread, F.lit(7)), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    return own.withColumn("_o", other).withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_o", "_n")


def deal_apart(rows: DataFrame, key: str, group: str, spread: str, block: int) -> DataFrame:
    """deal() for keys whose rows are in known groups: only pairs of different groups are wanted.

    A group of more than block rows of a key gets blocks of its own, which are not paired with each other, so a large group
    among few others makes copies in proportion to its size; all smaller groups share the key's first blocks.
    """
    sizes = cut(rows.groupBy(key, group).agg(F.count("*").alias("_c")))
    big = F.col("_c") > block
    mixed = sizes.groupBy(key).agg(F.ceil(F.sum(F.when(big, 0).otherwise(F.col("_c"))) / block).cast("int").alias("_mixed"), F.sum(F.when(big, F.ceil(F.col("_c") / block)).otherwise(0)).cast("int").alias("_bigs"))
    before = Window.partitionBy(key).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    large = sizes.where(big).withColumn("_nb", F.ceil(F.col("_c") / block).cast("int"))
    large = large.withColumn("_off", F.coalesce(F.sum("_nb").over(before), F.lit(0)).cast("int")).select(key, group, "_nb", "_off")
    out = rows.join(cut(mixed), key).join(cut(large), [key, group], "left")
    h = F.xxhash64(spread, F.lit(7))
    out = out.withColumn("_b", F.when(F.col("_nb").isNull(), F.pmod(h, F.greatest("_mixed", F.lit(1)))).otherwise(F.col("_mixed") + F.col("_off") + F.pmod(h, F.greatest("_nb", F.lit(1)))).cast("int"))
    others = F.when(F.col("_mixed") + F.col("_bigs") > 0, F.sequence(F.lit(0), F.col("_mixed") + F.col("_bigs") - 1))
    first = F.col("_mixed") + F.col("_off")
    others = F.filter(others, lambda o: F.col("_nb").isNull() | (o < first) | (o >= first + F.col("_nb")))
    out = out.withColumn("_o", F.explode(others)).withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o"))
    return out.drop("_o", "_mixed", "_bigs", "_nb", "_off")


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by keys, each as a table; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(b.schema.get_field_index(k))) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        edge = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            if s:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def forest(linked: np.ndarray) -> np.ndarray:
    """For each member, the smallest index it is connected to under a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def grouped(dealt: DataFrame, keys: list[str], order: str, compute: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """compute() on every group of equal keys, in the order of a column, streamed through sorted partitions."""

    def run(batches):
        for t in by_group(batches, keys):
            got = compute(t)
            if got is not None and got.num_rows:
                yield got

    return dealt.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)
