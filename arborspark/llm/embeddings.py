"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Equal vectors are folded first. Each of ``TABLES`` tables hashes a vector by ``WIDTH`` pseudo-random rotations (three
rounds of sign flips and a Hadamard transform) to the nearest signed axes; besides that bucket a vector also enters those
in which one of the axes is its second nearest (multiprobe), and two vectors meet if any of their buckets agree. What
meets is verified by the cosine in double precision, in blocks; verified links make groups, and within each group all
pairs are verified again, so that every link is counted once. Folded vectors are numbered, so ids need not be distinct. At the default settings and 64 dimensions a pair at the
threshold meets in a table with probability 0.87, so it is missed with probability 1e-7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import deal, forest, grouped
from .common import bounded_batches, cut, join_hot, mix, release, spread
from .components import components, named
from .jaccard import _one_side

THRESHOLD, TABLES, WIDTH, BLOCK = 0.98, 8, 3, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def buckets(x: np.ndarray, tables: int = TABLES, width: int = WIDTH) -> np.ndarray:
    """Bucket numbers of each vector: one for each table and probe, table by table."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng, out = np.random.default_rng(23), []
    for t in range(tables):
        axes = []
        for _ in range(width):
            y = x
            for s in rng.choice([-1.0, 1.0], (3, d)):
                y = hadamard(y * s)
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            size = np.abs(np.take_along_axis(y, top, 1))
            top = np.where((size[:, 0] >= size[:, 1])[:, None], top, top[:, ::-1])
            axes.append((top * 2 + (np.take_along_axis(y, top, 1) > 0)).astype(np.uint64))
        for probe in range(width + 1):
            h = np.full(len(x), t + 1, np.uint64)
            for j in range(width):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + axes[j][:, 1 if probe == j + 1 else 0])
            out.append(h)
    return np.stack(out, axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column.to_pylist()])


def cosines(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares stay in range
    norm = np.sqrt((x * x).sum(1))
    return (x @ x.T) / (norm[:, None] * norm[None, :])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, width: int = WIDTH) -> DataFrame:
    """id, n_links, component_id, kept for each row.

    Rows are compared if their labels are equal and not null and their vectors have the same dimensions. Vectors that
    are null, empty, zero, or hold a null or a component that is not finite link with nothing, and so do rows with a null id
    (component null, not kept). n_links counts the other rows with cosine >= threshold; repeated rows count, and rows of one id
    with different vectors are rows of their own. A cosine of exactly the threshold links. Other columns are ignored; an empty table
    gives an empty one.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = F.col("v")
    source = spread(vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"), vectors[label_col].alias("label")))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    source = source.withColumn("ok", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False)))
    value = F.transform(v, lambda x: x + F.lit(0.0))  # one zero, whatever its sign
    good = source.where("ok").select("id", value.alias("v"), "label").select("id", "v", "label", F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(5), "v", "label").alias("h2"))
    folded = good.groupBy("h1", "h2").agg(F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.min("id").alias("least"), F.count("*").alias("n"))
    folded = cut(folded.withColumn("rep", F.monotonically_increasing_id()))

    def hashed(batches):
        for b in batches:
            ids, sizes = np.asarray(b.column(0)), np.asarray(b.column(3))
            salt = np.asarray(b.column(2)).view(np.uint64)
            rows = b.column(1).to_pylist()
            for d in np.unique(sizes):
                on = np.flatnonzero(sizes == d)
                x = np.stack([np.asarray(rows[i], np.float64) for i in on])
                h = buckets(x / np.abs(x).max(1, keepdims=True), tables, width)
                h = mix(h ^ salt[on][:, None] ^ np.uint64(d))
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(ids[on], h.shape[1]))], ["bucket", "id"])

    rows = cut(folded.select("rep", "v", F.xxhash64("label").alias("salt"), F.size("v").cast("long").alias("width")).mapInArrow(hashed, "bucket long, id long"))
    counts = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    full = rows.join(counts, "bucket")
    reps = folded.select(F.col("rep").alias("id"), "v", "label")

    def verify(t: pa.Table, weight: np.ndarray | None) -> pa.RecordBatch | None:
        ids, b = np.asarray(t.column("id")), np.asarray(t.column("_b"))
        if len(ids) < 2 or _one_side(t, b):
            return None
        sizes = [len(x) for x in t.column("v").to_pylist()]
        labels = t.column("label").to_pylist()
        linked = np.zeros((len(ids), len(ids)), bool)
        for kind in set(zip(sizes, labels, strict=True)):  # one, unless two kinds share a bucket's hash
            on = np.array([i for i, k in enumerate(zip(sizes, labels, strict=True)) if k == kind])
            linked[np.ix_(on, on)] = cosines(_matrix(t.column("v").take(pa.array(on)))) >= threshold
        np.fill_diagonal(linked, False)
        if (b != b[0]).any():
            linked &= b[:, None] != b[None, :]
        on = np.flatnonzero(linked.any(1))
        total = linked[on] @ weight if weight is not None else np.zeros(len(on), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[forest(linked)[on]]), pa.array(total.astype(np.int64))], ["a", "b", "weight"])

    dealt = deal(full, "bucket", "n", "id", BLOCK).join(reps, "id").select("bucket", "_i", "_j", "_b", "id", "v", "label")
    met = grouped(dealt, ["bucket", "_i", "_j"], "id", lambda t: verify(t, None), "a long, b long, weight long")
    group = cut(components(met))
    sizes = cut(group.groupBy("component").agg(F.count("*").alias("m")))
    weights = folded.select(F.col("rep").alias("id"), "v", "label", F.col("n").alias("w"))
    members = join_hot(group, sizes, "component").withColumnRenamed("node", "id").join(weights, "id")
    dealt = deal(members, "component", "m", "id", BLOCK).select("component", "_i", "_j", "_b", "id", "v", "label", "w")
    links = cut(grouped(dealt, ["component", "_i", "_j"], "id", lambda t: verify(t, np.asarray(t.column("w"))), "a long, b long, weight long"))
    linked = components(links.select("a", "b"))
    classes = linked.withColumnRenamed("component", "label")
    least = classes.join(folded.select(F.col("rep").alias("node"), "least"), "node").groupBy("label").agg(F.min("least").alias("name"))
    direct = links.groupBy("a").agg(F.sum("weight").alias("direct"))
    final = folded.select("h1", "h2", "rep", "least", "n").join(named(classes, least).withColumnRenamed("node", "rep"), "rep", "left").join(direct.withColumnRenamed("a", "rep"), "rep", "left")
    final = cut(final.select("h1", "h2", (F.col("n") - 1 + F.coalesce("direct", F.lit(0))).alias("n_links"), F.coalesce("name", "least").alias("component_id")))
    release(rows, counts, group, sizes, links, linked)
    both = F.struct("h1", "h2").alias("h")
    out = join_hot(cut(good.select("id", both)), final.select(both, "n_links", "component_id"), "h").select("id", "n_links", "component_id")
    out = out.unionByName(source.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).withColumnRenamed("id", id_col)
