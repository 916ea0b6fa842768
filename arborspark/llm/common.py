"""Plumbing that the operators share: checkpoints, chunks, Arrow batches and a vectorised word scanner."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a worker handles at a time; bounds the arrays built from them.
SLICE_BYTES = 1 << 19


#: Rows of a table that may be keyed by hot keys: every key holds more than one row in HOT, so there are fewer than HOT of them.
HOT = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where none is named, a local session gets a temporary one; on a cluster that would not be shared, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="arborspark-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint.

    The frame that checkpoint() returns also keeps the size that was estimated for df. Estimates of joins are products, so
    after some rounds of joins and checkpoints they are numbers of millions of digits, which fill the driver; so the
    checkpoint is wrapped as a source of unknown size, and adaptive execution goes by the sizes that it measures.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    file = kept.queryExecution().analyzed().rdd().getCheckpointFile()
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)
    out._checkpoint_file = file.get() if file.isDefined() else None
    return out


def release(*frames: DataFrame | None) -> None:
    """Deletes the checkpoints of frames from cut() that nothing will read again, rather than when the driver collects garbage."""
    for df in frames:
        if file := getattr(df, "_checkpoint_file", None):
            remove(df.sparkSession, file)
            df._checkpoint_file = None


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in whatever file system it is in."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """A table read in less than half as many tasks as there are cores (one small file, say) dealt out over them.

    Only plain reads of files are looked at: other plans have the partitions of their own shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if df.isStreaming or "FileScan" not in plan or any(x in plan for x in ("Exchange", "Join", "Aggregate", "Sort", "Window")):
        return df
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def join_hot(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """many joined to one (whose keys are distinct), inner or left, so that no key, however frequent, comes into one task.

    Keys of more than one row in HOT are fewer than HOT, whatever the size of the tables: their rows of one are sent to
    where many lies; the rest is joined by a shuffle. many is read three times: give it written.
    """
    n = many.count()
    hot = cut(many.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") * HOT > n).select(key))
    few = cut(one.join(F.broadcast(hot), key, "left_semi"))
    frequent = many.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how)
    return frequent.unionByName(many.join(F.broadcast(hot), key, "left_anti").join(one, key, how))


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's defaults, by rows and by bytes, where the session has not chosen others.

    Texts are long, and a batch is held several times over (in the JVM, on its way, and in the worker). Workers get one
    numeric thread each, unless the session says otherwise: tasks fill the cores, and more threads would only wait for them.
    """
    spark.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    for key, default, ours in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", str(1 << 28), str(4 << 20))):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default).lower().removesuffix("b") in (default, "256m", "-1"):
            spark.conf.set(key, ours)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each value; null gives no bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items whose sizes sum to about the limit; a larger item stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


# --- words ------------------------------------------------------------------------------------------------------------


def _mixed_table(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = [_mixed_table(11, 256), _mixed_table(12, 256)]
_BASE = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]
_POWERS: dict[int, np.ndarray] = {}

#: Bytes that separate words, by kind of word.
SPACE_SEPARATED = np.ones(256, bool)
SPACE_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(which: int, n: int) -> np.ndarray:
    have = _POWERS.get(which)
    if have is None or len(have) < n:
        size = max(256, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE[which], np.uint64)]))
        _POWERS[which] = have
    return have[:n]


class Words:
    """Words of several texts in one run of arrays: byte spans in buf, document of each, first word of each document, hashes."""

    def __init__(self, texts: list[bytes], kind: np.ndarray, hashes: int = 1):
        joined = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        at = np.concatenate([[0], np.cumsum(sizes)])
        starts, ends, found = [], [], [[] for _ in range(hashes)]
        pos, n = 0, len(self.buf)
        while pos < n:
            end = min(pos + SLICE_BYTES, n)
            while end < n and kind[self.buf[end - 1]]:
                free = np.flatnonzero(~kind[self.buf[end : end + 4096]])
                end = min(n, end + (int(free[0]) + 1 if len(free) else 4096))
            part = self.buf[pos:end]
            inside = kind[part]
            edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
            s, e = edge[0::2], edge[1::2]
            starts.append(s + pos)
            ends.append(e + pos)
            if len(s) and hashes:
                chars = part[inside]
                lens = e - s
                first = np.cumsum(lens) - lens
                place = np.arange(len(chars)) - np.repeat(first, lens)
                for k in range(hashes):
                    h = np.add.reduceat(_BYTE[k][chars] * _powers(k, int(lens.max()))[place], first)
                    found[k].append(mix(h + lens.astype(np.uint64)))
            pos = end
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.hash = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found]
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)


def window_hash(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of each run of width words; there are len(words) - width + 1 of them."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done = np.zeros(n, np.uint64), 0
    level, have, base = words, 1, _BASE[1 - which]
    while True:  # hashes of 1, 2, 4 ... words, put together by the binary digits of width
        if width & have:
            out = out * base + level[done : done + n]
            done += have
        if done == width:
            return mix(out)
        level = level[:-have] * base + level[have:]
        base, have = np.uint64(int(base) ** 2 % (1 << 64)), have * 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[:-rest], out[rest:])
    return out


# --- chunks of documents in one row -----------------------------------------------------------------------------------


def ipc(t: pa.Table, level: int = 1) -> bytes:
    """A table as an Arrow stream compressed at that level."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def packed(docs: DataFrame, chunk_bytes: int, encode: Callable[[pa.Table], bytes] = ipc) -> DataFrame:
    """(chunk, blob): the rows of docs in their order, about chunk_bytes to a row, compressed, in a written table; nothing is shuffled.

    A chunk is numbered by the task that made it and its place there, so chunks of equal rows are chunks of their own. What
    is stored of its rows is up to encode.
    """

    def run(batches):
        held, size, made = [], 0, TaskContext.get().partitionId() << 32

        def blob():
            nonlocal made
            made += 1
            raw = encode(pa.Table.from_batches(held))
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([raw], pa.binary())], ["chunk", "blob"])

        for b in batches:
            at = 0
            rows = max(1, int(b.num_rows * chunk_bytes / max(1, 4 * b.nbytes)))
            while at < b.num_rows:
                part = b.slice(at, rows)
                at += rows
                held.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], part.schema.names))
                size += held[-1].nbytes
                if size >= chunk_bytes:
                    yield blob()
                    held, size = [], 0
        if size:
            yield blob()

    return cut(spread(docs).mapInArrow(run, "chunk long, blob binary"))


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of Arrow batches, each as a table."""
    for b in batches:
        for i in range(b.num_rows):
            yield pa.Table.from_batches([b.slice(i, 1)])


def unpacked(t: pa.Table) -> pa.Table:
    """The rows of a chunk."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in t.column("blob").to_pylist()])
