"""Removal of word passages that repeat anywhere in the corpus, with a count-min prefilter.

First pass: every task sketches its part of the corpus; the sketches are merged into one count-min sketch whose cells
saturate at two. What is counted for a window is its minimizer, the smallest hash among its runs of ``GRAM`` words: equal
windows have equal minimizers at different places, so the estimate is never below the window's count, and about a tenth
of the counters are needed. Second pass: only windows estimated to repeat are grouped exactly, by a 128-bit hash. Each
chunk of documents asks once for each distinct window, however often it holds it, and gets one bit back, so a passage
that every document holds makes as many rows as there are chunks. A sketch that is too small for its corpus lets more
windows through to the exact pass; it never loses one. Chunks are packed as the texts lie and written once, so texts are
not shuffled, and the shard of a window follows from its hash by arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_SEPARATED, Words, bounded_batches, mix, one_by_one, packed, slices, sliding_min, spread, text_bytes, unpacked, window_hash

WIDTH, GRAM, DEPTH, BLOCK_BITS, CHUNK_BYTES, SHARD_BYTES = 35, 18, 3, 16, 8 << 20, 32 << 20
#: Cells of a sketch row: about two for each minimizer, at most 2**28 (a bound of 32 MB a row for what executors get).
MIN_BITS, MAX_BITS, BYTES_PER_CELL = 16, 28, 30
_SALT = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


def minimizers(w: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows that lie in one document, their minimizers, and the distinct places of minimizers (hashes)."""
    n = len(w.start) - width + 1
    none = np.zeros(0, np.uint64)
    if n <= 0:
        return np.zeros(0, np.int64), none, none
    grams = window_hash(w.hash[0], gram) | np.uint64(1)
    least = sliding_min(grams, width - gram + 1)
    valid = w.doc[:n] == w.doc[width - 1 :]
    span = width - gram + 1
    pad = np.zeros(span - 1, np.uint64)
    top = ~sliding_min(~np.concatenate([pad, np.where(valid, least, np.uint64(0)), pad]), span)
    first = np.flatnonzero(valid)
    return first, least[first], grams[grams == top]


def cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(values ^ _SALT[row]) >> np.uint64(64 - bits)


def sketch(source: DataFrame, bits: int, width: int, gram: int, depth: int) -> np.ndarray:
    """For each row of the merged sketch, one bit for each cell: whether its count is two or more."""
    per_row = 1 << max(0, bits - BLOCK_BITS)
    size = 1 << min(bits, BLOCK_BITS)

    def count(batches):
        found = []
        for b in batches:
            raw = text_bytes(b.column(1))
            for s, e in slices([len(t) for t in raw]):
                found.append(minimizers(Words(raw[s:e], SPACE_SEPARATED), width, gram)[2])
        values = np.concatenate(found) if found else np.zeros(0, np.uint64)
        for row in range(depth):
            at, n = np.unique(cells(values, row, bits), return_counts=True)
            edge = np.searchsorted(at, np.arange(per_row + 1, dtype=np.uint64) * np.uint64(size))
            block, once, more = [], [], []
            for k in range(per_row):
                a, c = at[edge[k] : edge[k + 1]] % np.uint64(size), n[edge[k] : edge[k + 1]]
                if len(a):
                    block.append(row * per_row + k)
                    once.append(a[c == 1].astype("<u2").tobytes())
                    more.append(a[c > 1].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["block", "once", "more"])

    def merge(batches):
        state: dict[int, np.ndarray] = {}
        for b in batches:
            for k, once, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                have = state.setdefault(k, np.zeros(size, np.uint8))
                at = np.frombuffer(once, "<u2")
                have[at] = np.minimum(have[at] + 1, 2)
                have[np.frombuffer(more, "<u2")] = 2
        bits_of = [np.packbits(x > 1).tobytes() for x in state.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(state), pa.int32()), pa.array(bits_of, pa.binary())], ["block", "bits"])

    parts = source.mapInArrow(count, "block int, once binary, more binary").repartition("block")
    out = np.zeros((depth * per_row, size // 8), np.uint8)
    for r in parts.mapInArrow(merge, "block int, bits binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(depth, -1)


def _estimated_repeated(values: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    ok = np.ones(len(values), bool)
    for row in range(len(table)):
        c = cells(values[ok], row, bits)
        ok[ok] = (table[row][c >> np.uint64(3)] >> (7 - (c & np.uint64(7)).astype(np.uint8))) & 1 > 0
    return ok


class _Candidates:
    """Windows of a chunk that may repeat: document and first word of each, and the distinct 128-bit hashes."""

    def __init__(self, raw: list[bytes], table: np.ndarray, bits: int, width: int, gram: int):
        doc, first, h1, h2 = [], [], [], []
        for s, e in slices([len(t) for t in raw]):
            w = Words(raw[s:e], SPACE_SEPARATED, hashes=2)
            at, least, _ = minimizers(w, width, gram)
            at = at[_estimated_repeated(least, table, bits)]
            if len(at):
                doc.append(w.doc[at] + s)
                first.append(at - w.first[w.doc[at]])
                h1.append(window_hash(w.hash[0], width)[at])
                h2.append(window_hash(w.hash[1], width, 1)[at])
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.doc, self.first = join(doc, np.int64), join(first, np.int64)
        h1, h2 = join(h1, np.uint64), join(h2, np.uint64)
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        self.key = np.empty(len(h1), np.int64)
        self.key[order] = np.cumsum(new) - 1
        self.h1, self.h2 = h1[new], h2[new]
        self.many = np.bincount(self.key, minlength=len(self.h1)) > 1

    def parts(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The shards that have distinct hashes of this chunk, in order, and where each begins among them (and the end)."""
        shard = ((self.h1 >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(shard, prepend=-1))
        return shard[first], np.append(first, len(shard))


def _shared(key1: np.ndarray, key2: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Whether each window occurs at two places, given a row for each chunk that holds it."""
    order = np.lexsort((key2, key1))
    k1, k2 = key1[order], key2[order]
    new = np.ones(len(k1), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=1.0 + many[order])
    out = np.zeros(len(k1), bool)
    out[order] = total[group] > 1
    return out


def _kept(raw: bytes, starts: Iterator[int], width: int) -> tuple[int, int, str]:
    w = raw.split()
    if len(starts):
        edge = np.zeros(len(w) + 1, np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
        return len(w), int(gone.sum()), b" ".join(kept).decode()
    return len(w), 0, b" ".join(w).decode()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id, n_words, n_removed and kept (the words that stay, joined by one space) for each row.

    A null text has no words. Repeated rows are documents of their own, so their passages of width words repeat and go
    from each. Null ids stay null, other columns are ignored, an empty table gives an empty one. A text is never split.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = spread(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")))
    kind = source.schema["id"].dataType.simpleString()
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(total / BYTES_PER_CELL + 1))))
    table = spark.sparkContext.broadcast(sketch(source, bits, width, gram, depth))
    shards = max(math.ceil(total / SHARD_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = packed(source, chunk_bytes)

    def ask(batches):
        for t in one_by_one(batches):
            c = _Candidates(text_bytes(unpacked(t).column("text")), table.value, bits, width, gram)
            used, edge = c.parts(shards)
            span = [slice(a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            keys = [np.concatenate([c.h1[i], c.h2[i]]).tobytes() for i in span]
            many = [np.packbits(c.many[i]).tobytes() for i in span]
            chunk = t.column("chunk")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int64()), pa.array(keys, pa.binary()), pa.array(many, pa.binary())], ["shard", "chunk", "keys", "many"])

    def answer(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64).reshape(2, -1) for k in t.column("keys").to_pylist()]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=k.shape[1]).astype(bool) for m, k in zip(t.column("many").to_pylist(), keys, strict=True)]
        both = np.concatenate(keys, axis=1)
        found = _shared(both[0], both[1], np.concatenate(many))
        cut = np.cumsum([k.shape[1] for k in keys])[:-1]
        return pa.table({"shard": t.column("shard"), "chunk": t.column("chunk"), "bits": pa.array([np.packbits(x).tobytes() for x in np.split(found, cut)], pa.binary())})

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = unpacked(left)
        raw = text_bytes(docs.column("text"))
        c = _Candidates(raw, table.value, bits, width, gram)
        used, edge = c.parts(shards)
        at = {k: (a, b) for k, a, b in zip(used.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)}
        repeated = np.zeros(len(c.h1), bool)
        for k, got in zip(right.column("shard").to_pylist(), right.column("bits").to_pylist(), strict=True):
            a, b = at[k]
            repeated[a:b] = np.unpackbits(np.frombuffer(got, np.uint8), count=b - a)
        hit = repeated[c.key]
        doc, first = c.doc[hit], c.first[hit]
        cut = np.searchsorted(doc, np.arange(len(raw) + 1))
        rows = [_kept(t, first[cut[i] : cut[i + 1]], width) for i, t in enumerate(raw)]
        return pa.table({"id": docs.column("id"), "n_words": pa.array([r[0] for r in rows], pa.int64()), "n_removed": pa.array([r[1] for r in rows], pa.int64()), "kept": pa.array([r[2] for r in rows], pa.string())})

    asked = chunks.mapInArrow(ask, "shard int, chunk long, keys binary, many binary")
    answers = asked.groupBy("shard").applyInArrow(answer, "shard int, chunk long, bits binary")
    out = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(clean, f"id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
