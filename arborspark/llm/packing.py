"""Packing of documents into fixed-length training sequences as a cutting-stock problem solved by column generation.

Every document becomes token ids with an end id. It is cut into pieces of the sequence length and a rest. A rest below twice
``TAIL`` stays whole; a longer one is cut into a piece whose length is a multiple of ``GRAIN`` and a tail of at least ``TAIL``, so
that pieces have few distinct lengths, none is a sliver of its document, and the histogram of lengths (the only thing the
driver sees) is bounded whatever the corpus size. A linear program over patterns
of lengths is solved by column generation: a knapsack dynamic program prices new patterns. Pattern counts are rounded
down, so every used pattern is exactly filled; what remains (at most about one sequence for each length) is packed by
bounded knapsacks. Ranked pieces of a length then take the slots of the patterns in order, by arithmetic alone.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, spread
from .tokens import load

LENGTH, GRAIN, TAIL, END_ID, CHECKED = 2048, 16, 64, 1, 64
#: Characters on which both libraries are tested to agree; texts with others take the reference library.
_PLAIN = re.compile(r"[^\x00-ɏ]")


@lru_cache(maxsize=2)
def _ranks(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_ids(text: str, tokenizer: str, ranks: str | None) -> np.ndarray:
    """Ids of a text as the tokenizers library gives them, without added special tokens.

    ranks names the same vocabulary for the faster library, which is used where both are known to agree: texts of plain
    letters without a special string. One text in ``CHECKED`` of these (by its crc32) is encoded by both, and a difference
    is an error.
    """
    if ranks and "<|" not in text and not _PLAIN.search(text):
        ids = np.array(_ranks(ranks).encode_ordinary(text), "<u4")
        if zlib.crc32(text.encode()) % CHECKED or np.array_equal(ids, load(tokenizer).encode(text, add_special_tokens=False).ids):
            return ids
        raise ValueError("the two libraries give different ids; pack without ranks")
    return np.array(load(tokenizer).encode(text, add_special_tokens=False).ids, "<u4")


def cuts(n: int, length: int = LENGTH, grain: int = GRAIN, tail: int = TAIL) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    rest, at = n % length, n - n % length
    out = [(s, length) for s in range(0, at, length)]
    if rest < 2 * tail or rest % grain == 0:
        return [*out, (at, rest)] if rest else out
    main = (rest - tail) - (rest - tail) % grain
    return [*out, (at, main), (at + main, rest - main)]


# --- linear program -----------------------------------------------------------------------------------------------------


def price(sizes: np.ndarray, values: np.ndarray, length: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: unbounded knapsack by dynamic programming over the capacity."""
    best, take = np.zeros(length + 1), np.full(length + 1, -1)
    order = np.argsort(sizes)
    sz, val = sizes[order], values[order]
    upto = np.searchsorted(sz, np.arange(length + 1), "right")
    for c in range(1, length + 1):
        best[c] = best[c - 1]
        k = upto[c]
        if k:
            got = best[c - sz[:k]] + val[:k]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], take[c] = got[i], i
    pattern, c = np.zeros(len(sizes), np.int64), length
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[order[take[c]]] += 1
            c -= sz[take[c]]
    return float(best[length]), pattern


def first_basis(sizes: np.ndarray, need: np.ndarray, length: int) -> np.ndarray:
    """A feasible basis to start from: the fullest pattern of what is left, used until one of its sizes runs out, and so on.

    Later patterns lack the sizes that ran out, so the patterns, each paired with the size it used up, are a triangular matrix.
    """
    left, columns, open_sizes = need.astype(float), [], np.ones(len(sizes), bool)
    while open_sizes.any():
        pattern = fill(sizes, np.ceil(left).astype(np.int64), length)
        has = np.flatnonzero(pattern)
        if not len(has):  # what ran out together with another size
            columns += [np.eye(len(sizes), dtype=np.int64)[i] for i in np.flatnonzero(open_sizes)]
            break
        ratio = left[has] / pattern[has]
        out = has[int(ratio.argmin())]
        left = left - ratio.min() * pattern
        left[left < 1e-9] = 0
        left[out] = 0
        open_sizes[out] = False
        columns.append(pattern)
    return np.stack(columns, axis=1).astype(float)


def solve(sizes: np.ndarray, need: np.ndarray, length: int = LENGTH, max_rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """Patterns (counts by size) and how often each is used; together they hold exactly need pieces of each size."""
    m = len(sizes)
    if not m:
        return []
    basis = before = first_basis(sizes, need, length)
    for _ in range(max_rounds):
        try:
            duals = np.linalg.solve(basis.T, np.ones(m))
        except np.linalg.LinAlgError:  # the last exchange was of a pattern that the others make up
            basis = before
            break
        worth, pattern = price(sizes, duals, length)
        if worth <= 1 + 1e-7:
            break
        x = np.linalg.solve(basis, need.astype(float))
        d = np.linalg.solve(basis, pattern.astype(float))
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, np.maximum(x, 0) / np.where(ok, d, 1), np.inf)
        tied = np.flatnonzero(ratio <= ratio.min() + 1e-9)
        before, basis = basis, basis.copy()
        basis[:, tied[d[tied].argmax()]] = pattern  # of columns that run out together, the one most used
    x = np.linalg.solve(basis, need.astype(float))
    left, out = need.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        pattern = basis[:, j].round().astype(np.int64)
        uses = int(max(0, np.floor(x[j] + 1e-9)))
        has = pattern > 0
        uses = min(uses, int((left[has] // pattern[has]).min()))
        if uses:
            out.append((pattern, uses))
            left -= uses * pattern
    while left.any():
        pattern = fill(sizes, left, length)
        has = pattern > 0
        uses = int((left[has] // pattern[has]).min())
        out.append((pattern, uses))
        left -= uses * pattern
    return out


def fill(sizes: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """The fullest pattern from what is left, large pieces first among equals: bounded knapsack."""
    items = []
    for i in np.argsort(-sizes):
        n, k = int(min(left[i], length // sizes[i])), 1
        while n > 0:
            items.append((i, min(k, n)))
            n -= min(k, n)
            k *= 2
    best, used = np.zeros(length + 1), np.zeros((len(items), length + 1), bool)
    for r, (i, k) in enumerate(items):
        w = int(sizes[i]) * k
        if w <= length:
            got = best[:-w] + w + 1e-6 * (k * int(sizes[i]) ** 2 / length)
            used[r, w:] = got > best[w:]
            best[w:] = np.maximum(best[w:], got)
    pattern, c = np.zeros(len(sizes), np.int64), length
    for r in range(len(items) - 1, -1, -1):
        if used[r, c]:
            i, k = items[r]
            pattern[i] += k
            c -= int(sizes[i]) * k
    return pattern


# --- operator -----------------------------------------------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None, id_col: str, text_col: str) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens and row (a number of the document's row) of every piece."""
    source = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        seen = TaskContext.get().partitionId() << 40
        for b in batches:
            row, start, size, crc, whole = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.append(encode_ids(t or "", tokenizer, ranks), np.uint32(END_ID)).astype("<u4")
                raw = ids.tobytes()
                for s, n in cuts(len(ids)):
                    row.append(i)
                    start.append(s)
                    size.append(n)
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
                    whole.append(len(ids))
            cols = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, whole)), pa.array(np.array(row, np.int64) + seen)]
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays(cols, ["id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    return source.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, row long")


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece holding the end id. Repeated rows are packed each, null ids stay null, other
    columns are ignored, and an empty table gives no rows. Pieces of one length are ranked by document (ties by where their
    row was read). The pieces are written once to the shared folder; after that only small rows are shuffled, by length and
    a hash of the row, so that no length and no group of equal rows gathers in one task.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = cut(pieces(docs, tokenizer, ranks, id_col, text_col))
    kind = parts.schema["id"].dataType.simpleString()
    total = parts.count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 20_000)
    parts = parts.withColumn("_part", F.pmod(F.xxhash64("row"), F.lit(n)))
    counts = parts.groupBy("length", "_part").count()
    need = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    full = need.pop(LENGTH, 0)
    sizes = np.array(sorted(need), np.int64)
    plan = solve(sizes, np.array([need[s] for s in sizes.tolist()], np.int64))

    # slots of each length: for each pattern, the rank at which its slots begin, its first sequence, slots in a sequence, offset of the first
    slots: dict[int, list[tuple[int, int, int, int]]] = {LENGTH: [(0, 0, 1, 0)]}
    ranked, base = dict.fromkeys(sizes.tolist(), 0), full
    for pattern, uses in plan:
        at = 0
        for i in range(len(sizes) - 1, -1, -1):
            if k := int(pattern[i]):
                s = int(sizes[i])
                slots.setdefault(s, []).append((ranked[s], base, k, at))
                ranked[s] += k * uses
                at += k * s
        base += uses
    tables = {s: np.array(rows, np.int64) for s, rows in slots.items()}

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("length").alias("_l"), F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("length", "_part").orderBy("id", "start", "row")
    ranks_df = parts.withColumn("_rank", F.row_number().over(inner) - 1).join(starts, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p")))
    ranks_df = ranks_df.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_rank") + F.col("_base")).alias("_rank"))

    def place(batches):
        for b in batches:
            size, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size).tolist():
                here, t = size == s, tables[s]
                row = t[np.searchsorted(t[:, 0], rank[here], "right") - 1]
                k = rank[here] - row[:, 0]
                seq[here] = row[:, 1] + k // row[:, 2]
                off[here] = row[:, 3] + k % row[:, 2] * s
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    out = ranks_df.mapInArrow(place, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
