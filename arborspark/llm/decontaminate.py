"""Benchmark decontamination with an FM-index for each training shard.

A shard is the text of a slice of documents as a sequence of word numbers. Words that no benchmark phrase holds become
one separator symbol, and stretches too short to hold the shortest phrase are left out of the index, as neither can be
part of an occurrence; so the index stays small and loses nothing. Suffixes are sorted by prefix doubling, the Burrows-Wheeler transform is kept in a wavelet matrix with rank counts, phrases are found by backward
search (all phrases of a block at once), occurrences are located through sampled suffix positions, and their word spans
are merged into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALPHANUMERIC, LOWER, bounded_batches, slices, spread, text_bytes

WINDOW, SAMPLE, SHARD_BYTES, BLOCK_BYTES = 8, 4, 8 << 20, 8 << 20
#: Lower-cases A-Z and turns every byte outside words into a space.
_FOLD = bytes(LOWER[c] if ALPHANUMERIC[LOWER[c]] else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def phrases(text: bytes, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Windows of an item: its runs of 8 words; all its words if there are fewer, but not none."""
    w = words(text)
    return [tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))] if w else []


class FMIndex:
    """Backward search over a sequence of integers below symbols; 0 separates and occurs in no pattern."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = SAMPLE):
        seq = np.append(seq + 1, 0)  # an end smaller than all else
        n = len(seq)
        rank, have = seq.astype(np.int64), 1
        while have < n and int(rank.max()) < n - 1 or have == 1:  # prefix doubling: order by the first 2, 4, 8 ... symbols
            nxt = np.zeros(n, np.int64)
            nxt[: n - have] = rank[have:] + 1
            _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + nxt, return_inverse=True)
            have *= 2
        self.sa = np.argsort(rank, kind="stable")
        bwt = seq[self.sa - 1]
        self.n, self.sample = n, sample
        self.levels = symbols.bit_length()
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=1 << self.levels))])
        self.bits, self.zeros, cur = [], [], bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1
            self.bits.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        kept = self.sa % sample == 0
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.samples = self.sa[kept]
        self.kept = kept
        del self.sa

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        low, high = np.zeros_like(at), at.copy()
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.bits[k]
            one = ((symbol >> level) & 1).astype(bool)
            low = np.where(one, self.zeros[k] + ones[low], low - ones[low])
            high = np.where(one, self.zeros[k] + ones[high], high - ones[high])
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(at), at.copy()
        for k in range(self.levels):
            ones = self.bits[k]
            one = ones[at + 1] > ones[at]
            out = out * 2 + one
            at = np.where(one, self.zeros[k] + ones[at], at - ones[at])
        return out

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern; patterns are padded on the right."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            on = np.flatnonzero((lengths > k) & (high > low))
            s = patterns[on, k] + 1
            low[on], high[on] = self.before[s] + self.rank(s, low[on]), self.before[s] + self.rank(s, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: step left until a sampled one."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, rows = np.arange(len(rows)), rows.copy()
        while len(live):
            at = rows[live]
            found = self.kept[at]
            done = live[found]
            out[done] = self.samples[self.kept_rank[rows[done]]] + steps[done]
            live = live[~found]
            at = rows[live]
            s = self.symbol(at)
            rows[live] = self.before[s] + self.rank(s, at)
            steps[live] += 1
        return out


class Block:
    """Phrases of a bounded block of benchmark items."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            for p in phrases(text, window):
                owners.setdefault(p, set()).add(item)
        self.vocab: dict[bytes, int] = {}
        for p in owners:
            for w in p:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        self.owners = [sorted(o) for o in owners.values()]
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.patterns = np.zeros((len(owners), int(self.lengths.max(initial=1))), np.int64)
        for i, p in enumerate(owners):
            self.patterns[i, : len(p)] = [self.vocab[w] for w in p]

    def occurrences(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, phrase) of every occurrence in a shard."""
        none = np.zeros(0, np.int64)
        if not len(self.lengths):
            return none, none, none
        get = self.vocab.get
        seq = np.fromiter((x for d in docs for x in (*(get(w, 0) for w in d), 0)), np.int64, sum(len(d) + 1 for d in docs))
        shortest = int(self.lengths.min())
        edge = np.flatnonzero(np.diff(seq > 0, prepend=False, append=False))
        s, e = edge[0::2], edge[1::2]
        long = e - s >= shortest
        s, n = s[long], (e - s)[long]
        if not len(s):
            return none, none, none
        # the kept stretches, each followed by a separator; where they stood in the shard
        place = np.repeat(s, n + 1) + np.arange(int((n + 1).sum())) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
        index = FMIndex(seq[place], len(self.vocab) + 1)
        low, high = index.search(self.patterns, self.lengths)
        hits = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(hits)), hits)
        rows = np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(int(hits.sum()))
        at = place[index.locate(rows)]
        starts = np.cumsum([0] + [len(d) + 1 for d in docs])
        doc = np.searchsorted(starts, at, "right") - 1
        return doc, at - starts[doc], which


def blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, so that what is sent to the executors never grows with it."""
    items, size = [], 0
    for r in benchmark.select(benchmark[id_col].alias("id"), benchmark[text_col].cast("string").alias("text")).toLocalIterator():
        raw = (r["text"] or "").encode()
        if items and size + len(raw) > limit:
            yield Block(items)
            items, size = [], 0
        items.append(("" if r["id"] is None else str(r["id"]), raw))
        size += len(raw)
    if items:
        yield Block(items)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _shards(raw: list[bytes], block: Block) -> Iterator[tuple[int, list[bytes], list[tuple[int, int]], list]]:
    """(row, words, merged spans of words, items) of every document."""
    for s, e in slices([len(t) for t in raw], SHARD_BYTES):
        docs = [words(t) for t in raw[s:e]]
        doc, first, which = block.occurrences(docs)
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        for d, a, p in zip(doc.tolist(), first.tolist(), which.tolist(), strict=True):
            spans.setdefault(d, []).append((a, a + int(block.lengths[p])))
            items.setdefault(d, set()).update(block.owners[p])
        for i, d in enumerate(docs):
            yield s + i, d, merge(spans.get(i, [])), sorted(items.get(i, ()))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _with(spans: list[dict], found: list[tuple[int, int]]) -> list[dict]:
    """Spans of earlier blocks merged with those of one more."""
    return [{"start": x, "end": y} for x, y in merge([*((s["start"], s["end"]) for s in spans), *found])]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_words, spans (merged word ranges [start, end) that benchmark windows cover), items (of those windows, as strings).

    A null or empty text has no words; an item without words has no window; an item without an id is named by the empty
    string; repeated rows and rows with null ids give a row each; several items with one id are one; a window that several
    items hold counts for each. Texts are searched whole, however long; empty tables work; other columns are ignored.
    Nothing is shuffled: the blocks of a benchmark of more than block_bytes are searched
    one after another, and each row carries what was found so far.
    """
    bounded_batches(docs.sparkSession)
    source = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<string>"

    def scan(df: DataFrame, block: Block, first: bool, last: bool) -> DataFrame:
        def run(batches):
            for b in batches:
                n, spans, items = [], [], []
                before = [([], [])] * b.num_rows if first else list(zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True))
                for i, w, found, of in _shards(text_bytes(b.column("text")), block):
                    n.append(len(w))
                    spans.append(_with(before[i][0], found))
                    items.append(sorted({*before[i][1], *of}))
                out = [b.column("id"), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
                names = ["id", "n_words", "spans", "items"]
                yield pa.RecordBatch.from_arrays(out if last else [*out, b.column("text")], names if last else [*names, "text"])

        return df.mapInArrow(run, schema if last else f"{schema}, text string")

    source = source.withColumn("text", F.col("text").cast("string"))
    parts = [*blocks(benchmark, item_col, item_text, block_bytes)] or [Block([])]
    for k, block in enumerate(parts):
        source = scan(source, block, k == 0, k + 1 == len(parts))
    return source.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and the item digest of contamination()."""
    return found.select(
        id_col,
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    folded = np.frombuffer(text.translate(_FOLD), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(folded, prepend=False, append=False))
    s, e = edge[0::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : int(s[a])])
        at = int(e[b - 1])
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with every removal span cut out of the texts; rows without a hit are unchanged, and all columns stay.

    A null text stays null, an empty one empty; repeated rows and rows with null ids are cut each; names of other columns
    are free; without documents or items docs comes back as it is. Nothing is shuffled. All blocks of the benchmark are judged on the text as it came: each row carries the spans found
    so far, and the scan of the last block cuts them.
    """
    bounded_batches(docs.sparkSession)
    at, columns = docs.columns.index(text_col), docs.schema
    carried = "_spans"
    while carried in docs.columns:
        carried += "_"
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    more = T.StructType([*columns.fields, T.StructField(carried, T.ArrayType(span))])

    def stage(df: DataFrame, block: Block, first: bool, last: bool) -> DataFrame:
        def run(batches):
            for b in batches:
                raw = text_bytes(b.column(at))
                kept = b.columns if first else b.columns[:-1]
                before = [[]] * len(raw) if first else b.column(len(kept)).to_pylist()
                spans = [_with(before[i], found) for i, _, found, _ in _shards(raw, block)]
                if last:
                    new = [cut_words(t, [(x["start"], x["end"]) for x in found]) for t, found in zip(raw, spans, strict=True)]
                    text = pa.array([None if old is None else x.decode() for x, old in zip(new, b.column(at).to_pylist(), strict=True)], pa.string())
                    kept = [text if k == at else c for k, c in enumerate(kept)]
                else:
                    kept = [*kept, pa.array(spans, _SPANS)]
                yield pa.RecordBatch.from_arrays(kept, columns.names if last else more.names)

        return df.mapInArrow(run, columns if last else more)

    parts = [*blocks(benchmark, item_col, item_text)]
    for k, block in enumerate(parts):
        docs = stage(docs, block, k == 0, k + 1 == len(parts))
    return docs
