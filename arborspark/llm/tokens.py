"""Token counts of whole texts, with overlap resynchronisation for huge documents.

Texts of up to ``huge_chars`` characters are encoded in one call. Longer ones are encoded in overlapping chunks with
offsets; two neighbouring chunks are spliced at a boundary that is proven stable, and the overlap is widened until one is
found. So the count is that of encoding the whole text, while no call sees more than a bounded piece of ordinary text.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, slices, spread

HUGE_CHARS, CHUNK_CHARS, OVERLAP_CHARS, STABLE_TOKENS = 1 << 16, 1 << 15, 512, 4


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer in a file, one for each worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _encode(tok, text: str, base: int) -> tuple[np.ndarray, np.ndarray]:
    e = tok.encode(text, add_special_tokens=False)
    return np.array(e.ids, np.int64), np.array([a for a, _ in e.offsets], np.int64) + base


def stable_boundary(text: str, left: tuple, right: tuple, low: int, high: int, stable: int = STABLE_TOKENS) -> int | None:
    """A position in (low, high) at which both encodings start a token, agree on the tokens around it, and white space
    meets a character that cannot combine with it; None if there is none.

    White space never lies inside a pre-token together with what stands before it, so nothing left of such a place can
    change the tokens right of it; agreement on both sides shows that neither chunk's cut end reaches it.
    """
    (li, lo), (ri, ro) = left, right
    l0, r0 = np.searchsorted(lo, low, "right"), np.searchsorted(ro, low, "right")
    lo, li, ro, ri = lo[l0:], li[l0:], ro[r0:], ri[r0:]
    ro, ri = ro[: np.searchsorted(ro, high)], ri[: np.searchsorted(ro, high)]
    common, a, b = np.intersect1d(lo, ro, return_indices=True)
    good = []
    for p, i, j in zip(common.tolist(), a.tolist(), b.tolist(), strict=True):
        if i < stable or j < stable or i + stable > len(li) or j + stable > len(ri):
            continue
        span = slice(i - stable, i + stable), slice(j - stable, j + stable)
        if not (np.array_equal(li[span[0]], ri[span[1]]) and np.array_equal(lo[span[0]], ro[span[1]])):
            continue
        edge = text[p - 1].isspace() != text[p].isspace()
        if edge and not unicodedata.combining(text[p]):
            good.append(p)
    return good[len(good) // 2] if good else None


def spliced_ids(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
    """Ids of the whole text from overlapping chunks."""
    n, out = len(text), []
    begin, end, done = 0, min(chunk, len(text)), 0
    cur = _encode(tok, text[begin:end], begin)
    width = overlap
    while end < n:
        if end - width <= max(begin, done):  # no boundary in all of this chunk: take more text into it
            end = min(n, end + (end - begin))
            cur, width = _encode(tok, text[begin:end], begin), overlap
            continue
        start = end - width
        stop = min(n, start + max(chunk, 2 * width))
        nxt = _encode(tok, text[start:stop], start)
        at = stable_boundary(text, cur, nxt, start, end)
        if at is None:
            width *= 2
            continue
        ids, off = cur
        out.append(ids[(off >= done) & (off < at)])
        begin, end, done, cur, width = start, stop, at, nxt, overlap
    ids, off = cur
    out.append(ids[off >= done])
    return np.concatenate(out)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, huge_chars: int = HUGE_CHARS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row; tokenizer is the path of a tokenizers file.

    A null text counts as empty, a null id stays null, repeated rows are counted each, an empty table gives an empty
    one, and other columns are not looked at. No rows are shuffled.
    """
    bounded_batches(docs.sparkSession)
    source = spread(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        tok = load(tokenizer)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            counts = np.zeros(len(texts), np.int64)
            small = [i for i, t in enumerate(texts) if len(t) <= huge_chars]
            for s, e in slices([len(texts[i]) for i in small], 1 << 19):
                got = tok.encode_batch_fast([texts[i] for i in small[s:e]], add_special_tokens=False)
                counts[small[s:e]] = [len(x) for x in got]
            for i, t in enumerate(texts):
                if len(t) > huge_chars:
                    counts[i] = len(spliced_ids(tok, t, chunk, overlap))
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(counts), pa.array(counts > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
