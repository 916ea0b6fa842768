"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed byte 2- and 3-grams of its lower-cased letters. Each language has
several centroids, found by spherical k-means over a bounded sample of labelled rows (``per_language``, a documented
parameter); idf comes from the same sample. A text takes the language of the centroid with the largest cosine, and is rejected
if it has no letter or lies too far from that centroid for its length. The radii are calibrated on the fourth part of the
sample, which the centroids have not seen: for each length class, the cosine that 95 of 100 foreign texts (texts of a
language, compared with the centroids of all others) do not reach, but never so much that a text of a known language fails.
A class with few such texts takes those of its neighbours too: the least cosine of few texts fails many others.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bounded_batches, slices, spread

DIM, PER_LANGUAGE, CENTROIDS, ROUNDS = 4096, 800, 4, 12
#: Share of foreign texts that a radius shuts out where known ones allow it, how far below the lowest known cosine it stays, texts to calibrate a class on.
FOREIGN, ROOM, ENOUGH, LANGUAGES = 0.95, 0.9, 200, 200
_KEEP = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_DROP = bytes(c for c in range(0x21, 0x80) if not 0x61 <= c <= 0x7A)
_LETTER = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a text has a letter; number forms like a half or a Roman numeral sign are none."""
    return any(c.isalpha() for m in _LETTER.finditer(text) for c in m.group())


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts, a row for each text, and how many n-grams it has."""
    raw = [b" " + t.lower().encode("utf-8", "ignore").translate(_KEEP, _DROP) + b" " for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    joined = np.frombuffer(b"".join(raw) + b"  ", np.uint8)
    out = np.zeros(len(raw) * DIM, np.int64)
    last, total = np.cumsum(sizes), int(sizes.sum())
    for at in range(0, total, SLICE_BYTES):  # a long text is counted part by part
        n = min(SLICE_BYTES, total - at)
        b = joined[at : at + n + 2].astype(np.uint32)
        row = np.searchsorted(last, np.arange(at, at + n), "right") * DIM
        two = b[:n] * np.uint32(0x9E3779B1) + b[1 : n + 1] * np.uint32(0x85EBCA6B)
        three = two * np.uint32(0xC2B2AE35) + b[2 : n + 2] * np.uint32(0x27D4EB2F)
        letters = (b[:n] != 0x20) | (b[1 : n + 1] != 0x20)
        for width, h in ((2, two), (3, three)):
            inside = letters.copy()
            for k in range(1, width):  # no n-gram reaches into the next text
                edge = last - k - at
                inside[edge[(edge >= 0) & (edge < n)]] = False
            out += np.bincount(row[inside] + (h[inside] >> np.uint32(20)).astype(np.int64), minlength=len(out))
    counts = out.reshape(len(raw), DIM)
    return counts, counts.sum(1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(int), 15)


def _dense(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and lengths of texts given as (length, buckets, counts)."""
    x = np.zeros((len(rows), DIM), np.float32)
    for i, (_, at, c) in enumerate(rows):
        x[i, at] = c
    return x, np.array([r[0] for r in rows], np.int64)


class Model:
    """idf, centroids with their languages, the least cosine accepted for each length class, and the error rates of calibration.

    rows holds, for each language, its texts as (length, buckets, counts); one language is unfolded at a time.
    """

    def __init__(self, rows: dict[str, list], centroids: int = CENTROIDS, rounds: int = ROUNDS):
        seen, total = np.zeros(DIM), sum(map(len, rows.values()))
        for got in rows.values():
            for _, at, _ in got:
                seen[at] += 1
        self.idf = np.log((1 + total) / (1 + seen)).astype(np.float32) + 1
        self.langs, centres = [], []
        for lang in sorted(rows):
            x = self.vectors(_dense([r for i, r in enumerate(rows[lang]) if i % 4 != 3])[0])
            rng = np.random.default_rng(5)
            k = min(centroids, len(x))
            c = x[rng.choice(len(x), k, replace=False)]
            for _ in range(rounds):
                near = (x @ c.T).argmax(1)
                c = _unit(np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(k)]))
            centres.append(c)
            self.langs += [lang] * k
        self.centres = np.concatenate(centres).astype(np.float32) if centres else np.zeros((0, DIM), np.float32)
        self._calibrate(rows)

    def _calibrate(self, rows: dict[str, list]) -> None:
        own, foreign, classes = [np.zeros(0)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for lang in sorted(rows):
            held = rows[lang][3::4]
            if held:
                x, n = _dense(held)
                cos, mine = self.vectors(x) @ self.centres.T, np.array([y == lang for y in self.langs])
                own.append(cos[:, mine].max(1))
                foreign.append(cos[:, ~mine].max(1) if not mine.all() else np.zeros(len(held)))
                classes.append(_length_class(n))
        own, foreign, classes = np.concatenate(own), np.concatenate(foreign), np.concatenate(classes)
        self.least = np.zeros(16)
        for j in range(16 if len(own) else 0):
            reach = next((w for w in range(16) if (np.abs(classes - j) <= w).sum() >= ENOUGH), 16)  # neighbouring classes help out
            here = np.abs(classes - j) <= reach
            self.least[j] = max(0.0, min(np.quantile(foreign[here], FOREIGN), ROOM * own[here].min()))
        #: Shares of the held-out texts of known languages that are rejected and, as foreign ones, accepted.
        self.rejected = float((own < self.least[classes]).mean()) if len(own) else 0.0
        self.accepted = float((foreign >= self.least[classes]).mean()) if len(own) else 0.0

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts.astype(np.float32)) * self.idf)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether the text is rejected."""
        counts, n = ngram_counts(texts)
        letters = np.array([has_letter(t) for t in texts], bool)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cos = self.vectors(counts) @ self.centres.T
        best = cos.argmax(1)
        score = np.clip(cos[np.arange(len(texts)), best].astype(float), 0, 1)
        score[~letters] = 0
        langs = [self.langs[j] if ok else "und" for j, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return langs, score, ~letters | (score < self.least[_length_class(n)])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_languages: int = LANGUAGES, **options) -> Model:
    """A model from rows with a language and a text.

    At most per_language distinct texts of each language are used, those with the smallest hashes; copies count once, so a
    text repeated often neither crowds out others nor is more than one row. Rows are thinned by a hash threshold from each
    language's number of distinct texts before they are ranked, so nothing unbounded is gathered by language. Rows with a
    null text or language are left out; no rows at all give a model that rejects everything; more than max_languages
    languages are an error, as the model holds centroids for each.
    """
    rows = spread(labelled.select(labelled[text_col].alias("text"), labelled[lang_col].alias("lang"))).where("text is not null and lang is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return Model({})
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * per_language / max(n, 1)))])
    u = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(u < F.element_at(share, F.col("lang"))).groupBy("lang", "h").agg(F.any_value("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    sample = sample.withColumn("rank", rank).where(F.col("rank") <= per_language).select("text", "lang")

    def features(batches):
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1)
            for s, e in slices([len(t) for t in texts]):
                for s2 in range(s, e, 256):
                    e2 = min(e, s2 + 256)
                    counts, n = ngram_counts(texts[s2:e2])
                    at = [np.flatnonzero(c) for c in counts]
                    yield pa.RecordBatch.from_arrays([langs.slice(s2, e2 - s2), pa.array(n), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([c[a].astype(np.int32) for c, a in zip(counts, at, strict=True)], pa.list_(pa.int32()))], ["lang", "n", "at", "count"])

    sparse: dict[str, list] = {}
    for r in sample.mapInArrow(features, "lang string, n long, at array<int>, count array<int>").toLocalIterator():
        sparse.setdefault(r["lang"], []).append((r["n"], np.array(r["at"], np.int64), np.array(r["count"], np.float32)))
    for got in sparse.values():
        got.sort(key=lambda g: (g[1].tobytes(), g[2].tobytes()))  # whatever the order of partitions
    return Model(sparse, **options)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns keep (all by default) with lang_pred, score and rejected after them.

    A null text, or one without a letter, is ``und`` and rejected with score 0. Repeated rows get a row each, ties take
    the first centroid in the order of languages, columns of the same names as the results are replaced, and an empty
    table gives an empty one. No rows are shuffled.
    """
    bounded_batches(docs.sparkSession)
    new = ["lang_pred", "score", "rejected"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = spread(docs.select(*[docs[c] for c in names], docs[text_col].alias("_text")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(names)]), "lang_pred string, score double, rejected boolean"])
    sent = source.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            texts = [t or "" for t in b.column(len(names)).to_pylist()]
            langs, score, out = [], [], []
            for s, e in slices([len(t) for t in texts]):
                for s2 in range(s, e, 256):
                    got = m.predict(texts[s2 : min(e, s2 + 256)])
                    langs += got[0]
                    score.append(got[1])
                    out.append(got[2])
            if texts:
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(langs), pa.array(np.concatenate(score)), pa.array(np.concatenate(out))], [*names, *new])

    return source.mapInArrow(run, schema)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0))
