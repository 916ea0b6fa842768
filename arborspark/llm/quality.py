"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of byte n-grams of ``ORDER``, so that every script is covered and the tables stay sharded rows of numbers. Counts
of trusted documents are summed by n-gram; lower orders count the distinct continuations, and everything a probability
needs (counts, sums and numbers of followers of each context) is joined to the n-grams that the corpus asks for, order by
order, as DataFrames hashed by n-gram. The resulting log probabilities go to where the texts lie if their number is small
enough (it is checked); otherwise a chunk of documents asks once for each of its distinct n-grams and gets them back by a
join. Each document's perplexity follows from them. A text is kept unless its perplexity exceeds the
quantile of the trusted texts of its language that are held out of the counts.
"""

from __future__ import annotations

import zlib
from functools import partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, ipc, join_hot, one_by_one, packed, release, slices, spread, text_bytes, unpacked

ORDER, QUANTILE, HELD, CHUNK_BYTES = 5, 0.995, 5, 16 << 20
#: How far chunks are compressed, as they are written and shuffled: a fifth less than at level 1 for 11 CPU seconds a GB.
LEVEL = 6
#: Distinct n-grams up to which their log probabilities (12 bytes each) are sent to the executors; beyond it they are joined to chunks.
TABLE_LIMIT = 4_000_000
#: Languages up to which thresholds are sent to the texts.
LANGUAGES = 10_000


def grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram ending at every byte, as a number with the last byte lowest, and the bytes in each text; texts begin with line ends."""
    pad = b"\n" * (ORDER - 1)
    joined = np.frombuffer(b"".join(pad + t for t in raw), np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    n = max(0, len(joined) - ORDER + 1)
    key = np.zeros(n, np.int64)
    for k in range(ORDER):
        key = (key << 8) | joined[k : k + n]
    starts = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    if len(raw) > 1:  # n-grams that reach over the end of a text into the next one's padding
        keep = np.ones(n, bool)
        for k in range(ORDER - 1):
            at = starts[1:] - 1 - k
            keep[at[(at >= 0) & (at < n)]] = False
        key = key[keep]
    return key, sizes


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two and more, from the counts of counts; c is the count column."""
    n = {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (float(n.get(k, 0)) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


def model(counts: DataFrame) -> list[tuple[DataFrame, DataFrame, tuple[float, float, float]]]:
    """For each order, highest first: (key, c), contexts (ctx, total, gamma) and discounts, from the counts of the highest."""
    out, level = [], counts
    for order in range(ORDER, 0, -1):
        d = discounts(level)
        c = F.col("c")
        weight = F.sum(F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2]))
        ctx = cut(level.groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum("c").alias("total"), (weight / F.sum("c")).alias("gamma")))
        out.append((level, ctx, d))
        if order > 1:  # lower orders count in how many ways an n-gram is preceded
            level = cut(level.groupBy(F.col("key").bitwiseAND((1 << 8 * (order - 1)) - 1).alias("key")).agg(F.count("*").alias("c")))
    return out


def log_probs(asked: DataFrame, levels: list) -> DataFrame:
    """(key, logp) for every n-gram asked for: interpolated from the lowest order up."""
    p, last = asked.select("key").withColumn("p", F.lit(1 / 256)), None
    for order, (level, ctx, d) in zip(range(1, ORDER + 1), reversed(levels), strict=True):
        part = F.col("key").bitwiseAND((1 << 8 * order) - 1)
        p = p.withColumn("_k", part).withColumn("_c", F.shiftright(part, 8))
        p = p.join(level.withColumnRenamed("key", "_k"), "_k", "left").join(ctx.withColumnRenamed("ctx", "_c"), "_c", "left")
        c = F.coalesce("c", F.lit(0))
        off = F.when(c == 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
        p = cut(p.select("key", F.when(F.col("total").isNull(), F.col("p")).otherwise((c - off) / F.col("total") + F.col("gamma") * F.col("p")).alias("p")))
        release(last)
        last = p
    return p.select("key", F.log("p").cast("float").alias("logp"))


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chunk_bytes: int = CHUNK_BYTES, table_limit: int = TABLE_LIMIT, held: int = 0) -> DataFrame:
    """id, lang, n_bytes, trusted, perplexity (for each byte; null for a text without bytes) for each row.

    trusted holds the ids whose texts the model learns from. With held, texts whose crc32 is a multiple of it are not
    learned from (so all copies of a text are on one side), and a column held_out names them. Null texts are empty; rows with a null id are scored but
    not learned from; repeated rows are scored each; other columns are ignored; empty tables give empty results; without
    trusted text every byte is equally likely.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = spread(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")))
    kind = source.schema["id"].dataType.simpleString()
    chunks = packed(source, chunk_bytes, partial(ipc, level=LEVEL))

    def ids(batches):
        for t in one_by_one(batches):
            for b in unpacked(t).select(["id"]).to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t.column("chunk")[0].as_py())), b.column(0)], ["chunk", "id"])

    named = chunks.mapInArrow(ids, f"chunk long, id {kind}")
    known = trusted.select(F.col(trusted.columns[0]).alias("id")).distinct()
    wanted = named.join(known, "id", "left_semi")

    def learn(left: pa.Table, right: pa.Table) -> pa.Table:
        d = unpacked(left)
        want = set(right.column("id").to_pylist())
        raw = [t for i, t in zip(d.column("id").to_pylist(), text_bytes(d.column("text")), strict=True) if i in want and not _held(t, held)]
        key, c = _counted(raw)
        return pa.table({"key": pa.array(key), "c": pa.array(c)})

    counted = chunks.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(learn, "key long, c long")
    counts = cut(counted.groupBy("key").agg(F.sum("c").alias("c")))

    def distinct(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_counted(text_bytes(b.column(0)))[0])], ["key"])

    asked = cut(source.select("text").mapInArrow(distinct, "key long").distinct())
    by_table = asked.count() <= table_limit
    if by_table:  # the chunks have been counted and are not scored
        release(chunks)
    levels = model(counts)
    probs = cut(log_probs(asked, levels))
    release(asked, *[f for level, ctx, _ in levels for f in (level, ctx)])
    scored = cut(_by_table(source, probs, kind, held) if by_table else _by_chunk(chunks, probs, kind, held))
    release(chunks, probs)
    scored = scored.join(known.withColumn("trusted", F.lit(True)), "id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    return scored.select("id", "lang", "n_bytes", "trusted", "perplexity", *(["held_out"] if held else [])).withColumnRenamed("id", id_col)


def _held(text: bytes, held: int) -> bool:
    return held > 0 and zlib.crc32(text) % held == 0


def _rated(raw: list[bytes], key: np.ndarray, logp: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Bytes and perplexity of texts whose n-grams are all in the sorted table."""
    size, total = np.zeros(len(raw), np.int64), np.zeros(len(raw))
    for s, e in slices([len(t) for t in raw]):
        k, n = grams(raw[s:e])
        size[s:e] = n
        if len(k):
            at = np.searchsorted(key, k)
            if not len(key) or (key[np.minimum(at, len(key) - 1)] != k).any():
                raise ValueError("the texts are not those that the model was asked about; read the input from a stable source")
            total[s:e] = np.bincount(np.repeat(np.arange(e - s), n), weights=logp[at], minlength=e - s)
    return pa.array(size), pa.array(np.exp(-total / np.maximum(size, 1)), mask=size == 0)


def _by_table(source: DataFrame, probs: DataFrame, kind: str, held: int) -> DataFrame:
    """Scores where the texts lie: the table of log probabilities is sent to the executors, its size having been checked."""
    table = probs.select("key", "logp").toArrow()
    key, logp = table.column("key").to_numpy(), table.column("logp").to_numpy()
    order = np.argsort(key)
    sent = source.sparkSession.sparkContext.broadcast((key[order], logp[order]))

    def score(batches):
        for b in batches:
            raw = text_bytes(b.column(1))
            away = pa.array([_held(t, held) for t in raw], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *_rated(raw, *sent.value), away], ["id", "lang", "n_bytes", "perplexity", "held_out"])

    return source.mapInArrow(score, f"id {kind}, lang string, n_bytes long, perplexity double, held_out boolean")


def _by_chunk(chunks: DataFrame, probs: DataFrame, kind: str, held: int) -> DataFrame:
    """Scores by a join: every chunk asks once for each of its distinct n-grams."""

    def ask(batches):
        for t in one_by_one(batches):
            key, _ = _counted(text_bytes(unpacked(t).column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t.column("chunk")[0].as_py(), np.int64)), pa.array(key)], ["chunk", "key"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        d = unpacked(left)
        key, logp = right.column("key").to_numpy(), right.column("logp").to_numpy()
        order = np.argsort(key)
        raw = text_bytes(d.column("text"))
        size, ppl = _rated(raw, key[order], logp[order])
        return pa.table({"id": d.column("id"), "lang": d.column("lang"), "n_bytes": size, "perplexity": ppl, "held_out": pa.array([_held(t, held) for t in raw], pa.bool_())})

    found = chunks.mapInArrow(ask, "chunk long, key long").join(probs, "key").select("chunk", "key", "logp")
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, f"id {kind}, lang string, n_bytes long, perplexity double, held_out boolean")


def _counted(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    pending, size = [], 0
    parts = [*slices([len(t) for t in raw], 4 << 20)]
    for i, (s, e) in enumerate(parts):
        pending.append(np.unique(grams(raw[s:e])[0], return_counts=True))
        size += len(pending[-1][0])
        if size > 4_000_000 or i + 1 == len(parts):
            k = np.concatenate([keys, *(p[0] for p in pending)])
            c = np.concatenate([counts, *(p[1] for p in pending)])
            keys, inverse = np.unique(k, return_inverse=True)
            counts, pending, size = np.bincount(inverse, weights=c).astype(np.int64), [], 0
    return keys, counts


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", quantile: float = QUANTILE, held: int = HELD, **columns) -> DataFrame:
    """perplexities() with threshold and keep.

    The threshold of a language is the quantile of its trusted texts that are held out of the counts (one in held, by
    text). Where they are too few for any to lie beyond the quantile, it is the quantile of a log-normal fitted to them,
    with the prediction error of their number; a language with fewer than two takes the threshold of all held-out ones.
    A text without bytes is not kept; without two held-out trusted texts every other text is. A perplexity of exactly the
    threshold is kept; columns of other names are not looked at. Thresholds, one for each language, are sent to the texts where
    there are at most LANGUAGES of them and joined otherwise; a frequent language is not brought into one task either way.
    """
    scored = cut(perplexities(docs, trusted, id_col, held=held, **columns))
    lang = F.coalesce("lang", F.lit("")).alias("_lang")
    known = scored.where("trusted and held_out and perplexity is not null")
    found = [F.percentile_approx("perplexity", quantile, 10_000).alias("q"), F.count("*").alias("n"), F.avg(F.log("perplexity")).alias("m"), F.stddev_samp(F.log("perplexity")).alias("d")]
    limit = F.udf(lambda *x: bound(quantile, *x), "double")("q", "n", "m", "d").alias("q")
    by_lang = cut(known.groupBy(lang).agg(*found).select("_lang", limit))
    overall = bound(quantile, *known.agg(*found).first())
    other = F.lit(float("inf") if overall is None else overall)
    scored = scored.withColumn("_lang", lang)
    out = scored.join(F.broadcast(by_lang), "_lang", "left") if by_lang.count() <= LANGUAGES else join_hot(scored, by_lang, "_lang", "left")
    out = out.withColumn("threshold", F.coalesce("q", other)).drop("_lang", "q", "held_out")
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))


def bound(quantile: float, q: float | None, n: int, m: float | None, d: float | None) -> float | None:
    """The quantile of n values: q, the empirical one, where at least one lies beyond it, else by mean and deviation of their logarithms."""
    if n < 2:
        return None
    if n * (1 - quantile) >= 1:
        return q
    z, v = NormalDist().inv_cdf(quantile), n - 1  # Student's t by its expansion around the normal
    t = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3)
    return float(np.exp(m + t * d * (1 + 1 / n) ** 0.5))
