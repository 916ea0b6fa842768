"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

log P(word | history) = log P(class | history) + log P(part | class, history) + log P(word | class, part). The ``TOP`` most
frequent words and the end of a text are classes of their own, which end there; other words fall into ``KINDS`` classes by
their endings, and those into ``PARTS`` parts by a hash. The first two factors are softmaxes whose scores sum hashed features
of the history: the last word, the last two, and skips (the second and the third last), for parts together with the class.
Within a part a word takes its smoothed share of the training count. Weights start from the counts of features with outcomes
over the whole training text, pulled towards the outcomes' shares as strongly as leaving one token out says is best, and are
improved by ``ROUNDS`` synchronous distributed gradient updates: every chunk sums the model's expected counts over every
token of every training document, the sums are added block by block and taken from the counts seen, and each row of weights
moves by its mean gradient. Chunks are scored in numpy batches.

Texts are split once: a written chunk holds its distinct words and, for each token, which of them it is, and all passes read
that. Counts are exact, over all training documents. A chunk names each of its distinct words once (by a 64-bit hash) with its
training count, dealt by ranges of the hash; what comes back is the total count of each.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_SEPARATED, Words, bounded_batches, cut, ipc, mix, one_by_one, packed, slices, text_bytes

CLASSES, TOP, PARTS, TEMPLATES, ROWS, BLOCK_ROWS = 64, 47, 64, 4, 4096, 128
KINDS = CLASSES - TOP - 1
ROUNDS, RATE, START, CHUNK_BYTES, BATCH, ADDED = 2, 0.7, 0.35, 8 << 20, 1 << 10, 1 << 14
#: Packed bytes of a task whose result is one array of 8 MB.
TASK_BYTES = 64 << 20
#: Weights stay within this, so that exponentials of their sums stay in range.
LARGEST = 12.0
PRIORS = (5.0, 20.0, 80.0, 320.0, 1280.0, 5120.0, 1e5, 1e9)
_END, _BEGIN = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)


def split(raw: list[bytes]) -> "Tokens":
    """Tokens of several texts, each ended by one end."""
    w = Words([t.translate(LOWER) for t in raw], SPACE_SEPARATED)
    end = np.cumsum(w.count + 1) - 1
    word = np.ones(len(w.start) + len(raw), bool)
    word[end] = False
    tokens = Tokens(np.full(len(word), _END), np.zeros(len(word), np.uint16), end)
    tokens.hash[word] = w.hash[0]
    last = w.buf[w.end - 1].astype(np.uint32)
    before = np.where(w.end - w.start > 1, w.buf[np.maximum(w.end - 2, 0)], 0).astype(np.uint32)
    kind = ((last * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA6B)) >> np.uint32(16)) % np.uint32(KINDS)
    tokens.cell[word] = kind * np.uint32(PARTS) + ((w.hash[0] >> np.uint64(7)) % np.uint64(PARTS)).astype(np.uint32)
    return tokens


class Tokens:
    """Hash, cell (kind by ending, and part) and text of each token, and the place of each text's end."""

    def __init__(self, hash: np.ndarray, cell: np.ndarray, end: np.ndarray):
        self.hash, self.cell, self.end = hash, cell, end
        self.doc = np.repeat(np.arange(len(end), dtype=np.int32), np.diff(end, prepend=-1))

    def features(self) -> list[np.ndarray]:
        """What the templates look at, for each token: the last word, the last two, the second last, the third last."""
        back = []
        for k in (1, 2, 3):
            h = np.concatenate([np.full(k, _BEGIN), self.hash])[: len(self.hash)]
            crossed = np.concatenate([np.full(k, -1), self.doc])[: len(self.hash)] != self.doc
            h[crossed] = _BEGIN
            back.append(h)
        return [back[0], mix(back[0] + np.uint64(3) * back[1]), back[1], back[2]]

    def rows(self, on: np.ndarray, cls: np.ndarray) -> list[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        """For both factors: rows of weights by template, outcomes, and which tokens they are for (of those that are on)."""
        seen, first = self.features(), np.flatnonzero(on)
        second = first[cls[first] > TOP]
        salt = mix(cls[second].astype(np.uint64) + np.uint64(101))
        a = [_row(x[first], t) for t, x in enumerate(seen)]
        b = [*(_row(x[second] ^ salt, TEMPLATES + t) for t, x in enumerate(seen[:-1])), _row(salt, 2 * TEMPLATES)]  # the last: the class alone
        return [(a, cls[first], first), (b, (self.cell[second] % PARTS).astype(np.int64), second)]


def _row(x: np.ndarray, template: int) -> np.ndarray:
    return (mix(x ^ np.uint64(template + 1)) >> np.uint64(52)).astype(np.int64)


class Classes:
    """Class of each token: 0 the end, then the most frequent words, then the endings."""

    def __init__(self, top: list[int]):
        self.hash = np.array(sorted(top), np.uint64)

    def __call__(self, hash: np.ndarray, cell: np.ndarray) -> np.ndarray:
        out = (cell // PARTS).astype(np.int64) + TOP + 1
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, hash), len(self.hash) - 1)
            hit = self.hash[at] == hash
            out[hit] = at[hit] + 1
        out[hash == _END] = 0
        return out


class Chunk:
    """Texts as numbers of the chunk's distinct words: ids, which are held out, ends, words (hash, cell), and the word of each token."""

    def __init__(self, row: pa.Table):
        t = pa.ipc.open_stream(row.column("blob")[0].as_py()).read_all()
        read = lambda name, kind: np.frombuffer(t.column(name)[0].as_py(), kind)
        self.ids = t.column("ids").chunk(0).flatten()
        self.away, self.end = read("away", bool), read("end", np.int64)
        self.key, self.cell = read("key", np.uint64), read("cell", np.uint16)
        self.word = read("low", np.uint16) | read("high", np.uint16).astype(np.uint32) << np.uint32(16)

    @staticmethod
    def encode(t: pa.Table, fold: int, held: int) -> bytes:
        raw, ids = text_bytes(t.column("text")), t.column("id").combine_chunks()
        found = [split(raw[s:e]) for s, e in slices([len(x) + 8 for x in raw])]
        ends, at = [], 0
        for x in found:
            ends.append(x.end + at)
            at += len(x.hash)
        key, first, word = np.unique(np.concatenate([x.hash for x in found]), return_index=True, return_inverse=True)
        cell = np.concatenate([x.cell for x in found])[first]
        away = np.array([remainder(i, fold) == held for i in ids.to_pylist()], bool)
        one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        blobs = {"away": away, "end": np.concatenate(ends), "key": key, "cell": cell, "low": (word & 0xFFFF).astype(np.uint16), "high": (word >> 16).astype(np.uint16)}
        return ipc(pa.table({"ids": one, **{k: pa.array([x.tobytes()], pa.large_binary()) for k, x in blobs.items()}}))

    def counts(self) -> np.ndarray:
        """How often each distinct word stands in training texts."""
        train = np.repeat(~self.away, np.diff(self.end, prepend=-1))
        return np.bincount(self.word, weights=train, minlength=len(self.key)).astype(np.int64)

    def parts(self, classes: "Classes", limit: int = 1 << 17) -> Iterator[tuple[slice, np.ndarray, Tokens, np.ndarray]]:
        """The texts some at a time: which they are, the word of each token, the tokens, the class of each."""
        of_word, n = classes(self.key, self.cell), np.diff(self.end, prepend=-1)
        for s, e in slices(n.tolist(), limit):
            a, b = int(self.end[s] - n[s] + 1), int(self.end[e - 1]) + 1
            w = self.word[a:b]
            yield slice(s, e), w, Tokens(self.key[w], self.cell[w], self.end[s:e] - a), of_word[w]


def remainder(value, n: int) -> int:
    """crc32 of the id as text, modulo n; a null id counts as remainder 0."""
    return 0 if value is None else zlib.crc32(str(value).encode()) % n


def _scores(weights: np.ndarray, rows: list[np.ndarray], z: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Sums of the weights in the rows of all templates, in z; more is room of the same shape."""
    np.take(weights[0], rows[0], axis=0, out=z, mode="clip")
    for t in range(1, TEMPLATES):
        np.take(weights[t], rows[t], axis=0, out=more, mode="clip")
        z += more
    return z


def log_chances(weights: np.ndarray, rows: list[np.ndarray], outcome: np.ndarray) -> np.ndarray:
    """Natural logarithm of the softmax of each outcome; weights include the bias."""
    out, room = np.zeros(len(outcome)), np.empty((2, BATCH, CLASSES), np.float32)
    for at in range(0, len(outcome), BATCH):
        o = outcome[at : at + BATCH]
        z = _scores(weights, [r[at : at + BATCH] for r in rows], room[0, : len(o)], room[1, : len(o)])
        out[at : at + BATCH] = z[np.arange(len(o)), o]
        out[at : at + BATCH] -= np.log(np.einsum("ij->i", np.exp(z, out=z)))
    return out


def histories(rows: list[np.ndarray]) -> np.ndarray:
    """The rows of all templates as one number."""
    bits, key = ROWS.bit_length() - 1, rows[0]
    for r in rows[1:]:
        key = key << bits | r
    return key


def expect(out: np.ndarray, weights: np.ndarray, keys: list[np.ndarray]) -> None:
    """Adds to out (template, outcome, row) the counts of features with outcomes that the model expects; equal histories are worked out once.

    All arrays of a batch stay small enough for a core's cache, and nothing in it starts threads. A sum for each outcome over
    the rows of a template is one pass over contiguous numbers.
    """
    bits = ROWS.bit_length() - 1
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    room, turned = np.empty((2, BATCH, CLASSES), np.float32), np.empty((CLASSES, ADDED), np.float32)
    for at in range(0, len(key), ADDED):
        k4 = key[at : at + ADDED]
        f = [k4 >> bits * (TEMPLATES - 1 - k) & (ROWS - 1) for k in range(TEMPLATES)]
        for s in range(0, len(k4), BATCH):
            e = min(len(k4), s + BATCH)
            z = np.exp(_scores(weights, [x[s:e] for x in f], room[0, : e - s], room[1, : e - s]), out=room[0, : e - s])
            np.multiply(z.T, (times[at + s : at + e] / np.einsum("ij->i", z)).astype(np.float32), out=turned[:, s:e])
        p = turned[:, : len(k4)]
        first = np.flatnonzero(np.diff(f[0], prepend=-1))  # histories are in the order of the first template's rows
        out[0][:, f[0][first]] += np.add.reduceat(p, first, axis=1)
        for k in range(1, TEMPLATES):
            for c in range(CLASSES):
                out[k, c] += np.bincount(f[k], weights=p[c], minlength=ROWS)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 7, held: int = 2, rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Rows whose crc32(id) % fold is not held are learned from. A null text is empty: one end token. Repeated rows are
    scored (and learned from) each, a null id is in the training part, ties among the most frequent words go by their hash,
    texts are used whole, however long, other columns are ignored, and an empty table gives no rows. Without training rows every token is unknown and the classes are even.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    chunks = packed(source, chunk_bytes, lambda t: Chunk.encode(t, fold, held))
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array([(k << 64) // shards for k in range(shards)], np.uint64)

    def name(t: pa.Table) -> pa.RecordBatch:
        c = Chunk(t)
        key, cell, count = c.key, c.cell, c.counts()
        edge = np.append(np.searchsorted(key, bounds), len(key))
        used = np.flatnonzero(np.diff(edge))
        blob = lambda x: pa.array([x[edge[k] : edge[k + 1]].tobytes() for k in used], pa.binary())
        chunk = t.column("chunk")[0].as_py()
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int64()), blob(key), blob(cell), blob(count.astype("<u4"))], ["shard", "chunk", "keys", "cells", "counts"])

    def total(t: pa.Table) -> pa.Table:
        """What each chunk asked for, and one row (chunk null) for the shard: distinct words, tokens, the like for each cell, the most frequent words."""
        keys = [np.frombuffer(x, np.uint64) for x in t.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in t.column("counts").to_pylist()]).astype(np.int64)
        cells = np.concatenate([np.frombuffer(x, np.uint16) for x in t.column("cells").to_pylist()])
        key, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        count, cell = np.bincount(inverse, weights=counts).astype(np.int64), cells[first]
        back = np.split(count[inverse], np.cumsum([len(k) for k in keys])[:-1])
        known, word = count > 0, key != _END
        rare = known & word
        sums = [np.bincount(cell[rare], weights=count[rare], minlength=KINDS * PARTS), np.bincount(cell[rare], minlength=KINDS * PARTS)]
        top = np.flatnonzero(rare)
        top = top[np.lexsort((key[top], -count[top]))][:TOP]
        stats = np.concatenate([[known.sum(), count.sum()], *sums]).astype(np.int64)
        best = np.stack([key[top].view(np.int64), count[top], cell[top].astype(np.int64)])
        return pa.table({
            "chunk": pa.array([*t.column("chunk").to_pylist(), None], pa.int64()),
            "shard": pa.array([*t.column("shard").to_pylist(), t.column("shard")[0].as_py()], pa.int32()),
            "counts": pa.array([*(x.astype("<i8").tobytes() if (x >> 32).any() else x.astype("<u4").tobytes() for x in back), stats.tobytes()], pa.binary()),
            "top": pa.array([None] * len(back) + [best.tobytes()], pa.binary()),
        })

    def names(batches):
        for t in one_by_one(batches):
            yield name(t)

    named = chunks.mapInArrow(names, "shard int, chunk long, keys binary, cells binary, counts binary")
    totals = cut(named.groupBy("shard").applyInArrow(total, "chunk long, shard int, counts binary, top binary"))
    stats, best = np.zeros(2 + 2 * KINDS * PARTS, np.int64), []
    for r in totals.where("chunk is null").select("counts", "top").toLocalIterator():
        stats += np.frombuffer(r["counts"], np.int64)
        best.append(np.frombuffer(r["top"], np.int64).reshape(3, -1))
        if len(best) > 64:
            best = [_best(best)]
    top = _best(best) if best else np.zeros((3, 0), np.int64)
    distinct_words, tokens = int(stats[0]), int(stats[1])
    n_cell, v_cell = stats[2 : 2 + KINDS * PARTS].astype(float), stats[2 + KINDS * PARTS :].astype(float)
    np.subtract.at(n_cell, top[2], top[1])
    np.subtract.at(v_cell, top[2], 1)
    classes = Classes(top[0].view(np.uint64).tolist())
    within = np.log10(n_cell + v_cell + 1)

    def summed(part) -> np.ndarray:
        """The sum over all chunks of an array (both factors' templates, rows, outcomes) that part() makes of each, by blocks.

        A task sends one array, so tasks take TASK_BYTES of packed chunks where there are enough for all cores.
        """

        def run(batches):
            acc = None
            for t in one_by_one(batches):
                got = part(t)
                acc = got if acc is None else acc + got
            if acc is not None:
                parts = acc.reshape(-1, BLOCK_ROWS, CLASSES)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "sums"])

        def add(batches):
            state: dict[int, np.ndarray] = {}
            for b in batches:
                for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    v = np.frombuffer(x, np.float32).astype(np.float64)
                    state[k] = state[k] + v if k in state else v
            yield pa.RecordBatch.from_arrays([pa.array(list(state), pa.int32()), pa.array([x.tobytes() for x in state.values()], pa.binary())], ["block", "sums"])

        bytes_of = chunks.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
        few = max(2 * spark.sparkContext.defaultParallelism, math.ceil(bytes_of / TASK_BYTES))
        out = np.zeros((2 * TEMPLATES * ROWS // BLOCK_ROWS, BLOCK_ROWS * CLASSES))
        for r in chunks.coalesce(few).mapInArrow(run, "block int, sums binary").repartition("block").mapInArrow(add, "block int, sums binary").toLocalIterator():
            out[r["block"]] = np.frombuffer(r["sums"])
        return out.reshape(2, TEMPLATES, ROWS, CLASSES)

    def together(t: pa.Table) -> np.ndarray:
        out, chunk = np.zeros((2, TEMPLATES, ROWS * CLASSES), np.int64), Chunk(t)
        for of, _, x, cls in chunk.parts(classes):
            for factor, (rows, outcome, _) in zip(out, x.rows(~chunk.away[of][x.doc], cls), strict=True):
                for k, row in enumerate(rows):
                    factor[k] += np.bincount(row * CLASSES + outcome, minlength=ROWS * CLASSES)
        return out.astype(np.float32)

    seen = summed(together)
    factors = [Factor(x) for x in seen]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast([f.weights for f in factors])

        def expected(t: pa.Table, sent=sent) -> np.ndarray:
            out, chunk = np.zeros((2, TEMPLATES, CLASSES, ROWS)), Chunk(t)
            keys = [[histories(rows) for rows, _, _ in x.rows(~chunk.away[of][x.doc], cls)] for of, _, x, cls in chunk.parts(classes)]
            for factor, weights, found in zip(out, sent.value, zip(*keys, strict=True), strict=True):
                expect(factor, weights, found)
            return out.transpose(0, 1, 3, 2).astype(np.float32, order="C")

        for factor, sums in zip(factors, summed(expected), strict=True):
            factor.update(sums)
    sent = spark.sparkContext.broadcast([f.weights for f in factors])
    scale = math.log10(tokens + distinct_words + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left)
        key = chunk.key
        edge = np.append(np.searchsorted(key, bounds), len(key))
        count = np.zeros(len(key), np.int64)
        for k, x in zip(right.column("shard").to_pylist(), right.column("counts").to_pylist(), strict=True):
            n = int(edge[k + 1] - edge[k])
            count[edge[k] : edge[k + 1]] = np.frombuffer(x, "<u4" if len(x) == 4 * n else "<i8")
        out = []
        for of_texts, word, x, cls in chunk.parts(classes):
            n, c, logp = len(x.end), count[word], np.zeros(len(word))
            for weights, (rows, outcome, of) in zip(sent.value, x.rows(np.ones(len(c), bool), cls), strict=True):
                logp[of] += log_chances(weights, rows, outcome) / math.log(10)
            rare = cls > TOP
            logp[rare] += np.log10(c[rare] + 1) - within[x.cell[rare]]
            base = np.log10(c + 1) - scale
            sums = [np.bincount(x.doc, weights=v, minlength=n) for v in (np.ones(len(c)), c > 0, base, logp)]
            out.append(pa.table({
                "id": chunk.ids[of_texts], "held_out": pa.array(chunk.away[of_texts]), "n_tokens": pa.array(sums[0].astype(np.int64)), "n_known": pa.array(sums[1].astype(np.int64)),
                "train_tokens": pa.array(np.full(n, tokens, np.int64)), "base_score": pa.array(sums[2]), "score": pa.array(sums[3]),
            }))
        return pa.concat_tables(out)

    answers = totals.where("chunk is not null").select("chunk", "shard", "counts")
    out = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


class Factor:
    """Weights of one softmax: those of the first template include the bias, the logarithm of the outcomes' shares."""

    def __init__(self, seen: np.ndarray):
        self.seen, self.each = seen, seen.sum(2, keepdims=True)
        self.prior = (seen[0].sum(0) + 1) / (seen[0].sum() + CLASSES)
        self.pull = prior_strength(seen, self.prior)
        self._set(START * (np.log((seen + self.pull * self.prior) / (self.each + self.pull)) - np.log(self.prior)))

    def _set(self, raw: np.ndarray) -> None:
        self.raw = np.clip(raw, -LARGEST, LARGEST)
        self.weights = self.raw.astype(np.float32)
        self.weights[0] += np.log(self.prior).astype(np.float32)

    def update(self, expected: np.ndarray) -> None:
        """One step along the mean gradient of each row."""
        mean = (self.seen - expected) / (self.each + self.pull)
        self._set(self.raw + RATE * mean / np.sqrt(self.prior * (1 - self.prior) + 1e-4))


def prior_strength(seen: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """For each template, the number of prior counts under which its counts best predict each token from all the others."""
    out = []
    for counts in seen:
        total = counts.sum(1, keepdims=True)
        gain = []
        for a in PRIORS:
            left = np.log((np.maximum(counts - 1, 0) + a * prior) / (np.maximum(total - 1, 0) + a)) - np.log(prior)
            gain.append(float((counts * left).sum()))
        out.append(PRIORS[int(np.argmax(gain))])
    return np.array(out)[:, None, None]


def _best(parts: list[np.ndarray]) -> np.ndarray:
    """The most frequent words of several lists."""
    both = np.concatenate(parts, axis=1)
    return both[:, np.lexsort((both[0], -both[1]))[:TOP]]
