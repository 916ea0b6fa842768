"""Jaccard self-join of documents on word shingles by chosen paths.

Every document is the set of its runs of five lower-cased words. Equal sets are folded into one representative with a
weight. A set is embedded as one value for each of ``BINS`` coordinates (one-permutation hashing, empty coordinates
filled from others), which are the tokens on which a run splits the collection: a node of the tree samples coordinates
and sends each set to the child named by its value there, recursively while a bucket is larger than ``LEAF``, to a depth of
``DEPTH``. Buckets are then compared by brute force, in blocks. Runs are repeated until a pair at the threshold is met with
the target recall. What is met is filtered by the sketches (five standard deviations below the threshold), joined into
groups, and each group's sets are compared exactly; links of a group are counted where they are found, never listed. What
is dealt for that is not the sets but the shingles in which each differs from one set of its group, which gives the same
intersections and is short for near-copies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import deal, deal_apart, forest, grouped
from .common import ALPHANUMERIC, LOWER, Words, bounded_batches, cut, join_hot, mix, release, slices, spread, text_bytes, window_hash
from .components import components, named

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
BINS, LEAF, DEPTH, LAMBDA, SIGMAS = 64, 256, 3, 0.7, 5.0
MEET_BLOCK, BLOCK, FIRST_RUNS = 256, 1024, 2
_BIN_BITS = BINS.bit_length() - 1


def shingles(raw: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, ordered by both; a text of fewer words, but not none, has one."""
    w = Words([t.translate(LOWER) for t in raw], ALPHANUMERIC)
    n = len(w.start) - width + 1
    doc, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n > 0:
        inside = w.doc[:n] == w.doc[width - 1 :]
        doc, h = w.doc[:n][inside], window_hash(w.hash[0], width)[inside]
    few = np.flatnonzero((w.count > 0) & (w.count < width))
    if len(few):
        one = [window_hash(w.hash[0][w.first[d] : w.first[d + 1]], int(w.count[d]))[0] for d in few]
        doc, h = np.concatenate([doc, few]), np.concatenate([h, np.array(one, np.uint64)])
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(raw) < 1 << 16 else np.int64), kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _sketches(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """A value for each coordinate, 0 where no shingle falls."""
    cell = doc * BINS + (h >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    out = np.zeros(n * BINS, np.uint32)
    out[cell[first]] = ((h[first] >> np.uint64(20)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
    return out.reshape(n, BINS)


def _filled(s: np.ndarray) -> np.ndarray:
    """Empty coordinates take the value of others, in an order that depends on the coordinate alone."""
    s, base = s.copy(), s
    rng = np.random.default_rng(17)
    orders = np.stack([rng.permutation(BINS) for _ in range(BINS)])
    for k in range(BINS):
        row, col = np.nonzero(s == 0)
        if not len(row):
            break
        s[row, col] = base[row, orders[col, k]]
    return s


def _children(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates that nodes sample: one or two, 1 / LAMBDA on average; the second is -1 where there is none."""
    a = mix(path)
    one = (a >> np.uint64(8)).astype(np.int64) % BINS
    two = (one + 1 + (a >> np.uint64(20)).astype(np.int64) % (BINS - 1)) % BINS
    return one, np.where((a >> np.uint64(40)).astype(np.int64) % 1000 < round(1000 * (1 / LAMBDA - 1)), two, -1)


def _step(path: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(path ^ mix((coordinate.astype(np.uint64) << np.uint64(32)) | value.astype(np.uint64)))


def runs_for(recall: float, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold shares a bucket with the target recall, were every bucket as deep as can be."""
    both = 1 / LAMBDA - 1
    met = (1 - both) * threshold + both * (1 - (1 - threshold) ** 2)
    return max(FIRST_RUNS + 1, math.ceil(math.log(1 - recall) / math.log(1 - met**depth)))


def _sketch_links(a: np.ndarray, b: np.ndarray, threshold: float, sigmas: float) -> np.ndarray:
    out = np.zeros((len(a), len(b)), bool)
    for i in range(len(a)):  # a row at a time bounds the memory
        some = (a[i] != 0) | (b != 0)
        n = some.sum(1)
        out[i] = ((a[i] == b) & some).sum(1) >= n * threshold - sigmas * np.sqrt(n * threshold * (1 - threshold))
    return out


def _exact_links(size: np.ndarray, less: np.ndarray, base: int, differ: list[np.ndarray], threshold: float) -> np.ndarray:
    """The matrix of pairs of sets whose Jaccard similarity reaches the threshold.

    Each set A is given by its size, by the shingles in which it differs from a common set C of base shingles, and by how
    many of those are missing from A. As C holds no shingle that is added and every one that is missing,
    |A and B| = |C| - missing(A) - missing(B) + |differ(A) and differ(B)|.
    """
    n = len(size)
    doc = np.repeat(np.arange(n), [len(d) for d in differ])
    _, col, many = np.unique(np.concatenate(differ), return_inverse=True, return_counts=True) if n else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
    shared = many[col] > 1
    doc, col = doc[shared], col[shared]
    _, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    both = np.zeros((n, n), np.float32)
    last = int(col[-1]) + 1 if len(col) else 0
    for at in range(0, last, 2048):
        s, e = np.searchsorted(col, [at, at + 2048])
        x = np.zeros((n, min(2048, last - at)), np.float32)
        x[doc[s:e], col[s:e] - at] = 1
        both += x @ x.T
    both += (base - less)[:, None] - less[None, :]
    union = size[:, None] + size[None, :] - both
    out = both >= threshold * union - 1e-6 * np.maximum(union, 1)
    np.fill_diagonal(out, False)
    return out


def _signature(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each set and a hash of it, as two numbers."""
    size = np.bincount(doc, minlength=n)
    at, out = np.cumsum(size) - size, []
    for salt in (0, 0x5851F42D4C957F2D):
        m = np.append(mix(h ^ np.uint64(salt)), np.uint64(0))
        out.append(np.where(size > 0, np.add.reduceat(m, np.minimum(at, len(h))), np.uint64(0)).view(np.int64))
    return size.astype(np.int64), out[0], out[1]


def _emit(ids: np.ndarray, linked: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """For each member with a link: the member it is joined to and the weight of its links."""
    root = forest(linked)
    on = np.flatnonzero(linked.any(1))
    total = linked[on] @ weight
    return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[root[on]]), pa.array(total.astype(np.int64))], ["a", "b", "weight"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """id, class_id, n_links, kept for each row.

    class_id is the smallest id reachable by links of similarity >= threshold (equal sets are links), n_links counts the
    other rows linked directly, kept is id = class_id. Ids are of any type that has an order, and need not be distinct: rows
    of one id are documents of their own. A similarity of exactly the threshold links. A text without words and a row
    without an id link with nothing (a null id has class null and is kept). Texts are used whole, however long; other
    columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = spread(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")))
    kind = source.schema["id"].dataType.simpleString()
    known = source.where("id is not null")

    def embed(batches):
        for b in batches:
            raw = text_bytes(b.column(1))
            for s, e in slices([len(t) for t in raw]):
                n = e - s
                doc, h = shingles(raw[s:e], width)
                size, s1, s2 = _signature(doc, h, n)
                sk = _sketches(doc, h, n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, n), pa.array(size), pa.array(s1), pa.array(s2), pa.array([x.tobytes() for x in sk], pa.binary())], ["id", "size", "s1", "s2", "sketch"])

    sets = cut(known.mapInArrow(embed, f"id {kind}, size long, s1 long, s2 long, sketch binary"))
    folded = sets.where("size > 0").groupBy("s1", "s2", "size").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.any_value("sketch").alias("sketch"))
    folded = cut(folded.withColumn("rep", F.monotonically_increasing_id()))
    runs = runs_for(recall, threshold)

    reps = folded.select(F.col("rep").alias("id"), "sketch")

    def tree(first: int, last: int) -> tuple[DataFrame, list[DataFrame]]:
        """(path, id, n) of the buckets with company in which runs first to last - 1 leave the sets, and what holds them."""

        def split(batches):
            """The children of nodes, from (id, path, sketch); path null stands for the roots of all runs."""
            for b in batches:
                ids, sk = np.asarray(b.column(0)), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(-1, BINS)
                sk = _filled(sk)
                roots = b.column(1).null_count > 0
                for r in range(first, last) if roots else [0]:
                    path = np.full(len(ids), mix(np.array([r + 1], np.uint64))[0]) if roots else np.asarray(b.column(1)).view(np.uint64)
                    for c in _children(path):
                        on = np.flatnonzero(c >= 0)
                        if len(on):
                            yield pa.RecordBatch.from_arrays([pa.array(_step(path[on], c[on], sk[on, c[on]]).view(np.int64)), pa.array(ids[on])], ["path", "id"])

        leaves, done = None, []
        nodes = reps.select("id", F.lit(None).cast("long").alias("path"), "sketch")
        for depth in range(1, DEPTH + 1):
            children = cut(nodes.mapInArrow(split, "path long, id long"))
            counts = cut(children.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
            rows = cut(children.join(counts, "path"))
            last = depth == DEPTH or counts.where(F.col("n") > LEAF).isEmpty()
            release(children, counts)
            done.append(rows)
            if not last:
                nodes = rows.where(F.col("n") > LEAF).select("path", "id").join(reps, "id").select("id", "path", "sketch")
                rows = rows.where(F.col("n") <= LEAF)
            leaves = rows if leaves is None else leaves.unionByName(rows)
            if last:
                break
        return leaves, done

    def meet(t: pa.Table) -> pa.RecordBatch | None:
        ids, b = np.asarray(t.column("id")), np.asarray(t.column("_b"))
        if len(ids) < 2 or _one_side(t, b):
            return None
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint32).reshape(-1, BINS)
        linked = _sketch_links(sk, sk, threshold, SIGMAS)
        np.fill_diagonal(linked, False)
        same = b[:, None] == b[None, :]
        root = forest(linked & same)
        if same.all():
            on = np.flatnonzero(root != np.arange(len(root)))
            pairs = np.stack([on, root[on]], axis=1)
        else:  # trees within the blocks are another task's; one edge for each two trees that meet
            x, y = np.nonzero(linked & ~same)
            pairs = np.unique(np.stack([root[x], root[y]], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], ["a", "b"])

    def met(dealt: DataFrame) -> DataFrame:
        """Links between sets that meet; dealt has a copy of each row for each pair of blocks."""
        rows = dealt.select("path", "_i", "_j", "_b", "id").join(reps, "id")
        return grouped(rows.select("path", "_i", "_j", "_b", "id", "sketch"), ["path", "_i", "_j"], "id", meet, "a long, b long")

    # what the first runs have brought into one group is compared within the group later, so later runs look only for
    # pairs of different groups: buckets with one group are left out, and large groups are not paired with themselves
    leaves, held = tree(0, FIRST_RUNS)
    group = components(met(deal(leaves, "path", "n", "id", MEET_BLOCK)))
    release(*held)
    leaves, held = tree(FIRST_RUNS, runs)
    known_groups = leaves.join(group, F.col("id") == F.col("node"), "left").select("path", "id", F.coalesce("component", "id").alias("g"))
    known_groups = cut(known_groups)
    release(*held)
    open_paths = cut(known_groups.groupBy("path").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("path"))
    later = cut(met(deal_apart(cut(known_groups.join(open_paths, "path")), "path", "g", "id", MEET_BLOCK)))
    release(known_groups, open_paths)
    group = components(later.unionByName(group.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    release(later)

    # the sets of all groups, each once: rows are found by the least id of their set and taken if they hold that very set
    sizes = cut(group.groupBy("component").agg(F.count("*").alias("m")))
    grouped_sets = cut(join_hot(group, sizes, "component").join(folded.select(F.col("rep").alias("node"), "least", "s1", "s2", "n"), "node"))
    wanted = grouped_sets.select(F.col("least").alias("id"), "node", "component", "m", F.col("n").alias("w"), F.struct("s1", "s2").alias("sig"))

    def reread(batches):
        for b in batches:
            raw, want = text_bytes(b.column("text")), b.column("sig").flatten()
            w1, w2 = np.asarray(want[0]), np.asarray(want[1])
            for s, e in slices([len(t) for t in raw]):
                doc, h = shingles(raw[s:e], width)
                size, s1, s2 = _signature(doc, h, e - s)
                edge = np.cumsum(size)
                on = np.flatnonzero((s1 == w1[s:e]) & (s2 == w2[s:e]))
                if len(on):
                    take = pa.array(on + s)
                    kept = [b.column(c).take(take) for c in ("node", "component", "m", "w")]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array([h[edge[i] - size[i] : edge[i]].tobytes() for i in on], pa.binary())], ["id", "component", "m", "w", "hashes"])

    found = known.join(wanted, "id").select("text", "node", "component", "m", "w", "sig").mapInArrow(reread, "id long, component long, m long, w long, hashes binary")
    found = cut(found.dropDuplicates(["id"]) if _repeated(sets) else found)
    place = F.pmod(F.xxhash64("id", F.lit(7)), F.ceil(F.col("m") / BLOCK).cast("int")).alias("part")
    bases = found.where("id = component").select("component", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / BLOCK).cast("int") - 1)).alias("part"), F.col("hashes").alias("base"))

    def subtract(batches):
        for b in batches:
            less, base, differ, sizes = [], [], [], []
            for mine, common in zip(b.column("hashes").to_pylist(), b.column("base").to_pylist(), strict=True):
                x, c = np.frombuffer(mine, np.uint64), np.frombuffer(common, np.uint64)
                other = np.setxor1d(x, c, assume_unique=True)
                missing = (len(c) + len(other) - len(x)) // 2
                sizes.append(len(x))
                less.append(missing)
                base.append(len(c))
                differ.append(other.tobytes())
            kept = [b.column(c) for c in ("id", "component", "m", "w")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, pa.int64()) for v in (sizes, less, base)), pa.array(differ, pa.binary())], ["id", "component", "m", "w", "size", "less", "base", "differ"])

    against = found.select("id", "component", "m", "w", "hashes", place).join(bases, ["component", "part"]).drop("part")
    members = cut(against.mapInArrow(subtract, "id long, component long, m long, w long, size long, less long, base long, differ binary"))

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        ids, b = np.asarray(t.column("id")), np.asarray(t.column("_b"))
        if len(ids) < 2 or _one_side(t, b):
            return None
        differ = [np.frombuffer(x, np.uint64) for x in t.column("differ").to_pylist()]
        linked = _exact_links(np.asarray(t.column("size")), np.asarray(t.column("less")), t.column("base")[0].as_py(), differ, threshold)
        if (b != b[0]).any():
            linked &= b[:, None] != b[None, :]
        return _emit(ids, linked, np.asarray(t.column("w")))

    dealt = deal(members, "component", "m", "id", BLOCK).select("component", "_i", "_j", "_b", "id", "w", "size", "less", "base", "differ")
    links = cut(grouped(dealt, ["component", "_i", "_j"], "id", compare, "a long, b long, weight long"))
    release(group, sizes, found, members)
    linked = components(links.select("a", "b"))
    classes = linked.withColumnRenamed("component", "label")
    least = classes.join(folded.select(F.col("rep").alias("node"), "least"), "node").groupBy("label").agg(F.min("least").alias("name"))
    direct = links.groupBy("a").agg(F.sum("weight").alias("direct"))
    final = folded.select("s1", "s2", "size", "rep", "least", "n").join(named(classes, least).withColumnRenamed("node", "rep"), "rep", "left").join(direct.withColumnRenamed("a", "rep"), "rep", "left")
    sig = F.struct("s1", "s2", "size").alias("sig")
    final = cut(final.select(sig, F.coalesce("name", "least").alias("class_id"), (F.col("n") - 1 + F.coalesce("direct", F.lit(0))).alias("n_links")))
    release(grouped_sets, links, linked)
    rows = sets.where("size > 0").select("id", sig)
    out = join_hot(rows, final, "sig").select("id", "class_id", "n_links")
    out = out.unionByName(sets.where("size = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
    nameless = source.where("id is null").select("id", F.lit(None).cast(kind).alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    out = out.unionByName(nameless).withColumn("kept", F.col("id").eqNullSafe(F.col("class_id")))
    return out.withColumnRenamed("id", id_col)


def _one_side(t: pa.Table, block: np.ndarray) -> bool:
    """Whether a pair of blocks has rows of one only; pairs within a block are another task's."""
    return t.column("_i")[0].as_py() != t.column("_j")[0].as_py() and (block == block[0]).all()


def _repeated(sets: DataFrame) -> bool:
    return not sets.groupBy("id").count().where("count > 1").isEmpty()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class of near_duplicates(), the one with the smallest id; all columns stay as they are.

    Rows without an id stay, and so do texts without words. Of rows that share an id one stays, whichever sorts first by
    text. Ids are of any type that has an order; column names are free; an empty table gives an empty one.
    """
    names, number = docs.columns, "_row"
    while number in names:
        number += "_"
    if not docs.where(docs[id_col].isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        first = Window.partitionBy(docs[id_col]).orderBy(docs[text_col])
        numbered = docs.where(docs[id_col].isNotNull()).withColumn(number, F.row_number().over(first))
        docs = numbered.where(F.col(number) == 1).select(*names).unionByName(docs.where(docs[id_col].isNull()))
    source = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    keep = near_duplicates(source, "id", "text", **options).where("kept").select(F.col("id").alias(number))
    known = docs.join(keep, docs[id_col] == keep[number], "left_semi")
    return known.unionByName(docs.where(docs[id_col].isNull()))
