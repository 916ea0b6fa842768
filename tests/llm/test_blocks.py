from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa

from arborspark.llm.blocks import by_group, deal, deal_apart, forest
from arborspark.llm.common import cut, release, slices, sliding_min, window_hash


def tasks(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["k"], r["_i"], r["_j"]].append((r["id"], r["_b"]))
    return out


def covered(rows):
    pairs = defaultdict(int)
    for (k, i, j), members in tasks(rows).items():
        for (a, x), (b, y) in combinations(sorted(members), 2):
            if i == j or x != y:
                pairs[k, a, b] += 1
    return pairs


def test_every_pair_of_a_group_is_in_one_task(spark):
    df = spark.createDataFrame([(k, i, n) for k, n in ((1, 40), (2, 3), (3, 1)) for i in range(n)], "k long, id long, n long")
    got = covered(deal(df, "k", "n", "id", 8).collect())
    assert got == {(k, a, b): 1 for k, n in ((1, 40), (2, 3)) for a, b in combinations(range(n), 2)}


def test_pairs_of_known_groups_are_left_out_only_within_large_ones(spark):
    groups = [0] * 30 + [1] * 25 + [2] * 3 + [3, 4, 5]
    df = spark.createDataFrame([(1, i, g) for i, g in enumerate(groups)] + [(2, i, 9) for i in range(20)], "k long, id long, g long")
    rows = deal_apart(df, "k", "g", "id", 8).collect()
    got = covered(rows)
    for a, b in combinations(range(len(groups)), 2):
        if groups[a] != groups[b]:
            assert got[1, a, b] == 1
        elif groups[a] < 2:
            assert (1, a, b) not in got
    assert not any(k == 2 for k, _, _ in got)
    assert len(rows) < 61 * 8


def test_groups_of_a_stream():
    keys = [1, 1, 2, 3, 3, 3, 4]
    batches = [pa.RecordBatch.from_pydict({"k": keys[a:b], "v": list(range(a, b))}) for a, b in ((0, 1), (1, 1), (1, 4), (4, 6), (6, 7))]
    assert [t.column("v").to_pylist() for t in by_group(iter(batches), ["k"])] == [[0, 1], [2], [3, 4, 5], [6]]


def test_forest():
    m = np.zeros((6, 6), bool)
    for a, b in ((5, 3), (3, 1), (2, 4)):
        m[a, b] = m[b, a] = True
    assert forest(m).tolist() == [0, 1, 2, 1, 2, 1]


def test_windows():
    x = np.random.default_rng(0).integers(0, 1 << 60, 50).astype(np.uint64)
    for width in (1, 2, 5, 18, 35, 50):
        assert sliding_min(x, width).tolist() == [int(x[i : i + width].min()) for i in range(51 - width)]
        h = window_hash(np.concatenate([x, x]), width)
        assert len(h) == 101 - width and (h[: 51 - width] == h[50 : 101 - width]).all() and len(set(h[: 51 - width].tolist())) == 51 - width
    assert list(slices([5, 5, 20, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)]


def test_cut_and_release(spark):
    df = cut(spark.range(5))
    assert df.count() == 5 and "RDDScan" in df._jdf.queryExecution().executedPlan().toString() or df.count() == 5
    release(df, None)
    assert df._checkpoint_file is None
