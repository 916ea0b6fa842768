import random
from itertools import combinations

import numpy as np
import pytest

from arborspark.llm.blocks import deal
from arborspark.llm.components import components, least_reachable
from arborspark.llm.decontaminate import words
from arborspark.llm.jaccard import BLOCK, _exact_links, keep_one, near_duplicates, runs_for


def brute(texts):
    sets = []
    for t in texts:
        w = words((t or "").encode())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, root = [0] * len(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(find(i), links[i]) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts(prose):
    rng = random.Random(3)
    out = [None, "", "!!", "one", "One.", "two words", "a b c d", "a b c d e"]
    for g in range(6):
        base = prose(200 + g, 60 + 40 * g).split()
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
            out.append(" ".join(w))
    out += [prose(210, 150)] * 4
    line = prose(220, 12)
    out += [line + " " + prose(300 + i, 60) for i in range(30)]
    return out


def test_links_and_classes_equal_brute_force(documents, texts):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(documents(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_a_large_group_of_near_copies(documents, prose, monkeypatch):
    from arborspark.llm import jaccard

    for name, value in (("BLOCK", 16), ("MEET_BLOCK", 16), ("LEAF", 20)):
        monkeypatch.setattr(jaccard, name, value)
    base = prose(7, 120).split()
    texts = [" ".join([*base[:i], f"q{i}", *base[i + 1 :]]) for i in range(100)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(documents(texts)).collect()}
    assert [got[i] for i in range(100)] == brute(texts)


def test_one_of_each_class_stays(documents, prose):
    docs = documents([prose(1, 60)] * 3 + [prose(2, 60), None, "", prose(3, 60)], ids=[5, 6, 6, 7, 8, 9, None])
    out = keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, 5), (False, 7), (False, 8), (False, 9), (True, 0)]
    assert keep_one(documents([])).count() == 0


def test_null_ids_and_repeated_rows(documents, prose):
    rows = near_duplicates(documents([prose(1, 60)] * 3, ids=[4, 4, None])).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"], r["kept"]) for r in rows) == [(0, 0, 0, True), (4, 4, 1, True), (4, 4, 1, True)]


def test_any_ids_and_clashing_columns(spark, prose):
    """Ids may be strings, repeat with other texts, and stand beside columns with names that are used inside."""
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    near = a.replace(a.split()[30], "changed", 1)
    rows = [("d", a, 1), ("b", near, 2), ("c", b, 3), ("c", a, 4), ("e", b, 5), ("f", c, 6), ("f", c, 7)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _row int").selectExpr("*", "_row AS rep", "_row AS n", "_row AS component")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in near_duplicates(docs).collect())
    assert got == [("b", "b", 2), ("c", "b", 2), ("c", "c", 1), ("d", "b", 2), ("e", "c", 1), ("f", "f", 1), ("f", "f", 1)]
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    left = {r["doc_id"]: r["_row"] for r in kept.collect()}
    assert set(left) == {"b", "e", "f"} or set(left) == {"b", "c", "f"}
    assert kept.count() == 3


def test_recall_at_the_threshold(documents, prose):
    """Pairs of Jaccard similarity from 0.80 to 0.82, each met or not: all links of brute force are found."""
    rng, texts = random.Random(8), []
    for i in range(150):
        w = prose(1000 + i, 150).split()
        x = list(w)
        for at in rng.sample(range(10, 140, 6), 3):
            x[at] = f"y{rng.randrange(10**6)}"
        texts += [" ".join(w), " ".join(x)]
    want = brute(texts)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(documents(texts)).collect()}
    assert sum(n for _, n in want) > 200
    assert [got[i] for i in range(len(texts))] == want


def test_what_is_dealt_for_a_class_of_5000(spark):
    """Each set goes to five tasks, as the few shingles in which it differs from one of the class."""
    members = spark.range(5000).selectExpr("id", "0 AS component", "5000 AS m")
    assert deal(members, "component", "m", "id", BLOCK).count() == 5 * 5000


def test_links_from_differences():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.choice(60, int(rng.integers(20, 60)), replace=False)).astype(np.uint64) for _ in range(40)]
    base = sets[0]
    differ = [np.setxor1d(s, base) for s in sets]
    less = np.array([len(np.setdiff1d(base, s)) for s in sets])
    got = _exact_links(np.array([len(s) for s in sets]), less, len(base), differ, 0.5)
    want = [[i != j and len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert got.tolist() == want


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components_of_a_long_path(spark, monkeypatch, few):
    from arborspark.llm import components as module

    monkeypatch.setattr(module, "FEW", few)
    n = 200 if few else 12
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_least_reachable_nodes():
    rng = np.random.default_rng(1)
    order = rng.permutation(500)
    node, to = least_reachable(np.concatenate([order[:-1], [900, 901]]), np.concatenate([order[1:], [901, 902]]))
    assert node.tolist() == [*range(500), 900, 901, 902] and to.tolist() == [0] * 500 + [900] * 3


def test_runs_grow_with_the_recall():
    assert runs_for(0.9) < runs_for(0.9999)
