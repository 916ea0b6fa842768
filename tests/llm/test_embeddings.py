import numpy as np
import pytest

from arborspark.llm.embeddings import buckets, hadamard, near_vectors


def brute(rows):
    good = [r[1] is not None and r[2] is not None and r[0] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(x != 0 for x in r[1]) for r in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if good[a] and good[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                u, v = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                    links[a] += 1
                    links[b] += 1
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return [(links[i], rows[find(i)][0]) for i in range(n)]


def test_hadamard_is_orthonormal():
    h = hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))
    assert buckets(np.random.default_rng(0).normal(size=(5, 10))).shape == (5, 32)


def test_links_equal_brute_force(spark, monkeypatch):
    from arborspark.llm import embeddings

    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        c = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 30))):
            rows.append((len(rows), (c + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2])).astype(np.float32).tolist(), int(g % 3)))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, rows[0][1], None), (905, [], 0), (906, [float("inf")] * 16, 0), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0), (909, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, id string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()}
    assert [got[r[0]] for r in rows] == brute(rows)


def test_repeated_ids_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1), (3, [0.0, 1.0], 2), (4, [0.0, 2.0], 2), (5, [-0.0, 1.0], 1)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    want = [(r[0], *x) for r, x in zip(rows, brute(rows), strict=True)]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(want)


def test_recall_through_the_operator(spark):
    """Pairs with a cosine just above the threshold, each a group of its own: all are linked."""
    rng = np.random.default_rng(6)
    u = rng.normal(size=(600, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.9801 * u + np.sqrt(1 - 0.9801**2) * w
    rows = [(2 * i + k, x.tolist(), 0) for i in range(600) for k, x in enumerate((u[i], v[i]))]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.where("n_links = 1 and component_id = vec_id - vec_id % 2").count() >= 1199


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(3000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=(3000, 64))
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.98 * u + np.sqrt(1 - 0.98**2) * w
    a, b = buckets(u), buckets(v)
    met = np.zeros(3000, bool)
    for t in range(8):
        met |= (a[:, 4 * t : 4 * t + 4, None] == b[:, None, 4 * t : 4 * t + 4]).any((1, 2))
    assert met.mean() >= 0.999


@pytest.mark.parametrize("rows", [[], [(None, [1.0], 1), (3, [1.0], 1), (3, [1.0], 1)]])
def test_empty_null_and_repeated(spark, rows):
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got) == ([(0, 0, 0, False), (3, 1, 3, True), (3, 1, 3, True)] if rows else [])
