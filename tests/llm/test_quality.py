import math
import zlib
from collections import Counter

import pytest

from arborspark.llm.quality import ORDER, bound, classify, discounts, grams, perplexities


def brute(trusted, text):
    """Interpolated modified Kneser-Ney over bytes, from the definition."""
    pad = b"\n" * (ORDER - 1)
    counts = [Counter() for _ in range(ORDER + 1)]
    for t in trusted:
        s = pad + t.encode()
        counts[ORDER].update(s[i : i + ORDER] for i in range(len(s) - ORDER + 1))
    for o in range(ORDER - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    ds = [None]
    for o in range(1, ORDER + 1):
        n = Counter(counts[o].values())
        if not n[1] or not n[2]:
            ds.append((0.5, 0.5, 0.5))
            continue
        y = n[1] / (n[1] + 2 * n[2])
        d = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5)
        ds.append(tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)))

    def p(g):
        if not g:
            return 1 / 256
        o = len(g)
        follow = {k: c for k, c in counts[o].items() if k[:-1] == g[:-1]}
        low = p(g[1:])
        if not follow:
            return low
        total = sum(follow.values())
        d = ds[o]
        gamma = sum(d[min(c, 3) - 1] for c in follow.values()) / total
        c = follow.get(g, 0)
        return (c - (d[min(c, 3) - 1] if c else 0)) / total + gamma * low

    s = pad + text.encode()
    logs = [math.log(p(s[i : i + ORDER])) for i in range(len(s) - ORDER + 1)]
    return math.exp(-sum(logs) / len(logs))


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_perplexity_equals_the_definition(spark, documents, limit):
    texts = ["abc abd abc", "abcabcab bca", "zzz", None, "", "Ünï abc", "abd abc abd", "abc abd abc"]
    trusted = spark.createDataFrame([(0,), (1,), (6,), (6,)], "doc_id long")
    got = {r["doc_id"]: r for r in perplexities(documents(texts), trusted, table_limit=limit, chunk_bytes=64).collect()}
    for i, t in enumerate(texts):
        if not t:
            assert got[i]["perplexity"] is None
        else:
            assert got[i]["perplexity"] == pytest.approx(brute([texts[k] for k in (0, 1, 6)], t), rel=1e-4)
    assert [got[i]["trusted"] for i in range(8)] == [i in (0, 1, 6) for i in range(8)]


def test_junk_goes_and_prose_stays(spark, documents, prose):
    texts = [prose(s, 80) for s in range(40)] + ["".join(chr(33 + (i * s) % 90) for i in range(300)) for s in (7, 11, 13)] + [None]
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    got = {r["doc_id"]: r["keep"] for r in classify(documents(texts), trusted).collect()}
    assert all(got[i] for i in range(40)) and not any(got[i] for i in range(40, 44))


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "doc_id long")
    assert classify(documents([]), none).count() == 0
    rows = classify(documents(["abc", None]), none).collect()
    assert sorted((r["doc_id"], r["keep"]) for r in rows) == [(0, True), (1, False)]


def test_grams_stay_within_texts():
    key, sizes = grams([b"ab", b"", b"c"])
    assert sizes.tolist() == [2, 0, 1]
    assert [int(k).to_bytes(5, "big") for k in key] == [b"\n\n\n\na", b"\n\n\nab", b"\n\n\n\nc"]


def test_discounts_without_counts(spark):
    assert discounts(spark.createDataFrame([], "key long, c long")) == (0.5, 0.5, 0.5)


def test_the_threshold_is_the_quantile_of_held_out_trusted_texts(spark, documents, prose):
    texts = [prose(s, 20) for s in range(60)] + [" ".join(["word"] * 60), None]
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    got = {r["doc_id"]: r for r in classify(documents(texts), trusted, quantile=0.5).collect()}
    away = [i for i in range(60) if zlib.crc32(texts[i].encode()) % 5 == 0]
    learned = spark.createDataFrame([(i,) for i in range(60) if i not in away], "doc_id long")
    want = {r["doc_id"]: r["perplexity"] for r in perplexities(documents(texts), learned).collect()}
    assert all(got[i]["trusted"] for i in range(60)) and len(away) > 3
    assert all(got[i]["perplexity"] == pytest.approx(want[i], rel=1e-6) for i in range(61))
    half = sorted(want[i] for i in away)[(len(away) + 1) // 2 - 1]
    assert {round(got[i]["threshold"], 4) for i in range(61)} == {round(half, 4)}


def test_few_values_give_a_wider_bound_that_narrows():
    assert bound(0.995, 3.0, 400, 1.0, 0.1) == 3.0 and bound(0.995, None, 1, 1.0, None) is None
    few, more, most = (math.log(bound(0.995, 0.0, n, 1.0, 0.1)) for n in (5, 20, 199))
    assert few > more > most and most == pytest.approx(1 + 0.1 * 2.60 * (1 + 1 / 199) ** 0.5, abs=1e-3)
