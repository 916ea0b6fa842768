import hashlib
import re

import numpy as np
import pytest

from arborspark.llm.decontaminate import FMIndex, blocks, contamination, cut_words, decontaminate, digest, merge, phrases, words


@pytest.mark.parametrize("seed", range(25))
def test_fm_index_finds_every_occurrence(seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(0, 4, int(rng.integers(1, 200)))
    if len(seq) > 60:
        seq[30:60] = seq[:30]
    index = FMIndex(seq, 9)
    patterns = [rng.integers(1, 4 if rng.random() < 0.8 else 9, int(rng.integers(1, 5))) for _ in range(8)]
    lengths = np.array([len(p) for p in patterns])
    padded = np.zeros((8, lengths.max()), np.int64)
    for i, p in enumerate(patterns):
        padded[i, : len(p)] = p
    low, high = index.search(padded, lengths)
    for i, p in enumerate(patterns):
        want = [k for k in range(len(seq) - len(p) + 1) if (seq[k : k + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(low[i], max(low[i], high[i]))).tolist()) == want


def brute(texts, items):
    found = {}
    for i, t in enumerate(texts):
        w = words((t or "").encode())
        hit, owners = [False] * len(w), set()
        for item, text in items:
            for p in set(phrases((text or "").encode())):
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        hit[k : k + len(p)] = [True] * len(p)
                        owners.add(str(item))
        found[i] = (len(w), sum(hit), sorted(owners))
    return found


@pytest.fixture
def case(spark, prose):
    items = [(1, prose(100, 30)), (2, prose(101, 12)), (3, "Short one here"), (4, ""), (5, None), (6, prose(100, 30))]
    texts = [None, "", prose(1, 200), prose(2, 50) + " " + items[0][1].upper() + "! " + prose(3, 20), items[1][1], "a short-one (HERE) indeed", items[0][1] + " " + items[0][1], prose(1, 200), items[0][1][:60] + " x " + items[1][1]]
    return texts, items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_counts_equal_brute_force(case, documents, block_bytes):
    texts, items, bench = case
    want = brute(texts, items)
    for r in contamination(documents(texts), bench, block_bytes=block_bytes).collect():
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), list(r["items"])) == want[r["doc_id"]]


def test_digest_and_empty_tables(case, documents, spark):
    texts, items, bench = case
    rows = {r["doc_id"]: r for r in digest(contamination(documents(texts), bench)).collect()}
    assert rows[3]["contaminated"] and not rows[0]["contaminated"] and len(rows[0]["items_sha256"]) == 64
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(documents([]), bench).count() == 0
    assert {r["n_hit"] for r in digest(contamination(documents(texts), none)).collect()} == {0}


def test_items_without_an_id_and_very_long_texts(documents, spark, prose):
    item = prose(500, 12)
    bench = spark.createDataFrame([(None, item), (3, item)], "item_id long, text string")
    long = prose(501, 150_000) + " " + item + " " + prose(502, 150_000)
    rows = {r["doc_id"]: r for r in digest(contamination(documents([long, item, "x"]), bench)).collect()}
    assert [(rows[i]["n_words"], rows[i]["n_hit"], rows[i]["n_items"]) for i in range(3)] == [(300_012, 12, 2), (12, 12, 2), (1, 0, 0)]
    assert rows[0]["items_sha256"] == hashlib.sha256(b",3").hexdigest() and rows[2]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    cut = {r["doc_id"]: r["text"] for r in decontaminate(documents([long, item, "x"]), bench).collect()}
    assert len(words(cut[0].encode())) == 300_000 and cut[1] == "" and cut[2] == "x"


def test_removal_leaves_clean_documents_alone(case, documents):
    texts, items, bench = case
    out = {r["doc_id"]: r for r in decontaminate(documents(texts), bench).collect()}
    want = brute(texts, items)
    for i, t in enumerate(texts):
        if not want[i][1]:
            assert out[i]["text"] == t
        else:
            assert len(words(out[i]["text"].encode())) == want[i][0] - want[i][1]
    assert out[0].asDict().keys() == documents([]).first() or set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "id", "chunk", "n"}


def test_spans():
    assert merge([(5, 9), (0, 3), (2, 4)]) == [(0, 4), (5, 9)]
    assert cut_words(b"One, two; three four", [(1, 3)]) == b"One,  four" or re.split(rb"\W+", cut_words(b"One, two; three four", [(1, 3)])) == [b"One", b"four"]


def test_blocks_are_judged_on_the_uncut_text(spark, documents, monkeypatch):
    w = [f"word{k}x" for k in range(40)]
    items = [(1, " ".join(w[0:11])), (2, " ".join(w[5:16])), (3, " ".join(w[20:24] + w[32:36]))]
    texts = [" ".join(w[:20]), " ".join(w[20:24] + w[0:11] + w[32:36]), None, "clean", " ".join(w[:20])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len([*blocks(bench, "item_id", "text", 60)]) == 3
    monkeypatch.setattr("arborspark.llm.decontaminate.blocks", lambda *a: blocks(*a[:3], 60))
    out = {r["doc_id"]: r["text"] for r in decontaminate(documents(texts), bench).collect()}
    left = [(out[i] or "").split() for i in range(5)]
    assert left == [w[16:20], w[20:24] + w[32:36], [], ["clean"], w[16:20]] and out[2] is None


def test_several_blocks_give_each_repeated_id_its_row(spark, documents):
    w = [f"word{k}x" for k in range(20)]
    bench = spark.createDataFrame([(1, " ".join(w[0:11])), (2, " ".join(w[5:16]))], "item_id long, text string")
    rows = contamination(documents([" ".join(w), "clean", " ".join(w)], ids=[7, 7, None]), bench, block_bytes=60).collect()
    got = [(r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in rows]
    assert sorted(got, key=str) == sorted([(7, 20, [(0, 16)], ["1", "2"]), (7, 1, [], []), (None, 20, [(0, 16)], ["1", "2"])], key=str)
