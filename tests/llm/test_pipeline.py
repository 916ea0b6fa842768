import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from arborspark.llm.queries import tokenizer_path
from arborspark.llm.tokens import load
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as linked

SECRET = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


@pytest.fixture(scope="module")
def corpus(spark, documents, prose, tmp_path_factory):
    items = [(1, prose(100, 30)), (2, prose(101, 12))]
    near = prose(7, 200).split()
    texts = [prose(s, 120) for s in range(12)] + [None, "", "1234 !!", prose(3, 120), " ".join([*near[:50], "changed", *near[51:]]), " ".join(near), prose(50, 40) + " " + items[0][1] + " " + prose(51, 40), f'{prose(52, 60)} token = "{SECRET}" {prose(53, 60)}', prose(54, 9000)]
    sf = str(tmp_path_factory.mktemp("sf"))
    documents(texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, texts, items


def test_every_stage_and_the_whole(spark, corpus, tmp_path):
    sf, texts, items = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = docs
        if name != "packing":
            assert docs.columns == before
    text = {k: {r["doc_id"]: r["text"] for r in d.collect()} for k, d in steps.items() if k != "packing"}
    assert text["language"] == {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    ids = sorted(text["language"])
    groups = linked([text["language"][i] for i in ids])
    assert text["near_duplicates"] == {ids[k]: text["language"][ids[k]] for k, (g, _) in enumerate(groups) if g == k}
    after = text["decontamination"]
    for i, t in text["near_duplicates"].items():
        hit = contaminated([t], items)[0][1]
        assert (after[i] == t) == (hit == 0) and contaminated([after[i]], items)[0][1] == 0
    assert text["secrets"] == {i: t.replace(SECRET, "[secret]") for i, t in after.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in steps["secrets"].collect())

    tok, by_doc = load(tokenizer_path("byte_bpe_50k.json")), defaultdict(dict)
    for r in steps["packing"].collect():
        by_doc[r["doc_id"]][r["start"]] = r
    assert sorted(by_doc) == sorted(text["secrets"])
    for i, t in text["secrets"].items():
        want = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert sum(r["length"] for r in by_doc[i].values()) == len(want)
        assert all(r["ids_crc32"] == zlib.crc32(want[s : s + r["length"]].tobytes()) for s, r in by_doc[i].items())

    key = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in rows)
    assert key(corpus_pipeline.run(spark, sf).collect()) == key(steps["packing"].collect())
