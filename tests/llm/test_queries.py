"""Every registered training-data query over whole tables, against SQL or plain Python."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
from arborspark.llm import queries
from arborspark.llm.tokens import load

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "labels"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equal_to_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda found: sorted((tuple(r) for r in found), key=str)
    assert rows(got.select(*cols).collect()) == rows(want.select(", ".join(cols)).fetchall())


def test_language_ids(spark, con):
    langs = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = queries.op2_language_id(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_token_counts(spark, texts):
    tok = load(queries.tokenizer_path("word_bpe_49k.json"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op3_token_counts(spark, SF).collect()}
    for i, t in texts.items():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048)


def test_secrets(spark, texts):
    """Every assigned token of 40 hexadecimal digits is found; runs of digits alone are not."""
    for r in queries.op4_secret_scan(spark, SF).collect():
        text = texts[r["doc_id"]] or ""
        found = [text[s["start"] : s["end"]] for s in r["spans"]]
        assert set(re.findall(r'token = "([0-9a-f]{40})"', text)) <= set(found)
        assert not any(re.fullmatch(r"\d+", x) for x in found) and r["n_secrets"] == len(found)


def test_quality(spark, con):
    """Kept or not follows from perplexity and threshold; trusted texts have far lower perplexity than bad ones."""
    labels = {i: (q, t) for i, q, t in con.sql("SELECT doc_id, quality, toxic FROM labels").fetchall()}
    rows = queries.op5_quality(spark, SF).collect()
    assert all(r["keep"] == (r["perplexity"] is not None and r["perplexity"] <= r["threshold"]) for r in rows)
    assert all(r["trusted"] == (labels.get(r["doc_id"]) == (1, 0)) for r in rows)
    good = [r["keep"] for r in rows if r["trusted"]]
    bad = [r["keep"] for r in rows if labels.get(r["doc_id"], (1, 0))[0] == 0]
    assert sum(good) >= 0.97 * len(good) and (not bad or sum(bad) <= 0.4 * len(bad))


def test_lm_scores(spark, texts):
    words = {i: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    rows = queries.op8_lm_scores(spark, SF).collect()
    for r in rows:
        w = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_packing(spark, texts):
    tok = load(queries.tokenizer_path("byte_bpe_50k.json"))
    rows = queries.op9_packing(spark, SF).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        n, at = len(tok.encode(t or "", add_special_tokens=False).ids) + 1, 0
        for start, length, whole in sorted(docs[i]):
            assert (start, whole) == (at, n)
            at += length
        assert at == n
    for found in seqs.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    used = sum(r["length"] for r in rows)
    assert len(seqs) * 2048 <= 1.02 * used + 2 * 2048
