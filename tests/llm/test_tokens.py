import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")
import public_tokenizers

from arborspark.llm.tokens import load, spliced_ids, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_counts_equal_the_library(spark, documents, prose):
    texts = [None, "", " ", "Hello world", prose(1, 40_000), "x" * 70_000, "a <|endoftext|> b", "é" * 10 + " ñandú", prose(1, 30), prose(1, 30)]
    got = {r["doc_id"]: r for r in token_counts(documents(texts), PATH).collect()}
    tok = load(PATH)
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)
    assert token_counts(documents([]), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abz é'1<|>endoftx.\n", min_size=0, max_size=40), max_size=12), st.integers(8, 40), st.integers(1, 12))
def test_splicing_is_exact(parts, chunk, overlap):
    text = " ".join(parts)
    tok = load(PATH)
    assert spliced_ids(tok, text, chunk, overlap).tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_splicing_of_prose(name, prose):
    tok = load(public_tokenizers.path(name))
    text = prose(5, 3000) + "z" * 900 + prose(6, 500)
    assert spliced_ids(tok, text, 512, 32).tolist() == tok.encode(text, add_special_tokens=False).ids
