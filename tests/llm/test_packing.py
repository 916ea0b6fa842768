import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers

from arborspark.llm.packing import LENGTH, cuts, encode_ids, pack, solve
from arborspark.llm.tokens import load

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_both_libraries_agree_on_plain_characters():
    for low in range(0, 0x250, 16):
        for sep in ("", " ", "a", "1"):
            text = sep.join(chr(c) for c in range(low, min(low + 16, 0x250)))
            assert encode_ids(text, JSON, RANKS).tolist() == load(JSON).encode(text, add_special_tokens=False).ids


def test_patterns_hold_every_piece_exactly_once():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 3000):
        need = np.zeros(LENGTH, np.int64)
        for x in rng.integers(1, 5000, n):
            for _, k in cuts(int(x)):
                if k < LENGTH:
                    need[k] += 1
        sizes = np.flatnonzero(need)
        plan = solve(sizes, need[sizes])
        assert (sum(p * u for p, u in plan) == need[sizes]).all()
        assert all((p * sizes).sum() <= LENGTH for p, _ in plan)
        least = -(-int((sizes * need[sizes]).sum()) // LENGTH)
        assert sum(u for _, u in plan) <= least + 2 + least // 200


def test_many_equal_lengths():
    """Large groups of equal documents, whose patterns tie."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        need = np.zeros(LENGTH, np.int64)
        for n in rng.integers(1, 1500, int(rng.integers(1, 40))):
            for _, k in cuts(int(n)):
                need[k] += int(rng.choice([1, 16, 1000, 2048]))
        sizes = np.flatnonzero(need)
        plan = solve(sizes, need[sizes], max_rounds=60)
        assert (sum(p * u for p, u in plan) == need[sizes]).all() and all((p * sizes).sum() <= LENGTH for p, _ in plan)


def test_a_singular_exchange_is_taken_back(monkeypatch):
    calls, real = [], np.linalg.solve

    def solve_once(a, b):
        calls.append(1)
        if len(calls) == 4:
            raise np.linalg.LinAlgError("Singular matrix")
        return real(a, b)

    monkeypatch.setattr(np.linalg, "solve", solve_once)
    sizes, need = np.array([700, 600, 500, 300]), np.array([10, 10, 10, 10])
    assert (sum(p * u for p, u in solve(sizes, need)) == need).all()


def test_no_piece_is_a_sliver_of_its_document():
    for n in range(1, 5000):
        got = cuts(n)
        assert [a for a, _ in got] == [sum(k for _, k in got[:i]) for i in range(len(got))] and sum(k for _, k in got) == n
        assert all(k >= 64 for _, k in got[:-1]) and (got[-1][1] >= 64 or len(got) == 1 or n % LENGTH < 64)


def test_a_difference_between_the_libraries_is_an_error(monkeypatch):
    from arborspark.llm import packing

    monkeypatch.setattr(packing, "CHECKED", 1)
    assert len(encode_ids("plain text", JSON, RANKS))
    monkeypatch.setattr(packing, "load", lambda path: load(public_tokenizers.path("word_bpe_49k.json")))
    with pytest.raises(ValueError, match="different ids"):
        encode_ids("plain text", JSON, RANKS)


def test_every_id_lies_in_one_gapless_place(spark, documents, prose):
    texts = [None, "", "hi", prose(1, 10_000), prose(2, 700), prose(2, 700), "say <|endoftext|> now", "日本語 テキスト", *(prose(s, 30 * s) for s in range(3, 30))]
    rows = pack(documents(texts), JSON, RANKS).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*load(JSON).encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    used = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= LENGTH
        used += at
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert len(by_seq) <= -(-used // LENGTH) + 1
    assert pack(documents([]), JSON, RANKS).count() == 0


def test_repeated_rows_are_packed_each(spark, documents):
    rows = pack(documents(["same text"] * 5, ids=[7] * 5), JSON, RANKS).collect()
    assert len(rows) == sum(len(cuts(r)) for r in [rows[0]["doc_tokens"]] * 5)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
