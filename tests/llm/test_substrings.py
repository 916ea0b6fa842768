import re
from collections import Counter

import pytest

from arborspark.llm.substrings import remove_repeats


def brute(texts, width):
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("width", "gram"), [(35, 18), (6, 3)])
def test_equal_to_brute_force(documents, prose, width, gram):
    shared = prose(50, 60)
    texts = [None, "", "  ", prose(1, 20), prose(2, 400), prose(3, 100) + " " + shared + " " + prose(4, 90), shared, prose(5, 34) + "\n\n" + shared + "\t" + prose(6, 10), prose(2, 400), "w " * 100, "a b c d e f g h " * 12]
    texts += [prose(s, 50) for s in range(60, 80)]
    texts.append(shared + " tail " + " ".join(shared.split()[:35]))
    want = brute(texts, width)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(documents(texts), width=width, gram=gram, chunk_bytes=2000).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_repeated_rows_null_ids_and_empty_tables(documents, prose):
    rows = remove_repeats(documents([prose(1, 50)] * 3 + [prose(2, 50)], ids=[4, 4, None, 5])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 50), (4, 50), (4, 50), (5, 0)]
    assert remove_repeats(documents([])).count() == 0


def test_a_saturated_sketch_loses_nothing(documents, prose, monkeypatch):
    from arborspark.llm import substrings

    monkeypatch.setattr(substrings, "MIN_BITS", 4)
    monkeypatch.setattr(substrings, "MAX_BITS", 4)
    texts = [prose(s % 7, 80) for s in range(20)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(documents(texts)).collect()}
    assert [got[i] for i in range(20)] == brute(texts, 35)
