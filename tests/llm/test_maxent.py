import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from arborspark.llm import maxent
from arborspark.llm.maxent import lm_scores


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


@pytest.fixture(scope="module")
def case(documents, prose):
    other = lambda t: " ".join(w + "qu" for w in t.split())  # noqa: E731  a second language with words of its own
    texts = [None, "", "One  two\nTHREE"] + [other(prose(s, 150)) if s % 2 else prose(s, 150) for s in range(80)] + [prose(4, 150)]
    return texts, {r["doc_id"]: r for r in lm_scores(documents(texts), chunk_bytes=20_000).collect()}


def test_counts_and_base_are_exact(case):
    texts, got = case
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    count = Counter(t for text, h in zip(texts, held, strict=True) if not h for t in tokens(text))
    n, v = sum(count.values()), len(count)
    for i, text in enumerate(texts):
        t = tokens(text)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(count[x] > 0 for x in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t), abs=1e-6)


def test_the_model_beats_the_base_on_held_out_text(case):
    _, got = case
    held = [r for r in got.values() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got.values())



def test_empty_and_untrained(documents, spark):
    assert lm_scores(documents([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_scores(documents(["a b"], ids=[held])).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_every_training_token_gives_a_gradient_in_every_round(case):
    texts, got = case
    raw = [(t or "").encode() for t in texts]
    held = np.array([zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(raw))])
    t = maxent.split(raw)
    on = ~held[t.doc]
    key, first, count = np.unique(t.hash[on], return_index=True, return_counts=True)
    word = key != t.hash[t.end[0]]
    top = sorted(zip(-count[word], key[word].view(np.int64).tolist(), strict=True))[: maxent.TOP]
    cls = maxent.Classes([k % 2**64 for _, k in top])(t.hash, t.cell)
    want = np.zeros(len(cls))
    for (rows, outcome, of), (train, seen_outcome, _) in zip(t.rows(np.ones(len(cls), bool), cls), t.rows(on, cls), strict=True):
        seen = np.zeros((maxent.TEMPLATES, maxent.ROWS, maxent.CLASSES))
        for k, r in enumerate(train):
            np.add.at(seen[k], (r, seen_outcome), 1)
        prior = (seen[0].sum(0) + 1) / (seen[0].sum() + maxent.CLASSES)
        each, pull = seen.sum(2, keepdims=True), maxent.prior_strength(seen, prior)
        weights = maxent.START * (np.log((seen + pull * prior) / (each + pull)) - np.log(prior))

        def chances(weights, rows, prior=prior):
            z = np.log(prior) + sum(weights[k][r] for k, r in enumerate(rows))
            return z - np.log(np.exp(z).sum(1, keepdims=True))

        for _ in range(2):
            p, sums = np.exp(chances(weights, train)), np.zeros_like(seen)
            for k, r in enumerate(train):
                np.add.at(sums[k], r, p)
            weights = weights + maxent.RATE * (seen - sums) / (each + pull) / np.sqrt(prior * (1 - prior) + 1e-4)
        want[of] += chances(weights, rows)[np.arange(len(of)), outcome] / math.log(10)
    number, rare = Counter(t.hash[on].tolist()), cls > maxent.TOP
    total, words = Counter(t.cell[on & rare].tolist()), Counter(t.cell[on][first][cls[on][first] > maxent.TOP].tolist())
    want += [math.log10((number[h] + 1) / (total[c] + words[c] + 1)) if r else 0 for h, c, r in zip(t.hash.tolist(), t.cell.tolist(), rare.tolist(), strict=True)]
    assert [got[i]["score"] for i in range(len(raw))] == pytest.approx(np.bincount(t.doc, weights=want).tolist(), rel=1e-3)


def test_chances_sum_to_one():
    """Over all classes and, in each, all parts, whatever the weights."""
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(maxent.TEMPLATES, maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    rows = [np.full(maxent.CLASSES, r) for r in rng.integers(0, maxent.ROWS, maxent.TEMPLATES)]
    assert np.exp(maxent.log_chances(weights, rows, np.arange(maxent.CLASSES))).sum() == pytest.approx(1, rel=1e-5)
