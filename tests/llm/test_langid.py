import random

import numpy as np
import pytest

from arborspark.llm.langid import Model, fit, identify, ngram_counts

SYLLABLES = {"aa": ["ba", "na", "ra", "ta"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["ción", "ñe", "os", "que"]}


def sentence(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model(documents):
    rows = [(sentence(lang, s, 5 + s), lang) for lang in SYLLABLES for s in range(60)]
    return fit(documents([r[0] for r in rows] + [None, "x"], langs=[r[1] for r in rows] + ["aa", None]), per_language=40)


def test_held_out_accuracy_and_rejection(documents, model):
    rows = [(sentence(lang, s, 4 + s % 50), lang) for lang in SYLLABLES for s in range(1000, 1060)]
    texts = [r[0] for r in rows] + [None, "", "123 !!", "½ ² Ⅷ", "日本語"]
    got = {r["doc_id"]: r for r in identify(documents(texts), model, keep=("doc_id",)).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, (_, lang) in enumerate(rows)]) > 0.98
    assert not any(got[i]["rejected"] for i in range(len(rows)))
    for i in range(len(rows), len(rows) + 4):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[len(rows) + 4]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_never_learned_are_rejected(documents):
    """Radii come from languages compared with each other's centroids, and hold for those that were never learned."""
    rng = random.Random(9)
    made = [["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 2))) for _ in range(14)] for _ in range(9)]
    text = lambda words: " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(40, 80)))
    rows = [(text(w), f"l{i}") for i, w in enumerate(made[:6]) for _ in range(60)]
    model = fit(documents([r[0] for r in rows], langs=[r[1] for r in rows]))
    known = identify(documents([text(w) for w in made[:6] for _ in range(20)]), model, keep=("doc_id",)).collect()
    foreign = identify(documents([text(w) for w in made[6:] for _ in range(40)]), model, keep=("doc_id",)).collect()
    assert not any(r["rejected"] for r in known) and model.rejected == 0
    assert np.mean([r["rejected"] for r in foreign]) > 0.8 and model.accepted < 0.1


def test_the_sample_is_bounded_by_distinct_texts(documents):
    """A text repeated often is one row of the sample, and takes no other text's place."""
    texts = [sentence("aa", 1, 20)] * 500 + [sentence("aa", s, 20) for s in range(2, 30)] + [sentence("bb", s, 20) for s in range(30)]
    seen = []
    real = Model.__init__
    Model.__init__ = lambda self, rows, **k: (seen.append({x: len(r) for x, r in rows.items()}), real(self, rows, **k))[1]
    try:
        fit(documents(texts, langs=["aa"] * 528 + ["bb"] * 30), per_language=25)
    finally:
        Model.__init__ = real
    assert seen == [{"aa": 25, "bb": 25}]
    with pytest.raises(ValueError, match="languages"):
        fit(documents(texts, langs=["aa"] * 528 + ["bb"] * 30), max_languages=1)


def test_counts_do_not_cross_texts_or_depend_on_neighbours():
    together, n = ngram_counts(["abc def", "", "Éa!"])
    for i, t in enumerate(["abc def", "", "Éa!"]):
        alone, k = ngram_counts([t])
        assert (together[i] == alone[0]).all() and n[i] == k[0]


def test_long_texts_are_counted_in_parts(monkeypatch):
    from arborspark.llm import langid

    text = sentence("cc", 1, 500)
    whole, _ = ngram_counts([text, "abc"])
    monkeypatch.setattr(langid, "SLICE_BYTES", 100)
    parts, _ = ngram_counts([text, "abc"])
    assert (whole == parts).all()


def test_empty_tables(documents, model):
    assert identify(documents([]), model).count() == 0
    empty = fit(documents([]))
    assert isinstance(empty, Model)
    assert [r["lang_pred"] for r in identify(documents(["text"]), empty).collect()] == ["und"]
    assert identify(documents(["a b"]), model).columns[:-3] == documents([]).columns
